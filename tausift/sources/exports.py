"""Reading delimited score exports whose delimiter, quoting, line ends, names and number formats vary from file to file."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

#: Cells that stand for no value, compared in lower case.
MISSING = frozenset({"", "n/a", "--", "—", "nan"})
DELIMITERS = (",", ";", "\t")
_BLANK = "﻿​  \t\r\n"
_PLAIN = re.compile(r"\d+\.?\d*|\.\d+")
_NUMBER = re.compile(r"[-+−]?\d+(?:[.,]\d+)?|[-+−]?[.,]\d+")
_INDEX = re.compile(r"unnamed(?::\s*\d+)?", re.IGNORECASE)


@dataclass(frozen=True)
class Export:
    """fields: the names of the named columns in order. rows: one dict per line, field to cell; cells keep their text."""

    fields: tuple[str, ...]
    rows: tuple[dict[str, str], ...]


def field_name(cell: str) -> str:
    """A header cell without byte-order mark, surrounding blanks and quotes."""
    name = cell.strip(_BLANK)
    while len(name) > 1 and name[0] == name[-1] and name[0] in "\"'":
        name = name[1:-1].strip(_BLANK)
    return name


def parse_export(payload: str | None) -> Export:
    """The fields and rows of one file.

    The delimiter is the one that parts the header into the most cells. The unnamed column is no field; of two columns
    with the same name the first counts. Cells beyond the header are kept under the names `+1`, `+2` and so on; short
    lines lack cells. A null or blank file has no fields and no rows.
    """
    text = (payload or "").lstrip(_BLANK[:1])
    if not text.strip(_BLANK):
        return Export((), ())
    head = re.split(r"\r\n|\r|\n", text.lstrip("\r\n"), maxsplit=1)[0]
    delimiter = max(DELIMITERS, key=lambda d: len(next(csv.reader([head], delimiter=d))))
    lines = [line for line in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, skipinitialspace=True) if any(c.strip(_BLANK) for c in line)]
    names = [field_name(c) for c in lines[0]]
    fields = tuple(dict.fromkeys(n for n in names if n))
    rows = []
    for line in lines[1:]:
        row: dict[str, str] = {}
        for k, cell in enumerate(line):
            name = names[k] if k < len(names) else f"+{k + 1 - len(names)}"
            if name and name not in row:
                row[name] = field_name(cell)
        rows.append(row)
    return Export(fields, tuple(rows))


def is_missing(cell: str | None) -> bool:
    return cell is None or cell.strip(_BLANK).lower() in MISSING


def kind_of(cells: list[str | None]) -> str | None:
    """`number` if every value is digits, at most with a decimal point, else `text`; None if all are missing."""
    there = [c.strip(_BLANK) for c in cells if not is_missing(c)]
    return None if not there else "number" if all(_PLAIN.fullmatch(c) for c in there) else "text"


def leading_number(cell: str | None) -> tuple[float, int] | None:
    """The number a cell holds however it is written (`~70.68`, `70,68`, `70.68 ± 0.4`, `70.68%`, `70.68 (dev)`), and its decimals.

    None if there is none, or if words come before it.
    """
    if is_missing(cell):
        return None
    text = cell.strip(_BLANK)
    found = _NUMBER.search(text)
    if not found or any(c.isalpha() for c in text[: found.start()]):
        return None
    digits = found.group().replace(",", ".").replace("−", "-")
    return float(digits), len(digits.partition(".")[2])


def same_value(a: str, b: str) -> bool:
    """Whether two cells state one value: equal numbers at the coarser precision, or equal text but for case and blanks."""
    x, y = leading_number(a), leading_number(b)
    if x and y:
        return abs(x[0] - y[0]) <= 0.5001 * 10.0 ** -min(x[1], y[1]) + 1e-9
    return x is None and y is None and " ".join(a.lower().split()) == " ".join(b.lower().split())
