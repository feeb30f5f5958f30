"""Rescue-column ingestion of files whose fields drift, and the report of every change.

For the report, the target schema of a file is that of the file before it. Each file is enforced against it: known, castable
fields go through; unknown and uncastable ones are rescued as JSON. What is in the rescue column says what changed: a rescued
field whose values are those of a target field that is gone is its new name, other unknown fields are additions, known ones
are retyped. For the table, the target of a group holds the fields of its first file and every field that was added since;
rescued values of renamed fields are replayed into the typed column of their first name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tausift.operators.order import WINDOW_ROWS, ordinal
from tausift.runtime import cut
from tausift.sources.exports import Export, is_missing, kind_of, leading_number, parse_export, same_value

#: Share of the values in both files that must agree for a field to count as renamed.
SAME_SHARE = 0.5


def previous_row(df: DataFrame, group: str, order: str, item: str, most: int = WINDOW_ROWS) -> DataFrame:
    """(item, previous item) along `order` within each group; the first of a group is left out.

    Groups may be of any size: rows are numbered by `ordinal`, which spreads groups of more than `most` rows, and each joins
    the row numbered one less. Ties in `order` go by item. Rows with a null group or item are left out; a null order comes
    first.
    """
    named = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(item).alias("i")).dropna(subset=["g", "i"]).distinct()
    placed = cut(ordinal(named, ["g"], [F.col("o").asc_nulls_first(), F.col("i")], "n", most).select("g", "n", "i"))
    before = placed.select("g", (F.col("n") + 1).alias("n"), F.col("i").alias("previous"))
    return placed.join(before, ["g", "n"]).select(F.col("i").alias(item), "previous")


def key_fields(old: Export, new: Export) -> tuple[str, str] | None:
    """The fields that name the models in either file: the pair of text fields with the most values in common."""
    best: tuple[int, str, str] | None = None
    values = [{f: {r[f].lower() for r in e.rows if not is_missing(r.get(f))} for f in e.fields if kind_of([r.get(f) for r in e.rows]) == "text"} for e in (old, new)]
    for a, x in values[0].items():
        for b, y in values[1].items():
            common = len(x & y)
            if common and (best is None or (common, a == b) > (best[0], best[1] == best[2])):
                best = (common, a, b)
    return best[1:] if best else None


def enforce(export: Export, target: dict[str, str | None]) -> list[tuple[dict[str, str], str]]:
    """Each row as (fields that fit the target, JSON of all others). target: field to `number`, `text` or None (any)."""
    out = []
    for row in export.rows:
        fits, rescued = {}, {}
        for field, cell in row.items():
            castable = field in target and (is_missing(cell) or target[field] != "number" or kind_of([cell]) == "number")
            (fits if castable else rescued)[field] = cell
        out.append((fits, json.dumps(rescued, ensure_ascii=False) if rescued else "{}"))
    return out


def changes_between(old: Export, new: Export) -> list[tuple[str, str, str]]:
    """(kind, old field, new field) of every change from one file to the next; see `schema_changes`."""
    kinds_old = {f: kind_of([r.get(f) for r in old.rows]) for f in old.fields}
    enforced = [(fits, json.loads(rest)) for fits, rest in enforce(new, kinds_old)]
    kinds_new = {f: kind_of([fits.get(f, rest.get(f)) for fits, rest in enforced]) for f in new.fields}
    in_rescue = {f for _, rest in enforced for f in rest}
    # fields without cells are known by the header alone
    unknown = [f for f in new.fields if f not in kinds_old and (f in in_rescue or not any(f in fits for fits, _ in enforced))]
    gone = [f for f in old.fields if f not in kinds_new]
    keys = key_fields(old, new)
    renamed: dict[str, str] = {}
    if keys:
        rows_old = {r[keys[0]].lower(): r for r in old.rows if not is_missing(r.get(keys[0]))}
        scored = []
        for field in unknown:
            rescued = {raw[keys[1]].lower(): rest.get(field) for raw, (_, rest) in zip(new.rows, enforced, strict=True) if not is_missing(raw.get(keys[1]))}
            for target in gone:
                pairs = [(rows_old[m].get(target), cell) for m, cell in rescued.items() if m in rows_old]
                pairs = [(a, b) for a, b in pairs if not is_missing(a) and not is_missing(b)]
                agree = sum(same_value(a, b) for a, b in pairs)
                if pairs and agree > SAME_SHARE * len(pairs):
                    scored.append((agree / len(pairs), agree, target, field))
        for _, _, target, field in sorted(scored, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if target not in renamed and field not in renamed.values():
                renamed[target] = field
    out = [("renamed", a, b) for a, b in renamed.items()]
    out += [("removed", f, "") for f in gone if f not in renamed]
    out += [("added", "", f) for f in unknown if f not in renamed.values()]
    for a in old.fields:
        b = renamed.get(a, a)
        # numbers turned text are rescued, under their name or as a renamed field; text turned number fits, and is seen there
        uncastable = kinds_old[a] == "number" and b in in_rescue and kinds_new.get(b) == "text"
        narrowed = kinds_old[a] == "text" and kinds_new.get(b) == "number"
        if uncastable or narrowed:
            out.append(("retyped", a, b))
    return out


def schema_changes(files: DataFrame, file: str = "file_id", group: str = "board", order: str = "exported_at", payload: str = "payload") -> DataFrame:
    """(file, change_kind, old_field, new_field): what changed in each file against the one before it in its group.

    renamed: the old name is gone, a new one has come, and of the models in both files more than half of the values both
    have agree, however written. added and removed: all other names that come or go. retyped: a field of both files,
    renamed or not, whose values change between number and text; a field without values has no type. Names compare
    exactly. Files with a null group or id are left out, a null payload is a file without fields, repeated files count
    once, an empty table gives an empty result; other columns are ignored.
    """
    own = files.select(F.col(file).alias("__f"), F.col(payload).alias("__new"))
    pairs = previous_row(files, group, order, file).select(F.col(file).alias("__f"), "previous")
    both = pairs.join(own, "__f").join(own.select(F.col("__f").alias("previous"), F.col("__new").alias("__old")), "previous").select("__f", "__old", "__new")
    kind = files.schema[file].dataType.simpleString()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *c) for f, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in changes_between(parse_export(a), parse_export(b))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.string()) for c in columns[1:])], names=["__f", "change_kind", "old_field", "new_field"])

    changes = both.mapInArrow(compare, f"__f {kind}, change_kind string, old_field string, new_field string").distinct()
    return changes.withColumnRenamed("__f", file)


def ingest_rescued(files: DataFrame, target: DataFrame, file: str = "file_id", group: str = "board", order: str = "exported_at", payload: str = "payload") -> DataFrame:
    """(file, group, order, row_no, model, model_field, fits MAP, rescued JSON): every line of every file under a target schema.

    target: (group, fields MAP of field to `number` or `text`), one row per group. Fields outside the target and cells that
    aren't of its type are in rescued, so no cell is lost. model is the first text field of the file, model_field its name. A
    group without a target rescues everything.
    """
    rows = files.select(F.col(file).alias("f"), F.col(group).alias("g"), F.col(order).alias("o"), F.col(payload).alias("x")).join(target.select(F.col("group").alias("g"), "fields"), "g", "left").select("f", "g", "o", "x", "fields")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in "fgo"}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, g, o, text, fields in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                export, known = parse_export(text), dict(fields or ())
                name = next((n for n in export.fields if kind_of([r.get(n) for r in export.rows]) == "text" and not _numeric(export, n)), None)
                for k, (raw, (fits, rescued)) in enumerate(zip(export.rows, enforce(export, known), strict=True)):
                    out.append((f, g, o, k + 1, raw.get(name), name, list(fits.items()), rescued))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [batch.schema.field(0).type, batch.schema.field(1).type, batch.schema.field(2).type, pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["f", "g", "o", "row_no", "model", "model_field", "fits", "rescued"])

    read_rows = rows.mapInArrow(read, f"f {kinds['f']}, g {kinds['g']}, o {kinds['o']}, row_no int, model string, model_field string, fits map<string,string>, rescued string")
    return read_rows.withColumnsRenamed({"f": file, "g": group, "o": order})


def _numeric(export: Export, field: str) -> bool:
    """Whether most cells of a text field hold a number that is written with something around it."""
    there = [r[field] for r in export.rows if not is_missing(r.get(field))]
    return sum(leading_number(c) is not None for c in there) > len(there) / 2


def field_profiles(files: DataFrame, file: str = "file_id", group: str = "board", order: str = "exported_at", payload: str = "payload") -> DataFrame:
    """(f, g, o, field, place, kind): every field of every file with its place in the header and the type of its values."""
    slim = files.select(F.col(file).alias("f"), F.col(group).alias("g"), F.col(order).alias("o"), F.col(payload).alias("x")).dropna(subset=["g"])

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(3).to_pylist()):
                export = parse_export(text)
                rows += [(k, f, place, kind_of([r.get(f) for r in export.rows])) for place, f in enumerate(export.fields)]
            at, fields, places, types = zip(*rows, strict=True) if rows else [()] * 4
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(fields, pa.string()), pa.array(places, pa.int32()), pa.array(types, pa.string())], names=["f", "g", "o", "field", "place", "kind"])

    kinds = {c: slim.schema[c].dataType.simpleString() for c in "fgo"}
    return slim.mapInArrow(profile, f"f {kinds['f']}, g {kinds['g']}, o {kinds['o']}, field string, place int, kind string")


def approved_schemas(profiles: DataFrame, changes: DataFrame, file: str = "file_id") -> DataFrame:
    """(group, fields MAP): the fields of each group's first file, and those that were added since, with the type of their
    first values (`number` for a field that never has any). New names of old fields are no fields of their own."""
    firsts = profiles.groupBy("g").agg(F.min(F.struct("o", "f")).getField("f").alias("first"))
    added = changes.filter("change_kind = 'added'").select(F.col(file).alias("f"), F.col("new_field").alias("field")).distinct()
    approved = profiles.join(added, ["f", "field"], "left_semi").select("g", "field").union(profiles.join(firsts, "g").filter(F.col("f") == F.col("first")).select("g", "field")).distinct()
    typed = profiles.join(approved, ["g", "field"], "left_semi").groupBy("g", "field").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct("o", "f"))).alias("kind"))
    return typed.groupBy(F.col("g").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("kind", F.lit("number"))))).alias("fields"))


def first_names(changes: DataFrame, profiles: DataFrame, file: str = "file_id", group: str = "board") -> DataFrame:
    """(group, field, first_field): for every field that was ever renamed, the one among all its names that came first.

    Names that are linked by renames, over any number of files, get one label: labels spread along the renames, twice as
    far each round, until none changes. Each round is written to the shared folder.
    """
    known = profiles.groupBy("g", "field").agg(F.min(F.struct("o", "f", "place")).alias("since"))
    of_file = profiles.select(F.col("f").alias(file), "g").distinct()
    edges = changes.filter("change_kind = 'renamed'").join(of_file, file).select("g", F.col("old_field").alias("a"), F.col("new_field").alias("b"))
    links = cut(edges.union(edges.select("g", "b", "a")).distinct())
    labels = links.select("g", F.col("a").alias("field")).distinct().join(known, ["g", "field"], "left").select("g", "field", F.struct("since", F.col("field").alias("name")).alias("label"))
    while True:
        near = links.join(labels.select("g", F.col("field").alias("b"), "label"), ["g", "b"]).select("g", F.col("a").alias("field"), "label")
        least = labels.union(near).groupBy("g", "field").agg(F.min("label").alias("label"))
        jumped = least.withColumn("name", F.col("label.name")).join(least.select("g", F.col("field").alias("name"), F.col("label").alias("further")), ["g", "name"], "left")
        step = cut(jumped.select("g", "field", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = step.exceptAll(labels).limit(1).count()
        labels = step
        if not moved:
            return labels.select(F.col("g").alias(group), "field", F.col("label.name").alias("first_field"))


def consistent_scores(files: DataFrame, file: str = "file_id", group: str = "board", order: str = "exported_at", payload: str = "payload") -> DataFrame:
    """(file, group, order, row_no, model, field, written_field, score, text, rescued): all cells of all files in one table.

    Fits go in as they are; rescued cells are replayed: their field gets its first name if it was renamed, and their
    number is taken however it is written. text is the cell where it holds no number, rescued the cell as written where it
    didn't fit. The field that names the models is the column model. Cells that stand for no value give no row; no other cell
    is lost.
    """
    changes = cut(schema_changes(files, file, group, order, payload))
    profiles = cut(field_profiles(files, file, group, order, payload))
    rows = ingest_rescued(files, approved_schemas(profiles, changes, file), file, group, order, payload)
    cells = rows.select(file, group, order, "row_no", "model", "model_field", F.explode(F.map_concat(F.transform_keys("fits", lambda k, v: F.concat(F.lit("="), k)), F.transform_keys(F.from_json("rescued", "map<string,string>"), lambda k, v: F.concat(F.lit("?"), k)))).alias("k", "cell"))
    cells = cells.withColumns({"written_field": F.substring("k", 2, 1 << 20), "was_rescued": F.col("k").startswith("?")})
    cells = cells.filter(~F.lower(F.trim("cell")).isin("", "n/a", "--", "—", "nan") & ~F.col("written_field").eqNullSafe(F.col("model_field")))
    names = first_names(changes, profiles, file, group)
    named = cells.join(names.withColumnRenamed("field", "written_field"), [group, "written_field"], "left")
    number = F.regexp_replace(F.regexp_extract("cell", r"^[^\p{L}\d]*?([-+−]?\d+(?:[.,]\d+)?)", 1), ",", ".")
    score = F.nullif(number, F.lit("")).try_cast("double")
    return named.select(
        file, group, order, "row_no", "model", F.coalesce("first_field", "written_field").alias("field"), "written_field", score.alias("score"),
        F.when(score.isNull(), F.col("cell")).alias("text"), F.when(F.col("was_rescued"), F.col("cell")).alias("rescued"),
    )
