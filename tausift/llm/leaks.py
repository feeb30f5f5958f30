"""Evaluation items that stand inside training documents.

Items and documents become templates: words that items share or write in lower case stay, numbers, units and names turn into
typed placeholders. Windows of five template tokens are hash-joined: by their template, whatever number of items has it, or
with their values if they hold too few template words. Windows that follow each other in both texts make stretches. An item
counts as leaked if a stretch holds enough of its own text and its
slots hold the item's own values, or other values in the same places throughout: a question with new parameters.

Documents are read once, whatever the number of items: a filter of bounded size says which windows some item has, only these
are written, and they meet the items' windows in one shuffle join. No item comes to the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tausift.llm.filters import HashFilter, hash_filter
from tausift.llm.tokens import tokens
from tausift.runtime import cut, small

WINDOW = 5
#: Part of an item's own text that must lie in one stretch.
LEAST_SHARE = 0.4
#: Part of a stretch's slots that must hold the item's own values.
LEAST_SAME = 0.5
#: Slots of a stretch that must repeat an earlier slot, in the document as in the item, for new values to count as the item
#: with other parameters; and how many of them there must be for each that does not.
LEAST_AGREE, AGREE_RATIO = 3, 5
#: Items that must open with the same sentence for it to be an instruction.
SEVERAL = 3
#: A word is part of the templates if this many items, and this share of them, use it.
TEMPLATE_ITEMS, TEMPLATE_SHARE = 4, 0.002
#: Template words that a window needs to join by its template.
TEMPLATE_WORDS = 3
#: Item tokens that may be altered in a row, and document tokens that may come between.
ITEM_GAP, DOCUMENT_GAP = 8, 80
#: Words that a worker keeps the hashes of.
KEPT_WORDS = 500_000
#: Words for units of measure, a fixed list.
UNITS = frozenset("km m cm mm kg g mg t l ml h min s eur euro euros usd dollar dollars yen rupee rupees inr jpy days hours minutes giorni ore minuti percent 円 ドル 日 時間 分 घंटे मिनट दिन रुपये".split())

_UNIT_END = re.compile(r"(?<=[。！？।\n])|(?<=[.!?])\s")
_LOWER = re.compile(r"(?<!\w)[a-zß-ÿ]{2,}(?!\w)")
_NAME, _NUMBER, _UNIT, _FIRST = 1, 2, 3, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every WINDOW consecutive ids."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, x = np.zeros(n, np.uint64), _mix(ids.astype(np.uint64) + _ODD)
    for k in range(WINDOW):
        out = out * _ODD + x[k : k + n]
    return _mix(out)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _units(text: str) -> list[str]:
    return [u for u in _UNIT_END.split(text) if u.strip()]


def opening_keys(text: str) -> list[int]:
    """Hashes of the tokens of the first sentence, of the first two, and so on, short of the whole text."""
    digest, keys = xxhash.xxh3_64(), []
    for unit in _units(text)[:-1]:
        digest.update(" ".join(tokens(unit)) + "\x1f")
        keys.append(digest.intdigest() >> 1)
    return keys


def without_openings(text: str, depth: int) -> str:
    return " ".join(_units(text)[depth:]) if depth else text


def plain_words(text: str, words: Iterable[str]) -> set[str]:
    """The words of a text that are no names by their writing: in lower case, or single kana and ideographs."""
    lower = set(_LOWER.findall(unicodedata.normalize("NFKC", text)))
    return {w for w in words if w in lower or (len(w) == 1 and "぀" <= w <= "鿿")}


class Words:
    """Numbers for words, with the exact and the template hash of each; lexicon: the filter of the template words."""

    def __init__(self, lexicon: HashFilter) -> None:
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.exact, self.template = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def numbers(self, words: list[str]) -> list[int]:
        get = self.number.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            for k, n in enumerate(found):
                if n < 0:
                    found[k] = self._add(words[k])
        return found

    def _add(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            if n >= len(self.exact):
                self.exact, self.template = np.resize(self.exact, 2 * n), np.resize(self.template, 2 * n)
            h = word_hash(word)
            self.exact[n] = h
            self.template[n] = _NUMBER if word[0].isdigit() else _UNIT if word in UNITS else _FIRST + (h >> 3) if h in self.lexicon else _NAME
        return n

    def arrays(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exact hashes, template ids, where each text begins) of all texts, with WINDOW zeros behind each."""
        if len(self.number) > KEPT_WORDS:
            self._clear()
        numbers: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(numbers))
            numbers += self.numbers(words)
            numbers += [0] * WINDOW
        at = np.array(numbers, np.int64)
        return self.exact[at], self.template[at], np.array(starts, np.int64)


def _by_template(template: np.ndarray) -> np.ndarray:
    """Which windows hold enough template words to join by their template."""
    return np.convolve(template >= _FIRST, np.ones(WINDOW, int), "valid") >= TEMPLATE_WORDS


def _values(exact: np.ndarray, at: np.ndarray) -> pa.Array:
    """The five values of the windows at these places, 4 bytes each."""
    low = (exact & np.uint64(0xFFFFFFFF)).astype("<u4")
    data = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, WINDOW)[at])
    offsets = np.arange(0, 4 * WINDOW * (len(at) + 1), 4 * WINDOW, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def item_windows(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(template hashes, exact hashes, whether the template may join, values) of an item's windows, by position."""
    exact, template, _ = words.arrays([tokens(text)])
    exact, template = exact[:-WINDOW], template[:-WINDOW]
    t = _windows(template)
    if not len(t):
        return t, t, np.zeros(0, bool), pa.array([], pa.binary())
    return t, _windows(exact), _by_template(template), _values(exact, np.arange(len(t)))


def item_shape(text: str, words: Words) -> tuple[bytes, bytes, bytes, int, int]:
    """Of an item's tokens: characters before each and in all, placeholders before each and in all, and their values; then the
    fewest windows that can make a leak, and how many slots repeat an earlier one."""
    of = tokens(text)
    exact, template, _ = words.arrays([of])
    exact, template = exact[:-WINDOW], template[:-WINDOW]
    lengths = np.concatenate(([0], np.cumsum([len(w) for w in of], dtype=np.int64)))
    slots = np.concatenate(([0], np.cumsum(template < _FIRST, dtype=np.int64)))
    # the shortest stretch with enough characters; half of its tokens must lie in windows
    ends = np.searchsorted(lengths, lengths + LEAST_SHARE * lengths[-1] - 1e-6)
    shortest = int(min((e - k for k, e in enumerate(ends.tolist()) if e < len(lengths)), default=0))
    values = exact[template < _FIRST]
    return (
        lengths.astype("<i4").tobytes(), slots.astype("<i4").tobytes(), (exact & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
        -(-shortest // (2 * WINDOW)), len(values) - len(np.unique(values)),
    )


def document_windows(texts: list[str | None], words: Words, wanted: HashFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array] | None:
    """(row, position, key, values) of the windows of these texts that some item may have, None if there are none."""
    exact, template, starts = words.arrays([tokens(t) if t else [] for t in texts])
    t = _windows(template)
    if not len(t):
        return None
    e = _windows(exact)
    by_template = np.flatnonzero(_by_template(template) & wanted.holds(t))
    by_value = np.flatnonzero(wanted.holds(e))
    at = np.concatenate((by_template, by_value))
    if not len(at):
        return None
    rows = np.searchsorted(starts, at, side="right") - 1
    return rows, at - starts[rows], np.concatenate((t[by_template], e[by_value])), _values(exact, at)


def _runs(matches: list[tuple[int, int, bool]], slots: list[int]) -> list[list[int]]:
    """Matches on one diagonal, with gaps of at most ITEM_GAP tokens, as [item start, item end, document start, document
    end, tokens covered, slots covered by windows with the item's own values], by document start."""
    runs: list[list[int]] = []
    open_runs: dict[int, list[int]] = {}
    for d, i, same in matches:
        run = open_runs.get(d - i)
        if run is None or i - run[1] > ITEM_GAP:
            run = open_runs[d - i] = [i, i, d, d, 0, 0, i]
            runs.append(run)
        run[4] += i + WINDOW - max(i, run[1])
        if same:
            run[5] += slots[i + WINDOW] - slots[max(i, run[6])]
            run[6] = i + WINDOW
        run[1], run[3] = i + WINDOW, d + WINDOW
    return runs


def _stretch(matches: list[tuple[int, int, bool]], lengths: list[int], slots: list[int], consistent: Callable[[int, int, int, int], bool]) -> tuple[float, float]:
    """(share of the item's characters, share of its slots with the item's own values) of the best stretch.

    matches: (document position, item position, same values), by document position. Runs are joined to chains that go
    forward in both texts; a chain whose slots mostly hold other values counts only if they are consistent.
    """
    best, chains, first = (0.0, 0.0), [], 0
    for run in _runs(matches, slots):
        i0, i1, d0, d1, covered, own, _ = run
        chain = [i0, i1, d1, covered, own, d0]
        while first < len(chains) and d0 - chains[first][2] > DOCUMENT_GAP:
            first += 1
        for j0, j1, e1, other_covered, other_own, e0 in chains[first:]:
            back = max(0, j1 - i0, e1 - d0)
            if i0 > j0 and i1 > j1 and d1 > e1 and back < WINDOW and i0 - j1 <= ITEM_GAP and d0 - e1 <= DOCUMENT_GAP and other_covered + covered - back > chain[3]:
                chain = [j0, i1, d1, other_covered + covered - back, other_own + own, e0]
        chains.append(chain)
        all_slots = slots[i1] - slots[chain[0]]
        same = min(1.0, chain[4] / all_slots) if all_slots else 1.0
        share = (lengths[i1] - lengths[chain[0]]) / lengths[-1]
        if 2 * chain[3] >= i1 - chain[0] and (share, same) > best and (same >= LEAST_SAME or (share >= LEAST_SHARE and consistent(chain[0], i1, chain[5], d1))):
            best = (share, same)
    return best


def consistent_slots(own: list[int], given: dict[int, int], slots: list[int]) -> bool:
    """Whether a document fills an item's slots one to one: slots that are alike in the item are alike in the document.

    own: the item's values; given: item position to the document's value. Only slots that repeat an earlier value can agree
    or disagree; those of single use show nothing.
    """
    forward: dict[int, int] = {}
    backward: dict[int, int] = {}
    agree = against = 0
    for at in sorted(given):
        if slots[at + 1] == slots[at]:
            continue
        a, b = own[at], given[at]
        if a not in forward and b not in backward:
            forward[a], backward[b] = b, a
        elif forward.get(a) == b:
            agree += 1
        else:
            against += 1
    return agree >= LEAST_AGREE and agree >= AGREE_RATIO * against


def leak_of(windows: list[tuple[int, int, bytes | None]], shape: tuple[bytes, bytes, bytes]) -> tuple[float, float] | None:
    """(share of the item, share of its slots with its own values) if these windows of one document make a leak.

    windows: (document position, item position, the document's values where they aren't the item's), in any order. Those with
    the item's values are also tried by themselves, since a stretch of them may go over into the template with other values.
    """
    lengths, slots, own = np.frombuffer(shape[0], "<i4").tolist(), np.frombuffer(shape[1], "<i4").tolist(), np.frombuffer(shape[2], "<u4").tolist()
    windows = sorted(windows, key=lambda w: w[:2])

    def consistent(i0: int, i1: int, d0: int, d1: int) -> bool:
        given: dict[int, int] = {}
        for d, i, values in windows:
            if i0 <= i and i + WINDOW <= i1 and d0 <= d and d + WINDOW <= d1:
                for k, value in enumerate(own[i : i + WINDOW] if values is None else np.frombuffer(values, "<u4").tolist()):
                    given.setdefault(i + k, value)
        return consistent_slots(own, given, slots)

    every = [(d, i, v is None) for d, i, v in windows]
    own_values = [w for w in every if w[2]]
    share, same = max(_stretch(w, lengths, slots, consistent) for w in ([every, own_values] if 0 < len(own_values) < len(every) else [every]))
    return (share, same) if share >= LEAST_SHARE else None


def _own_texts(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own texts (i, x), members (i, m)): each different own text once, under its least id, and the ids m that have it.

    Own text: without the opening sentences that SEVERAL or more different texts share.
    """
    kind = first.schema["i"].dataType.simpleString()
    different = first.groupBy("x").agg(F.min("i").alias("i")).select("i", "x")

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([opening_keys(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["i", "x", "k"])

    opened = different.mapInArrow(keys, f"i {kind}, x string, k array<long>")
    each = opened.select("i", F.explode("k").alias("k"))
    shared = each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEVERAL).select("k")
    depth = each.join(shared, "k", "left_semi").groupBy("i").agg(F.count(F.lit(1)).cast("int").alias("d"))

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without_openings(t, d) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["i", "whole", "x"])

    stripped = cut(different.join(depth, "i", "left").select("i", "x", F.coalesce("d", F.lit(0)).alias("d")).mapInArrow(strip, f"i {kind}, whole string, x string"))
    named = stripped.groupBy("x").agg(F.min("i").alias("i"))
    of_text = first.select(F.col("i").alias("m"), F.col("x").alias("whole")).join(stripped.select("whole", "x"), "whole").join(named, "x").select("i", "m")
    return cut(named.select("i", "x")), cut(of_text)


def _item_index(own: DataFrame, lexicon: HashFilter) -> DataFrame:
    """(key, i, at, v): the windows of all items, by template where it has enough words, by value elsewhere."""
    kind = own.schema["i"].dataType.simpleString()

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                t, e, by_template, values = item_windows(text, words)
                if len(t):
                    key = np.where(by_template, t, e).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array([k] * len(t))), pa.array(np.arange(len(t), dtype=np.int32)), values], names=["key", "i", "at", "v"])

    return cut(own.mapInArrow(cut_up, f"key long, i {kind}, at int, v binary"))


def leaked_items(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(doc, item, share, same_values): every document that holds an item, or LEAST_SHARE of its own text in one stretch.

    Own text: without opening sentences that several items share. Case, width, marks, markup and layout don't count;
    interruptions and single altered words are bridged. Names and numbers may be altered, up to half of those in the stretch;
    beyond that the item counts as re-parameterised if its slots hold new values one to one, which repeated slots must show.
    share: part of the item's own characters in the stretch; same_values: part of its slots with the item's values. One row
    per document and item: documents that repeat an id give their best stretch. Null texts on either side match nothing; of
    several items with one id the first text by code point counts; empty tables give an empty result; other columns are
    ignored. Items with equal own texts are looked for once.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).dropna()
    first = items.select(F.col(item).alias("i"), F.col(item_text).alias("x")).dropna().groupBy("i").agg(F.min("x").alias("x"))
    kinds = rows.schema["__doc"].dataType.simpleString(), first.schema["i"].dataType.simpleString()
    own, members = _own_texts(first)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1).to_pylist():
                used = sorted(set(tokens(t)))
                plain = plain_words(t, used)
                yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in used], pa.int64()), pa.array([w in plain for w in used], pa.bool_())], names=["h", "plain"])

    least = max(TEMPLATE_ITEMS, TEMPLATE_SHARE * own.count())
    used = own.mapInArrow(count, "h long, plain boolean").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("plain").alias("plain"))
    lexicon = hash_filter(cut(used.filter((F.col("n") >= least) | F.col("plain")).select("h")))
    index = _item_index(own, lexicon)
    sent = spark.sparkContext.broadcast((lexicon, hash_filter(index.select(F.col("key").alias("h")))))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted = Words(sent.value[0]), sent.value[1]
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                found = document_windows(part, words, wanted)
                if found:
                    of, position, key, values = found
                    hit, back = np.unique(of, return_inverse=True)
                    same_text = np.array([word_hash(part[k]) for k in hit.tolist()], np.int64)[back]
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(of + at)), pa.array(same_text), pa.array(position.astype(np.int32)), pa.array(key.view(np.int64)), values], names=["__doc", "x", "d", "key", "v"])

    found = rows.mapInArrow(look, f"__doc {kinds[0]}, x long, d int, key long, v binary")
    met = found.join(index.withColumnRenamed("v", "own"), "key").select("__doc", "x", "i", F.struct("d", "at", F.when(F.col("v") != F.col("own"), F.col("v")).alias("v")).alias("w"))
    pairs = met.groupBy("__doc", "x", "i").agg(F.collect_set("w").alias("w"))

    def shape(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for b in batches:
            shapes = list(zip(*(item_shape(t, words) for t in b.column(1).to_pylist()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s, t) for s, t in zip(shapes, [pa.binary()] * 3 + [pa.int32()] * 2, strict=True))], names=["i", "l", "s", "t", "fewest", "repeats"])

    shapes = small(cut(own.mapInArrow(shape, f"i {kinds[1]}, l binary, s binary, t binary, fewest int, repeats int")))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(2, 8)]
            kept, shares = [], []
            for k, (d, at, v, *shape_of) in enumerate(zip(*columns, strict=True)):
                leak = leak_of(list(zip(d, at, v, strict=True)), tuple(shape_of))
                if leak:
                    kept.append(k)
                    shares.append(leak)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), b.column(1).take(pa.array(kept, pa.int64())), pa.array([s for s, _ in shares], pa.float64()), pa.array([s for _, s in shares], pa.float64())], names=["__doc", "i", "share", "same_values"])

    # what can't be a leak by its number of windows, or has no window with the item's values and no slots to compare
    able = (F.size("w") >= F.col("fewest")) & (F.exists("w", lambda w: w["v"].isNull()) | (F.col("repeats") >= LEAST_AGREE))
    judged = pairs.join(shapes, "i").filter(able).select("__doc", "i", "w.d", "w.at", "w.v", "l", "s", "t").mapInArrow(judge, f"__doc {kinds[0]}, i {kinds[1]}, share double, same_values double")
    best = judged.groupBy("__doc", "i").agg(F.max(F.struct("share", "same_values")).alias("b"))
    return best.join(small(members), "i").select(F.col("__doc").alias(doc), F.col("m").alias(item), "b.share", "b.same_values")
