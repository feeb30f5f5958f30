"""Filling containers of a fixed token capacity with texts.

Texts of one length are interchangeable, so the plan is made on the histogram of lengths, which never has more entries
than the capacity has tokens, however many texts there are. Dominance reduction fixes the sets that some best packing is
sure to use; the remainder goes in best fit, longest first. The plan says which ranks within a length go into which
containers; every text finds its container from its own rank, and ranks are counted in buckets of bounded size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tausift.runtime import cut

#: The public tokenizer whose tokens are counted, and its split pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of one length that are ranked in one task.
BUCKET_ROWS = 50_000

Bins = list[tuple[int, dict[int, int]]]


def token_counts(df: DataFrame, item: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, n_tokens) of every row: the tokens of the whole text; null counts as 0. Other columns are ignored."""
    rows = df.select(F.col(item).alias("__item"), F.col(text).alias("__text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["__item", "n_tokens"])

    kind = rows.schema["__item"].dataType.simpleString()
    return rows.mapInArrow(count, f"__item {kind}, n_tokens long").withColumnRenamed("__item", item)


class _Stock:
    """The items that are left, as counts by size."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, sizes: dict[int, int], times: int) -> None:
        for s, k in sizes.items():
            self.count[s] -= k * times
            if not self.count[s]:
                del self.count[s]
                self.sizes.pop(bisect_left(self.sizes, s))

    def largest(self, limit: int, used: dict[int, int]) -> int | None:
        """The largest size up to limit of which more than `used` items are left."""
        k = bisect_left(self.sizes, limit + 1) - 1
        while k >= 0 and self.count[self.sizes[k]] <= used.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def smallest(self, how_many: int, used: dict[int, int]) -> list[int]:
        """The smallest items left besides `used`, at most how_many."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(how_many - len(out), self.count[s] - used.get(s, 0))
            if len(out) == how_many:
                break
        return out


def _times(stock: _Stock, sizes: dict[int, int]) -> int:
    return min(stock.count[s] // k for s, k in sizes.items())


def _set_of(*sizes: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for s in sizes:
        out[s] += 1
    return dict(out)


def dominant_sets(histogram: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """(bins that can be fixed, remaining histogram) by dominance of small sets.

    For an item j with room r beside it: j alone if nothing fits; j with k if k fills r, or if every set of two or more
    items that fits r also fits k, the largest single one; j with k and b if no three items fit r and every pair that does
    is no larger, item by item, than k and b or fits k. Each such set replaces any other bin that holds j at no cost.
    """
    stock, fixed = _Stock(histogram), []
    sums = 1
    for s in stock.sizes:
        step, reach = s, sums
        while step <= capacity:
            reach |= reach << step
            step *= 2
        sums = reach & ((1 << (capacity + 1)) - 1)
    several = 0
    for s in stock.sizes:
        several |= (sums & ~1) << s
    for j in sorted(stock.sizes, reverse=True):
        while stock.count.get(j):
            chosen, room = _dominant(stock, j, capacity, several), capacity - j
            if chosen is None:
                break
            times = _times(stock, chosen)
            stock.take(chosen, times)
            fixed.append((times, chosen))
            assert sum(s * k for s, k in chosen.items()) <= j + room
    return fixed, dict(stock.count)


def _dominant(stock: _Stock, j: int, capacity: int, several: int) -> dict[int, int] | None:
    room, used = capacity - j, {j: 1}
    k = stock.largest(room, used)
    if k is None:
        return used
    if k == room or not (several >> (k + 1)) & ((1 << (room - k)) - 1):
        return _set_of(j, k)
    few = stock.smallest(3, used)
    if len(few) < 2 or sum(few[:2]) > room:
        return _set_of(j, k)
    if len(few) == 3 and sum(few) <= room:
        return None
    b = stock.largest(room - k, _set_of(j, k))
    if b is None:
        return None
    for low in stock.sizes:
        if 2 * low > room:
            break
        partner = stock.largest(room - low, _set_of(j, low))
        if partner is not None and partner >= low and not ((partner <= k and low <= b) or partner + low <= k):
            return None
    return _set_of(j, k, b)


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on a histogram: each size, from the largest, goes into the bins with the least room that holds it."""
    rooms: list[int] = []
    groups: defaultdict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)

    def put(room: int, bins: int, sizes: dict[int, int]) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((bins, sizes))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                bins, sizes = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, bins, sizes = capacity, -(-left // (capacity // size)), {}
            each = room // size
            full = min(bins, left // each)
            if full:
                put(room - each * size, full, sizes | {size: each})
                left -= full * each
            if full < bins and left and left < each:
                put(room - left * size, 1, sizes | {size: left})
                left, full = 0, full + 1
            if full < bins:
                put(room, bins - full, sizes)
    return [group for room in groups for group in groups[room]]


def packing_plan(histogram: dict[int, int], capacity: int) -> Bins:
    """(number of containers, items of each size in one of them) for items of 1 to capacity tokens."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed, rest = dominant_sets(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(plan: Bins) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """(size to (first rank, first container, items of the size per container) of each group; number of containers)."""
    lists: defaultdict[int, list[tuple[int, int, int]]] = defaultdict(list)
    next_rank: defaultdict[int, int] = defaultdict(int)
    container = 0
    for bins, sizes in plan:
        for size, each in sizes.items():
            lists[size].append((next_rank[size], container, each))
            next_rank[size] += bins * each
        container += bins
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in lists.items()}, container


def fill_containers(sizes: DataFrame, item: str, n_tokens: str, capacity: int) -> DataFrame:
    """(item, piece_no, n_tokens, container_id) for every row of sizes, which should be read from a cut.

    No text is divided unless it alone exceeds the capacity; such a text gives full pieces and one remainder, in token
    order, piece_no from 1. Every container holds at most `capacity` tokens. Texts without tokens (null counts as 0) are
    dealt out over the containers. Repeated items are placed each for itself; an empty table gives an empty result. Other
    columns are ignored. Collects the histogram of lengths, at most `capacity` rows.
    """
    rows = sizes.select(F.col(item).alias("i"), F.greatest(F.coalesce(F.col(n_tokens), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    pieces = F.ceil(F.col("n") / F.lit(capacity)).cast("int")
    parts = rows.select("i", "n", F.explode(F.sequence(F.lit(1), F.greatest(pieces, F.lit(1)))).alias("p"))
    parts = parts.select("i", "p", F.least(F.lit(capacity).cast("long"), F.col("n") - (F.col("p") - 1) * capacity).alias("s"))
    # a text of m whole pieces adds m to one size and 1 to another: counted before anything is exploded
    counts = rows.groupBy((F.col("n") % capacity).alias("s")).agg(F.sum(F.when((F.col("n") == 0) | (F.col("n") % capacity > 0), 1).otherwise(0)).alias("c"), F.sum(F.floor(F.col("n") / capacity)).alias("whole")).collect()
    histogram = {r.s: r.c for r in counts if r.c}
    whole = sum(r.whole for r in counts)
    empty = histogram.pop(0, 0)
    if whole:
        histogram[capacity] = histogram.get(capacity, 0) + whole
    plan = packing_plan(histogram, capacity)
    slots, containers = _slots(plan)
    per_size = {s: max(1, -(-n // BUCKET_ROWS)) for s, n in (histogram | {0: empty}).items()}
    busy = {s: n for s, n in per_size.items() if n > 1}
    buckets = F.coalesce(F.create_map(*(F.lit(x) for s, n in busy.items() for x in (s, n)))[F.col("s")], F.lit(1)) if busy else F.lit(1)
    # the row's place in the cut parts repeated items too
    keyed = parts.withColumn("u", F.monotonically_increasing_id()).withColumn("b", F.pmod(F.xxhash64("i", "p", "u"), buckets.cast("long")))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("i", "p", "u")) - 1)
    if busy:
        held = keyed.groupBy("s", "b").count()
        before = F.sum("count").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        ranked = ranked.join(held.select("s", "b", F.coalesce(before, F.lit(0)).alias("o")), ["s", "b"])
    else:
        ranked = ranked.withColumn("o", F.lit(0))
    sent = sizes.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            out = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order])) + 1
            for rows_of in np.split(order, edges) if len(order) else []:
                s = int(size[rows_of[0]])
                if s == 0:
                    out[rows_of] = rank[rows_of] % max(containers, 1)
                    continue
                first, start, each = where[s]
                k = np.searchsorted(first, rank[rows_of], side="right") - 1
                out[rows_of] = start[k] + (rank[rows_of] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out)], names=["i", "p", "s", "container_id"])

    kind = rows.schema["i"].dataType.simpleString()
    numbered = ranked.select("i", "p", "s", (F.col("r") + F.col("o")).cast("long").alias("r"))
    placed = numbered.mapInArrow(place, f"i {kind}, p int, s long, container_id long")
    return placed.withColumnsRenamed({"i": item, "p": "piece_no", "s": n_tokens})


def pack_texts(df: DataFrame, item: str, text: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, piece_no, n_tokens, container_id): texts, counted in tokens once, in containers; see `fill_containers`."""
    return fill_containers(cut(token_counts(df, item, text, tokenizer)), item, "n_tokens", capacity)
