import collections
import random

import pytest

from tausift.llm import pack
from tausift.llm.pack import best_fit, dominant_sets, fill_containers, pack_texts, packing_plan, token_counts


def optimum(items, capacity):
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for b in {r: b for b, r in enumerate(rooms) if r >= items[k]}.values():
            rooms[b] -= items[k]
            place(k + 1, rooms)
            rooms[b] += items[k]
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(5))
def test_reduction_costs_nothing_and_plans_hold(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.randint(5, 30)
        items = sorted((rng.randint(rng.choice([1, capacity // 4 + 1]), capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        histogram = dict(collections.Counter(items))
        best = optimum(items, capacity)
        fixed, rest = dominant_sets(histogram, capacity)
        left = sorted((s for s, c in rest.items() for _ in range(c)), reverse=True)
        assert sum(b for b, _ in fixed) + optimum(left, capacity) == best
        plan = packing_plan(histogram, capacity)
        used = collections.Counter()
        for bins, sizes in plan:
            assert bins > 0 and sum(s * k for s, k in sizes.items()) <= capacity
            for s, k in sizes.items():
                used[s] += bins * k
        assert used == histogram and best <= sum(b for b, _ in plan) <= best + 1


def test_plan_ignores_the_number_of_items():
    histogram = {s: 10**9 // s for s in range(1, 513)}
    plan = packing_plan(histogram, 512)
    tokens = sum(s * n for s, n in histogram.items())
    assert sum(b for b, _ in plan) <= tokens / 512 * 1.001 + 1 and len(plan) < 5000
    assert best_fit({}, 10) == []
    with pytest.raises(ValueError):
        packing_plan({11: 1}, 10)


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_containers(spark, bucket, monkeypatch):
    monkeypatch.setattr(pack, "BUCKET_ROWS", bucket)
    rng = random.Random(2)
    rows = [(k, rng.choice([3, 3, 3, 1, 7, 10, 0])) for k in range(300)] + [(900, 35), (901, 20), (902, None), (903, 10), (903, 10), (None, 4)]
    df = spark.createDataFrame(rows, "id long, n long").coalesce(1)
    got = fill_containers(df, "id", "n", 10).collect()
    held = collections.Counter()
    for r in got:
        held[r.container_id] += r.n
    assert max(held.values()) <= 10 and set(held) == set(range(len(held)))
    assert [(r.piece_no, r.n) for r in sorted(got, key=lambda r: r.piece_no) if r.id == 900] == [(1, 10), (2, 10), (3, 10), (4, 5)]
    assert sorted(r.n for r in got if r.id == 901) == [10, 10] and len(got) == len(rows) + 3 + 1
    total = sum(n or 0 for _, n in rows)
    assert len(held) <= total / 10 + 2
    assert fill_containers(df.limit(0), "id", "n", 10).count() == 0
    assert {r.container_id for r in fill_containers(df.filter("n = 0"), "id", "n", 10).collect()} == {0}


def test_texts(spark):
    df = spark.createDataFrame([(1, "hello world " * 50, 3), (2, None, 4), (3, "", 5), (4, "日本語", 6)], "id long, t string, n_tokens int")
    sizes = {r.id: r.n_tokens for r in token_counts(df, "id", "t").collect()}
    assert sizes[2] == sizes[3] == 0 and sizes[1] >= 100 and sizes[4] > 0
    got = pack_texts(df, "id", "t", 64).collect()
    assert sum(r.n_tokens for r in got) == sum(sizes.values()) and max(r.n_tokens for r in got) <= 64
