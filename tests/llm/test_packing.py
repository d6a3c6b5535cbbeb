import random
from collections import Counter, defaultdict

from yieldloom.llm import packing, tokens


def run(spark, items, capacity=100, partitions=3, **more):
    df = spark.createDataFrame([(i, s, "clash") for i, s in items], "id long, size long, container string").repartition(partitions)
    return packing.pack(df, capacity, **more).collect()


def check(items, got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.id].append((r.piece, r.start, r.size))
    assert set(by) == {i for i, s in items if s and s > 0}
    for i, s in items:
        if s and s > 0:
            pieces = sorted(by[i])
            assert sum(p[2] for p in pieces) == s and len(pieces) == max(1, -(-s // capacity))
            assert [p[1] for p in pieces] == [k * capacity for k in range(len(pieces))]
    fill = Counter()
    for r in got:
        fill[r.container] += r.size
    assert all(x <= capacity for x in fill.values())
    return fill


def test_every_item_once_whole_and_well_filled(spark):
    rnd = random.Random(4)
    items = [(i, rnd.choice([rnd.randint(1, 60), rnd.randint(1, 100), 100, 101, 250, 1])) for i in range(3_000)]
    for more in ({}, {"windows": 2}, {"windows": 8, "fan": 2, "partitions": 6}):
        fill = check(items, run(spark, items, **more), 100)
        least = -(-sum(s for _, s in items) // 100)
        assert len(fill) <= least * (1.25 if more.get("windows") == 2 else 1.08)


def test_leftovers_of_tasks_are_merged(spark):
    items = [(i, 30) for i in range(20)]  # open containers are merged as a whole: each task leaves 60 or 30 over
    alone = packing.pack(spark.createDataFrame(items, "id long, size long").repartition(10), 100, fan=2).collect()
    assert len(check(items, alone, 100)) <= 10 and 6 * 100 >= sum(s for _, s in items)
    tens = [(i, 10) for i in range(100)]
    assert len(check(tens, run(spark, tens, partitions=10, fan=2), 100)) <= 11


def test_empty_sizes_and_tables(spark):
    assert run(spark, []) == []
    assert check([(1, 5), (2, None), (3, 0), (4, -1)], run(spark, [(1, 5), (2, None), (3, 0), (4, -1)]), 100)


def test_lengths_of_texts(spark):
    texts = [(1, "The pump is fine."), (2, ""), (3, None), (4, "  "), (5, "a" * 200_000), (6, "<|endoftext|> ü €"), (7, "The pump is fine.")]
    df = spark.createDataFrame([(*t, 0) for t in texts], "doc long, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in tokens.with_lengths(df, "text", {"id": "doc"}).collect()}
    assert set(got) == {1, 4, 5, 6, 7} and got[1] == got[7] == 5
    assert got == {i: len(tokens.encoding().encode_ordinary(t)) for i, t in texts if t}
