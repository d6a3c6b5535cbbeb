import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from yieldloom.llm import clusters

SCHEMA = "id long, lot string, waf string, x double, y double, cx string, n int"


def brute(points, link, least):
    out = set()
    for space in {(p[1], p[2]) for p in points if p[1] and p[2]}:
        own = [p for p in points if (p[1], p[2]) == space and p[3] is not None and p[4] is not None and abs(p[3]) <= 1 and abs(p[4]) <= 1]
        label = list(range(len(own)))
        for i, p in enumerate(own):
            for j, q in enumerate(own[:i]):
                if np.hypot(p[3] - q[3], p[4] - q[4]) <= link and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
        for g in set(label):
            ids = [p[0] for p, x in zip(own, label) if x == g]
            if len(ids) >= least:
                out |= {(min(ids), i) for i in ids}
    return out


def sample(seed=0):
    """Chains, blobs and lone points, more than two links apart; ids in mixed order."""
    rng, points = np.random.default_rng(seed), []
    for w in range(6):
        used = []
        for _ in range(12):
            c = rng.uniform(-0.9, 0.9, 2)
            if any(np.hypot(*(c - u)) < 0.45 for u in used):
                continue
            used.append(c)
            n, kind = int(rng.integers(1, 14)), rng.integers(3)
            at = c + (rng.normal(0, 0.008, (n, 2)) if kind else np.outer(np.arange(n) * 0.02, [0.6, 0.5]))
            points += [(x, y, w) for x, y in at.clip(-1, 1)]
    ids = rng.permutation(len(points))
    return [(int(i), f"L{w % 2}", f"W{w}", float(x), float(y), "clash", 1) for i, (x, y, w) in zip(ids, points)]


def run(spark, points, least=6, partitions=None, names=True, **more):
    df = spark.createDataFrame(points, SCHEMA)
    df = df.repartition(partitions) if partitions else df
    return clusters.cluster(df, ["lot", "waf"], "id", "x", "y", clusters.ClusterConfig(link=0.05, min_size=least, **more), names).cache()


def groups(found):
    return {(r.group_id, r.id) for r in clusters.members(found).collect()}


def test_groups_equal_brute_force_with_copies_and_unusable_rows(spark):
    points = sample()
    points += [(10_000 + p[0], *p[1:]) for p in points[:20]]
    points += [(20_000 + i, "L0", w, x, y, "", 0) for i, (w, x, y) in enumerate([(None, 0.0, 0.0), ("W0", None, 0.0), ("W0", float("nan"), 0.0), ("W0", 1.5, 0.0)])]
    want = brute(points, 0.05, 6)
    assert groups(run(spark, points)) == want == groups(run(spark, points, names=False, batch=20, buffer=50, branch=2))


def test_steps_just_above_the_link_join_nothing(spark):
    rng = np.random.default_rng(7)
    points = [(i, "L", "W", float(x), float(y), "", 0) for i, (x, y) in enumerate(rng.uniform(-0.6, 0.6, (500, 2)).round(3))]  # dense, with many gaps of one to two links
    assert groups(run(spark, points)) == brute(points, 0.05, 6)


def test_result_does_not_depend_on_partitions(spark):
    points = sample(1)
    assert groups(run(spark, points, partitions=1)) == groups(run(spark, points, partitions=7)) == groups(run(spark, points, partitions=3, keep=1))


def test_a_hot_wafer_leaves_tasks_as_summaries(spark):
    rng = np.random.default_rng(2)
    points = [(i, "L", "W", float(x), float(y), "", 0) for i, (x, y) in enumerate(rng.normal(0, 0.02, (20_000, 2)))] + [(30_000, "L", "W", 0.9, 0.9, "", 0)]
    pdf = pd.DataFrame(points, columns=["id", "lot", "waf", "x", "y", "cx", "n"])[["id", "x", "y"]].assign(k1=1, k2=2)
    f = clusters.features(pdf["id"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy())
    order = np.argsort(clusters.curve(f["mx"], f["my"], -1, 1), kind="stable")
    f = {k: v[order] for k, v in f.items()}
    starts = clusters.absorb(np.zeros(len(order)), f, 0.025)
    leaves = clusters.merged(f, starts)
    assert len(starts) < 400 and leaves["n"].sum() == len(points) and (np.hypot(leaves["x1"] - leaves["x0"], leaves["y1"] - leaves["y0"]) <= 0.025).all()
    found = run(spark, points, least=1, partitions=4)
    assert sorted(r.size for r in found.filter(F.col("role") == clusters.GROUP).collect()) == [1, 20_000]
    assert len(groups(found)) == 20_001
    whole = found.filter(f"role = {clusters.GROUP} and size > 1").first()
    xy = np.array([p[3:5] for p in points[:-1]])
    assert np.allclose([whole.x, whole.y, whole.d2], [*xy.mean(axis=0), np.sqrt(((xy - xy.mean(axis=0)) ** 2).sum(axis=1).mean())])


def test_wards_limit_decides_the_parts(spark):
    points = [(i, "L", "W", 0.0 if i < 50 else 0.045, 0.0, "", 0) for i in range(100)]
    sizes = lambda **more: sorted(r.size for r in clusters.parts(run(spark, points, **more), ["lot", "waf"]).collect())
    assert sizes() == [50, 50] and sizes(limit=1.0) == [100]
    assert {r.size for r in clusters.members(run(spark, points)).collect()} == {100}


def test_typical_members_are_nearest_to_the_centroid_with_ties_by_id(spark):
    at = [(0.0, 0.0), (0.01, 0.0), (-0.01, 0.0), (0.0, 0.02), (0.0, -0.02), (0.0, 0.0)]
    points = [(i, "L", "W", x, y, "", 0) for i, (x, y) in enumerate(at)]
    t = clusters.described(run(spark, points), ["lot", "waf"]).first()
    assert (t.group_id, t.lot, t.waf, t.size, list(t.typical)) == (0, "L", "W", 6, [0, 5, 1])


def test_empty_table(spark):
    assert run(spark, []).count() == 0
