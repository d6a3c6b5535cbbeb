import tracemalloc

import numpy as np
import pyarrow as pa

from yieldloom.operators import batchrisk


def packed(z, prefix, columns):
    lot, sources, zs = columns
    names = [f"etch|ETCH-{i:02}|p" for i in range(z.shape[1])]
    return pa.table({lot: [f"{prefix}{i:05}" for i in range(len(z))], sources: [names] * len(z), zs: list(z)})


def test_memory_of_a_block_does_not_grow_with_its_pairs():
    """Readings far off make all similarities about 0, so that all pairs are among the best ones and are compared one by one."""
    rng = np.random.default_rng(1)
    z, old = rng.normal(0, 1, (200, 40)), rng.normal(0, 1, (4000, 40))
    z[:, 0] = 1e5
    a, b = packed(z, "A", ("lot_id", "sources", "zs")), packed(old, "B", ("old_lot", "old_sources", "old_zs"))
    tracemalloc.start()
    got = batchrisk._best(1.5, 0.2, 0.0, 50_000)(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # one matrix of all pairs by sources would be 256e6
    assert set(got["lot_id"].to_pylist()) == set(a["lot_id"].to_pylist()) and min(got["match"].to_pylist()) == "B00000"
    assert batchrisk._best(1.5, 0.2, 0.5, 50_000)(a, b).num_rows == 0


def test_best_match_among_deviations_of_millions(spark):
    """The products of z lose digits that decide here; the best match is found nevertheless, in tiles of any size."""
    rng = np.random.default_rng(46)
    own = np.array([1e7 / 0.3, 0.5, -0.2])
    old = own + rng.normal(0, 1, (400, 3))
    want = np.exp(-np.sqrt(((own - old) ** 2).mean(axis=1)) / 2)
    ddl = "lot_id string, source string, z double"
    running = spark.createDataFrame([("A", s, float(v)) for s, v in zip("stu", own)], ddl)
    history = spark.createDataFrame([(f"B{i:03}", s, float(v)) for i, z in enumerate(old) for s, v in zip("stu", z)], ddl)
    for cells in (300, 500_000):
        r = batchrisk.best_matches(running, history, cells=cells).first()
        assert r.match == f"B{want.argmax():03}" and abs(r.similarity - want.max()) < 1e-9
