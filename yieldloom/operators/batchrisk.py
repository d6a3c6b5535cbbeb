"""Lots in progress whose readings resemble those of lots that ended with a low yield.

A lot's fingerprint is its last z per source. The lots in progress are a query set held against all low-yield lots,
over the sources both have, in blocks: fingerprints of about `block` lots a side at most meet in one task, which compares
them by matrix products, some hundred lots a side at a time, and passes on only the best matches of each of its lots in progress. No index prunes this
search without loss: two lots at risk may differ by 1.4 deviations in every source, which is what lots differ by at random.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from yieldloom.operators import lots as ops
from yieldloom.operators.lots import KEY
from yieldloom.session import materialize


def fingerprints(last: DataFrame, base: DataFrame) -> DataFrame:
    """lot_id, source, z: the last reading of each source in standard deviations from its baseline.

    last: of rootcause.lot_sources(), or readings of which the last are taken. base: best a written table.
    """
    if "last_value" not in last.columns:
        last = ops.latest(last.filter("value is not null")).withColumn("last_value", F.col("value"))
    t = last.filter("last_value is not null").join(ops.small(base.select(*KEY, "base_mean", "base_sd")), KEY)
    return t.select("lot_id", F.concat_ws("|", *KEY).alias("source"), ((F.col("last_value") - F.col("base_mean")) / F.col("base_sd")).alias("z"))


def _flat(t: pa.Table, sources: str, zs: str) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """The sources and z of all lots in one list each, and where the lists of the lots begin and end in them."""
    ends = np.cumsum(pc.list_value_length(t[zs]).to_numpy())
    return pc.list_flatten(t[sources]), pc.list_flatten(t[zs]).to_numpy(), np.r_[0, ends]


def _dense(number: np.ndarray, z: np.ndarray, at: np.ndarray, first: int, last: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """z of the lots from first up to last by the number of the source, 0 where a lot has none, and whether it has one."""
    row, some = np.repeat(np.arange(last - first), np.diff(at[first : last + 1])), slice(at[first], at[last])
    out, has = np.zeros((last - first, width)), np.zeros((last - first, width))
    out[row, number[some]], has[row, number[some]] = z[some], 1.0
    return out, has


def _best(abnormal_z: float, calm: float, least: float, cells: int):
    """Memory doesn't grow with the square of the block: matrices have about `cells` numbers, of lots by lots or by sources."""

    def cost(similarity):
        with np.errstate(divide="ignore"):
            return -np.log(np.maximum(similarity, 0.0))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = {"lot_id": [], "match": [], "similarity": []}
        if a.num_rows and b.num_rows:
            b = b.sort_by("old_lot")
            (sa, za, at_a), (sb, zb, at_b) = _flat(a, "sources", "zs"), _flat(b, "old_sources", "old_zs")
            names = pa.chunked_array([*sa.chunks, *sb.chunks], sa.type).combine_chunks().dictionary_encode()
            number, width = names.indices.to_numpy(), len(names.dictionary)
            na, nb, tile = number[: len(za)], number[len(za) :], max(1, min(math.isqrt(cells), cells // max(1, width)))
            for i in range(0, a.num_rows, tile):
                end = min(i + tile, a.num_rows)
                x, hx = _dense(na, za, at_a, i, end, width)
                abnormal, x2, top = (np.abs(x) >= abnormal_z) * hx, x * x, np.full(end - i, np.inf)
                for j in range(0, b.num_rows, tile):
                    y, hy = _dense(nb, zb, at_b, j, min(j + tile, b.num_rows), width)
                    n = hx @ hy.T
                    terms = x2 @ hy.T + hx @ (y * y).T
                    d2 = np.maximum(0, terms - 2 * (x @ y.T))
                    lost = terms * ((width + 8) * 4.5e-16)  # at most that much of d2 is due to the rounding of the products
                    less = np.where(abnormal @ hy.T > 0, 0.0, cost(calm))
                    # The cost is minus the logarithm of the similarity; costs up to the limit may be the best one, to 9 places of the similarity.
                    d2, lost, few = d2 / np.maximum(n, 1), lost / np.maximum(n, 1), n == 0
                    most = np.where(few, np.inf, np.sqrt(d2 + lost) / 2 + less)
                    top = np.minimum(top, most.min(axis=1))
                    limit = cost(np.maximum(np.exp(-top), least) - 2e-9)
                    p, q = np.nonzero((np.sqrt(np.maximum(0, d2 - lost)) / 2 + less <= limit[:, None]) & ~few)
                    del n, terms, d2, lost, few, most
                    exact, step = np.empty(len(p)), max(1, cells // width)
                    for k in range(0, len(p), step):  # those that may be the best are compared one by one
                        u, v = p[k : k + step], q[k : k + step]
                        both = hx[u] * hy[v]
                        exact[k : k + step] = np.exp(-np.sqrt((((x[u] - y[v]) * both) ** 2).sum(axis=1) / both.sum(axis=1)) / 2) * np.where(less[u, v] != 0, calm, 1.0)
                    order = np.lexsort((q, -np.round(exact, 9), p))
                    first = order[np.r_[True, np.diff(p[order]) > 0]] if len(order) else order
                    found["lot_id"].append(a["lot_id"].take(pa.array(i + p[first])))
                    found["match"].append(b["old_lot"].take(pa.array(j + q[first])))
                    found["similarity"].append(pa.chunked_array([exact[first]], pa.float64()))
        types = {"lot_id": pa.string(), "match": pa.string(), "similarity": pa.float64()}
        return pa.table({c: pa.chunked_array([x.cast(types[c]) for t in ts for x in t.chunks], types[c]).combine_chunks() for c, ts in found.items()})

    return run


def best_matches(
    running: DataFrame, history: DataFrame, abnormal_z: float = 1.5, calm: float = 0.20, block: int = 8000, least: float = 0.0, cells: int = 500_000
) -> DataFrame:
    """lot_id, match, similarity: for each running lot the most similar low-yield lot; equal ones: the smaller lot_id.

    Lots without a match of at least that similarity may be left out. Blocks are smaller than `block` while there are fewer than four for each core.
    """
    # Blocks hold the sources as numbers, which take a quarter of the memory. Only sources of running lots count.
    running = materialize(running.select("lot_id", "source", "z"), "running_readings")
    numbers = running.select("source").distinct().select("source", F.row_number().over(W.orderBy("source")).alias("number"))
    numbers = ops.small(materialize(numbers, "source_numbers"))
    pack = lambda t: t.join(numbers, "source").groupBy("lot_id").agg(F.collect_list("number").alias("sources"), F.collect_list("z").alias("zs"))
    a = materialize(pack(running), "running")
    b = materialize(pack(history).select(F.col("lot_id").alias("old_lot"), F.col("sources").alias("old_sources"), F.col("zs").alias("old_zs")), "history")
    lots = [t.count() for t in (a, b)]
    block = min(block, max(1000, math.isqrt(lots[0] * lots[1] // (4 * running.sparkSession.sparkContext.defaultParallelism))))
    na, nb = (max(1, -(-n // block)) for n in lots)
    a = a.withColumn("qa", F.pmod(F.xxhash64("lot_id"), F.lit(na)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    b = b.withColumn("qb", F.pmod(F.xxhash64("old_lot"), F.lit(nb)).cast("int")).withColumn("qa", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))
    found = a.groupBy("qa", "qb").cogroup(b.groupBy("qa", "qb")).applyInArrow(_best(abnormal_z, calm, least, cells), "lot_id string, match string, similarity double")
    t = found.groupBy("lot_id").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "match", "similarity")).alias("b"))
    return t.select("lot_id", F.col("b.match").alias("match"), F.col("b.similarity").alias("similarity"))


def at_risk(lots: DataFrame, z: DataFrame, signatures: DataFrame, statuses: tuple[str, ...] = ("in_progress",), least: float = 0.50) -> DataFrame:
    """z: of fingerprints(), best written. Running lots of at least that risk: lot_id, risk_score, matched_signature, match."""
    running = z.join(lots.filter(F.col("status").isin(*statuses)).select("lot_id"), "lot_id", "left_semi")
    history = z.join(lots.filter("cohort = 'affected'").select("lot_id"), "lot_id", "left_semi")
    lowest = 0.05  # every lot has at least that risk
    t = best_matches(running, history, least=least if least > lowest else 0.0).withColumn("risk", F.least(F.greatest("similarity", F.lit(lowest)), F.lit(0.96))).filter(F.col("risk") >= least)
    sign = signatures.select(F.col("lot_id").alias("match"), "signature")
    return t.join(sign, "match", "left").select("lot_id", F.bround("risk", 4).alias("risk_score"), F.coalesce("signature", F.lit("random")).alias("matched_signature"), "match")
