"""Clusters of points in the plane, per space (here: per wafer), from mergeable cluster-feature trees.

1. Each task builds a cluster-feature (CF) tree per space over the points it reads. A leaf entry is a CF: count, mean, sum of
   squared deviations, bounding box and smallest id of points whose box has a diagonal of at most the threshold, half a
   link. Points are taken in along a Z-curve: one is absorbed by its neighbour's entry as long as the threshold
   holds. Inner nodes are the boxes of `branch` successive entries. Entries of more than `keep` points leave the task as
   one summary, whatever the number of points; the points of small ones leave as they are.
2. The summaries and points of a space are merged to one tree in the same way, entries being absorbed like points.
   From there on a space costs as much as it has entries, which its area bounds per task.
3. Leaves are linked when points of both are within `link`, found by descending the tree. Ward agglomeration merges
   linked clusters, those with the least increase first, while the increase is at most `limit`: these compact clusters
   are the parts. Parts with linked leaves make up a group.
4. One pass assigns every point to the part and group of its leaf; the members nearest to a group's centroid
   are its most typical ones.

Groups are exact for points: two points are in one group if and only if a chain of steps of at most `link` joins them.
Only a summary of more than `keep` points of one task stands for its box, so that a point up to link and threshold
away from one of its points may be taken for linked.

Nulls: rows without space or coordinates, or with coordinates that are NaN or out of bounds, are in no
cluster. Repeated points are members of their own. Ties of distance go to the smaller id. An empty table
gives no clusters. Other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from yieldloom.functions.columns import between
from yieldloom.session import materialize

#: Kinds of rows: points, summaries of entries, their members; results for groups and parts.
POINT, ENTRY, MEMBER, GROUP, PART = range(5)


@dataclass(frozen=True)
class ClusterConfig:
    link: float
    min_size: int = 1
    low: float = -1.0
    high: float = 1.0
    #: Largest increase of the squared deviations by a merge of parts; None: the square of the link.
    limit: float | None = None
    branch: int = 8
    keep: int = 8
    #: Points a task takes in before it passes its trees on, and entries of a batch of whole spaces.
    buffer: int = 200_000
    batch: int = 50_000


CF = ["n", "mx", "my", "dev", "x0", "x1", "y0", "y1", "least"]


def features(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Points as cluster features of one."""
    return {"n": np.ones(len(x)), "mx": x, "my": y, "dev": np.zeros(len(x)), "x0": x, "x1": x, "y0": y, "y1": y, "least": ids}


def merged(f: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
    """Successive features added up, from each start to the next."""
    n = np.add.reduceat(f["n"], starts)
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(f["n"])]))
    mx, my = (np.add.reduceat(f["n"] * f[c], starts) / n for c in ("mx", "my"))
    moved = f["n"] * ((f["mx"] - mx[of]) ** 2 + (f["my"] - my[of]) ** 2)
    low = {c: np.minimum.reduceat(f[c], starts) for c in ("x0", "y0", "least")}
    return {"n": n, "mx": mx, "my": my, "dev": np.add.reduceat(f["dev"] + moved, starts), **low, **{c: np.maximum.reduceat(f[c], starts) for c in ("x1", "y1")}}


def curve(x: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The place of each point on a Z-curve of 2**16 steps a side."""
    out = np.zeros(len(x), np.int64)
    for shift, v in enumerate((x, y)):
        q = np.clip((v - low) / (high - low) * 65_535, 0, 65_535).astype(np.int64)
        for bit in range(16):
            out |= ((q >> bit) & 1) << (2 * bit + shift)
    return out


def absorb(space: np.ndarray, f: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """Where the leaf entries begin, of features sorted by space and curve: neighbours are merged, pair by pair, in
    rounds, as long as the box of both has a diagonal of at most the threshold."""
    starts = np.arange(len(space))
    while len(starts) > 1:
        box = {c: (np.minimum if c in ("x0", "y0") else np.maximum).reduceat(f[c], starts) for c in ("x0", "y0", "x1", "y1")}
        side = lambda lo, hi: np.maximum(box[hi][1:], box[hi][:-1]) - np.minimum(box[lo][1:], box[lo][:-1])
        fits = (space[starts[1:]] == space[starts[:-1]]) & (np.hypot(side("x0", "x1"), side("y0", "y1")) <= threshold)
        if not fits.any():
            break
        at = np.arange(len(fits))
        run = np.maximum.accumulate(np.where(fits & ~np.r_[False, fits[:-1]], at, 0))
        starts = np.delete(starts, np.flatnonzero(fits & ((at - run) % 2 == 0)) + 1)
    return starts


def _expand(a: np.ndarray, b: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of a and one of b, each pair of nodes once, and which pair (a, b) they come from."""
    many = counts[a] * counts[b]
    of = np.repeat(np.arange(len(a)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    i, j = starts[a[of]] + k // counts[b[of]], starts[b[of]] + k % counts[b[of]]
    once = (a[of] != b[of]) | (i <= j)
    return i[once], j[once], of[once]


def _near(f: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, link: float) -> np.ndarray:
    gap = lambda lo, hi: np.maximum(0, np.maximum(f[lo][i] - f[hi][j], f[lo][j] - f[hi][i]))
    return np.hypot(gap("x0", "x1"), gap("y0", "y1")) <= link * (1 + 1e-9)


def leaf_links(space: np.ndarray, items: dict[str, np.ndarray], starts: np.ndarray, leaves: dict[str, np.ndarray], link: float, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (a < b) of one space with items within link; starts: where the leaves' items begin."""
    levels, at = [], space[starts]
    nodes = leaves
    while True:  # from the leaves up to one root a space
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        if len(first) == len(at):
            break
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        up = np.flatnonzero(rank % branch == 0)
        levels.append((nodes, up, np.diff(np.r_[up, len(at)])))
        nodes = {c: (np.minimum if c in ("x0", "y0") else np.maximum).reduceat(nodes[c], up) for c in ("x0", "x1", "y0", "y1")}
        at = at[up]
    a = b = np.arange(len(at))
    for below, up, counts in reversed(levels):
        a, b, _ = _expand(a, b, up, counts)
        near = _near(below, a, b, link)
        a, b = a[near], b[near]
    a, b = a[a < b], b[a < b]
    i, j, of = _expand(a, b, starts, np.diff(np.r_[starts, len(space)]))
    sure = np.unique(of[_near(items, i, j, link)])
    return a[sure], b[sure]


def ward(f: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Ward agglomeration along the links (a, b): the label of each leaf, the index of one leaf of its cluster.

    All pairs of clusters that are each other's cheapest neighbour merge in one round: Ward's increase never
    falls by merging others, so the order of such merges doesn't matter.
    """
    n, mx, my = (f[c].astype(float).copy() for c in ("n", "mx", "my"))
    label = np.arange(len(n))
    while len(a):
        cost = n[a] * n[b] / (n[a] + n[b]) * ((mx[a] - mx[b]) ** 2 + (my[a] - my[b]) ** 2)
        a, b, cost = (x[cost <= limit] for x in (a, b, cost))
        if not len(a):
            break
        # Equal costs: the pair with the smaller leaves first, so that some pair is always mutual.
        rank = np.empty(len(a), dtype=np.int64)
        rank[np.lexsort((b, a, cost))] = np.arange(len(a))
        best = np.full(len(n), len(a), dtype=np.int64)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        merge = (best[a] == rank) & (best[b] == rank)
        into, gone = a[merge], b[merge]
        both = n[into] + n[gone]
        for m in (mx, my):
            m[into] += (m[gone] - m[into]) * n[gone] / both
        n[into] = both
        to = np.arange(len(n))
        to[gone] = into
        label = to[label]
        a, b = to[a], to[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        pair = np.unique(a[a != b] * len(n) + b[a != b])
        a, b = pair // len(n), pair % len(n)
    return label


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of those joined by pairs (a, b), directly or over others, for each of n."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        least = least[label]
        while (least[least] != least).any():
            least = least[least]
        if (least == label).all():
            return label
        label = least


def _totals(f: dict[str, np.ndarray], label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The features of each label, and which of them each feature belongs to."""
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    of = np.empty(len(label), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(label)]))
    return merged({c: f[c][order] for c in CF}, starts), of


def _trees(space: Sequence[str], c: ClusterConfig):
    """Points in, in any order; summaries, points and members out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, next_ = [], TaskContext.get().partitionId() << 33

        def flush() -> pd.DataFrame:
            nonlocal next_
            pdf = pd.concat(kept, ignore_index=True)
            kept.clear()
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            order = np.lexsort((curve(x, y, c.low, c.high), pdf["k2"], pdf["k1"]))
            pdf = pdf.iloc[order]
            code = pdf.groupby(["k1", "k2"], sort=False).ngroup().to_numpy()
            f = features(pdf["id"].to_numpy(np.int64), x[order], y[order])
            starts = absorb(code, f, c.link / 2)
            size = np.diff(np.r_[starts, len(pdf)])
            big = size > c.keep
            leaf = np.where(big, next_ + np.cumsum(big), 0)
            next_ += int(big.sum()) + 1
            of = np.repeat(leaf, size)
            pdf = pdf.assign(role=np.where(of > 0, MEMBER, POINT).astype(np.int32), leaf=of, n=1, dev=0.0, x0=pdf["x"], x1=pdf["x"], y0=pdf["y"], y1=pdf["y"])
            if not big.any():
                return pdf
            whole = merged(f, starts)
            top = pdf.iloc[starts[big]].assign(role=np.int32(ENTRY), leaf=leaf[big], id=whole["least"][big], n=whole["n"][big].astype(np.int64), x=whole["mx"][big], y=whole["my"][big], **{k: whole[k][big] for k in ("dev", "x0", "x1", "y0", "y1")})
            return pd.concat([pdf, top], ignore_index=True)

        for pdf in batches:
            kept.append(pdf)
            if sum(map(len, kept)) >= c.buffer:
                yield flush()
        if kept and sum(map(len, kept)):
            yield flush()

    return run


def _agglomerate(space: Sequence[str], c: ClusterConfig):
    """Rows of _trees sorted by space in; points, entries, groups and parts of groups of at least min_size out."""
    limit = c.link**2 if c.limit is None else c.limit

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["id"], curve(pdf["x"].to_numpy(), pdf["y"].to_numpy(), c.low, c.high), pdf["k2"], pdf["k1"]))
        pdf = pdf.iloc[order]
        code = pdf.groupby(["k1", "k2"], sort=False).ngroup().to_numpy()
        items = {k: pdf[v].to_numpy() for k, v in zip(CF, ("n", "x", "y", "dev", "x0", "x1", "y0", "y1", "id"))}
        items["n"] = items["n"].astype(float)
        starts = absorb(code, items, c.link / 2)
        leaves = merged(items, starts)
        a, b = leaf_links(code, items, starts, leaves, c.link, c.branch)
        part = ward(leaves, a, b, limit)
        group = joined(len(starts), part[a], part[b])[part]
        groups, g = _totals(leaves, group)
        parts, p = _totals(leaves, part)
        item = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pdf)]))
        g, p, home = g[item], p[item], [x for x in space if x in pdf]
        kept = groups["n"][g] >= c.min_size
        entry = (pdf["role"] == ENTRY).to_numpy()
        d2 = (items["mx"] - groups["mx"][g]) ** 2 + (items["my"] - groups["my"][g]) ** 2
        rows = pdf[["role", *home]].assign(
            id=np.where(entry, pdf["leaf"], pdf["id"]), group_id=groups["least"][g], part=parts["least"][p], size=groups["n"][g].astype(np.int64),
            x=np.where(entry, groups["mx"][g], items["mx"]), y=np.where(entry, groups["my"][g], items["my"]), d2=d2)[kept]

        def totals(role: int, t: dict, of: np.ndarray) -> pd.DataFrame:
            _, first = np.unique(of[kept], return_index=True)
            i = of[kept][first]
            return rows.iloc[first].assign(role=np.int32(role), id=t["least"][i], size=t["n"][i].astype(np.int64), x=t["mx"][i], y=t["my"][i], d2=np.sqrt(t["dev"][i] / t["n"][i]))

        return pd.concat([rows, totals(GROUP, groups, g), totals(PART, parts, p)], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Many spaces at a time, only whole ones."""
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            kept.append(pdf)
            if sum(map(len, kept)) < c.batch:
                continue
            all_ = pd.concat(kept, ignore_index=True)
            last = ((all_["k1"] == all_["k1"].iloc[-1]) & (all_["k2"] == all_["k2"].iloc[-1])).to_numpy()
            if not last.all():
                yield batch(all_[~last])
            kept = [all_[last]] if not last.all() else [all_]
        if kept and sum(map(len, kept)):
            yield batch(pd.concat(kept, ignore_index=True))

    return run


def cluster(df: DataFrame, space: Sequence[str], id_col: str, x: str, y: str, c: ClusterConfig, names: bool = True) -> DataFrame:
    """Rows of roles POINT (id, group_id, part, size of the group, d2 to its centroid), GROUP (id, size, x, y, d2: radius) and PART
    (id, group_id, size, x, y, d2: radius), written once. names: whether the space columns come along; where they aren't needed they
    aren't moved, a space being known by a hash of 128 bits."""
    known = between(x, c.low, c.high) & between(y, c.low, c.high)
    for s in space:
        known = known & F.col(s).isNotNull()
    key = [F.xxhash64(*space).alias("k1"), F.xxhash64(F.lit("second"), *space).alias("k2")]
    home = list(space) if names else []
    points = df.filter(known).select(*home, *key, F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kinds = "".join(f"`{s}` {t}, " for s, t in points.select(*home).dtypes)
    trees = points.mapInPandas(_trees(home, c), f"{kinds}k1 long, k2 long, id long, x double, y double, role int, leaf long, n long, dev double, x0 double, x1 double, y0 double, y1 double")
    trees = materialize(trees, "trees")
    moved = trees.filter(F.col("role") != MEMBER).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    found = materialize(moved.mapInPandas(_agglomerate(home, c), f"role int, {kinds}id long, group_id long, part long, size long, x double, y double, d2 double"), "clusters")
    entries = found.filter(F.col("role") == ENTRY).select(F.col("id").alias("leaf"), *home, "group_id", "part", "size", F.col("x").alias("gx"), F.col("y").alias("gy"))
    members = trees.filter(F.col("role") == MEMBER).select("leaf", "id", "x", "y").join(entries, "leaf")
    d2 = (F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2
    members = members.select(F.lit(POINT).alias("role"), *home, "id", "group_id", "part", "size", "x", "y", d2.alias("d2"))
    return found.filter(F.col("role") != ENTRY).select(members.columns).unionByName(members)


def members(found: DataFrame) -> DataFrame:
    """Every point in a group: id, group_id, part, size, d2 and, if they came along, the space columns."""
    return found.filter(F.col("role") == POINT).drop("role", "x", "y")


def _typical(found: DataFrame, by: str, d2, count: int) -> DataFrame:
    # Spark keeps the best of each task before it moves rows, so a group of any size costs little.
    w = W.partitionBy(by).orderBy(F.round(d2, 12), "id")  # the order of summing decides no tie
    near = found.filter(F.col("role") == POINT).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count)
    return near.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda m: m["id"]).alias("typical"))


def described(found: DataFrame, space: Sequence[str], count: int = 3) -> DataFrame:
    """One row per group: its size, centroid, radius and the ids of the members nearest to the centroid."""
    groups = found.filter(F.col("role") == GROUP).select("group_id", *space, "size", F.col("x").alias("center_x"), F.col("y").alias("center_y"), F.col("d2").alias("radius"))
    return groups.join(_typical(found, "group_id", F.col("d2"), count), "group_id")


def parts(found: DataFrame, space: Sequence[str]) -> DataFrame:
    """One row per part, the compact clusters that Ward's limit leaves of a group: group_id, part (smallest id), size, centroid, radius."""
    return found.filter(F.col("role") == PART).select("group_id", "part", *space, "size", F.col("x").alias("center_x"), F.col("y").alias("center_y"), F.col("d2").alias("radius"))
