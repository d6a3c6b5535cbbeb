"""Implausible readings per source: spikes, stuck values and readings that cannot be.

The rows are range-partitioned by (source, time), so a source of any size is spread over as many tasks
as its rows need, sorted, numbered and written once. Tasks then stream the written rows in chunks that overlap. The
first and last readings of a source within a stretch of rows lack neighbours, which another task reads; they come out
as edge rows and are looked at in a second, small step. A stretch ends where the numbers do, so it doesn't
matter how Spark splits the files.

There are two passes over the written rows. The first measures each source as a whole: a histogram of
its first differences, of which the median is its usual scatter, and how often the deviations from a moving
median keep their sign, which is its autocorrelation. Both are counts that add up to the same whatever the chunks and
partitions are. The second pass judges the readings by them, so a verdict depends on the source and the
readings around it, not on how the rows were cut.

Method: a robust autoregression of the deviations from a moving median level; the scatter comes from
first differences, so neither wandering levels nor spikes inflate it. Readings whose additive-outlier
statistic is large are set aside and level and residuals are estimated again, until no more are found. A
level-shift test then compares each with the clean readings before and after it: where it agrees with
either, the level has changed and it is no spike.

Defined results: null and NaN values, and rows without source or time, are no readings. Infinite values
are readings. Copies (rows equal in all but the id) count once and share their verdict. Readings of equal
time are ordered by content and id. A source of fewer than min_readings readings, an empty table, and a
source that never varies apart from its stuck runs have no spikes. Extra columns only tell copies apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from yieldloom.functions.columns import content_hash
from yieldloom.session import materialize

#: Most sources whose measures are broadcast; with more they are joined by shuffle and the rows put in order again.
BROADCAST_SOURCES = 1_000_000


@dataclass(frozen=True)
class SpikeConfig:
    #: A spike lies more than this many scatters from its level (cases: 8; ordinary readings: up to 4).
    limit: float = 6.5
    #: Readings on each side that make up the level.
    half: int = 10
    #: Clean readings on each side that a reading is compared with.
    side: int = 5
    rounds: int = 4
    #: Equal readings in a row that are a stuck run.
    stuck: int = 8
    min_readings: int = 20
    #: Unique readings beyond which a neighbour no longer matters: (half + 1) * rounds, and side clean ones.
    halo: int = 64
    #: Unique readings of a chunk.
    chunk: int = 50_000
    #: Cells of the histogram of differences per factor of two: the scatter is known to 0.6 %.
    cells: int = 64
    #: Physical limits: readings beyond them cannot be, whatever their source does.
    lowest: float = -1e7
    highest: float = 1e7


def _moving_median(y: np.ndarray, half: int) -> np.ndarray:
    """Median of the 2 * half + 1 readings around each; fewer at the ends."""
    width = 2 * half + 1
    if len(y) <= width:
        return np.array([np.median(y[max(0, i - half) : i + half + 1]) for i in range(len(y))])
    mid = np.empty(len(y))
    view = np.lib.stride_tricks.sliding_window_view(y, width)
    for a in range(0, len(view), 65_536):
        part = np.partition(view[a : a + 65_536], half, axis=1)
        mid[half + a : half + a + len(part)] = part[:, half]
    for i in [*range(half), *range(len(y) - half, len(y))]:
        mid[i] = np.median(y[max(0, i - half) : i + half + 1])
    return mid


def run_lengths(y: np.ndarray) -> np.ndarray:
    """For each reading the length of the run of equal readings it belongs to."""
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    length = np.diff(np.r_[first, len(y)])
    return np.repeat(length, length)


def measure(y: np.ndarray, lo: int, hi: int, c: SpikeConfig) -> tuple[dict[int, int], int, int]:
    """Counts over the readings lo..hi - 1, the others being context: cells of |difference to the one before|, how often the
    deviation has the sign of the one before, less how often it has the other, and how often both have a sign.

    Differences within runs of three and more equal readings don't count. Cell 0 holds differences of 0.
    """
    runs = run_lengths(y)
    at = np.arange(max(lo, 1), hi)
    d = np.abs(y[at] - y[at - 1])
    d = d[((d > 0) | (runs[at] < 3)) & (d < 1e99)]
    cell = np.zeros(len(d), np.int64)
    # np.frexp is exact, so equal differences share a cell on every machine.
    part, power = np.frexp(d[d > 0])
    cell[d > 0] = (power.astype(np.int64) + 2000) * c.cells + np.floor((part - 0.5) * 2 * c.cells).astype(np.int64)
    cells, counts = np.unique(cell, return_counts=True)
    sign = np.sign(y - _moving_median(y, c.half))
    both = sign[at] * sign[at - 1]
    return dict(zip(cells.tolist(), counts.tolist())), int(both.sum()), int(np.abs(both).sum())


def scatter(cell: Column, c: SpikeConfig) -> Column:
    """Robust scale of the readings around their level from the cell of their median difference, as the middle of that cell."""
    middle = 0.5 + (F.pmod(cell, F.lit(c.cells)) + 0.5) / (2 * c.cells)
    return F.when(cell > 0, 1.4826 / np.sqrt(2).item() * middle * F.pow(F.lit(2.0), F.floor(cell / c.cells) - 2000)).otherwise(0.0)


def find_spikes(y: np.ndarray, s: float, phi: float, c: SpikeConfig) -> np.ndarray:
    """Which of a source's readings, in order of time, are spikes. See the module's text for the method."""
    n = len(y)
    out = np.zeros(n, bool)
    if n < 3 or not s > 0:
        return out
    clean = y.copy()
    for _ in range(c.rounds):
        level = _moving_median(clean, c.half)
        dev = np.clip(y - level, -1e6 * s, 1e6 * s)
        prev = np.r_[0.0, np.where(out[:-1], 0.0, dev[:-1])]
        # Innovation at t; an outlier set aside before t doesn't predict it.
        e = dev - phi * np.clip(prev, -3 * s, 3 * s)
        new = (np.abs(e) > 0.75 * c.limit * s) & ~out
        if not new.any():
            break
        out |= new
        clean[out] = level[out]
    # Level-shift test: the clean readings before and after, which a changed level agrees with on one side.
    good = np.flatnonzero(~out)
    at = np.flatnonzero(out)
    if not len(good) or not len(at):
        return np.zeros(n, bool)
    pos = np.searchsorted(good, at)
    padded = np.r_[np.full(c.side, np.nan), y[good], np.full(c.side, np.nan)]
    view = np.lib.stride_tricks.sliding_window_view(padded, c.side)
    before, after = _nanmedian(view[pos]), _nanmedian(view[pos + c.side])
    far_b = ~(np.abs(y[at] - before) <= c.limit * s)
    far_a = ~(np.abs(y[at] - after) <= c.limit * s)
    # With readings on one side only, that side decides.
    verdict = np.zeros(n, bool)
    verdict[at] = far_b & far_a
    return verdict


def _nanmedian(rows: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN for a row of nothing else."""
    out = np.full(len(rows), np.nan)
    some = ~np.isnan(rows).all(axis=1)
    out[some] = np.nanmedian(rows[some], axis=1)
    return out


def judge(y: np.ndarray, s: float, phi: float, c: SpikeConfig) -> np.ndarray:
    """0 ordinary, 1 spike, 2 stuck, 3 beyond the physical limits; for readings in order of time."""
    kind = np.where(find_spikes(y, s, phi, c), 1, 0)
    kind[(y < c.lowest) | (y > c.highest)] = 3
    kind[run_lengths(y) >= c.stuck] = 2
    return kind.astype("int32")


@dataclass
class _Piece:
    """Rows of one source in order, of which the unique readings lo..hi - 1 are looked at and the rest is context."""

    tool: str
    param: str
    s: float
    phi: float
    id: np.ndarray
    h: np.ndarray
    v: np.ndarray
    pos: np.ndarray
    of: np.ndarray  # the unique reading of each row
    y: np.ndarray  # the unique readings; infinite ones are large numbers, so that they can be subtracted
    lo: int
    hi: int
    first: bool  # whether the stretch's first and last readings are in it
    last: bool
    stretch: int  # the number of the stretch's first row


def _unique(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.r_[True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])] if len(h) else np.empty(0, bool)


def _pieces(batches: Iterator[pd.DataFrame], c: SpikeConfig) -> Iterator[_Piece]:
    """The rows of a task, stretch by stretch, in chunks that overlap by two halos.

    A stretch is rows of one source with successive numbers. Its first and last `halo` unique readings are in no
    piece's lo..hi.
    """
    h = c.halo
    key, buf, first, stretch, after = None, [], True, 0, -1

    def piece(last: bool) -> _Piece:
        nonlocal buf, first
        ids, hs, vs, pos = (np.concatenate([b[i] for b in buf]) for i in range(4))
        new = _unique(hs, vs)
        n = int(new.sum())
        out = _Piece(*key, ids, hs, vs, pos, np.cumsum(new) - 1, np.clip(vs[new], -1e100, 1e100), h, n - h, first, last, stretch)
        if not last:  # two halos stay: one is context, one is still to be looked at
            keep = int(np.flatnonzero(new)[n - 2 * h])
            buf, first = [(ids[keep:], hs[keep:], vs[keep:], pos[keep:])], False
        return out

    for pdf in batches:
        if not len(pdf):
            continue
        tool, param = pdf["tool"].to_numpy(), pdf["param"].to_numpy()
        arrays = [pdf[x].to_numpy() for x in ("id", "h", "v", "pos")]
        cut = np.flatnonzero(np.r_[True, (tool[1:] != tool[:-1]) | (param[1:] != param[:-1]) | (np.diff(arrays[3]) != 1)])
        s, phi = (pdf[x].to_numpy() if x in pdf else np.zeros(len(pdf)) for x in ("s", "phi"))
        for a, b in zip(cut, [*cut[1:], len(pdf)]):
            k = (tool[a], param[a], float(s[a]), float(phi[a]))
            if k != key or arrays[3][a] != after:
                if key is not None:
                    yield piece(last=True)
                key, buf, first, stretch = k, [], True, int(arrays[3][a])
            after = arrays[3][b - 1] + 1
            buf.append(tuple(x[a:b] for x in arrays))
            if sum(len(x[0]) for x in buf) >= c.chunk + 4 * h:
                hs, vs = (np.concatenate([x[i] for x in buf]) for i in (1, 2))
                if _unique(hs, vs).sum() >= c.chunk // 2 + 4 * h:
                    yield piece(last=False)
    if key is not None:
        yield piece(last=True)


_EDGE = "tool string, param string, stretch long, side int, pos long, id long, h long, v double, s double, phi double, n long, kind int"
_EDGE_COLUMNS = [x.split()[0] for x in _EDGE.split(", ")]
#: side of a row: the first rows of a stretch, its last ones, all of a short one; or a result.
HEAD, TAIL, ALL, RESULT = 0, 1, 2, 9


def _edges(p: _Piece, c: SpikeConfig) -> Iterator[pd.DataFrame]:
    """The rows around the ends of a stretch, with kind 1 for those that are looked at with the neighbours."""
    h, n = c.halo, len(p.y)
    parts = []
    if _short(p, c):
        parts.append((ALL, p.of >= 0, p.of >= 0))
    else:
        if p.first:
            parts.append((HEAD, p.of < 2 * h, p.of < h))
        if p.last:
            parts.append((TAIL, p.of >= n - 2 * h, p.of >= n - h))
    for side, m, own in parts:
        yield pd.DataFrame(dict(pos=p.pos[m], id=p.id[m], h=p.h[m], v=p.v[m], kind=own[m].astype("int32"))).assign(
            tool=p.tool, param=p.param, stretch=p.stretch, side=side, s=p.s, phi=p.phi, n=0)[_EDGE_COLUMNS]


def _results(p, **columns) -> dict:
    """Columns of results of one source; those that aren't given are 0."""
    n = len(next(iter(columns.values())))
    return {**dict.fromkeys(_EDGE_COLUMNS, np.zeros(n)), "tool": np.repeat(p.tool, n), "param": np.repeat(p.param, n), "side": np.full(n, RESULT), **columns}


def _frame(parts: list[dict]) -> pd.DataFrame:
    t = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in _EDGE_COLUMNS})
    return t.astype({k: np.int64 for k in ("stretch", "pos", "id", "h", "n")} | {"side": np.int32, "kind": np.int32})


def _short(p: _Piece, c: SpikeConfig) -> bool:
    return p.first and p.last and len(p.y) <= 4 * c.halo


#: pos of a measure's row: signs that stay (h) of all (n), unique readings (n); other rows: cell (h) and count (n).
SIGNS, READINGS, CELL = -1, -2, -3


def _measured(p, y: np.ndarray, lo: int, hi: int, c: SpikeConfig) -> dict:
    cells, same, both = measure(y, lo, hi, c)
    rows = np.array([(SIGNS, same, both), (READINGS, 0, hi - lo), *((CELL, k, n) for k, n in cells.items())], np.int64)
    return _results(p, pos=rows[:, 0], h=rows[:, 1], n=rows[:, 2])


def _judged(p, y: np.ndarray, of: np.ndarray, ids: np.ndarray, own: np.ndarray, c: SpikeConfig) -> dict:
    """own: which unique readings are looked at."""
    kind = np.where(own, judge(y, p.s, p.phi, c), 0)[of]
    return _results(p, id=ids[kind > 0], kind=kind[kind > 0])


def _stream(c: SpikeConfig, judging: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _pieces(batches, c):
            yield from _edges(p, c)
            if not _short(p, c) and p.hi > p.lo:
                own = np.zeros(len(p.y), bool)
                own[p.lo : p.hi] = True
                yield _frame([_judged(p, p.y, p.of, p.id, own, c) if judging else _measured(p, p.y, p.lo, p.hi, c)])

    return run


def _seams(c: SpikeConfig, judging: bool):
    """The rows around the seams between two stretches of a source, and around its ends; sorted by seam and place."""

    def one(g: pd.DataFrame) -> dict:
        h, v, ids, kind = (g[x].to_numpy() for x in ("h", "v", "id", "kind"))
        first = _unique(h, v)
        y = np.clip(v[first], -1e100, 1e100)
        own = kind[first] > 0
        p = next(g.iloc[:1].itertuples())
        if judging:
            return _judged(p, y, np.cumsum(first) - 1, ids, own, c)
        at = np.flatnonzero(own)  # a seam's own readings are one stretch
        return _measured(p, y, int(at[0]), int(at[-1]) + 1, c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last seam of the batches so far; a seam has few rows
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            keys = [pdf[k].to_numpy() for k in ("tool", "param", "at")]
            cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            if len(cut) > 1:
                yield _frame([one(pdf.iloc[a:b]) for a, b in zip(cut, cut[1:])])
            kept = pdf.iloc[cut[-1] :]
        if kept is not None:
            yield _frame([one(kept)])

    return run


def _both(out: DataFrame, c: SpikeConfig, judging: bool) -> DataFrame:
    """The results within stretches and those at the seams; out: what _stream gave, written.

    A seam takes the last rows of a stretch and the first ones of the source's next. A short stretch is in the seam
    with the one before, or, where there is none, with the next.
    """
    here = out.filter(F.col("side") != RESULT)
    w = W.partitionBy("tool", "param").orderBy("stretch")  # one row per stretch: as many as tasks and sources, whatever the number of readings
    parts = here.select("tool", "param", "stretch").distinct().select("tool", "param", "stretch", F.lag("stretch").over(w).alias("before"), F.lead("stretch").over(w).alias("after"))
    to_next = (F.col("side") == TAIL) | ((F.col("side") == ALL) & F.col("before").isNull() & F.col("after").isNotNull())
    edges = here.join(parts, ["tool", "param", "stretch"]).withColumn("at", F.when(to_next, F.coalesce("after", -1 - F.col("stretch"))).otherwise(F.col("stretch")))
    keys = ["tool", "param", "at"]
    seams = edges.select(*keys, "pos", "id", "h", "v", "s", "phi", "kind").repartition(*keys).sortWithinPartitions(*keys, "pos").mapInPandas(_seams(c, judging), _EDGE)
    return out.filter(F.col("side") == RESULT).unionByName(seams)


def measures(out: DataFrame, c: SpikeConfig) -> DataFrame:
    """tool, param, s, phi, readings of each source, from what the first pass gave."""
    source = ["tool", "param"]
    is_ = lambda kind: F.col("pos") == kind
    t = _both(out, c, False).groupBy(*source, "pos", F.when(is_(CELL), F.col("h")).alias("cell")).agg(F.sum("n").alias("n"), F.sum("h").alias("same"))
    # As many rows as a source's differences have orders of magnitude, times cells.
    w = W.partitionBy(*source, "pos")
    t = t.withColumn("below", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    agree = F.try_divide(F.sum(F.when(is_(SIGNS), F.col("same"))), F.sum(F.when(is_(SIGNS), F.col("n"))))
    t = t.groupBy(*source).agg(
        F.min(F.when(is_(CELL) & (2 * F.col("below") >= F.col("all")), F.col("cell"))).alias("cell"), F.sum(F.when(is_(READINGS), F.col("n"))).alias("readings"),
        # Of normal deviations with correlation phi, signs agree so often.
        F.least(F.greatest(F.coalesce(F.sin(math.pi / 2 * agree), F.lit(0.0)), F.lit(-0.9)), F.lit(0.9)).alias("phi"),
    )
    return t.select(*source, F.coalesce(scatter(F.col("cell"), c), F.lit(0.0)).alias("s"), "phi", "readings")


def flag_readings(
    df: DataFrame, id_col: str, tool: Column, param: Column, ts: str, value: str, config: SpikeConfig = SpikeConfig(), partitions: int | None = None
) -> DataFrame:
    """The implausible readings of each source (tool, param): columns id, tool, param, kind (spike, stuck, impossible)."""
    c = config
    rows = df.select(
        tool.alias("tool"), param.alias("param"), F.col(ts).alias("ts"), F.col(id_col).alias("id"),
        content_hash([x for x in df.columns if x != id_col]).alias("h"), F.col(value).cast("double").alias("v"),
    ).filter(F.col("tool").isNotNull() & F.col("param").isNotNull() & F.col("ts").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    order = ["tool", "param", "ts", "h", "id"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).select("tool", "param", "id", "h", "v", F.monotonically_increasing_id().alias("pos"))
    placed = materialize(placed, "readings")
    out = materialize(placed.mapInPandas(_stream(c, False), _EDGE), "measured")
    known = materialize(measures(out, c).filter(F.col("readings") >= c.min_readings).drop("readings"), "sources")
    if known.count() <= BROADCAST_SOURCES:
        judged = placed.join(F.broadcast(known), ["tool", "param"])
    else:
        judged = placed.join(known, ["tool", "param"]).repartitionByRange("pos").sortWithinPartitions("pos")
    judged = judged.select("tool", "param", "id", "h", "v", "pos", "s", "phi").mapInPandas(_stream(c, True), _EDGE)
    names = F.element_at(F.array(*[F.lit(x) for x in ("spike", "stuck", "impossible")]), F.col("kind"))
    return _both(materialize(judged, "judged"), c, True).filter("kind > 0").select("id", "tool", "param", names.alias("kind"))
