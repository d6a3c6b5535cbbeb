"""Percentiles with a bounded relative rank error, from sketches that merge.

A sketch is a stack of relative compactors. The buffer of level h holds values of weight 2**h. When it is
full it is sorted; the part next to the protected tail stays, and of the rest every second value moves up a
level, so ranks near the protected tail are hardly disturbed. How much is compacted follows a schedule (one
section most times, two every second time, four every fourth, ...), which makes the error of a rank r
proportional to r. Sketches of partitions, days or files merge level by level.

Each source has two sketches, one that protects the low tail and one, over the negated values, that protects
the high tail; percentiles up to 50 come from the first, those above from the second. The error of an
estimate's rank is at most rank_error(k) * min(rank, n - rank) with 99.7 % confidence, whatever n; the 384
values (k = 64) next to either end are kept as they are.

Null and NaN are no values. Infinite values are ordered like others. Rows with a null in a key are left out.
A source without values has no row, an empty table gives none. Equal values count as often as they occur. The
choice of every second value is made from the sketch's own contents, so a retried task gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

K = 64
SECTIONS = 3


def rank_error(k: int = K) -> float:
    """Three standard errors of a rank, relative to its distance from the protected end."""
    return 3 * float(np.sqrt(0.0512 / SECTIONS)) / k


class Compactors:
    """One sketch; protects the low tail."""

    def __init__(self, k: int = K):
        self.k, self.n = k, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.done: list[int] = [0]  # the schedule: compactions so far, per level

    def _capacity(self, h: int) -> int:
        return 2 * self.k * max(SECTIONS, int(self.done[h]).bit_length())

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._settle()

    def merge(self, other: Compactors) -> None:
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.done.append(0)
        for h, (values, done) in enumerate(zip(other.levels, other.done)):
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.done[h] |= done
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            cap = self._capacity(h)
            if len(self.levels[h]) >= cap:
                values = np.sort(self.levels[h])
                ones = (self.done[h] ^ (self.done[h] + 1)).bit_length() - 1  # trailing ones of the schedule
                keep = cap - min(ones + 1, cap // self.k // 2) * self.k
                keep += (len(values) - keep) % 2
                coin = int(np.random.default_rng([self.n, h, self.done[h]]).integers(2))
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.done.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[keep:][coin::2]])
                self.levels[h] = values[:keep]
                self.done[h] += 1
            h += 1

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        """The smallest kept value whose estimated rank reaches share * n, for each share."""
        values = np.concatenate(self.levels)
        weights = np.repeat(2.0 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.maximum(1, np.ceil(shares * self.n - 1e-9)))
        return values[order][np.minimum(at, len(values) - 1)]

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, len(self.levels), *map(len, self.levels), *self.done], dtype=np.int64)
        return head.tobytes() + np.concatenate(self.levels).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Compactors:
        k, n, m = np.frombuffer(data, np.int64, 3)
        head = np.frombuffer(data, np.int64, 2 * m, 24)
        s = cls(int(k))
        s.n, s.done = int(n), [int(x) for x in head[m:]]
        s.levels = np.split(np.frombuffer(data, np.float64, int(head[:m].sum()), 24 + 16 * int(m)), np.cumsum(head[: m - 1]))
        return s


def _build(keys: Sequence[str], k: int, batch: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        own: dict[tuple, tuple[Compactors, Compactors]] = {}
        kept: list[pd.DataFrame] = []

        def take() -> None:
            pdf = pd.concat(kept, ignore_index=True)
            kept.clear()
            codes, names = pd.factorize(pd.MultiIndex.from_frame(pdf[list(keys)]))
            order = np.argsort(codes, kind="stable")
            values = pdf["v"].to_numpy()[order]
            ends = np.cumsum(np.bincount(codes, minlength=len(names)))
            for name, a, b in zip(names, np.r_[0, ends[:-1]], ends):
                low, high = own.setdefault(name, (Compactors(k), Compactors(k)))
                low.add(values[a:b])
                high.add(-values[a:b])

        def states() -> pd.DataFrame:
            rows = [(*name, part, low.n, low.to_bytes(), high.to_bytes()) for name, (low, high) in own.items()]
            own.clear()
            return pd.DataFrame(rows, columns=[*keys, "part", "n", "low", "high"])

        for pdf in batches:
            kept.append(pdf)
            if sum(map(len, kept)) >= batch:
                take()
                if len(own) > most:  # many sources: pass on what there is instead of holding all of them
                    yield states()
        if kept:
            take()
        if own:
            yield states()

    return run


def _combine(keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key: one state at a time is merged into the key's sketch; no group is collected."""
        now, low, high = None, None, None
        columns = [*keys, "part", "n", "low", "high"]
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, x) for x in (*keys, "up"))
                a, b = Compactors.from_bytes(row.low), Compactors.from_bytes(row.high)
                if key == now:
                    low.merge(a)
                    high.merge(b)
                    continue
                if now is not None:
                    rows.append((*now, low.n, low.to_bytes(), high.to_bytes()))
                now, low, high = key, a, b
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if now is not None:
            yield pd.DataFrame([(*now, low.n, low.to_bytes(), high.to_bytes())], columns=columns)

    return run


def build_sketches(df: DataFrame, keys: dict[str, Column], value: Column, k: int = K, batch: int = 200_000, most: int = 5_000) -> DataFrame:
    """One state per key and partition: key columns, part, n, low, high. States of several tables may be put together."""
    rows = df.select(*[c.alias(x) for x, c in keys.items()], value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    for x in keys:
        rows = rows.filter(F.col(x).isNotNull())
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in keys], "part int", "n long", "low binary", "high binary"])
    return rows.mapInPandas(_build(list(keys), k, batch, most), schema)


def merge_sketches(states: DataFrame, keys: Sequence[str], parts: int = 1, fan: int = 256) -> DataFrame:
    """One state per key, merged as a tree: a key's states of at most fan parts are merged by one task, one by one.

    parts: the number of different values of part (0 .. parts - 1). Key columns left out of keys, such as the
    day, are merged away.
    """
    kinds = dict(states.dtypes)
    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in keys], "part int", "n long", "low binary", "high binary"])
    while True:
        up = F.floor(F.col("part") / fan).cast("int")
        ordered = states.select(*keys, "part", "n", "low", "high", up.alias("up")).repartition(*keys, "up").sortWithinPartitions(*keys, "up", "part", "n", F.xxhash64("low"))
        states = ordered.mapInPandas(_combine(keys), schema)
        parts = -(-parts // fan)
        if parts <= 1:
            return states


def percentiles(states: DataFrame, keys: Sequence[str], at: Sequence[float], k: int = K) -> DataFrame:
    """Key columns, n, pct, value and rank_error, one row per key and percentile, from merged states."""
    shares = np.array(at) / 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            values = []
            for a, b in zip(pdf["low"], pdf["high"]):
                low, high = Compactors.from_bytes(a), Compactors.from_bytes(b)
                # The value of rank r from below has rank n + 1 - r from above.
                above = (low.n + 1 - np.maximum(1, np.ceil(shares * low.n - 1e-9))) / low.n
                values.append(np.where(shares <= 0.5, low.quantiles(shares), -high.quantiles(above)))
            out = pdf[[*keys, "n"]].loc[pdf.index.repeat(len(shares))].reset_index(drop=True)
            yield out.assign(pct=np.tile(np.array(at, float), len(pdf)), value=np.concatenate(values), rank_error=rank_error(k))

    kinds = dict(states.dtypes)
    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in keys], "n long", "pct double", "value double", "rank_error double"])
    return states.select(*keys, "n", "low", "high").mapInPandas(run, schema)


def brackets(states: DataFrame, keys: Sequence[str], at: Sequence[float], k: int = K) -> DataFrame:
    """Key columns, n, pct, low, high: values between which the exact percentile lies, two stated errors of rank to each side."""
    shares = np.array(at) / 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            low, high = [], []
            for a, b in zip(pdf["low"], pdf["high"]):
                below, above = Compactors.from_bytes(a), Compactors.from_bytes(b)
                n = below.n
                want = np.maximum(1, np.ceil(shares * n - 1e-9))
                reach = 2 * rank_error(k) * np.minimum(want, n + 1 - want) + 1
                value = lambda rank: np.where(rank <= n / 2, below.quantiles(rank / n), -above.quantiles((n + 1 - rank) / n))  # noqa: B023, E731
                low.append(value(np.maximum(1, want - reach)))
                high.append(value(np.minimum(n, want + reach)))
            out = pdf[[*keys, "n"]].loc[pdf.index.repeat(len(shares))].reset_index(drop=True)
            yield out.assign(pct=np.tile(np.array(at, float), len(pdf)), low=np.concatenate(low), high=np.concatenate(high))

    kinds = dict(states.dtypes)
    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in keys], "n long, pct double, low double, high double"])
    return states.select(*keys, "n", "low", "high").mapInPandas(run, schema)
