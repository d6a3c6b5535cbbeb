"""Packing items into containers of fixed capacity: bounded-space online best fit.

Each task keeps at most `windows` open containers. An item goes to the open container it leaves the least
space in; if none has room and all windows are open, the fullest is closed and a new one opened. What is still
open at the end of a task is packed again, in rounds over the open containers of up to `fan` tasks, until one
task has them all; at any time a task holds only its open windows. An item longer than the capacity is
split: its full pieces are containers by themselves and the rest is an item like others; nothing else is ever
split.

Items of size 0 or less, or without a size, need no container and have no row. Equal items are separate
items. An empty table gives no rows. Container ids are unique, not dense.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from yieldloom.session import materialize


class Windows:
    """The open containers of one task."""

    def __init__(self, capacity: int, windows: int, prefix: int):
        self.capacity, self.windows, self.next = capacity, windows, prefix << 32
        self.open: list[tuple[int, int]] = []  # (space left, container), sorted
        self.closed: list[int] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, size: int) -> int:
        """The container of an item of at most the capacity."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            left, where = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                self.closed.append(self.open.pop(0)[1])
            left, where = self.capacity, self.new()
        if left > size:
            insort(self.open, (left - size, where))
        else:
            self.closed.append(where)
        return where


def _pack(capacity: int, windows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        w = Windows(capacity, windows, part)
        waiting: dict[int, list[tuple]] = {}  # the items of the open containers

        def rows(containers: list[int], is_open: bool) -> list[tuple]:
            return [(*item, c, is_open, part) for c in containers for item in waiting.pop(c)]

        columns = ["id", "piece", "start", "size", "container", "open", "part"]
        for pdf in batches:
            out: list[tuple] = []
            for id_, size in zip(pdf["id"].tolist(), pdf["size"].tolist()):
                full, rest = divmod(size, capacity)
                if full and not rest:
                    full, rest = full - 1, capacity
                out += [(id_, i, i * capacity, capacity, w.new(), False, part) for i in range(full)]
                where = w.put(rest)
                waiting.setdefault(where, []).append((id_, full, full * capacity, rest))
                if w.closed:
                    out += rows(w.closed, False)
                    w.closed = []
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(rows([c for _, c in w.open], True), columns=columns)

    return run


def _repack(capacity: int, windows: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Open containers as items, the largest first, which suits best fit."""
        pdf = pdf.sort_values(["size", "container"], ascending=[False, True], kind="stable")
        up = int(pdf["up"].iloc[0])
        w = Windows(capacity, windows, (level << 24) + up)
        to = [w.put(s) for s in pdf["size"].tolist()]
        still = {c for _, c in w.open}
        return pd.DataFrame({"container": pdf["container"], "size": pdf["size"], "to": to, "open": [c in still for c in to], "part": up})

    return run


def pack(items: DataFrame, capacity: int, windows: int = 64, fan: int = 64) -> DataFrame:
    """items: id, size. Returns container, id, piece, start (offset of the piece in its item), size."""
    kind = dict(items.dtypes)["id"]
    rows = items.select("id", F.col("size").cast("long").alias("size")).filter(F.col("size") > 0)
    first = materialize(rows.mapInPandas(_pack(capacity, windows), f"id {kind}, piece int, start long, size long, container long, open boolean, part int"), "packed")
    open_ = first.filter("open").groupBy("container", "part").agg(F.sum("size").alias("size"))
    parts = (first.agg(F.max("part")).first()[0] or 0) + 1
    packed, level = first.drop("open", "part"), 0
    while True:
        level += 1
        up = F.floor(F.col("part") / fan).cast("int")
        moved = materialize(
            open_.withColumn("up", up).groupBy("up").applyInPandas(_repack(capacity, windows, level), "container long, size long, to long, open boolean, part int"), "repacked"
        )
        target = moved.select("container", "to")
        packed = packed.join(target, "container", "left").withColumn("container", F.coalesce("to", "container")).drop("to")
        parts = -(-parts // fan)
        if parts <= 1:
            return packed.select("container", "id", "piece", "start", "size")
        open_ = moved.filter("open").groupBy(F.col("to").alias("container"), "part").agg(F.sum("size").alias("size"))
