"""The N best items of every group by secondary sort, without buffering a group.

Each task first sorts and streams the rows it reads and passes on its own first N of each group, so that at most N rows
per group and task are shuffled. These are hash-partitioned by (group, salt), sorted within partitions by group, score and id, and
streamed in Arrow batches that pass on the first N of each group. The salt is made from a row's content, so a group
with a third of all rows is shared out among `salts` partitions, while the copies of a row stay together. A
second, small round does the same over at most N * salts rows per group.

Scores are numbers; rows with a null or NaN score, or a null in a group column, are left out. The higher
score comes first, then the smaller id. Copies (equal in all columns but the id; null equals null, NaN equals
NaN) take part once, with the smallest id. Only the copies' N best ids have to be remembered, because a copy
of an item that isn't among the best isn't either. Groups with fewer than N rows give what they have; an
empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from yieldloom.functions.columns import content_hash


def _take(group: Sequence[str], n: int):
    keys = list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the rows already passed on of the group that the last batch ended with
        for pdf in batches:
            if not len(pdf):
                continue
            fresh = np.ones(len(pdf), bool)
            if kept is not None:
                pdf, fresh = pd.concat([kept, pdf], ignore_index=True), np.r_[np.zeros(len(kept), bool), fresh]
            first = ~pdf.duplicated([*keys, "score", "content", "content2"]).to_numpy()
            pdf, fresh = pdf[first], fresh[first]
            top = (pdf.groupby(keys, sort=False).cumcount() < n).to_numpy()
            pdf, fresh = pdf[top], fresh[top]
            yield pdf[fresh]
            last = pdf[keys].iloc[-1]
            kept = pdf[(pdf[keys] == last).all(axis=1)]

    return run


def top_n(df: DataFrame, group: dict[str, Column], id_col: str, score: Column, n: int, salts: int = 16) -> DataFrame:
    """The group columns, id and score of the n best items of each group; see the module's text."""
    content = [c for c in df.columns if c != id_col]
    # Two hashes of different kinds: 96 bits stand for the content.
    rows = df.select(
        *[c.alias(k) for k, c in group.items()], F.col(id_col).alias("id"), score.cast("double").alias("score"),
        content_hash(content).alias("content"), F.hash(*content).alias("content2"),
    )
    known = F.col("score").isNotNull() & ~F.isnan("score")
    for k in group:
        known = known & F.col(k).isNotNull()
    rows = rows.filter(known)
    order = [*group, F.col("score").desc(), "id"]
    own = rows.sortWithinPartitions(*order).mapInPandas(_take(list(group), n), rows.schema)
    salted = own.repartition(*group, F.pmod("content", F.lit(salts))).sortWithinPartitions(*order)
    some = salted.mapInPandas(_take(list(group), n), rows.schema)
    best = some.repartition(*group).sortWithinPartitions(*order).mapInPandas(_take(list(group), n), rows.schema)
    return best.drop("content", "content2")
