"""Control-chart rules on a stream of readings, with the last seven readings of each source as state.

Deviations are taken from a static table of source statistics, as of operators.spc.key_stats. Readings are judged in the
order of arrival. The state of a source is seven numbers, so its size depends on the number of sources only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from yieldloom.operators.lots import KEY

_OUT = "step string, tool_id string, parameter string, id long, z double, rule1 boolean, rule2 boolean, rule3 boolean, rule4 boolean"


def _rules(z: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """The rules for z[first:], with what comes before as context."""
    def among(last: int, least: int, limit: float) -> np.ndarray:
        hit = np.zeros(len(z), bool)
        if len(z) >= last:
            view = np.lib.stride_tricks.sliding_window_view(z, last)
            hit[last - 1 :] = ((view > limit).sum(axis=1) >= least) | ((view < -limit).sum(axis=1) >= least)
        return hit[first:]

    return {"rule1": (np.abs(z) > 3)[first:], "rule2": among(3, 2, 2.0), "rule3": among(5, 4, 1.0), "rule4": among(8, 8, 0.0)}


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A source's readings of a trigger, batch by batch with seven deviations carried over, so that a hot source is never held as a whole."""
    before = np.array(state.get[0] if state.exists else [], float)
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "id"], kind="stable")
        z = np.r_[before, pdf["z"].to_numpy()]
        yield pd.DataFrame({"step": key[0], "tool_id": key[1], "parameter": key[2], "id": pdf["id"].to_numpy(), "z": pdf["z"].to_numpy(), **_rules(z, len(before))})
        before = z[-7:]
    state.update((before.tolist(),))


def control_chart(stream: DataFrame, stats: DataFrame) -> DataFrame:
    """stream: readings as of sources.fab.steps_of; stats: sources with mean and sd. Appends judged readings.

    The order is that of arrival, by Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch readings of a source), and that of time
    within a batch. Late readings are judged when they come; the batch chart of operators.spc judges them in their place.
    """
    t = stream.filter("value is not null").join(stats.select(*KEY, "mean", "sd"), KEY)
    t = t.select(*KEY, "id", "ts", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") <= 1e-12, 1e-6).otherwise(F.col("sd"))).alias("z"))
    return t.groupBy(*KEY).applyInPandasWithState(_step, _OUT, "last array<double>", "append", GroupStateTimeout.NoTimeout)


def rates(stream: DataFrame, late: str = "1 hour", window: str = "15 minutes") -> DataFrame:
    """Readings and readings out of their limits per source and window; readings later than `late` are left out."""
    from yieldloom.operators.lots import out_of_spec

    t = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", window), *KEY).agg(F.count(F.lit(1)).alias("readings"), F.count_if(out_of_spec()).alias("out_of_spec"))
