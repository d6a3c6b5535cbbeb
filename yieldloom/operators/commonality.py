"""Tools that affected lots have in common, by Fisher's exact test (two-sided) on tool x cohort tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def two_sided(a: int, b: int, c: int, d: int) -> float:
    """The probability of the tables with the same margins that are no likelier than this one; 1 for an empty table or margin.

    Terms follow from their neighbours by a ratio, so no factorials are needed. Only terms within 60 standard deviations (and 1,000
    tables) of the likeliest are made: all others are 0 as doubles, so margins of billions need some hundred thousand.
    """
    n, k, m = a + b + c + d, a + c, a + b
    if n <= 0 or k <= 0 or m <= 0:
        return 1.0
    low, high = max(0, k + m - n), min(k, m)
    mode = (k + 1) * (m + 1) // (n + 2)
    reach = 1000 + int(60 * np.sqrt(k / n * m / n * (n - k) * ((n - m) / max(1, n - 1))))
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(low, high, dtype=float)
    ratio = np.log(k - x) + np.log(m - x) - np.log(x + 1) - np.log(n - k - m + x + 1)
    logs = np.r_[0.0, np.cumsum(ratio)]
    p = np.exp(logs - logs.max())
    p /= p.sum()
    observed = p[a - low] if low <= a <= high else 0.0
    return float(min(1.0, p[p <= observed + 1e-12].sum()))


def fisher(tables: DataFrame) -> DataFrame:
    """tables: any columns and the counts a, b, c, d; one row per tool, say. Adds p_value, see two_sided()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p_value=[two_sided(*t) for t in zip(*(pdf[c].tolist() for c in "abcd"))])

    schema = ", ".join(f"`{c}` {t}" for c, t in tables.dtypes)
    return tables.mapInPandas(run, f"{schema}, p_value double")


def odds_ratio(endless: float = 9999.0) -> Column:
    bc, ad = F.col("b") * F.col("c"), F.col("a") * F.col("d")
    return F.when((bc == 0) & (ad > 0), endless).when(bc == 0, 1.0).otherwise(F.try_divide(ad.cast("double"), bc))


def relative_risk(endless: float = 9999.0) -> Column:
    """Ratio of the shares of affected and of normal lots that saw the tool."""
    hit = F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("a") + F.col("b")), F.lit(0.0))
    base = F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("c") + F.col("d")), F.lit(0.0))
    return F.when((base == 0) & (hit > 0), endless).when(base == 0, 1.0).otherwise(F.try_divide(hit, base))


def tools_of_lots(steps: DataFrame) -> DataFrame:
    """lot_id and tool_id, each pair once; empty names are none."""
    return steps.filter("tool_id is not null and tool_id <> ''").select("lot_id", "tool_id").distinct()


def tool_tests(lots: DataFrame, used: DataFrame, min_lots: int = 4) -> DataFrame:
    """used: of tools_of_lots(). Per tool: the table a, b (affected on, off the tool), c, d (normal), p_value, odds_ratio, relative_risk, strength.

    Without min_lots lots in the cohorts, or with an empty cohort, there is no test.
    """
    known = lots.filter("cohort is not null").select("lot_id", "cohort")
    on = used.join(known, "lot_id")
    seen = on.groupBy("tool_id").agg(F.count_if(F.col("cohort") == "affected").alias("a"), F.count_if(F.col("cohort") == "normal").alias("c"))
    sizes = known.agg(F.count_if(F.col("cohort") == "affected").alias("na"), F.count_if(F.col("cohort") == "normal").alias("nn"))
    t = seen.join(F.broadcast(sizes)).filter(f"na > 0 and nn > 0 and na + nn >= {min_lots}")
    t = t.select("tool_id", "a", (F.col("na") - F.col("a")).alias("b"), "c", (F.col("nn") - F.col("c")).alias("d"))
    p = F.col("p_value")
    strength = F.when(p < 0.001, "very strong").when(p < 0.01, "strong").when(p < 0.05, "moderate").otherwise("not statistically significant")
    return fisher(t).withColumns({"odds_ratio": odds_ratio(), "relative_risk": relative_risk(), "strength": strength})


def for_lots(tests: DataFrame, used: DataFrame, top: int = 5) -> DataFrame:
    """The top tools of every lot by p (rounded to six places), then name; the report's length is the feature."""
    w = W.partitionBy("lot_id").orderBy(F.bround("p_value", 6), "tool_id")
    return used.join(tests, "tool_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
