"""Per-key results over a join in which a few keys hold most of the rows.

Neither input is shuffled row by row. Each is first reduced to one compact state per join key (and
grouping column), on the map side, so a key with a third of all rows leaves each task as one row.
The states are joined and the results of the full join follow by algebra:

    rows of the join            = sum over keys of  n_left * n_right
    sum of a left measure       = sum over keys of  s_left * n_right
    sum of a right measure      = sum over keys of  n_left * s_right

Only additive results (counts, sums, and the means made from them) can be had this way.

Nulls: a null join key matches nothing, as in SQL; a full join keeps it with no partner. A null
grouping value forms its own group. Null and NaN measures count as no value. Empty inputs give an
empty result. Repeated rows count as often as they occur. Columns that are not named are ignored,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def compact(df: DataFrame, keys: Mapping[str, Column], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One state per combination of keys: n, and for each measure m its sum s_m and count c_m."""
    measures = measures or {}
    named = df.select(
        *[c.alias(k) for k, c in keys.items()],
        *[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"m_{m}") for m, c in measures.items()],
    )
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(f"m_{m}"), F.lit(0.0)).alias(f"s_{m}") for m in measures],
        *[F.count(f"m_{m}").alias(f"c_{m}") for m in measures],
    )


def _measures(state: DataFrame) -> list[str]:
    return [c[2:] for c in state.columns if c.startswith("s_") and f"c_{c[2:]}" in state.columns]


def join_states(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two compact states and scale the sums and counts of each side by the rows of the other.

    Grouping columns of both sides are kept; they must differ in name. own_left and own_right are the
    rows of the state itself, unscaled, 0 where the side has no state.
    """
    extra_l = [c for c in left.columns if c not in on and c != "n" and c[:2] not in ("s_", "c_")]
    extra_r = [c for c in right.columns if c not in on and c != "n" and c[:2] not in ("s_", "c_")]
    lm, rm = _measures(left), _measures(right)
    if set(lm) & set(rm) or set(extra_l) & set(extra_r):
        raise ValueError("measures and grouping columns of the two sides need different names")
    joined = left.withColumnRenamed("n", "n_left").join(right.withColumnRenamed("n", "n_right"), list(on), how)
    nl, nr = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    zero = F.lit(0)
    return joined.select(
        *on, *extra_l, *extra_r, nl.alias("own_left"), nr.alias("own_right"), (nl * nr).alias("n"),
        *[(F.coalesce(f"s_{m}", zero.cast("double")) * nr).alias(f"s_{m}") for m in lm],
        *[(F.coalesce(f"c_{m}", zero) * nr).alias(f"c_{m}") for m in lm],
        *[(F.coalesce(f"s_{m}", zero.cast("double")) * nl).alias(f"s_{m}") for m in rm],
        *[(F.coalesce(f"c_{m}", zero) * nl).alias(f"c_{m}") for m in rm],
    )


def roll_up(states: DataFrame, by: Sequence[str], own: str | None = None) -> DataFrame:
    """Combine joined states to one row per by.

    own="left" (or "right") also adds up the rows of that side by themselves, as own_rows. It needs a
    side whose states occur once in the join, that is, whose partner has one state per join key.
    """
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *([F.sum(f"own_{own}").alias("own_rows")] if own else []),
        *[F.sum(f"s_{m}").alias(f"s_{m}") for m in _measures(states)],
        *[F.sum(f"c_{m}").alias(f"c_{m}") for m in _measures(states)],
    )


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, on: Mapping[str, tuple[Column, Column]],
    by_left: Mapping[str, Column] | None = None, by_right: Mapping[str, Column] | None = None,
    left_measures: Mapping[str, Column] | None = None, right_measures: Mapping[str, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Group left join right by columns of either side, or, without any, by the join key itself.

    Returns the grouping columns, n (rows of the join) and, per measure, s_ (sum) and c_ (values).
    """
    by_left, by_right = by_left or {}, by_right or {}
    a = compact(left, {k: c[0] for k, c in on.items()} | dict(by_left), left_measures)
    b = compact(right, {k: c[1] for k, c in on.items()} | dict(by_right), right_measures)
    return roll_up(join_states(a, b, list(on), how), [*by_left, *by_right] or list(on))


def heavy_keys(per_key: DataFrame, field: str, key: str, rows: str, share: float) -> DataFrame:
    """Of results per (field, key), those with at least share of all rows of their field.

    The totals are one row per field, so they are joined by broadcast.
    """
    totals = per_key.groupBy(field).agg(F.sum(rows).alias("_total"))
    return (
        per_key.join(F.broadcast(totals), field)
        .filter((F.col(rows) >= share * F.col("_total")) & F.col(key).isNotNull())
        .drop("_total")
    )
