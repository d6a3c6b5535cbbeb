"""Queries of the analytical operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.operators import batchrisk, commonality, outcome, rootcause, spatial, spc
from yieldloom.operators.lots import KEY
from yieldloom.session import kept, materialize
from yieldloom.sources import fab
from yieldloom.sources.tables import state_of


def spc_capability(spark: SparkSession, d: str) -> DataFrame:
    t = spc.key_stats(fab.steps(spark, d)).withColumn("out_of_capability", spc.out_of_capability(F.col("cpk")))
    return t.select(*KEY, "n", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.round("cpk", 6).alias("cpk"), "out_of_capability", "last_value")


def spc_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every reading that violates a Western Electric rule, with the rules."""
    s = fab.steps(spark, d)
    t = spc.control_chart(s, materialize(spc.key_stats(s), "stats")).filter("rule1 or rule2 or rule3 or rule4")
    return t.select(*KEY, "id", F.round("z", 4).alias("z"), "rule1", "rule2", "rule3", "rule4")


def spc_summary(spark: SparkSession, d: str) -> DataFrame:
    t = spc.summary(fab.steps(spark, d))
    return t.select(*KEY, "n", F.round("cpk", 6).alias("cpk"), "out_of_capability", F.round("last_z", 6).alias("last_z"), "rule1", "rule2", "rule3", "rule4")


def _signature_columns(t: DataFrame, by: list[str]) -> DataFrame:
    return t.select(*by, "points", *[F.round(c, 6).alias(c) for c in ("center", "edge", "donut", "linearity", "span")], F.col("quadrants").cast("int").alias("quadrants"), "signature", F.round("confidence", 6).alias("confidence"))


def lot_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signature_columns(spatial.signatures(fab.defects(spark, d)), ["lot_id"])


def wafer_signatures(spark: SparkSession, d: str) -> DataFrame:
    by = ["lot_id", "wafer_id"]
    return _signature_columns(spatial.signatures(fab.defects(spark, d).filter("wafer_id is not null"), by), by)


def baselines(spark: SparkSession, d: str) -> DataFrame:
    """The baselines of all sources, written once for all that need them."""
    return kept(spark, "baselines", state_of(spark, d, "process_steps", "wafer_lots"), lambda: rootcause.baselines(fab.steps(spark, d), fab.lots(spark, d)))


def lot_sources(spark: SparkSession, d: str) -> DataFrame:
    """The states and last readings of all lots and sources, written once for the ranking and the fingerprints."""
    return kept(spark, "lot_sources", state_of(spark, d, "process_steps", "wafer_lots"), lambda: rootcause.lot_sources(fab.steps(spark, d), baselines(spark, d)))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The last deviations of all lots, from a written table."""
    return batchrisk.fingerprints(lot_sources(spark, d), baselines(spark, d))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """The signatures of all lots, written once for the ranking and the lots at risk."""
    return kept(spark, "signatures", state_of(spark, d, "defects"), lambda: spatial.signatures(fab.defects(spark, d)).select("lot_id", "signature"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of all lots, written once for all that need it."""
    make = lambda: rootcause.rank_causes(fab.lots(spark, d), fab.steps(spark, d), fab.defects(spark, d), base=baselines(spark, d), sign=signatures(spark, d), of_lot=lot_sources(spark, d))
    return kept(spark, "ranking", state_of(spark, d, "process_steps", "wafer_lots", "defects"), make)


def parameter_baselines(spark: SparkSession, d: str) -> DataFrame:
    t = baselines(spark, d)
    return t.select(*KEY, "n", "normal_n", F.round("base_mean", 3).alias("base_mean"), F.round("base_sd", 3).alias("base_sd"))


def root_causes(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).select("lot_id", "rank", *KEY, "spatial_signature", "deviation_score", "confidence", "sample_size", "risk_score")


def root_cause_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The contract as one nested row per lot; the evidence is wording, so there is no SQL."""
    return rootcause.findings(ranked(spark, d), batch_risk(spark, d))


def contract_causes(spark: SparkSession, d: str) -> DataFrame:
    """The contracts as flat rows, one a cause: its evidence in words, how many lots at risk the contract lists and has, and the first of them."""
    t = rootcause.findings(ranked(spark, d), batch_risk(spark, d)).withColumn("listed", F.size("at_risk_upcoming_batches"))
    t = t.select("lot_id", "listed", "at_risk_total", F.get("at_risk_upcoming_batches", F.lit(0)).getField("lot_id").alias("first_at_risk"), F.explode("candidate_causes").alias("c"))
    return t.select("lot_id", *[F.col(f"c.{c}").alias(c) for c in ("rank", "tool_id", "parameter", "evidence")], "listed", "at_risk_total", "first_at_risk")


def batch_risk(spark: SparkSession, d: str) -> DataFrame:
    return batchrisk.at_risk(fab.lots(spark, d), fingerprints(spark, d), signatures(spark, d)).orderBy(F.desc("risk_score"), "lot_id")


def _used(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, "lot_tools", state_of(spark, d, "process_steps"), lambda: commonality.tools_of_lots(fab.steps(spark, d)))


def tool_commonality(spark: SparkSession, d: str) -> DataFrame:
    t = commonality.tool_tests(fab.lots(spark, d), _used(spark, d))
    return t.select("tool_id", "a", "b", "c", "d", *[F.round(c, 6).alias(c) for c in ("p_value", "odds_ratio", "relative_risk")], "strength")


def lot_commonality(spark: SparkSession, d: str) -> DataFrame:
    used = _used(spark, d)
    t = commonality.for_lots(commonality.tool_tests(fab.lots(spark, d), used), used)
    return t.select("lot_id", "rank", "tool_id", "a", "c", F.round("p_value", 6).alias("p_value"))


def yield_recovery(spark: SparkSession, d: str) -> DataFrame:
    t = outcome.recovery(ranked(spark, d), fab.lots(spark, d))
    return t.select("lot_id", "rank", *KEY, *[F.round(c, 6).alias(c) for c in ("gap", "attributed", "recoverable", "low", "high")])


def total_recovery(spark: SparkSession, d: str) -> DataFrame:
    t = outcome.total_recovery(outcome.recovery(ranked(spark, d), fab.lots(spark, d)))
    return t.select("lot_id", "causes", F.round("gap", 6).alias("gap"), F.round("recoverable", 6).alias("recoverable"))


def ranker_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = outcome.accuracy(outcome.hits(ranked(spark, d), fab.labels(spark, d)))
    return t.select("lots", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"), F.round("brier", 6).alias("brier"), "passed")


def ranker_calibration(spark: SparkSession, d: str) -> DataFrame:
    t = outcome.calibration(outcome.hits(ranked(spark, d), fab.labels(spark, d)))
    return t.select("bin", "lots", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


def signature_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Per signature of the defects: lots, mean yield, lots below 90, and the leading cause that most of them share."""
    sign = spatial.signatures(fab.defects(spark, d)).select("lot_id", "signature")
    first = ranked(spark, d).filter("rank = 1").select("lot_id", F.concat_ws(" ", "tool_id", "parameter").alias("cause"))
    t = fab.lots(spark, d).join(sign, "lot_id").join(first, "lot_id", "left")
    causes = t.groupBy("signature", "cause").agg(
        F.count(F.lit(1)).alias("n"), F.sum("yield_pct").alias("y"), F.count("yield_pct").alias("k"), F.count_if(F.col("yield_pct") < 90).alias("low"))
    most = F.min(F.when(F.col("cause").isNotNull(), F.struct((-F.col("n")).alias("n"), "cause")))
    out = causes.groupBy("signature").agg(F.sum("n").alias("lots"), F.round(F.sum("y") / F.sum("k"), 6).alias("mean_yield"), F.sum("low").alias("low_yield"), most.alias("m"))
    return out.select("signature", "lots", "mean_yield", "low_yield", F.col("m.cause").alias("cause"), (-F.col("m.n")).alias("cause_lots"))


QUERIES = {
    f.__name__: f for f in (
        spc_capability, spc_violations, spc_summary, lot_signatures, wafer_signatures, parameter_baselines, root_causes, root_cause_evidence, contract_causes, batch_risk, tool_commonality,
        lot_commonality, yield_recovery, total_recovery, ranker_accuracy, ranker_calibration, signature_patterns,
    )
}

S = fab.SQL

_STATS = S + """, r AS (SELECT * FROM steps WHERE value IS NOT NULL),
stats AS (
  SELECT step, tool_id, parameter, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd,
         arg_min(spec_min, (ts, id)) AS lo, arg_min(spec_max, (ts, id)) AS hi, arg_max(value, (ts, id)) AS last_value FROM r GROUP BY ALL),
cap AS (
  SELECT *, CASE WHEN n < 2 OR (lo IS NULL AND hi IS NULL) THEN NULL
                 WHEN sd <= 1e-12 THEN CASE WHEN coalesce(mean < lo, false) OR coalesce(mean > hi, false) THEN 0.0 ELSE 9.99 END
                 ELSE least((hi - mean) / (3 * sd), (mean - lo) / (3 * sd)) END AS cpk FROM stats),
zs AS (SELECT r.*, (value - mean) / CASE WHEN sd <= 1e-12 THEN 1e-6 ELSE sd END AS z FROM r JOIN stats USING (step, tool_id, parameter)),
we AS (
  SELECT *, abs(z) > 3 AS rule1,
    count(*) OVER w3 = 3 AND (count(*) FILTER (WHERE z > 2) OVER w3 >= 2 OR count(*) FILTER (WHERE z < -2) OVER w3 >= 2) AS rule2,
    count(*) OVER w5 = 5 AND (count(*) FILTER (WHERE z > 1) OVER w5 >= 4 OR count(*) FILTER (WHERE z < -1) OVER w5 >= 4) AS rule3,
    count(*) OVER w8 = 8 AND (count(*) FILTER (WHERE z > 0) OVER w8 >= 8 OR count(*) FILTER (WHERE z < 0) OVER w8 >= 8) AS rule4
  FROM zs WINDOW w3 AS (PARTITION BY step, tool_id, parameter ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
                 w5 AS (PARTITION BY step, tool_id, parameter ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                 w8 AS (PARTITION BY step, tool_id, parameter ORDER BY ts, id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
viol AS (
  SELECT step, tool_id, parameter, count(*) FILTER (WHERE rule1) AS rule1, count(*) FILTER (WHERE rule2) AS rule2,
         count(*) FILTER (WHERE rule3) AS rule3, count(*) FILTER (WHERE rule4) AS rule4 FROM we GROUP BY ALL)
"""


def _shapes(by: str, where: str = "") -> str:
    on = " AND ".join(f"p.{c} = a.{c}" for c in by.split(", "))
    return f""", pts AS (SELECT * FROM places {where}),
one AS (
  SELECT {by}, count(*) AS points, avg(CAST(sqrt(x*x + y*y) <= 35e-2 AS DOUBLE)) AS center, avg(CAST(sqrt(x*x + y*y) >= 72e-2 AS DOUBLE)) AS edge,
         avg(CAST(sqrt(x*x + y*y) >= 30e-2 AND sqrt(x*x + y*y) <= 80e-2 AS DOUBLE)) AS donut,
         CAST(count(DISTINCT CAST(floor((atan2(y, x) + pi()) / (pi() / 2)) AS INTEGER) % 4) AS INTEGER) AS quadrants,
         var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM pts GROUP BY {by}),
two AS (SELECT *, (vx + vy) / 2 + sqrt(((vx - vy) / 2) * ((vx - vy) / 2) + vxy * vxy) AS top FROM one),
axes AS (
  SELECT {by}, CASE WHEN abs(vxy) < 1e-15 THEN CASE WHEN vx >= vy THEN 1.0 ELSE 0.0 END ELSE top - vy END AS ax,
         CASE WHEN abs(vxy) < 1e-15 THEN CASE WHEN vx >= vy THEN 0.0 ELSE 1.0 END ELSE vxy END AS ay FROM two WHERE points >= 4),
spans AS (SELECT {", ".join("a." + c for c in by.split(", "))}, max((x*ax + y*ay) / sqrt(ax*ax + ay*ay)) - min((x*ax + y*ay) / sqrt(ax*ax + ay*ay)) AS span FROM pts p JOIN axes a ON {on} GROUP BY ALL),
shp AS (
  SELECT two.*, CASE WHEN vx + vy > 1e-12 THEN top / (vx + vy) ELSE 0.0 END AS linearity, CASE WHEN vx + vy > 1e-12 THEN coalesce(span, 0.0) ELSE 0.0 END AS span
  FROM two LEFT JOIN spans USING ({by})),
named AS (
  SELECT *, CASE WHEN points < 4 THEN 'few' WHEN linearity >= 88e-2 AND span >= 35e-2 AND (edge < 85e-2 OR quadrants <= 2) THEN 'scratch'
    WHEN edge >= 58e-2 AND center <= 15e-2 AND quadrants >= 3 THEN 'edge-ring' WHEN center >= 48e-2 AND edge <= 25e-2 THEN 'center-cluster'
    WHEN donut >= 55e-2 AND center <= 18e-2 AND edge <= 40e-2 AND quadrants >= 3 THEN 'donut' ELSE 'random' END AS kind FROM shp),
sig AS (
  SELECT * EXCLUDE kind, CASE kind WHEN 'few' THEN 'random' ELSE kind END AS signature,
    CASE kind WHEN 'few' THEN 5e-1 WHEN 'scratch' THEN least(95e-2, 65e-2 + 30e-2 * linearity) WHEN 'edge-ring' THEN least(95e-2, 60e-2 + 35e-2 * edge)
      WHEN 'center-cluster' THEN least(95e-2, 60e-2 + 35e-2 * center) WHEN 'donut' THEN least(95e-2, 60e-2 + 35e-2 * donut) ELSE 70e-2 END AS confidence FROM named)
"""


_SIG_OUT = "round(center, 6) AS center, round(edge, 6) AS edge, round(donut, 6) AS donut, round(linearity, 6) AS linearity, round(span, 6) AS span, quadrants, signature, round(confidence, 6) AS confidence"

_BASE = """, hist AS (SELECT s.*, cohort FROM steps s LEFT JOIN lots USING (lot_id) WHERE value IS NOT NULL),
b0 AS (
  SELECT step, tool_id, parameter, count(*) AS n, avg(value) AS pop_mean, stddev_samp(value) AS pop_sd, count(*) FILTER (WHERE cohort = 'normal') AS normal_n,
         avg(value) FILTER (WHERE cohort = 'normal') AS normal_mean, stddev_samp(value) FILTER (WHERE cohort = 'normal') AS normal_sd,
         arg_min(spec_min, (ts, id)) AS lo, arg_min(spec_max, (ts, id)) AS hi FROM hist GROUP BY ALL),
base AS (
  SELECT *, CASE WHEN normal_n >= 2 THEN normal_mean WHEN hi > lo THEN (lo + hi) / 2 ELSE pop_mean END AS base_mean,
    CASE WHEN normal_n >= 2 THEN CASE WHEN normal_sd = 0 THEN 1e-6 ELSE normal_sd END WHEN hi > lo THEN (hi - lo) / 6
         WHEN n >= 2 THEN CASE WHEN pop_sd = 0 THEN 1e-6 ELSE pop_sd END ELSE 1.0 END AS base_sd FROM b0)
"""

_RANKED = _STATS + _shapes("lot_id") + _BASE + """,
seen AS (SELECT DISTINCT lot_id, step FROM marks WHERE step IS NOT NULL),
narrowed AS (SELECT * FROM seen UNION ALL SELECT DISTINCT lot_id, step FROM steps WHERE lot_id NOT IN (SELECT lot_id FROM seen)),
own AS (
  SELECT s.lot_id, step, tool_id, parameter,
         count(*) FILTER (WHERE value IS NOT NULL AND (coalesce(abs((value - pop_mean) / CASE WHEN pop_sd <= 1e-12 THEN 1e-6 ELSE pop_sd END) >= 1.5, false)
                                 OR coalesce(value > spec_max, false) OR coalesce(value < spec_min, false))) AS own_abnormal
  FROM steps s JOIN base USING (step, tool_id, parameter) GROUP BY ALL),
cur AS (SELECT lot_id, step, tool_id, parameter, value, spec_min, spec_max FROM steps
        QUALIFY row_number() OVER (PARTITION BY lot_id, step, tool_id, parameter ORDER BY ts DESC, id DESC) = 1),
of_lot AS (SELECT o.*, c.value, c.spec_min, c.spec_max, l.cohort, l.status FROM own o JOIN cur c USING (lot_id, step, tool_id, parameter) LEFT JOIN lots l USING (lot_id)),
cnt AS (SELECT step, tool_id, parameter, coalesce(sum(own_abnormal) FILTER (WHERE cohort = 'affected'), 0) AS abn_affected,
               coalesce(sum(own_abnormal) FILTER (WHERE cohort = 'normal'), 0) AS abn_normal FROM of_lot GROUP BY ALL),
sizes AS (SELECT count(*) FILTER (WHERE cohort = 'affected') AS n_affected, count(*) FILTER (WHERE cohort = 'normal') AS n_normal FROM lots),
cand AS (
  SELECT o.lot_id, step, tool_id, parameter, k.cpk, (v.rule1 + v.rule2 + v.rule3 + v.rule4 > 0) AS any_rule,
         n_affected + CASE WHEN o.cohort = 'affected' THEN 0 ELSE 1 END AS affected, abn_affected + CASE WHEN o.cohort = 'affected' THEN 0 ELSE own_abnormal END AS abn_a,
         abn_normal - CASE WHEN o.cohort = 'normal' THEN own_abnormal ELSE 0 END AS abn_n, n_normal, (o.value - base_mean) / base_sd AS z,
         coalesce(o.value > o.spec_max, false) OR coalesce(o.value < o.spec_min, false) AS violated
  FROM of_lot o JOIN base b USING (step, tool_id, parameter) JOIN cap k USING (step, tool_id, parameter) JOIN viol v USING (step, tool_id, parameter)
       JOIN cnt USING (step, tool_id, parameter), sizes
  WHERE o.value IS NOT NULL AND o.status <> 'in_progress' AND b.n >= 2 AND EXISTS (SELECT 1 FROM narrowed d WHERE d.lot_id = o.lot_id AND d.step = o.step)),
c1 AS (
  SELECT *, least(1.0, abs(z) / 3) AS zp, greatest(abn_a, 1) AS sample_size, least(greatest(abn_a / affected, 0.05), 1.0) AS frequency,
         greatest(0.20, 1 - CASE WHEN n_normal > 0 THEN abn_n / n_normal ELSE 0.0 END) AS specific,
         CASE WHEN coalesce(cpk < 1.33, false) OR any_rule THEN 0.15 ELSE 0.0 END AS support FROM cand),
c2 AS (
  SELECT *, least(greatest(4e-1 * zp + 3e-1 * CASE WHEN violated THEN 1.0 ELSE zp END + 2e-1 * coalesce(least(greatest((133e-2 - cpk) / 133e-2, 0.0), 1.0), 2e-1)
                           + 1e-1 * CASE WHEN any_rule THEN 3e-1 ELSE 0.0 END, 1e-2), 98e-2) AS deviation,
         least(greatest((frequency * specific * 7e-1 + support) * (CAST(sample_size AS DOUBLE) / (sample_size + 4e0)) + 15e-2 * zp, 1e-1), 92e-2) AS conf FROM c1),
c3 AS (SELECT *, round_even(deviation, 4) AS deviation_score, round_even(conf, 4) AS confidence, round_even(deviation * frequency * conf, 4) AS risk_score FROM c2),
ranked AS (
  SELECT c3.lot_id, CAST(row_number() OVER (PARTITION BY c3.lot_id ORDER BY round(deviation_score * c3.confidence, 8) DESC, step, tool_id, parameter) AS INTEGER) AS rank,
         step, tool_id, parameter, coalesce(signature, 'random') AS spatial_signature, deviation_score, c3.confidence, CAST(sample_size AS BIGINT) AS sample_size, risk_score
  FROM c3 LEFT JOIN sig USING (lot_id))
"""

_RECOVERY = _RANKED + """,
gaps AS (SELECT lot_id, CASE WHEN yield_pct IS NULL OR m IS NULL THEN 12.0 ELSE greatest(m - yield_pct, 0.0) END AS gap
         FROM lots, (SELECT avg(yield_pct) AS m FROM lots WHERE cohort = 'normal')),
rec AS (
  SELECT *, gap * least(greatest(deviation_score * confidence, 1e-1), 8e-1) AS attributed,
         gap * least(greatest(deviation_score * confidence, 1e-1), 8e-1) * least(confidence + 1e-1, 9e-1) AS recoverable
  FROM ranked JOIN gaps USING (lot_id) WHERE rank <= 3)
"""

_HITS = _RANKED + """,
hits AS (
  SELECT c.lot_id, min(rank) FILTER (WHERE step = lower(trim(injected_cause_step)) AND tool_id = upper(trim(injected_cause_tool_id)) AND parameter = injected_cause_parameter) AS true_rank,
         coalesce(max(risk_score) FILTER (WHERE rank = 1), 0) AS score FROM cause_labels c LEFT JOIN ranked r USING (lot_id) GROUP BY c.lot_id)
"""

_FISHER = S + """,
known AS (SELECT lot_id, cohort FROM lots WHERE cohort IS NOT NULL),
sizes AS (SELECT count(*) FILTER (WHERE cohort = 'affected') AS na, count(*) FILTER (WHERE cohort = 'normal') AS nn FROM known),
tab AS (
  SELECT tool_id, a, na - a AS b, c, nn - c AS d FROM (
    SELECT tool_id, count(*) FILTER (WHERE cohort = 'affected') AS a, count(*) FILTER (WHERE cohort = 'normal') AS c
    FROM (SELECT DISTINCT lot_id, tool_id FROM steps WHERE tool_id <> '') JOIN known USING (lot_id) GROUP BY tool_id), sizes
  WHERE na > 0 AND nn > 0 AND na + nn >= 4),
terms AS (SELECT *, a + b + c + d AS n, a + c AS k, a + b AS m, unnest(range(0, least(a + c, a + b) + 1)) AS x FROM tab),
lp AS (
  SELECT *, CASE WHEN x <= k AND m - x <= n - k AND x <= m THEN exp(
      lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) ELSE 0.0 END AS p,
    exp(lgamma(k + 1) - lgamma(a + 1) - lgamma(k - a + 1) + lgamma(n - k + 1) - lgamma(m - a + 1) - lgamma(n - k - m + a + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) AS obs FROM terms),
fish AS (SELECT tool_id, a, b, c, d, least(1.0, sum(CASE WHEN p <= obs + 1e-12 THEN p ELSE 0.0 END)) AS p_value FROM lp GROUP BY ALL)
"""

ORACLE = {
    "spc_capability": _STATS + """
SELECT step, tool_id, parameter, n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(cpk, 6) AS cpk, coalesce(cpk < 1.33, false) AS out_of_capability, last_value FROM cap""",
    "spc_violations": _STATS + "SELECT step, tool_id, parameter, id, round(z, 4) AS z, rule1, rule2, rule3, rule4 FROM we WHERE rule1 OR rule2 OR rule3 OR rule4",
    "spc_summary": _STATS + """
SELECT step, tool_id, parameter, n, round(cpk, 6) AS cpk, coalesce(cpk < 1.33, false) AS out_of_capability,
       round(CASE WHEN sd > 1e-12 THEN (last_value - mean) / sd ELSE 0.0 END, 6) AS last_z, rule1, rule2, rule3, rule4 FROM cap LEFT JOIN viol USING (step, tool_id, parameter)""",
    "lot_signatures": S + _shapes("lot_id") + f"SELECT lot_id, points, {_SIG_OUT} FROM sig",
    "wafer_signatures": S + _shapes("lot_id, wafer_id", "WHERE wafer_id IS NOT NULL") + f"SELECT lot_id, wafer_id, points, {_SIG_OUT} FROM sig",
    "parameter_baselines": S + _BASE + "SELECT step, tool_id, parameter, n, normal_n, round(base_mean, 3) AS base_mean, round(base_sd, 3) AS base_sd FROM base",
    "root_causes": _RANKED + "SELECT * FROM ranked",
    "batch_risk": S + _shapes("lot_id") + _BASE + """,
fp AS (
  SELECT lot_id, step, tool_id, parameter, (value - base_mean) / base_sd AS z FROM (
    SELECT * FROM steps WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lot_id, step, tool_id, parameter ORDER BY ts DESC, id DESC) = 1) JOIN base USING (step, tool_id, parameter)),
pairs AS (
  SELECT a.lot_id, b.lot_id AS match, exp(-sqrt(avg((a.z - b.z) * (a.z - b.z))) / 2) * CASE WHEN max(abs(a.z)) >= 1.5 THEN 1.0 ELSE 0.20 END AS sim
  FROM fp a JOIN fp b USING (step, tool_id, parameter)
  WHERE a.lot_id IN (SELECT lot_id FROM lots WHERE status = 'in_progress') AND b.lot_id IN (SELECT lot_id FROM lots WHERE cohort = 'affected') GROUP BY a.lot_id, b.lot_id),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY lot_id ORDER BY round(sim, 9) DESC, match) = 1)
SELECT best.lot_id, round_even(least(greatest(sim, 0.05), 0.96), 4) AS risk_score, coalesce(signature, 'random') AS matched_signature, match
FROM best LEFT JOIN sig ON sig.lot_id = match WHERE least(greatest(sim, 0.05), 0.96) >= 0.5""",
    "tool_commonality": _FISHER + """
SELECT tool_id, a, b, c, d, round(p_value, 6) AS p_value,
       round(CASE WHEN b * c = 0 THEN CASE WHEN a * d > 0 THEN 9999.0 ELSE 1.0 END ELSE CAST(a * d AS DOUBLE) / (b * c) END, 6) AS odds_ratio,
       round(CASE WHEN c = 0 THEN CASE WHEN a > 0 THEN 9999.0 ELSE 1.0 END ELSE (CAST(a AS DOUBLE) / (a + b)) / (CAST(c AS DOUBLE) / (c + d)) END, 6) AS relative_risk,
       CASE WHEN p_value < 0.001 THEN 'very strong' WHEN p_value < 0.01 THEN 'strong' WHEN p_value < 0.05 THEN 'moderate' ELSE 'not statistically significant' END AS strength FROM fish""",
    "lot_commonality": _FISHER + """
SELECT lot_id, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY round_even(p_value, 6), tool_id) AS INTEGER) AS rank, tool_id, a, c, round(p_value, 6) AS p_value
FROM (SELECT DISTINCT lot_id, tool_id FROM steps WHERE tool_id <> '') JOIN fish USING (tool_id) QUALIFY rank <= 5""",
    "yield_recovery": _RECOVERY + """
SELECT lot_id, rank, step, tool_id, parameter, round(gap, 6) AS gap, round(attributed, 6) AS attributed, round(recoverable, 6) AS recoverable,
       round(recoverable * 0.7, 6) AS low, round(recoverable * 1.3, 6) AS high FROM rec""",
    "total_recovery": _RECOVERY + "SELECT lot_id, count(*) AS causes, round(min(gap), 6) AS gap, round(least(sum(recoverable), min(gap)), 6) AS recoverable FROM rec GROUP BY lot_id",
    "ranker_accuracy": _HITS + """
SELECT count(*) AS lots, round(avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN true_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3,
       round(avg(pow(score - CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier, coalesce(avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END) >= 0.7, false) AS passed FROM hits""",
    "signature_patterns": _RANKED + """,
pt AS (SELECT s.signature, l.yield_pct, r.tool_id || ' ' || r.parameter AS cause FROM lots l JOIN sig s USING (lot_id) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (lot_id)),
pc AS (SELECT signature, cause, count(*) AS n FROM pt WHERE cause IS NOT NULL GROUP BY signature, cause QUALIFY row_number() OVER (PARTITION BY signature ORDER BY count(*) DESC, cause) = 1)
SELECT signature, lots, mean_yield, low_yield, cause, n AS cause_lots FROM (
  SELECT signature, count(*) AS lots, round(avg(yield_pct), 6) AS mean_yield, count(*) FILTER (WHERE yield_pct < 90) AS low_yield FROM pt GROUP BY signature) LEFT JOIN pc USING (signature)""",
    "ranker_calibration": _HITS + """
SELECT CAST(least(floor(score * 5), 4) AS INTEGER) AS bin, count(*) AS lots, round(avg(score), 6) AS predicted, round(avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM hits GROUP BY ALL""",
}

ORACLE["contract_causes"] = _RANKED + f""",
risks AS ({ORACLE["batch_risk"]}),
said AS (
  SELECT c2.lot_id, step, tool_id, parameter, printf('%s at %s deviates by %+.1f sigma', parameter, tool_id, round(z, 1) + 0e0) AS a, printf('abnormal on %d of %d low-yield lots', abn_a, affected) AS b,
         CASE WHEN cpk IS NOT NULL THEN printf('Cpk %.2f', cpk) END AS c,
         CASE WHEN any_rule THEN 'control rules broken: ' || concat_ws(', ', CASE WHEN rule1 > 0 THEN '1' END, CASE WHEN rule2 > 0 THEN '2' END, CASE WHEN rule3 > 0 THEN '3' END, CASE WHEN rule4 > 0 THEN '4' END) END AS d
  FROM c2 JOIN viol USING (step, tool_id, parameter))
SELECT lot_id, rank, tool_id, parameter, concat_ws(' | ', a, b, c, d, CASE WHEN spatial_signature <> 'random' THEN 'defect pattern: ' || spatial_signature END) AS evidence,
       CAST(least(100, n) AS INTEGER) AS listed, n AS at_risk_total, l AS first_at_risk
FROM ranked JOIN said USING (lot_id, step, tool_id, parameter), (SELECT count(*) AS n, arg_min(lot_id, (-risk_score, lot_id)) AS l FROM risks)"""
