"""Queries of the training-data problems p2, p3, p4, p7, p8 and p9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from yieldloom.functions.columns import between, canonical
from yieldloom.llm import clusters, mixing, packing, percentiles, subjects, tokens, topn
from yieldloom.operators.lots import small
from yieldloom.session import kept, materialize
from yieldloom.sources.tables import state_of, table

WAFER = ["lot_id", "wafer_id"]


def _clusters(spark: SparkSession, d: str, names: bool) -> DataFrame:
    return clusters.cluster(table(spark, d, "defects"), WAFER, "id", "x", "y", clusters.ClusterConfig(link=0.05, min_size=6), names)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(_clusters(spark, d, False)).select("group_id", "id")


def _place(c: str):
    """Six places; 1e-9 decides means that lie just between two of them."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of six and more with size, centre, radius and their three most typical defects."""
    t = clusters.described(_clusters(spark, d, True), WAFER)
    return t.select("group_id", *WAFER, "size", _place("center_x"), _place("center_y"), _place("radius"), F.concat_ws(" ", "typical").alias("typical"))


def p2_parts(spark: SparkSession, d: str) -> DataFrame:
    """The compact parts of the groups, as Ward's limit leaves them."""
    return clusters.parts(_clusters(spark, d, True), WAFER)


PERCENTILES = [0.1, 1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0, 99.9]


def _source() -> dict:
    return {"tool_id": canonical("tool_id"), "parameter_name": F.col("parameter_name")}


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "process_steps")
    states = percentiles.merge_sketches(percentiles.build_sketches(steps, _source(), F.col("value")), list(_source()), steps.rdd.getNumPartitions())
    return percentiles.percentiles(states, list(_source()), PERCENTILES)


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every source on each day, and (day null) those of all days, combined from the days' kept states."""
    steps, keys = table(spark, d, "process_steps"), {"day": F.to_date("timestamp"), **_source()}
    states = percentiles.merge_sketches(percentiles.build_sketches(steps, keys, F.col("value")), list(keys), steps.rdd.getNumPartitions())
    # Days are spread over 256 parts, so that those of a source are merged as a tree, 16 at a time.
    days = materialize(states.withColumn("part", F.pmod(F.unix_date("day"), F.lit(256)).cast("int")), "days")
    total = percentiles.merge_sketches(days, list(_source()), parts=256, fan=16).withColumn("day", F.lit(None).cast("date"))
    return percentiles.percentiles(days.unionByName(total), list(keys), PERCENTILES)


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentiles, found by the sketches: of all values only those in the bracket around a wanted rank are kept apart.

    A bracket is twice the stated error wide on each side; in the one of about a billion cases in which it misses, the value is null.
    """
    steps = table(spark, d, "process_steps")
    states = percentiles.merge_sketches(percentiles.build_sketches(steps, _source(), F.col("value")), list(_source()), steps.rdd.getNumPartitions())
    keys = ["tool_id", "parameter_name"]
    brackets = materialize(percentiles.brackets(states, keys, PERCENTILES).groupBy(*keys).agg(F.collect_list(F.struct("pct", "n", "low", "high")).alias("b")), "brackets")
    v = F.col("value")
    rows = steps.select(*[c.alias(k) for k, c in _source().items()], v.alias("v")).filter(v.isNotNull() & ~F.isnan(v)).join(small(brackets), keys)
    rows = rows.select(*keys, "v", F.explode(F.filter("b", lambda b: F.col("v") <= b["high"])).alias("b"))
    counts = rows.groupBy(*keys, "b.pct", "b.n", F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(W.partitionBy(*keys, "pct").orderBy(F.asc_nulls_first("value")))  # over the different values of a bracket
    first = counts.withColumn("upto", upto).filter(F.col("upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("pct") / 100 * F.col("n") - 1e-9)))
    return first.groupBy(*keys, "pct", "n").agg(F.min_by("value", "upto").alias("value"))


def p3_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Each estimate held against exact counts over the whole table: whether its rank is within the stated error."""
    est = p3_percentiles(spark, d).groupBy("tool_id", "parameter_name").agg(F.array_sort(F.collect_list(F.struct("pct", "value", "n", "rank_error"))).alias("e"))
    v = F.col("value")
    rows = table(spark, d, "process_steps").select(*[c.alias(k) for k, c in _source().items()], v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    counted = rows.join(est, ["tool_id", "parameter_name"])
    below = [F.count_if(F.col("v") < F.col("e")[i]["value"]).alias(f"b{i}") for i in range(len(PERCENTILES))]
    upto = [F.count_if(F.col("v") <= F.col("e")[i]["value"]).alias(f"u{i}") for i in range(len(PERCENTILES))]
    t = counted.groupBy("tool_id", "parameter_name").agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("n"), *below, *upto)
    rows_ = F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto"), F.col("e")[i]["rank_error"].alias("err")) for i, p in enumerate(PERCENTILES)])
    t = t.select("tool_id", "parameter_name", "n", F.explode(rows_).alias("q"))
    want = F.greatest(F.lit(1.0), F.ceil(F.col("q.pct") / 100 * F.col("n") - 1e-9))
    off = F.greatest(F.col("q.below") + 1 - want, want - F.col("q.upto"), F.lit(0.0))
    allowed = F.col("q.err") * F.least(want, F.col("n") + 1 - want) + 1
    return t.select("tool_id", "parameter_name", F.col("q.pct").alias("pct"), "n", (off <= allowed).alias("within"))


def _score():
    return F.when(between("risk_score", 0, 1), F.col("risk_score")).when(between("probability", 0, 1), F.col("probability"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = topn.top_n(table(spark, d, "mock_findings"), {"lot_id": F.col("lot_id"), "tool": canonical("tool_id")}, "finding_id", _score(), 3)
    return t.select("lot_id", F.col("tool").alias("tool_id"), F.col("id").alias("finding_id"))


CAPACITY = 1024


def _lengths(spark: SparkSession, d: str, **keep: str) -> DataFrame:
    return tokens.with_lengths(table(spark, d, "documents"), "text", {"id": "doc_id", **keep}).withColumnRenamed("n_tokens", "size")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    t = packing.pack(_lengths(spark, d), CAPACITY)
    return t.select(F.col("container").alias("container_id"), F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, by their number of pieces, and how full they are."""
    t = p7_containers(spark, d).groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n_tokens"))
    return t.groupBy("pieces").agg(F.count(F.lit(1)).alias("containers"), F.sum("n_tokens").alias("n_tokens"), F.min("n_tokens").alias("least"), F.avg(F.col("n_tokens") / CAPACITY).alias("fill"))


def _characters(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") > 0).select(F.col("doc_id").alias("id"), *keep, F.length("text").cast("long").alias("size"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Packing by characters, into containers of 4,096: per document its pieces, their sum and the longest, and whether all of their containers hold."""
    t = materialize(packing.pack(_characters(spark, d), 4096), "packed_documents")
    fill = t.groupBy("container").agg(F.sum("size").alias("fill"))
    return t.join(fill, "container").groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("n_chars"), F.max("size").alias("longest"), (F.max("fill") <= 4096).alias("within"))


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """Mixing by characters: per document its rank in its source, its expected copies, and whether it has these, rounded down or up."""
    items, weights = materialize(_characters(spark, d, "source"), "lengths"), table(spark, d, "source_weights")
    r = materialize(mixing.ranked(items), "ranks")
    plan = F.broadcast(mixing.copies_plan(r, weights).select("source", "expected", "max_repeats"))  # one row per source of the weights
    got = mixing.mix(items, weights).groupBy("source", "id").agg(F.max("copy").alias("copies"))
    t = r.join(plan, "source").join(got, ["source", "id"], "left").fillna(0, ["copies"])
    kept_ = (F.col("copies") >= F.floor("expected")) & (F.col("copies") <= F.ceil("expected")) & (F.col("copies") <= F.col("max_repeats"))
    return t.select("source", F.col("id").alias("doc_id"), F.col("size").alias("n_chars"), "rank", F.round("expected", 6).alias("expected"), kept_.alias("kept"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    lengths = materialize(_lengths(spark, d, source="source"), "lengths")  # read twice: range partitioning samples its input
    t = mixing.mix(lengths, table(spark, d, "source_weights"))
    return t.select("source", F.col("id").alias("doc_id"), F.col("size").alias("n_tokens"), "copy")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "source_weights")
    return mixing.shares(p8_mix(spark, d).withColumnRenamed("n_tokens", "size"), weights)


def _subjects(spark: SparkSession, d: str, config: subjects.SubjectConfig):
    """The encoded documents and the topics, made by the first query that needs them."""
    labels = table(spark, d, "subject_labels").select(F.col("doc_id").alias("id"), "subject")
    source = (config, *state_of(spark, d, "documents", "subject_labels", "subject_areas"))
    write = lambda name, make: kept(spark, name, source, make)
    return subjects.prepare(table(spark, d, "documents"), "doc_id", "text", labels, table(spark, d, "subject_areas"), config, write)


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects per document with the number and share of the sentences that treat them."""
    c = subjects.SubjectConfig()
    encoded, topics = _subjects(spark, d, c)
    return subjects.document_subjects(encoded, topics, c).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject")


def p9_topics(spark: SparkSession, d: str) -> DataFrame:
    """The topics, the subject each was mapped to (null: general) and its top terms, for inspection."""
    c = subjects.SubjectConfig()
    _, t = _subjects(spark, d, c)
    rows = [(i, t.subjects[s] if s >= 0 else None, ", ".join(t.term(j) for j in (-t.counts[i]).argsort(kind="stable")[:20])) for i, s in enumerate(t.subject_of)]
    return spark.createDataFrame(rows, "topic int, subject string, top_terms string")


def p9_make_up(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents of each subject and treating sentences."""
    return p9_subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("treating").alias("sentences"))


QUERIES = {
    "p2_found": p2_found, "p2_clusters": p2_clusters, "p2_parts": p2_parts, "p3_daily": p3_daily, "p3_percentiles": p3_percentiles, "p3_rank_check": p3_rank_check, "p3_exact": p3_exact,
    "p4_found": p4_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p7_documents": p7_documents, "p8_copies": p8_copies,
    "p9_found": p9_found, "p9_subjects": p9_subjects, "p9_topics": p9_topics, "p9_make_up": p9_make_up,
}

_PCT = ", ".join(f"({p})" for p in PERCENTILES)

#: Reachability by steps of at most 0.05; 1e-9 stands for the rounding of a distance of just 0.05.
_REACH = """
WITH RECURSIVE pts AS (
  SELECT id, lot_id, wafer_id, x, y FROM defects WHERE lot_id IS NOT NULL AND wafer_id IS NOT NULL AND x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1),
step AS (
  SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b USING (lot_id, wafer_id)
  WHERE a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05 + 1e-9),
reach AS (SELECT id, id AS r FROM pts UNION SELECT reach.id, step.b FROM reach JOIN step ON step.a = reach.r),
grp AS (SELECT id, min(r) AS group_id, count(*) AS size FROM reach GROUP BY id)
"""

ORACLE = {
    "p2_found": _REACH + "SELECT group_id, id FROM grp WHERE size >= 6",
    "p2_clusters": _REACH + """,
mem AS (SELECT g.group_id, g.size, p.* FROM grp g JOIN pts p USING (id) WHERE g.size >= 6),
cen AS (SELECT group_id, avg(x) AS cx, avg(y) AS cy FROM mem GROUP BY group_id),
near AS (
  SELECT m.*, cx, cy, avg((x - cx) * (x - cx) + (y - cy) * (y - cy)) OVER (PARTITION BY group_id) AS r2, row_number() OVER (PARTITION BY group_id ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 12), id) AS k FROM mem m JOIN cen USING (group_id))
SELECT group_id, min(lot_id) AS lot_id, min(wafer_id) AS wafer_id, min(size) AS size, round(min(cx) + 1e-9, 6) AS center_x, round(min(cy) + 1e-9, 6) AS center_y, round(sqrt(min(r2)) + 1e-9, 6) AS radius, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY k) AS typical
FROM near WHERE k <= 3 GROUP BY group_id""",
    "p3_rank_check": f"""
SELECT tool_id, parameter_name, pct, n, TRUE AS within FROM (
  SELECT upper(trim(tool_id)) AS tool_id, parameter_name, count(*) AS n FROM process_steps
  WHERE tool_id IS NOT NULL AND parameter_name IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
  (SELECT CAST(p AS DOUBLE) AS pct FROM (VALUES {_PCT}) v(p))""",
    "p3_exact": f"""
SELECT tool_id, parameter_name, pct, n, l[CAST(greatest(1, ceil(pct / 100 * n - 1e-9)) AS BIGINT)] AS value FROM (
  SELECT upper(trim(tool_id)) AS tool_id, parameter_name, count(*) AS n, list(value ORDER BY value) AS l FROM process_steps
  WHERE tool_id IS NOT NULL AND parameter_name IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
  (SELECT CAST(p AS DOUBLE) AS pct FROM (VALUES {_PCT}) v(p))""",
    "p7_documents": """
SELECT doc_id, CAST(ceil(length(text) / 4096.0) AS BIGINT) AS pieces, CAST(length(text) AS HUGEINT) AS n_chars, least(length(text), 4096) AS longest, TRUE AS within
FROM documents WHERE length(text) > 0""",
    "p8_copies": """
WITH it AS (SELECT doc_id, source, length(text) AS size FROM documents WHERE length(text) > 0 AND source IS NOT NULL),
own AS (SELECT source, target_share, max_repeats, sum(size) AS own FROM it JOIN source_weights USING (source) GROUP BY ALL),
sh AS (SELECT *, target_share / sum(target_share) OVER () AS share FROM own),
pl AS (SELECT *, least(min(own * max_repeats / share) OVER () * share / own, max_repeats) AS c FROM sh)
SELECT source, doc_id, size AS n_chars, rank, round(c, 6) AS expected, TRUE AS kept
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rank FROM it) JOIN pl USING (source)""",
    "p4_found": """
WITH once AS (SELECT * EXCLUDE finding_id, min(finding_id) AS finding_id FROM mock_findings GROUP BY ALL),
scored AS (
  SELECT lot_id, upper(trim(tool_id)) AS tool_id, finding_id,
         CASE WHEN risk_score BETWEEN 0 AND 1 THEN risk_score WHEN probability BETWEEN 0 AND 1 THEN probability END AS score
  FROM once WHERE tool_id IS NOT NULL AND lot_id IS NOT NULL)
SELECT lot_id, tool_id, finding_id FROM scored WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lot_id, tool_id ORDER BY score DESC, finding_id) <= 3""",
}
