"""Queries of excursions, experiments, retrieval, routing and claim verification, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.functions import text as fx
from yieldloom.operators import doe, excursions, retrieval, spc, verify
from yieldloom.operators.lots import KEY
from yieldloom.plans.analytics import _BASE, _RANKED, baselines, fingerprints, ranked
from yieldloom.session import kept
from yieldloom.sources import fab
from yieldloom.sources.tables import state_of, table


def lot_excursions(spark: SparkSession, d: str) -> DataFrame:
    t = excursions.leading(excursions.excursion_scores(fab.steps(spark, d)))
    return t.select("lot_id", "rank", *KEY, "id", F.round("z", 6).alias("z"), F.round("capability", 6).alias("capability"), F.round("probability", 6).alias("probability"), F.round("score", 6).alias("score"))


def _factors(spark: SparkSession, d: str) -> DataFrame:
    s = fab.steps(spark, d)
    return doe.factors(ranked(spark, d).filter("rank = 1"), doe.factor_levels(s))


def doe_factors(spark: SparkSession, d: str) -> DataFrame:
    return _factors(spark, d).select("lot_id", "tool_id", "factor", "parameter", *[F.round(c, 6).alias(c) for c in ("nominal", "low", "high")])


def doe_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels for every parameter that a label names, at each of the steps and tools that labels name, from the nearest history."""
    named = fab.labels(spark, d).select(F.lower(F.trim("injected_cause_step")).alias("step"), F.upper(F.trim("injected_cause_tool_id")).alias("tool_id"), F.col("injected_cause_parameter").alias("parameter"))
    parameters = F.broadcast(named.select("parameter").distinct())  # names of parameters, some hundred at most
    wanted = named.select("step", "tool_id").distinct().crossJoin(parameters)
    t = doe.level_cascade(wanted, fab.steps(spark, d))
    return t.select("step", "tool_id", "parameter", *[F.round(c, 6).alias(c) for c in ("nominal", "low", "high")], "from")


def doe_runs(spark: SparkSession, d: str) -> DataFrame:
    return doe.runs(_factors(spark, d)).drop("run_order").withColumn("value", F.round("value", 6))


def doe_order(spark: SparkSession, d: str) -> DataFrame:
    """The shuffled order of execution, that of a hash of lot, run and seed."""
    return doe.runs(_factors(spark, d)).select("lot_id", "run", "run_order", "type").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a knowledge base; the step is that of the tool they are about."""
    kind = F.lower(F.substring_index(F.trim("tool_id"), "-", 1))
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", F.when(kind == "imp", "implant").otherwise(kind).alias("step"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subject_areas").select(F.col("subject").alias("query_id"), F.concat_ws(" ", F.replace("subject", F.lit("_"), F.lit(" ")), "description").alias("text"))


def _index(spark: SparkSession, d: str) -> retrieval.Index:
    """The index of all documents, written once for all that search it."""
    return retrieval.build_index(_docs(spark, d), lambda name, make: kept(spark, name, state_of(spark, d, "documents"), make))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    t = retrieval.bm25(_index(spark, d), _questions(spark, d))
    return t.withColumn("bm25", F.round("bm25", 6))


def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    t = retrieval.tfidf(_index(spark, d), _questions(spark, d))
    return t.withColumn("cosine", F.round("cosine", 6))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    t = retrieval.hybrid(_docs(spark, d), _questions(spark, d), index=_index(spark, d))
    return t.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "method")


def cause_search(spark: SparkSession, d: str) -> DataFrame:
    """For every different cause that a label names, the three best documents of its step, all boosts of that cause counted."""
    names = {"step": "injected_cause_step", "tool_id": "injected_cause_tool_id", "parameter": "injected_cause_parameter", "spatial_signature": "injected_signature"}
    causes = fab.labels(spark, d).select(F.lower(F.trim("injected_cause_step")).alias("step"), *[F.col(c).alias(k) for k, c in names.items() if k != "step"]).distinct()
    causes = causes.withColumn("query_id", F.concat_ws(" ", *names))
    t = retrieval.hybrid(_docs(spark, d), retrieval.cause_queries(causes, "query_id"), top=3, causes=causes, index=_index(spark, d))
    return t.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "method")


def search_grades(spark: SparkSession, d: str) -> DataFrame:
    docs, q = _docs(spark, d), _questions(spark, d)
    t = retrieval.grade(retrieval.hybrid(docs, q, index=_index(spark, d)), docs, q)
    return t.select("query_id", "id", F.round("overlap", 6).alias("overlap"), "grade", "query_grade")


def merged_search(spark: SparkSession, d: str) -> DataFrame:
    """Name and description of a subject as two queries; each document once with its better score, the five best a subject."""
    kinds = F.array(F.struct(F.lit("name").alias("kind"), F.replace("subject", F.lit("_"), F.lit(" ")).alias("text")), F.struct(F.lit("description").alias("kind"), F.col("description").alias("text")))
    q = table(spark, d, "subject_areas").select("subject", F.inline(kinds)).select("subject", F.concat_ws(": ", "subject", "kind").alias("query_id"), "text")
    t = retrieval.hybrid(_docs(spark, d), q.select("query_id", "text"), index=_index(spark, d)).join(q.select("query_id", "subject"), "query_id")
    return retrieval.merge(t, "subject").withColumn("score", F.round("score", 6))


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The results of hybrid_search again by score with more for the step, the three best a query."""
    q = _questions(spark, d)
    t = retrieval.rerank(retrieval.hybrid(_docs(spark, d), q, index=_index(spark, d)), q)
    return t.select("query_id", "rank", "id", "score")


def document_intents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.coalesce(fx.first_rule(F.col("text"), fx.INTENTS, "general"), F.lit("general")).alias("intent"))
    return t.groupBy("source", "intent").agg(F.count(F.lit(1)).alias("documents"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mock_findings").select(F.col("finding_id").alias("id"), "lot_id", F.col("evidence").alias("text"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Per lot: deviations of its last readings, capabilities of its sources, its tools, and the scores of its findings."""
    base = baselines(spark, d).withColumn("cpk", spc.cpk(*[F.col(c) for c in ("pop_mean", "pop_sd", "n", "spec_min", "spec_max")]))
    z = fingerprints(spark, d).join(base.select(F.concat_ws("|", *KEY).alias("source"), "tool_id", "cpk"), "source")
    t = z.groupBy("lot_id").agg(F.collect_list(F.abs("z")).alias("sigmas"), F.collect_set("cpk").alias("cpks"), F.collect_set("tool_id").alias("tools"))
    return t.join(verify.score_references(table(spark, d, "mock_findings")), "lot_id", "full")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return verify.check(verify.claims(_evidence(spark, d)), _references(spark, d))


def evidence_claims(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("id", "kind", "place", "word", "grounded")


def evidence_grounding(spark: SparkSession, d: str) -> DataFrame:
    return verify.grounding(_evidence(spark, d), _checked(spark, d)).withColumn("rate", F.round("rate", 6))


def evidence_marked(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their ungrounded claims marked in the text."""
    return verify.mark(_evidence(spark, d), _checked(spark, d))


QUERIES = {
    f.__name__: f for f in (
        lot_excursions, doe_factors, doe_levels, doe_runs, doe_order, bm25_scores, tfidf_scores, hybrid_search, cause_search, merged_search, reranked_search, search_grades, document_intents, evidence_claims, evidence_grounding, evidence_marked,
    )
}

S = fab.SQL

_FACTORS = _RANKED + """,
lv0 AS (
  SELECT tool_id, parameter, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, arg_min(spec_min, (ts, id)) FILTER (WHERE spec_min IS NOT NULL) AS lo,
         arg_min(spec_max, (ts, id)) FILTER (WHERE spec_max IS NOT NULL) AS hi, min((ts, id)) AS seen FROM steps WHERE value IS NOT NULL GROUP BY ALL),
lv1 AS (
  SELECT *, lo IS NOT NULL AND hi IS NOT NULL AS lim, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE mean END AS nominal,
         CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (hi - lo) * 1e-1 WHEN sd > 1e-6 THEN 2 * sd WHEN mean = 0 THEN 1.0 ELSE abs(mean) * 1e-1 END AS size FROM lv0),
lv AS (
  SELECT tool_id, parameter, seen, nominal, least(nominal, CASE WHEN lim THEN greatest(nominal - size, lo) ELSE nominal - size END) AS low,
         greatest(nominal, CASE WHEN lim THEN least(nominal + size, hi) ELSE nominal + size END) AS high FROM lv1),
fac AS (
  SELECT r.lot_id, r.tool_id, r.deviation_score, lv.parameter, nominal, low, high,
         CAST(row_number() OVER (PARTITION BY r.lot_id ORDER BY CASE WHEN lv.parameter = r.parameter THEN 0 ELSE 1 END, seen, lv.parameter) - 1 AS INTEGER) AS factor
  FROM ranked r JOIN lv ON lv.tool_id = r.tool_id WHERE r.rank = 1 QUALIFY factor < 3)
"""

_TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s_/]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
_STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)


def _kb(queries: str) -> str:
    """Documents, queries (query_id, q and what else they have), scores bm and cs."""
    return f"""
WITH docs AS (
  SELECT doc_id AS id, text, CASE WHEN k = 'imp' THEN 'implant' ELSE k END AS step, {_TOK.format("text")} AS toks
  FROM (SELECT *, lower(split_part(trim(tool_id), '-', 1)) AS k FROM documents) WHERE text IS NOT NULL),
qs AS (SELECT *, {_TOK.format("q")} AS toks FROM ({queries})),
st AS (SELECT count(*) AS n, avg(len(toks)) AS mean_len FROM docs),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS term FROM qs) GROUP BY ALL),
dt AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
bm AS (
  SELECT query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len))) AS bm25
  FROM dt JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY query_id, id),
kd AS (SELECT id, list_filter(toks, lambda x: x NOT IN ({_STOP})) AS k FROM docs),
kq AS (SELECT query_id, list_filter(toks, lambda x: x NOT IN ({_STOP})) AS k FROM qs),
td AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM kd) GROUP BY ALL),
tq AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM kq) GROUP BY ALL),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM td GROUP BY term), (SELECT CAST(n AS DOUBLE) AS n FROM st)),
wd AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM td JOIN idf USING (term)),
wq AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM tq JOIN idf USING (term)),
cs AS (
  SELECT query_id, id, dot / (qn * dn) AS cosine FROM (SELECT query_id, id, sum(a.w * b.w) AS dot FROM wd a JOIN wq b USING (term) GROUP BY ALL)
  JOIN (SELECT query_id, sqrt(sum(w * w)) AS qn FROM wq GROUP BY query_id) USING (query_id) JOIN (SELECT id, sqrt(sum(w * w)) AS dn FROM wd GROUP BY id) USING (id))
"""


_KB = _kb("SELECT subject AS query_id, replace(subject, '_', ' ') || ' ' || description AS q FROM subject_areas") + """,
sc AS (
  SELECT query_id, id, least(coalesce(bm25, 0) / 20, 1) AS part, coalesce(cosine, 0) AS cos,
         CASE WHEN coalesce(step, '') <> '' AND contains(lower(q), step) THEN 0.25 ELSE 0.0 END AS boost
  FROM (SELECT * FROM bm FULL JOIN cs USING (query_id, id)) JOIN docs USING (id) JOIN qs USING (query_id)),
hy AS (
  SELECT *, 6e-1 * part + 4e-1 * cos + 3e-1 * boost AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(6e-1 * part + 4e-1 * cos + 3e-1 * boost, 9) DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5 AND score > 0)
"""


#: As the end of _KB, over all pairs of a query and a document, those without a common word too.
_ALL = """,
sc AS (
  SELECT query_id, docs.id, least(coalesce(bm25, 0) / 20, 1) AS part, coalesce(cosine, 0) AS cos, CASE WHEN coalesce(step, '') <> '' AND contains(lower(q), step) THEN 25e-2 ELSE 0.0 END AS boost
  FROM docs CROSS JOIN qs LEFT JOIN bm USING (query_id, id) LEFT JOIN cs USING (query_id, id)),
hy AS (
  SELECT *, 6e-1 * part + 4e-1 * cos + 3e-1 * boost AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(6e-1 * part + 4e-1 * cos + 3e-1 * boost, 9) DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5 AND score > 0)
"""


def _when_rules() -> str:
    clean = "trim(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'))"
    cases = [f"WHEN {' OR '.join(f'''contains(c, '{p}')''' for p in phrases)} THEN '{name}'" for name, phrases in fx.INTENTS]
    return f"SELECT source, intent, count(*) AS documents FROM (SELECT source, CASE {' '.join(cases)} ELSE 'general' END AS intent FROM (SELECT source, {clean} AS c FROM documents)) GROUP BY ALL"


def _found(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT finding_id AS id, lot_id, '{kind}' AS kind, unnest(range(0, len(w))) AS place, upper(unnest(w)) AS word FROM (SELECT *, regexp_extract_all(evidence, '{p}', 1) AS w FROM mock_findings WHERE evidence IS NOT NULL)"


_CLAIMS = S + _BASE + """,
fp AS (
  SELECT lot_id, step, tool_id, parameter, abs((value - base_mean) / base_sd) AS z,
         CASE WHEN n < 2 OR (lo IS NULL AND hi IS NULL) THEN NULL WHEN pop_sd <= 1e-12 THEN CASE WHEN pop_mean < lo OR pop_mean > hi THEN 0.0 ELSE 9.99 END
              ELSE least((hi - pop_mean) / (3 * pop_sd), (pop_mean - lo) / (3 * pop_sd)) END AS cpk
  FROM (SELECT * FROM steps WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lot_id, step, tool_id, parameter ORDER BY ts DESC, id DESC) = 1)
       JOIN base USING (step, tool_id, parameter)),
refs AS (SELECT lot_id, list(z) AS sigmas, list(cpk) FILTER (WHERE cpk IS NOT NULL) AS cpks, list(tool_id) AS tools FROM fp GROUP BY lot_id),
sc AS (SELECT lot_id, list(v) AS scores FROM (SELECT lot_id, unnest([risk_score, probability]) AS v FROM mock_findings) WHERE v BETWEEN 0 AND 1 GROUP BY lot_id),
cl AS (SELECT *, CASE WHEN kind <> 'tool' THEN TRY_CAST(word AS DOUBLE) END AS value FROM (""" + " UNION ALL ".join(_found(k, p) for k, p in fx.claim_patterns().items()) + """)),
ck AS (
  SELECT id, kind, CAST(place AS INTEGER) AS place, word,
         CASE WHEN kind = 'tool' THEN coalesce(list_contains(tools, word), true)
              WHEN kind = 'sigma' THEN len(list_filter(list_concat(coalesce(sigmas, []), [1.5, 2.0, 3.0, 6.0]), lambda r: abs(value - r) <= 0.5)) > 0
              WHEN kind = 'cpk' THEN coalesce(len(cpks), 0) = 0 OR len(list_filter(cpks, lambda r: abs(value - r) <= greatest(0.10, 0.05 * value))) > 0
              ELSE coalesce(len(scores), 0) = 0 OR len(list_filter(scores, lambda r: abs(value - r) <= greatest(0.05, 0.05 * value))) > 0 END AS grounded
  FROM cl LEFT JOIN refs USING (lot_id) LEFT JOIN sc USING (lot_id) WHERE kind <> 'risk_score' OR value <= 1)
"""

def _levels(by: str) -> str:
    return f"""(
  SELECT {by}, nominal, least(nominal, CASE WHEN lim THEN greatest(nominal - size, lo) ELSE nominal - size END) AS low, greatest(nominal, CASE WHEN lim THEN least(nominal + size, hi) ELSE nominal + size END) AS high FROM (
    SELECT *, lo IS NOT NULL AND hi IS NOT NULL AS lim, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE mean END AS nominal,
           CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (hi - lo) * 1e-1 WHEN sd > 1e-6 THEN 2 * sd WHEN mean = 0 THEN 1.0 ELSE abs(mean) * 1e-1 END AS size FROM (
      SELECT {by}, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, arg_min(spec_min, (ts, id)) FILTER (WHERE spec_min IS NOT NULL) AS lo,
             arg_min(spec_max, (ts, id)) FILTER (WHERE spec_max IS NOT NULL) AS hi FROM steps WHERE value IS NOT NULL GROUP BY {by})))"""


ORACLE = {
    "doe_levels": S + f""", n AS (SELECT lower(trim(injected_cause_step)) AS step, upper(trim(injected_cause_tool_id)) AS tool_id, injected_cause_parameter AS parameter FROM cause_labels),
w AS (SELECT * FROM (SELECT DISTINCT step, tool_id FROM n), (SELECT DISTINCT parameter FROM n))
SELECT step, tool_id, parameter, round(coalesce(a.nominal, b.nominal, c.nominal), 6) AS nominal, round(coalesce(a.low, b.low, c.low), 6) AS low, round(coalesce(a.high, b.high, c.high), 6) AS high,
       CASE WHEN a.nominal IS NOT NULL THEN 'step' WHEN b.nominal IS NOT NULL THEN 'tool' WHEN c.nominal IS NOT NULL THEN 'parameter' END AS "from"
FROM w LEFT JOIN {_levels("step, tool_id, parameter")} a USING (step, tool_id, parameter) LEFT JOIN {_levels("tool_id, parameter")} b USING (tool_id, parameter) LEFT JOIN {_levels("parameter")} c USING (parameter)""",
    "lot_excursions": S + """,
sc AS (
  SELECT lot_id, step, tool_id, parameter, id, abs(value - (spec_min + spec_max) / 2) / CASE WHEN spec_max > spec_min THEN (spec_max - spec_min) / 6 ELSE 1.0 END AS z0,
         CASE WHEN spec_max > spec_min THEN least(spec_max - value, value - spec_min) / (3 * ((spec_max - spec_min) / 6)) ELSE 1.5 END AS capability
  FROM steps WHERE value IS NOT NULL AND spec_min IS NOT NULL AND spec_max IS NOT NULL),
r AS (SELECT *, z0 AS z, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY round(z0, 9) DESC, step, tool_id, parameter, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3)
SELECT lot_id, rank, step, tool_id, parameter, id, round(z, 6) AS z, round(capability, 6) AS capability, round(exp(least(z, 6.0)) / sum(exp(least(z, 6.0))) OVER (PARTITION BY lot_id), 6) AS probability,
       round(least(0.95, 0.35 + 0.15 * z), 6) AS score FROM r""",
    "doe_factors": _FACTORS + "SELECT lot_id, tool_id, factor, parameter, round(nominal, 6) AS nominal, round(low, 6) AS low, round(high, 6) AS high FROM fac",
    "doe_runs": _FACTORS + """,
k AS (SELECT lot_id, CAST(pow(2, count(*)) AS INTEGER) AS corners FROM fac GROUP BY lot_id),
ru AS (SELECT fac.*, corners, unnest(range(1, corners + 4)) AS run FROM fac JOIN k USING (lot_id)),
co AS (SELECT *, CASE WHEN run > corners THEN 0 WHEN ((run - 1) // CAST(pow(2, factor) AS BIGINT)) % 2 = 1 THEN 1 ELSE -1 END AS coded FROM ru)
SELECT lot_id, tool_id, CAST(run AS INTEGER) AS run, CASE WHEN run > corners THEN 'center' ELSE 'corner' END AS type, factor, parameter, coded,
       round(CASE coded WHEN 0 THEN nominal WHEN 1 THEN high ELSE low END, 6) AS value,
       CAST(least(greatest(ceil(16 / (greatest(deviation_score, 0.3) * greatest(deviation_score, 0.3))), 4), 25) AS INTEGER) AS wafers FROM co""",
    "doe_order": _FACTORS + """,
ru AS (SELECT lot_id, corners, unnest(range(1, corners + 4)) AS run FROM (SELECT lot_id, CAST(pow(2, count(*)) AS INTEGER) AS corners FROM fac GROUP BY lot_id))
SELECT lot_id, CAST(run AS INTEGER) AS run, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY md5(concat_ws('|', lot_id, run, 42)), run) AS INTEGER) AS run_order,
       CASE WHEN run > corners THEN 'center' ELSE 'corner' END AS type FROM ru""",
    "bm25_scores": _KB + "SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm",
    "tfidf_scores": _KB + "SELECT query_id, id, round(cosine, 6) AS cosine FROM cs",
    "hybrid_search": _KB + "SELECT query_id, rank, id, round(score, 6) AS score, CASE WHEN boost > 0.3 THEN 'domain_boost' WHEN part > cos THEN 'bm25' ELSE 'tfidf' END AS method FROM hy",
    "cause_search": _kb("""
  SELECT concat_ws(' ', step, tool, parameter, signature) AS query_id, concat_ws(' ', step, tool, replace(parameter, '_', ' '), signature) AS q, step, upper(trim(tool)) AS tool FROM (
    SELECT DISTINCT lower(trim(injected_cause_step)) AS step, injected_cause_tool_id AS tool, injected_cause_parameter AS parameter, injected_signature AS signature FROM cause_labels)""") + """,
sc AS (
  SELECT query_id, docs.id, least(coalesce(bm25, 0) / 20, 1) AS part, coalesce(cosine, 0) AS cos, least(25e-2 + 15e-2 + CASE WHEN contains(upper(text), tool) THEN 2e-1 ELSE 0 END, 1) AS boost
  FROM docs JOIN qs ON docs.step = qs.step LEFT JOIN bm USING (query_id, id) LEFT JOIN cs USING (query_id, id)),
hy AS (
  SELECT *, 6e-1 * part + 4e-1 * cos + 3e-1 * boost AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(6e-1 * part + 4e-1 * cos + 3e-1 * boost, 9) DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3)
SELECT query_id, rank, id, round(score, 6) AS score, CASE WHEN boost > 0.3 THEN 'domain_boost' WHEN part > cos THEN 'bm25' ELSE 'tfidf' END AS method FROM hy""",
    "merged_search": _kb("""
  SELECT subject || ': name' AS query_id, replace(subject, '_', ' ') AS q FROM subject_areas UNION ALL SELECT subject || ': description', description FROM subject_areas""") + _ALL + """
SELECT subject, id, round(best, 6) AS score, CAST(row_number() OVER (PARTITION BY subject ORDER BY round(best, 9) DESC, id) AS INTEGER) AS rank
FROM (SELECT split_part(query_id, ': ', 1) AS subject, id, max(score) AS best FROM hy GROUP BY ALL) QUALIFY rank <= 5""",
    "reranked_search": _kb("SELECT subject AS query_id, replace(subject, '_', ' ') || ' ' || description AS q FROM subject_areas") + _ALL + """,
more AS (SELECT query_id, id, round(score + CASE WHEN boost > 0 THEN 3e-1 ELSE 0.0 END, 4) AS score FROM hy)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM more QUALIFY rank <= 3""",
    "search_grades": _KB + """,
g AS (
  SELECT hy.query_id, hy.id, score, coalesce(len(list_intersect(list_distinct(qs.toks), docs.toks)) / nullif(len(list_distinct(qs.toks)), 0), 0) AS overlap FROM hy JOIN docs USING (id) JOIN qs USING (query_id)),
n AS (SELECT *, CASE WHEN score >= 0.4 AND overlap >= 0.2 THEN 2 WHEN score >= 0.15 OR overlap >= 0.1 THEN 1 ELSE 0 END AS k FROM g)
SELECT query_id, id, round(overlap, 6) AS overlap, ['irrelevant', 'partial', 'relevant'][k + 1] AS grade, ['irrelevant', 'partial', 'relevant'][max(k) OVER (PARTITION BY query_id) + 1] AS query_grade FROM n""",
    "document_intents": _when_rules(),
    "evidence_claims": _CLAIMS + "SELECT * FROM ck",
    "evidence_marked": _CLAIMS + r"""
SELECT finding_id AS id, lot_id, evidence AS text, CASE WHEN w IS NULL THEN evidence ELSE list_reduce(list_prepend(evidence, w), lambda t, x:
         regexp_replace(t, '(?i)(^|[^\w.σ])(' || regexp_escape(x) || ')($|[^\wσ])', '\1[UNVERIFIED: \2]\3')) END AS marked
FROM mock_findings f LEFT JOIN (SELECT id, list_sort(list(DISTINCT word)) AS w FROM ck WHERE NOT grounded GROUP BY id) b ON b.id = f.finding_id""",
    "evidence_grounding": _CLAIMS + """
SELECT f.finding_id AS id, coalesce(n, 0) AS claims, coalesce(g, 0) AS grounded, round(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE g / n END, 6) AS rate, coalesce(n, 0) = coalesce(g, 0) AS passed
FROM mock_findings f LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (WHERE grounded) AS g FROM ck GROUP BY id) c ON c.id = f.finding_id""",
}
