"""Ranked retrieval of documents for a set of queries: BM25, TF-IDF cosine and domain boosts.

Documents are cut into terms once: the postings (id, term, tf), the terms (term, df) and the documents (id, length, norm) are
written to the shared folder, over all documents and whole texts, and any number of query sets reads them. The queries are the
small side: their terms are broadcast (if there are few, which is counted first), so that only postings of those terms are
read on; lengths and norms are joined to the scores by document.

Documents without tokens are documents but match nothing; queries without tokens have no results. Ties rank by
document id.

Boosts: docs may have parameter (string) and signatures (array of strings) beside step. causes are the candidate causes a query
is about, one a row: query_id, step, tool_id, parameter, spatial_signature. They are summed to one map of counts a query, as
large as the names in it, not as the causes. Names are compared in one spelling; null and empty ones match nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from yieldloom.functions import text as fx
from yieldloom.functions.columns import canonical
from yieldloom.session import materialize

#: Most query terms that are broadcast; larger query sets are joined by shuffle.
BROADCAST_TERMS = 100_000
#: How often each field of a document stands in its text.
FIELD_WEIGHTS = {"title": 3, "step": 3, "parameter": 2, "signatures": 2, "keywords": 2, "procedures": 1, "precedents": 1, "trigger": 1, "id": 1}


@dataclass
class Index:
    postings: DataFrame  # id, term, tf; pairs of words have a blank in them
    terms: DataFrame  # term, df
    docs: DataFrame  # id, len (in words), norm (of the TF-IDF vector)
    documents: int
    mean_length: float


def _idf(documents: int) -> Column:
    return F.log((1.0 + documents) / (1 + F.col("df"))) + 1


def _meant() -> Column:
    return ~F.col("term").isin(fx.STOP_WORDS)


def build_index(docs: DataFrame, write: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, make: materialize(make(), name)) -> Index:
    """docs: id, text. write(name, make) writes a table and gives it back."""
    tf = write("postings", lambda: fx.with_terms(docs, "text", "id").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = write("terms", lambda: tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))

    def lengths() -> DataFrame:
        n = docs.count()
        common = df.filter("df > 1")  # a term of one document has df 1; the others are far fewer
        common = F.broadcast(common) if common.count() <= BROADCAST_TERMS else common
        w = (1 + F.log("tf")) * _idf(n)
        t = tf.join(common, "term", "left").fillna(1, ["df"])
        t = t.groupBy("id").agg(F.sum(F.when(~F.contains("term", F.lit(" ")), F.col("tf"))).alias("len"), F.sqrt(F.sum(F.when(_meant(), w * w))).alias("norm"))
        return docs.select("id").join(t, "id", "left").fillna(0, ["len"])

    known = write("documents", lengths)
    n, mean = known.agg(F.count(F.lit(1)), F.avg("len")).first()
    return Index(tf, df, known, n, mean or 0.0)


def _hint(queries: DataFrame):
    """broadcast() for what has at most as many rows as the queries have terms, if those are few; else nothing."""
    n = queries.select(F.sum(F.size(fx.tokens(F.col("text"))))).first()[0] or 0
    return F.broadcast if n <= BROADCAST_TERMS else lambda t: t


def bm25(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """queries: query_id, text. Returns query_id, id, bm25 for pairs with a common token.

    A token that a query repeats counts as often.
    """
    small = _hint(queries)
    q = queries.select("query_id", F.explode(fx.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = index.terms.join(small(q), "term")
    p = index.postings.join(small(q), "term").join(index.docs.select("id", "len"), "id")
    idf = F.log((index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / index.mean_length))
    return p.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * idf * weight).alias("bm25"))


def tfidf(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, cosine of sublinear, L2-normalised TF-IDF vectors over words that are no stop words, and pairs."""
    small = _hint(queries)
    idf = _idf(index.documents)
    q = fx.with_terms(queries, "text", "query_id").filter(_meant()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    q = index.terms.join(small(q), "term").select("query_id", "term", idf.alias("idf"), ((1 + F.log("tf")) * idf).alias("qw"))
    q = q.join(q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") ** 2)).alias("qn")), "query_id").select("query_id", "term", "idf", (F.col("qw") / F.col("qn")).alias("qw"))
    dots = index.postings.join(small(q), "term").groupBy("query_id", "id").agg(F.sum(F.col("qw") * (1 + F.log("tf")) * F.col("idf")).alias("dot"))
    return dots.join(index.docs.select("id", "norm"), "id").select("query_id", "id", (F.col("dot") / F.col("norm")).alias("cosine"))


def weighted_text(docs: DataFrame, weights: dict[str, int] = FIELD_WEIGHTS, separator: str = " ") -> Column:
    """The fields that docs has (strings or arrays of strings) as one text, each as often as its weight says.

    The separator stands between repetitions; an empty one makes one long word of them, which is of no use but for parity.
    """
    field = lambda c: F.concat_ws(" ", c if docs.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"))
    return F.concat_ws(" ", *[F.array_join(F.array_repeat(field(c), n), separator) for c, n in weights.items() if c in docs.columns])


def _facts(docs: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """id, step, parameter, signatures in lower case, and tools: those of the causes that the text mentions."""
    none = F.array().cast("array<string>")
    names = [(F.lower(c) if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("step", "parameter")]
    signatures = F.coalesce(F.array_distinct(F.transform("signatures", lambda s: F.lower(s))), none) if "signatures" in docs.columns else none
    if causes is None:
        return docs.select("id", *names, signatures.alias("signatures"), none.alias("tools"))
    known = causes.select(F.array_remove(F.collect_set(canonical("tool_id")), "").alias("_known"))
    mentioned = F.transform(F.array(F.upper("text")), lambda u: F.filter("_known", lambda k: F.contains(u, k)))[0]
    return docs.crossJoin(F.broadcast(known)).select("id", *names, signatures.alias("signatures"), F.coalesce(mentioned, none).alias("tools"))


def _asked(queries: DataFrame, causes: DataFrame | None, *more: str) -> DataFrame:
    """query_id, q (lower case), named: how many causes have a name, by keys like "step:etch"; and columns that queries may have."""
    optional = [(F.lower(c) if c in queries.columns else F.lit(None).cast("string")).alias(c) for c in more]
    q = queries.select("query_id", F.lower("text").alias("q"), *optional)
    if causes is None:
        return q.withColumn("named", F.lit(None).cast("map<string, bigint>"))
    kinds = {"step": F.lower("step"), "parameter": F.lower("parameter"), "signature": F.lower("spatial_signature"), "tool": canonical("tool_id")}
    names = F.array(*[F.concat(F.lit(f"{k}:"), F.nullif(c, F.lit(""))) for k, c in kinds.items()])
    n = causes.select("query_id", F.explode(names).alias("name")).filter("name is not null").groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return q.join(n.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("named")), "query_id", "left")


def _in_query(name: Column) -> Column:
    return F.coalesce((name != "") & F.contains(F.col("q"), name), F.lit(False))


def _causes(kind: str, name: Column) -> Column:
    """How many of the query's causes have that name."""
    return F.coalesce(F.try_element_at("named", F.concat(F.lit(f"{kind}:"), name)), F.lit(0).cast("long"))


def _causes_in(kind: str, names: str) -> Column:
    return F.aggregate(names, F.lit(0).cast("long"), lambda n, x: n + _causes(kind, x))


def domain_boost() -> Column:
    """Over pairs of _facts and _asked: 0.25 for a step that the query names, 0.2 for a parameter, 0.15 for any signature, and for
    each cause 0.15 for its step, 0.15 for its parameter, 0.1 for its signature and 0.2 for its tool in the text; up to 1."""
    part = lambda hit, v: F.when(hit, v).otherwise(0.0)
    named = part(_in_query(F.col("step")), 0.25) + part(_in_query(F.col("parameter")), 0.2) + part(F.exists("signatures", _in_query), 0.15)
    known = 0.15 * (_causes("step", F.col("step")) + _causes("parameter", F.col("parameter"))) + 0.1 * _causes_in("signature", "signatures") + 0.2 * _causes_in("tool", "tools")
    return F.least(named + known, F.lit(1.0))


def hybrid(docs: DataFrame, queries: DataFrame, top: int = 5, alpha: float = 0.6, causes: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """docs: id, text, step; the top documents of each query by alpha * bm25 / 20 + (1 - alpha) * cosine + 0.3 * domain_boost.

    bm25 / 20 counts up to 1. Scores of 0 are left out; a document without a common word can come in by its boost, so
    boosts are taken over all documents for each of the queries, each a look at a few names. Where queries have step_filter, only
    documents of that step count.
    """
    small = _hint(queries)
    index = index or build_index(docs.select("id", "text"))
    asked = _asked(queries, causes, "step_filter").filter(F.size(fx.tokens(F.col("q"))) > 0)
    facts, whole = _facts(docs, causes), asked.filter("step_filter is null").drop("step_filter")
    pairs = facts.crossJoin(small(whole))
    if "step_filter" in queries.columns:
        pairs = pairs.unionByName(facts.join(small(asked.withColumnRenamed("step_filter", "step")), "step"))
    boosts = pairs.select("query_id", "id", domain_boost().alias("boost")).filter("boost > 0")
    t = bm25(index, queries).join(tfidf(index, queries), ["query_id", "id"], "full").join(boosts, ["query_id", "id"], "full").fillna(0.0, ["boost"])
    shown = [c for c in ("step", "parameter", "signatures") if c in docs.columns]
    t = t.join(docs.select("id", *shown), "id")
    if "step_filter" in queries.columns:
        t = t.join(small(asked.select("query_id", "step_filter")), "query_id").filter(F.col("step_filter").isNull() | (F.lower("step") == F.col("step_filter")))
    part = F.least(F.coalesce("bm25", F.lit(0.0)) / 20, F.lit(1.0))
    cos = F.coalesce("cosine", F.lit(0.0))
    t = t.select("query_id", "id", *shown, part.alias("part"), cos.alias("cos"), "boost", (alpha * part + (1 - alpha) * cos + 0.3 * F.col("boost")).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    t = t.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= top) & (F.col("score") > 0))
    method = F.when(F.col("boost") > 0.3, "domain_boost").when(F.col("part") > F.col("cos"), "bm25").otherwise("tfidf")
    return t.select("query_id", "rank", "id", *shown, "score", method.alias("method"))


def cause_queries(causes: DataFrame, id_col: str) -> DataFrame:
    """A query per candidate cause (step, tool_id, parameter, spatial_signature), of its names, for documents of its step only."""
    words = F.concat_ws(" ", "step", "tool_id", F.replace("parameter", F.lit("_"), F.lit(" ")), "spatial_signature")
    return causes.select(F.col(id_col).alias("query_id"), words.alias("text"), F.col("step").alias("step_filter"))


def with_stubs(docs: DataFrame, stubs: DataFrame) -> DataFrame:
    """The documents and those promoted stubs that have an id of their own; columns that one side lacks are null."""
    return docs.unionByName(stubs.filter("id is not null").join(docs.select("id"), "id", "left_anti"), allowMissingColumns=True)


def merge(results: DataFrame, group: str, top: int = 5) -> DataFrame:
    """Results of several sub-queries of one question: each document once with its best score, the top ones."""
    best = results.groupBy(group, "id").agg(F.max("score").alias("score"))
    w = W.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rerank(results: DataFrame, queries: DataFrame, top: int = 3, causes: DataFrame | None = None) -> DataFrame:
    """Results (of hybrid, with the columns of docs that boosts use) again by score with more added.

    0.5 where the query names the document's parameter, with _ or blanks, 0.3 its step, 0.2 where the findings are of its step
    (finding_step of queries, if there), and for each cause 0.25 for its parameter and 0.15 for its signature.
    """
    part = lambda hit, v: F.when(F.coalesce(hit, F.lit(False)), v).otherwise(0.0)
    step, parameter = F.col("_f.step"), F.col("_f.parameter")
    none = F.array().cast("array<string>")
    facts = [(F.lower(c) if c in results.columns else F.lit(None).cast("string")).alias(c) for c in ("step", "parameter")]
    signatures = F.coalesce(F.array_distinct(F.transform("signatures", lambda s: F.lower(s))), none) if "signatures" in results.columns else none
    t = results.withColumn("_f", F.struct(*facts)).withColumn("_signatures", signatures).join(_hint(queries)(_asked(queries, causes, "finding_step")), "query_id")
    more = part(_in_query(parameter) | _in_query(F.replace(parameter, F.lit("_"), F.lit(" "))), 0.5) + part(_in_query(step), 0.3) + part((step != "") & (step == F.col("finding_step")), 0.2)
    more = more + 0.25 * _causes("parameter", parameter) + 0.15 * _causes_in("signature", "_signatures")
    t = t.withColumn("score", F.round(F.col("score") + more, 4))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*dict.fromkeys([*results.columns, "rank"]))


def grade(results: DataFrame, docs: DataFrame, queries: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """Each result relevant, partial or irrelevant by score and shared tokens, the best grade of its query, and used.

    A high score is relevant with enough shared tokens or when step or parameter are those of a cause of the query. Used are the
    relevant results, or, where a query has none, the partial ones. query_grades has the queries that need a fallback.
    """
    small = _hint(queries)
    q = small(_asked(queries, causes).select("query_id", fx.tokens(F.col("q")).alias("qt"), "named"))
    t = results.select("query_id", "id", "score").join(q, "query_id").join(docs.select("id", fx.tokens(F.col("text")).alias("dt")), "id").join(_facts(docs), "id")
    t = t.withColumn("overlap", fx.overlap(F.col("qt"), F.col("dt")))
    found = (_causes("step", F.col("step")) > 0) | (_causes("parameter", F.col("parameter")) > 0)
    g = F.when((F.col("score") >= 0.4) & ((F.col("overlap") >= 0.2) | found), 2).when((F.col("score") >= 0.15) | (F.col("overlap") >= 0.1), 1).otherwise(0)
    t = t.withColumn("g", g).withColumn("all", F.max("g").over(W.partitionBy("query_id")))
    name = lambda c: F.element_at(F.array(F.lit("irrelevant"), F.lit("partial"), F.lit("relevant")), F.col(c) + 1)
    return t.select("query_id", "id", "score", "overlap", name("g").alias("grade"), name("all").alias("query_grade"), ((F.col("g") == F.col("all")) & (F.col("g") > 0)).alias("used"))


def query_grades(graded: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, query_grade, fallback: every query, those without results too; irrelevant ones fall back on the findings."""
    t = queries.select("query_id").join(graded.select("query_id", "query_grade").distinct(), "query_id", "left").fillna("irrelevant", ["query_grade"])
    return t.withColumn("fallback", F.col("query_grade") == "irrelevant")
