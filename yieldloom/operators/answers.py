"""Assessments of answers to questions: scope, claims of probability, use of retrieved documents, views of a query.

Inputs are columns of one table of answers; nothing is joined. Null texts count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

#: Words near a percentage that make it a claim of probability.
PROBABILITY_WORDS = ["probab", "confidence", "likelihood", "chance", "calibrated"]
#: Words that carry no meaning when answers and documents are compared.
PLAIN_WORDS = "the a an and or in on at to for with by from is are was were this that these those it its as be of lot".split()


def out_of_scope(text: Column, blocked: Sequence[str]) -> Column:
    """Whether one of the words or phrases stands in the text as a whole word."""
    pattern = "|".join(re.escape(w.lower()) for w in blocked)
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{pattern})\b"), F.lit(False)) if blocked else F.lit(False)


def probability_claims(text: Column, around: int = 50) -> Column:
    """The whole percentages from 5 to 100 with a word of probability within `around` characters, in order.

    It needs the place of each match, which Spark's functions don't give, so batches of texts go through pandas.
    """
    percent = re.compile(r"(?<![.\d])(\d{1,3})\s*%")

    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            out = []
            for m in percent.finditer(t or ""):
                near = t[max(0, m.start() - around) : m.end() + around].lower()
                if 5 <= int(m[1]) <= 100 and any(w in near for w in PROBABILITY_WORDS):
                    out.append(float(m[1]))
            return out

        return texts.map(one)

    return found(text)


def words(text: Column) -> Column:
    """The different words of three and more characters, lower case, without plain words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9_-]{3,}\b"), F.lit(0)))
    return F.array_except(F.coalesce(found, F.array().cast("array<string>")), F.array(*map(F.lit, PLAIN_WORDS)))


def retrieval_quality(answer: Column, docs: Column, entities: Column) -> dict[str, Column]:
    """precision, recall and utilization of retrieved docs (array of structs id, title, content) in an answer.

    precision: documents that the answer names by id or title (of more than six characters). recall: entities that occur in the
    documents, 1 without entities. utilization: shared words over the documents' words, of which 30 count at most;
    0.5 without words. All are 1 without documents.
    """
    up = F.upper(F.coalesce(answer, F.lit("")))
    names = lambda v: F.coalesce((v != "") & up.contains(F.upper(v)), F.lit(False))
    cited = F.filter(docs, lambda d: names(d["id"]) | ((F.coalesce(F.length(d["title"]), F.lit(0)) > 6) & names(d["title"])))
    text = F.array_join(F.transform(docs, lambda d: F.concat_ws(" ", d["title"], d["content"])), " ")
    wanted = F.array_distinct(F.transform(entities, F.upper))
    hits = F.size(F.filter(wanted, lambda e: F.upper(text).contains(e)))
    a, b = words(answer), words(text)
    used = F.least(F.lit(1.0), F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(b), F.lit(30))))
    none = F.coalesce(F.size(docs) <= 0, F.lit(True))
    return {
        "precision": F.when(none, 1.0).otherwise(F.size(cited) / F.size(docs)),
        "recall": F.when(none | F.coalesce(F.size(wanted) <= 0, F.lit(True)), 1.0).otherwise(F.try_divide(hits, F.size(wanted))),
        "utilization": F.when(none, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(used),
    }


def overall_confidence(grounding: Column, utilization: Column) -> Column:
    return 0.6 * grounding + 0.4 * utilization


def sub_queries(query: Column, views: Sequence[Column], most: int = 3) -> Column:
    """The query and its views, as of the caller (null: no such view); different ones, the first `most`."""
    return F.slice(F.array_distinct(F.array_compact(F.array(query, *views))), 1, most)
