"""Subject areas of documents from latent Dirichlet topics over their sentences.

1. Texts are cut into words and sentence ends by Arrow's string functions, whole batches at a time; only the different
   character strings of a task are looked at one by one. The vocabulary is every word, and every pair of neighbouring
   known words, in at least min_share of the documents, the most_terms most frequent ones if there are more; it and the
   topics are the only things that pass through the driver. Document frequencies are counted over all documents. The
   known words of every sentence are written once, as numbers.
2. Topics are fitted by collapsed variational Bayes (CVB0): each task holds the topic-term weights, infers the
   topics of its sentences and returns expected term counts, which Spark adds up by term. A bounded sample of
   labelled documents guides the start: in their sentences, only the topics of their subjects and the general
   topics are possible. Then a pass over all documents fits the topics without labels.
3. Topics are mapped to subjects by their top terms: each term votes for the subjects of the labelled
   documents it occurs in; a topic whose top terms agree on no subject stays general.
4. A sentence treats the subject that most of its terms' weight in subject topics belongs to, if that weight
   reaches treats of the sentence. A document gets the subjects of at least share of its treating sentences.

Null, empty and blank texts, and texts without a sentence that treats a subject, have no subject. Equal texts
get equal subjects. Of repeated labels one counts; labels of unknown subjects or documents are ignored. Without
labels, the descriptions of the subjects alone guide the topics. Markup, wrongly decoded UTF-8 and digits in the
place of letters are undone where they stand, and codes (tools, lots, numbers) are no words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from yieldloom.session import materialize

#: Between these strings a text is cut; points, dashes and ends of lines stay with the words until _pieces().
_GAPS = r"[^\p{L}\p{N}_.!?\n-]+"
#: A code (word with a digit, name-number), or in group 1 a word of two letters and more or the end of a sentence.
_PIECE = re.compile(r"\w*\d\w*(?:\.+\w+)*|[^\W\d_]+-\d[\w-]*|([^\W\d_]{2,}|[.!?]+$|\n)")
_TAG = re.compile(r"<[^<>]*>")
_MIXED = re.compile(r"[^\W\d_]*(?:[^\W\d_]\d|\d[^\W\d_])\w*")
#: Runs of characters that UTF-8 bytes of one letter or sign become when they are read as Windows-1252.
_WRONG = re.compile("[\u00c2-\u00df][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]|[\u00e0-\u00ef][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{2}")
#: Fixed value: digits that stand for letters in mistyped words.
_DIGITS = str.maketrans("01345", "oleas")


def _decoded(m: re.Match) -> str:
    """The letter whose bytes these are, or what stood there."""
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def repair(text: str) -> str:
    """Markup taken out and wrongly decoded letters put right; everything else stays."""
    text = _WRONG.sub(_decoded, text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    return html.unescape(text) if "&" in text else text


def _letters(m: re.Match) -> str:
    """A word of two letters and more with at most as many digits, its letters put back; parts of codes stay."""
    word, digits = m[0], sum(c.isdigit() for c in m[0])
    before, after = m.string[: m.start()], m.string[m.end() :]
    if len(word) - digits < 2 or 2 * digits > len(word) or before.endswith("-") or re.match(r"-[\w-]*\d", after):
        return word
    return word.translate(_DIGITS)


def _pieces(string: str) -> list[str]:
    """The words and ends of sentences ("." for any) in one string without gaps, lower case."""
    if any(c.isdigit() for c in string):
        string = _MIXED.sub(_letters, string)
    return [x if x[0].isalpha() else "." for x in _PIECE.findall(string) if x]


class Cutter:
    """Texts as numbers of words, as of this task; number 0 is the end of a sentence."""

    def __init__(self, known: list[str] | None = None):
        """known: the only words that have a number; others are -1."""
        self.number = {w: i + 1 for i, w in enumerate(known or [])} | {".": 0}
        self.closed = known is not None
        self.pieces: dict[str, list[int]] = {}

    def _of(self, string: str) -> list[int]:
        if string not in self.pieces:
            words = _pieces(string)
            if len(self.pieces) > 500_000:
                self.pieces.clear()
            self.pieces[string] = [self.number.get(w, -1) if self.closed else self.number.setdefault(w, len(self.number)) for w in words]
        return self.pieces[string]

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words and sentence ends, one after another, and the row of each."""
        odd = pc.fill_null(pc.match_substring_regex(texts, "[<&ÂÃâ]"), False)
        if pc.any(odd).as_py():
            texts = pc.replace_with_mask(texts, odd, pa.array([repair(t) for t in texts.filter(odd).to_pylist()], texts.type))
        lists = pc.split_pattern_regex(pc.replace_substring(pc.utf8_lower(texts), "\n", " \n "), _GAPS)
        coded = lists.flatten().dictionary_encode()
        pieces = [self._of(s) for s in coded.dictionary.to_pylist()]
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = np.array([x for p in pieces for x in p], np.int64)
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        many = sizes[index]
        # Each string's pieces, put in the place of the string.
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return flat[np.repeat(first[index], many) + within], np.repeat(row, many)


@dataclass(frozen=True)
class SubjectConfig:
    #: Share of the documents a term of the vocabulary must occur in, and least number of them; most terms.
    min_share: float = 5e-4
    min_documents: int = 3
    most_terms: int = 100_000
    general_topics: int = 8
    #: Most labelled documents that guide the start.
    labelled: int = 20_000
    guided_rounds: int = 3
    rounds: int = 1
    alpha: float = 0.1
    eta: float = 0.01
    inner: int = 5
    #: A term belongs to a subject from this share of its labelled sentences on, if that is significant.
    own: float = 0.4
    top_terms: int = 50
    treats: float = 0.3
    share: float = 0.2
    most: int = 3
    seed: int = 0


@dataclass
class Topics:
    """The fitted model: bounded by vocabulary and number of topics."""

    words: list[str]
    pairs: np.ndarray  # of two words, first * len(words) + second; their terms follow those of the words
    subjects: list[str]
    counts: np.ndarray  # topics x terms
    labelled: np.ndarray  # subjects x terms
    subject_of: list[int] = field(default_factory=list)  # of each topic; -1: general

    def term(self, i: int) -> str:
        v = len(self.words)
        return self.words[i] if i < v else f"{self.words[self.pairs[i - v] // v]} {self.words[self.pairs[i - v] % v]}"

    def weights(self, eta: float) -> np.ndarray:
        c = self.counts + eta
        return np.ascontiguousarray((c / c.sum(axis=1, keepdims=True)).T.astype(np.float32))


def _frequent(df: DataFrame, term: str, least: float, most: int) -> DataFrame:
    """Of rows of term and df, as tasks have counted them, the most frequent terms of enough documents."""
    return df.groupBy(term).agg(F.sum("df").alias("df")).filter(F.col("df") >= least).orderBy(F.desc("df"), term).limit(most).select(term)


def vocabulary(docs: DataFrame, text: str, least: float, c: SubjectConfig) -> list[str]:
    """Words of at least so many documents, sorted; document frequencies are counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(), np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            some = np.flatnonzero(seen[1:]) + 1
            names = list(cutter.number)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(seen[some])], names=["term", "df"])

        for batch in batches:
            word, row = cutter.cut(batch.column(0))
            pair = np.unique(row * len(cutter.number) + word)  # each word once a document
            n = np.bincount(pair % len(cutter.number), minlength=len(cutter.number))
            n[: len(seen)] += seen
            seen = n
            if len(seen) > 500_000:
                yield counted()
                cutter, seen = Cutter(), np.zeros(0, np.int64)
        if len(seen):
            yield counted()

    df = docs.select(text).mapInArrow(count, "term string, df long")
    return sorted(r.term for r in _frequent(df, "term", least, c.most_terms).collect())


def encode(docs: DataFrame, id_col: str, text: str, words: list[str]) -> DataFrame:
    """id, words (numbers of the words of all sentences, one after another; -1: not in the vocabulary), sizes (words of each sentence)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for batch in batches:
            word, row = cutter.cut(batch.column(1))
            sentence = np.cumsum(word == 0) + row  # grows with every end and every document
            keep = word != 0
            word, row, sentence = np.where(word > 0, word - 1, -1)[keep], row[keep], sentence[keep]
            new = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(word) else np.empty(0, int)
            lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))].astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(row, word), lists(row[new], np.diff(np.r_[new, len(word)]))], names=["id", "words", "sizes"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, words array<int>, sizes array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each sentence, words of each sentence, and row of each sentence."""
    words, sizes = (batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("words", "sizes"))
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False))
    return words, np.cumsum(sizes) - sizes, sizes, row


def _neighbours(words: np.ndarray, starts: np.ndarray, v: int) -> np.ndarray:
    """For each word the number of the pair with the one before it in its sentence; -1 if either is unknown or there is none."""
    pair = np.r_[-1, np.where((words[1:] >= 0) & (words[:-1] >= 0), words[:-1] * v + words[1:], -1)][: len(words)]
    pair[starts] = -1
    return pair


def pairs(encoded: DataFrame, v: int, least: float, c: SubjectConfig) -> np.ndarray:
    """Pairs of neighbouring words in at least so many documents, as sorted numbers first * v + second."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = pd.Series(dtype=np.int64)
        for batch in batches:
            words, starts, sizes, row = _flat(batch)
            pair = _neighbours(words, starts, v)
            doc = np.repeat(row, sizes)
            some = pair >= 0
            once = np.unique(doc[some] * (v * v) + pair[some]) % (v * v)
            code, n = np.unique(once, return_counts=True)
            total = total.add(pd.Series(n, code), fill_value=0)
            if len(total) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.index.to_numpy(np.int64)), pa.array(total.to_numpy(np.int64))], names=["pair", "df"])
                total = total.iloc[:0]
        yield pa.RecordBatch.from_arrays([pa.array(total.index.to_numpy(np.int64)), pa.array(total.to_numpy(np.int64))], names=["pair", "df"])

    found = _frequent(encoded.mapInArrow(count, "pair long, df long"), "pair", least, c.most_terms).collect()
    return np.array(sorted(r.pair for r in found), np.int64)


def _parts(batch: pa.RecordBatch, known: np.ndarray, v: int, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms (known words and, from v on, known pairs), first term and row of each sentence that has any, of about so many words at a
    time, so that long texts don't fill the memory."""
    words, starts, sizes, row = _flat(batch)
    pair = _neighbours(words, starts, v)
    at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
    pair = np.where(known[at] == pair, at + v, -1) if len(known) else np.full(len(pair), -1)
    both = np.empty(2 * len(words), np.int64)
    both[0::2], both[1::2] = pair, words
    keep = both >= 0
    terms, sentence = both[keep], np.repeat(np.arange(len(starts)), 2 * sizes)[keep]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(terms) else np.empty(0, int)
    of = row[sentence[first]]
    cuts = np.flatnonzero(np.r_[True, np.diff(first // most) > 0]) if len(first) else []
    for a, b in zip(cuts, [*cuts[1:], len(first)]):
        lo, hi = first[a], first[b] if b < len(first) else len(terms)
        yield terms[lo:hi], first[a:b] - lo, of[a:b]


def infer(terms: np.ndarray, starts: np.ndarray, weights: np.ndarray, c: SubjectConfig, allowed: np.ndarray | None = None, each: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """CVB0 over a batch of sentences: expected terms per sentence and topic, and (each) the topics of each term.

    Sentences of the same length are inferred together, as one dense array.
    """
    sizes = np.diff(np.r_[starts, len(terms)])
    got = np.empty((len(starts), weights.shape[1]), np.float32)
    phi = np.empty((len(terms) if each else 0, weights.shape[1]), np.float32)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        at = starts[rows][:, None] + np.arange(size)
        w = weights[terms[at]]
        theta = np.full((len(rows), weights.shape[1]), c.alpha, np.float32)
        for i in range(c.inner):
            if i:
                theta = now + np.float32(c.alpha)
            if allowed is not None:
                theta *= allowed[rows]
            share = np.float32(1) / (np.einsum("slk,sk->sl", w, theta) + np.float32(1e-30))
            now = theta * np.einsum("slk,sl->sk", w, share)
        got[rows] = now
        if each:
            w *= theta[:, None, :]
            w *= share[:, :, None]
            phi[at.ravel()] = w.reshape(-1, weights.shape[1])
    return got, phi


def _counts(encoded: DataFrame, known: tuple[np.ndarray, int], weights: np.ndarray, c: SubjectConfig, subjects: int | None = None, count_only: bool = False) -> np.ndarray:
    """Expected counts, topics x terms, over all sentences; known: pairs and number of words. With subjects, rows have labels (an array of subject
    numbers) that limit the possible topics; count_only counts their subjects' sentences instead."""
    v, k = weights.shape
    shared = encoded.sparkSession.sparkContext.broadcast((weights, *known))
    n = subjects if count_only else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, v))
        weights, pairs_, words_ = shared.value
        for batch in batches:
            limits = None
            if subjects is not None:
                limits = np.zeros((batch.num_rows, k), np.float32)
                limits[:, subjects:] = 1
                labels = batch.column("labels")
                limits[np.repeat(np.arange(batch.num_rows), pc.list_value_length(labels).to_numpy(zero_copy_only=False)), labels.flatten().to_numpy(zero_copy_only=False)] = 1
            for terms, starts, row in _parts(batch, pairs_, words_):
                allowed = None if limits is None else limits[row]
                if count_only:
                    own = allowed[:, :subjects] / np.maximum(1, allowed[:, :subjects].sum(axis=1, keepdims=True))
                    phi = np.repeat(own, np.diff(np.r_[starts, len(terms)]), axis=0)
                else:
                    _, phi = infer(terms, starts, weights, c, allowed)
                for t in range(n):
                    total[t] += np.bincount(terms, phi[:, t], minlength=v)
        used = np.flatnonzero(total.sum(axis=0) > 0)
        yield pa.RecordBatch.from_arrays([*(pa.array(total[i, used]) for i in range(n)), pa.array(used)], names=[*(f"k{i}" for i in range(n)), "term"])

    schema = ", ".join([*[f"k{i} double" for i in range(n)], "term long"])
    found = encoded.mapInArrow(run, schema).groupBy("term").agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(n)]).toPandas()
    out = np.zeros((n, v))
    out[:, found["term"].to_numpy(np.int64)] = found[[f"k{i}" for i in range(n)]].to_numpy().T
    return out


def _start(labelled: np.ndarray, c: SubjectConfig) -> np.ndarray:
    """First topic counts: terms that belong to a subject in its topic, the rest spread over the general topics."""
    s, v = labelled.shape
    total = labelled.sum(axis=0)
    prior = labelled.sum(axis=1) / max(1e-9, labelled.sum())
    share = (labelled + 0.5 * prior[:, None]) / (total + 0.5)
    sure = (share - prior[:, None]) / np.sqrt(prior[:, None] * (1 - prior[:, None]) / np.maximum(total, 1) + 1e-12) > 3
    own = labelled * (sure & (share >= c.own))
    spread = np.random.default_rng(c.seed).dirichlet(np.full(c.general_topics, 2.0), v).T
    return np.vstack([own, (total - own.sum(axis=0)) * spread])


def map_topics(t: Topics, c: SubjectConfig) -> list[int]:
    """The subject of each topic, by the votes of its top terms; -1 where they don't agree."""
    prior = t.labelled.sum(axis=1) / max(1e-9, t.labelled.sum())
    vote = (t.labelled + 0.25 * prior[:, None]) / (t.labelled.sum(axis=0) + 0.25)
    out = []
    for counts in t.counts:
        top = np.argsort(-counts, kind="stable")[: c.top_terms]
        score = vote[:, top] @ counts[top] / max(1e-9, counts[top].sum())
        best = int(np.argmax(score))
        out.append(best if score[best] >= max(0.25, 1.5 * prior[best]) else -1)
    return out


def fit(encoded: DataFrame, words: list[str], pairs_: np.ndarray, labels: DataFrame, areas: DataFrame, c: SubjectConfig) -> Topics:
    """encoded as of encode(); labels: id, subject; areas: subject, description (as many rows as there are subjects)."""
    described = sorted((r.subject, r.description or "") for r in areas.select("subject", "description").collect())
    names = [s for s, _ in described]
    number = F.element_at(F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]), F.col("subject"))
    per_doc = labels.withColumn("n", number).filter("n is not null and id is not null").groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("labels"))
    sample = per_doc.orderBy(F.xxhash64("id"), "id").limit(c.labelled)
    guide = materialize(encoded.join(F.broadcast(sample), "id"), "guide")  # as many rows as the parameter says, at most
    known = pairs_, len(words)
    k, v, s = len(names) + c.general_topics, len(words) + len(pairs_), len(names)
    labelled = _counts(guide, known, np.ones((v, k), np.float32), c, s, count_only=True)
    word, row = Cutter(words).cut(pa.array([text for _, text in described], pa.string()))
    np.add.at(labelled, (row[word > 0], word[word > 0] - 1), 1)
    t = Topics(words, pairs_, names, _start(labelled, c), labelled)
    for _ in range(c.guided_rounds):
        t.counts = _counts(guide, known, t.weights(c.eta), c, s)
    guided = t.counts
    for _ in range(c.rounds):
        t.counts = guided + _counts(encoded, known, t.weights(c.eta), c)
    t.subject_of = map_topics(t, c)
    return t


def document_subjects(encoded: DataFrame, t: Topics, c: SubjectConfig) -> DataFrame:
    """id, subject, treating (sentences of the subject), share; the subjects of each document."""
    of = np.array(t.subject_of)
    shared = encoded.sparkSession.sparkContext.broadcast((t.weights(c.eta), (of[:, None] == np.arange(len(t.subjects))).astype(np.float32), t.subjects, t.pairs, len(t.words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, to_subject, names, pairs_, words_ = shared.value
        for batch in batches:
            n = np.zeros((batch.num_rows, len(names)))
            for terms, starts, row in _parts(batch, pairs_, words_):
                got, _ = infer(terms, starts, weights, c, each=False)
                subject = got @ to_subject
                treats = subject.sum(axis=1) >= c.treats * got.sum(axis=1)
                np.add.at(n, (row[treats], subject.argmax(axis=1)[treats]), 1)
            share = n / np.maximum(1, n.sum(axis=1, keepdims=True))
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
            i, j = np.nonzero((n > 0) & (share >= c.share - 1e-9) & (rank < c.most))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(i)), pa.array([names[x] for x in j], pa.string()), pa.array(n[i, j].astype(np.int64)), pa.array(share[i, j])],
                names=["id", "subject", "treating", "share"])

    kind = dict(encoded.dtypes)["id"]
    return encoded.mapInArrow(run, f"id {kind}, subject string, treating long, share double")


def prepare(
    docs: DataFrame, id_col: str, text: str, labels: DataFrame, areas: DataFrame, c: SubjectConfig = SubjectConfig(),
    write: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, make: materialize(make(), name),
) -> tuple[DataFrame, Topics]:
    """The encoded documents and the topics fitted on them, both written once; write(name, make) writes a table and gives it back."""
    spark = docs.sparkSession
    docs = docs.filter(F.length(text) > 0)

    def terms() -> DataFrame:
        least = float(max(c.min_documents, docs.count() * c.min_share))
        return spark.createDataFrame([(w, least) for w in vocabulary(docs, text, least, c)], "word string, least double")

    found = write("vocabulary", terms).orderBy("word").collect()
    words, least = [r.word for r in found], found[0].least if found else 0.0
    encoded = write("encoded", lambda: encode(docs, id_col, text, words))
    known = write("pairs", lambda: spark.createDataFrame([(int(p),) for p in pairs(encoded, len(words), least, c)], "pair long"))
    pairs_ = np.array(sorted(r.pair for r in known.collect()), np.int64)

    def fitted() -> DataFrame:
        t = fit(encoded, words, pairs_, labels, areas, c)
        return spark.createDataFrame([("subject", i, [0.0], s) for i, s in enumerate(t.subjects)] + [(kind, i, row.tolist(), "") for kind, m in (("topic", t.counts), ("labelled", t.labelled)) for i, row in enumerate(m)], "kind string, number int, weights array<double>, name string")

    rows = sorted(write("topics", fitted).collect(), key=lambda r: r.number)
    of = lambda kind: np.array([[*r.weights] for r in rows if r.kind == kind], float).reshape(sum(r.kind == kind for r in rows), len(words) + len(pairs_))
    t = Topics(words, pairs_, [r.name for r in rows if r.kind == "subject"], of("topic"), of("labelled"))
    t.subject_of = map_topics(t, c)
    return encoded, t
