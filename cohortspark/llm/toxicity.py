"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Method. Terms (words, and their first letters) that stand in bad texts far more often than in good ones are mined from
labelled rows; by kind and by how sure they are they make up many lexicon voters. Patterns that know nothing of the words (shouting,
exclamation marks, symbols, repeats, length, several hits) are voters too. Each voter says toxic, clean or nothing about
every document of the corpus. The label model is a tree of voters within each class: expectation maximisation over all
documents' votes estimates how accurate each voter is and, by the conditional information of its pairs, which voters
depend on which, so that agreeing twins do not count twice. Labelled rows keep their label meanwhile. A logistic
regression on the terms of documents is then trained on the label model's posteriors (a given label stands), each
document once as toxic and once as clean with these weights; it scores every document.

Learning reads labels of rows for which ``held_out`` is false only; a score depends on the text alone.

Cases. A null text is empty. Empty texts get the classifier's score without any term. Labels of null doc_id or null
value are left out, as is a document with contradicting labels; repeated labels and equal texts count once in the
mining and in the training. A null doc_id has crc32 null and is not held out. Without labels of both classes no terms
are mined, and every score is the smoothed share of toxic labels. Ties between terms go by their spelling. An empty
table gives an empty result. Extra columns are not read, whatever their names. Texts are read whole.

Scale. Votes of all documents are counted by pattern before they are shuffled, and the model reads those counts. Terms
are mined from at most ``MINED`` labelled texts of each class and the classifier is fitted to at most ``FITTED`` texts,
both the first by a hash of the text; these bounds, and the numbers of terms below, do not grow with the data. Only the
texts so chosen are shuffled, the others are hashed, voted on and scored where they lie.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shared import bounded_batches, sent, staged

#: Labelled texts of each class that terms are mined from, and texts that the classifier is fitted to.
MINED, FITTED = 10_000, 20_000
#: Terms in lexicons, and terms that the classifier weighs.
LEXICON, FEATURES = 4_000, 8_000
#: Bad texts that a term must stand in, and the least share of bad texts among those with it (Wilson's lower bound).
SUPPORT, PRECISION = 3, 0.6
#: First letters that are terms, and lexicon voters by kind of term.
PREFIXES, SPLIT = (3, 4, 5, 6, 7, 8), 3
#: Predicted toxic from this score on.
THRESHOLD = 0.7
STEPS, REGULARISATION = 12, 1e-4
#: Different terms that a task counts before it hands them on.
_HELD = 400_000
#: Votes.
SILENT, CLEAN, TOXIC = range(3)
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(words: set[str]) -> set[str]:
    """Words as such (behind a mark), and first letters of longer words."""
    found = {"=" + w for w in words}
    for n in PREFIXES:
        found.update([w[:n] for w in words if len(w) > n])
    return found


class Terms:
    """Looks for given terms in sets of words."""

    def __init__(self, terms: list[str]) -> None:
        self.words = {t[1:] for t in terms if t[0] == "="}
        self.starts = {n: {t for t in terms if t[0] != "=" and len(t) == n} for n in PREFIXES}
        #: Most words start like none of the terms.
        self.heads = {t[:2] for t in (*self.words, *(s for v in self.starts.values() for s in v))}

    def found(self, words: set[str]) -> list[str]:
        near, out = [w for w in words if w[:2] in self.heads], set()
        for w in near:
            if w in self.words:
                out.add("=" + w)
            for n, starts in self.starts.items():
                if len(w) > n and w[:n] in starts:
                    out.add(w[:n])
        return sorted(out)


def term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic and clean: how much weight of texts of either class each term stands in. rows: text, p (share toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, every = Counter(), Counter()

        def out() -> pd.DataFrame:
            terms = list(every)
            bad = np.array([toxic[t] for t in terms], float)
            return pd.DataFrame({"term": np.array(terms, object), "toxic": bad, "clean": np.array([every[t] for t in terms], float) - bad})

        for batch in batches:
            for text, p in zip(batch["text"], batch["p"], strict=True):
                terms = terms_of(set(words_of(text)))
                every.update(terms)
                if p > 0:
                    toxic.update(dict.fromkeys(terms, p))
                if len(every) > _HELD:
                    yield out()
                    toxic.clear()
                    every.clear()
        yield out()

    found = rows.select("text", F.col("p").cast("double").alias("p")).mapInPandas(count, "term string, toxic double, clean double")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def first_keys(rows: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` distinct keys of ``rows`` (h, y): the first by the hash itself; p is the mean over equal texts."""
    sums = staged(rows.groupBy("h").agg(F.avg("y").alias("p")))
    n = sums.count()
    if n > most:  # hashes are uniform: the first share of their range
        sums = sums.where(F.col("h") < -(2**63) + int(2**64 * (most / n)))
    return sums


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text and p of each of ``keys`` (h, p; few rows): other texts stay where they are, copies meet in their tasks."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = keyed.join(sent(staged(keys)), "h").groupBy("h", "p").agg(F.first("text").alias("text"))
    return staged(found.select("text", "p"))


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and y (0 or 1) of the labels that may be learnt from."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("most")
    )
    return rows.where((F.col("y") == F.col("most")) & ~held_out(F.col("doc_id"))).select("doc_id", "y")


def mined_terms(labelled: DataFrame, most: int = LEXICON) -> list[str]:
    """The terms that mark bad texts most reliably. labelled: text, p (0 or 1)."""
    counts = term_counts(labelled).where((F.col("toxic") >= SUPPORT) & (F.col("toxic") > PRECISION * (F.col("toxic") + F.col("clean"))))
    n, z = F.col("toxic") + F.col("clean"), 1.64
    share = F.col("toxic") / n
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rows = counts.withColumn("bound", bound).where(F.col("bound") > PRECISION)
    return [r["term"] for r in rows.orderBy(F.desc("bound"), "term").limit(most).collect()]


def lexicons(terms: list[str]) -> dict[str, int]:
    """The voter of each term (the surest first): by its kind (a word, or so many first letters) and how sure it is."""
    kinds = ["=", *PREFIXES]
    of = [kinds.index("=") if t[0] == "=" else kinds.index(len(t)) for t in terms]
    sizes, turn, out = Counter(of), Counter(), {}
    for t, kind in zip(terms, of, strict=True):
        out[t] = kind * SPLIT + turn[kind] * SPLIT // sizes[kind]
        turn[kind] += 1
    return out


N_LEXICONS = (1 + len(PREFIXES)) * SPLIT
#: Pattern voters, after the lexicons.
PATTERNS = ("several", "none", "shouting", "exclaiming", "symbols", "repeating", "short")
N_VOTERS = N_LEXICONS + len(PATTERNS)


def votes_of(text: str, voter: dict[str, int], terms: Terms) -> list[int]:
    """One vote of each voter on a text."""
    votes, words = [SILENT] * N_VOTERS, words_of(text)
    found = terms.found(set(words))
    for t in found:
        votes[voter[t]] = TOXIC
    several, none, shouting, exclaiming, symbols, repeating, short = range(N_LEXICONS, N_VOTERS)
    if len(found) > 3:
        votes[several] = TOXIC
    if not found:
        votes[none] = CLEAN
    letters = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    votes[shouting] = TOXIC if 3 * upper > letters else CLEAN
    votes[exclaiming] = TOXIC if 100 * text.count("!") > letters else SILENT
    votes[symbols] = TOXIC if 50 * sum(map(text.count, "#*$%&|<>")) > letters else SILENT
    votes[repeating] = TOXIC if len(words) > 20 and 5 * len(set(words)) < len(words) else SILENT
    votes[short] = CLEAN if len(words) < 10 else SILENT
    return votes


def as_code(votes: list[int]) -> int:
    """Two bits a voter."""
    return sum(v << (2 * k) for k, v in enumerate(votes))


def one_hot(codes: np.ndarray) -> np.ndarray:
    """Rows of three places a voter, one of them 1."""
    votes = codes[:, None] >> (2 * np.arange(N_VOTERS)) & 3
    return (votes[:, :, None] == np.arange(3)).reshape(len(codes), -1).astype(float)


@dataclass
class LabelModel:
    """P(toxic), and for each class a tree of voters: the parent of each (-1: none) and its table by the parent's vote."""

    prior: float
    parents: list[int]
    #: tables[class][voter][parent's vote][vote]; voters without a parent have equal rows.
    tables: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        votes = codes[:, None] >> (2 * np.arange(N_VOTERS)) & 3
        above = np.where(np.array(self.parents) >= 0, votes[:, np.maximum(self.parents, 0)], 0)
        logs = np.log(self.tables)[:, np.arange(N_VOTERS), above, votes].sum(2)
        odds = logs[1] - logs[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def learnt(pairs: np.ndarray) -> LabelModel:
    """The model of expected counts: for each class, how often each two votes stand together (weights on the diagonal).

    The tree joins the pairs of voters that tell most about each other within the classes; pairs that could be chance
    stay apart.
    """
    weights = np.array([pairs[c].trace() / N_VOTERS for c in (0, 1)])
    total = weights.sum()
    cells = pairs.reshape(2, N_VOTERS, 3, N_VOTERS, 3).transpose(0, 1, 3, 2, 4)
    smooth = cells + 0.1
    p = smooth / smooth.sum((3, 4), keepdims=True)
    own, other = p.sum(4, keepdims=True), p.sum(3, keepdims=True)
    told = ((p * np.log(p / (own * other))).sum((3, 4)) * (weights / max(total, 1e-9))[:, None, None]).sum(0)
    parents, joined = [-1] * N_VOTERS, list(range(N_VOTERS))
    edges = [[] for _ in range(N_VOTERS)]
    for i, j in sorted(((i, j) for i in range(N_VOTERS) for j in range(i)), key=lambda e: (-told[e], e)):
        # Twice the count times the information is chi-squared, of four degrees of freedom in each class.
        if joined[i] != joined[j] and 2 * total * told[i, j] > 26:
            edges[i].append(j)
            edges[j].append(i)
            old, new = joined[i], joined[j]
            joined = [new if k == old else k for k in joined]
    seen = set()
    for root in range(N_VOTERS):
        stack = [] if root in seen else [root]
        while stack:
            k = stack.pop()
            seen.add(k)
            for m in edges[k]:
                if m not in seen:
                    parents[m] = k
                    stack.append(m)
    tables = np.empty((2, N_VOTERS, 3, 3))
    for k, parent in enumerate(parents):
        counts = cells[:, parent, k] if parent >= 0 else np.repeat(np.diagonal(cells[:, k, k], axis1=1, axis2=2)[:, None], 3, 1)
        # What a parent's vote was never seen with falls back on the voter's own shares.
        base = np.diagonal(cells[:, k, k], axis1=1, axis2=2)[:, None] + 0.5
        mixed = counts + base / base.sum(2, keepdims=True)
        tables[:, k] = mixed / mixed.sum(2, keepdims=True)
    prior = float((weights[1] + 1) / (total + 2))
    return LabelModel(prior, parents, tables)


def expected_pairs(patterns: DataFrame, model: LabelModel | None) -> np.ndarray:
    """Expected counts of pairs of votes in each class; without a model those of labelled patterns only."""

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 3 * N_VOTERS, 3 * N_VOTERS))
        for batch in batches:
            codes, y, n = (batch[c].to_numpy() for c in ("code", "y", "n"))
            given = y >= 0
            p = np.where(given, y, 0.0) if model is None else np.where(given, y, model.posterior(codes))
            n, hot = np.where(given | (model is not None), n, 0).astype(float), one_hot(codes)
            for c, share in ((0, 1 - p), (1, p)):
                total[c] += hot.T @ (hot * (share * n)[:, None])
        yield pd.DataFrame({"total": [total.tobytes()]})

    parts = patterns.select("code", "y", "n").mapInPandas(expect, "total binary")
    return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add).reshape(2, 3 * N_VOTERS, 3 * N_VOTERS)


def label_model(patterns: DataFrame, steps: int = STEPS) -> LabelModel:
    """Expectation maximisation over ``patterns`` (code, y: 0, 1 or -1 for unknown, n), starting from the labelled ones."""
    model = learnt(expected_pairs(patterns, None))
    for _ in range(steps):
        new = learnt(expected_pairs(patterns, model))
        done = new.parents == model.parents and np.abs(new.tables - model.tables).max() < 1e-4
        model = new
        if done:
            break
    return model


@dataclass
class Classifier:
    """A logistic model over the presence of terms."""

    intercept: float
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.terms = Terms(list(self.weights))

    def score(self, text: str | None) -> float:
        total = self.intercept + sum([self.weights[t] for t in self.terms.found(set(words_of(text)))])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def posterior_texts(rows: DataFrame, terms: list[str], model: LabelModel) -> DataFrame:
    """``rows`` (text, p) with p, where it is null, from the label model's posterior of the text's votes."""
    voter, looked = lexicons(terms), Terms(terms)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = np.array([as_code(votes_of(t or "", voter, looked)) for t in batch["text"]], np.int64)
            yield batch.assign(p=batch["p"].fillna(pd.Series(model.posterior(codes), batch.index)))

    return rows.select("text", "p").mapInPandas(judged, "text string, p double")


def fitted(rows: DataFrame, features: int = FEATURES) -> Classifier:
    """The classifier trained on ``rows`` (text, p: probability of toxic)."""
    sums = rows.agg(F.sum("p").alias("toxic"), F.count("*").alias("n")).first()
    share = ((sums["toxic"] or 0) + 1) / (sums["n"] + 2)
    constant = Classifier(math.log(share / (1 - share)), {})
    # Terms whose presence moves the share of toxic texts most surely: their count against that of chance.
    n = F.col("toxic") + F.col("clean")
    surprise = F.abs(F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    counts = term_counts(rows).where(n >= SUPPORT).withColumn("surprise", surprise).where("surprise > 4")
    terms = [r["term"] for r in counts.orderBy(F.desc("surprise"), "term").limit(features).collect()]
    if not terms:
        return constant
    looked = Terms(terms)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [looked.found(set(words_of(t))) for t in batch["text"]], "p": batch["p"]})

    table = staged(rows.mapInPandas(found, "terms array<string>, p double"))
    vectors = CountVectorizerModel.from_vocabulary(terms, "terms", "x").setBinary(True).transform(table)
    both = vectors.select("x", F.lit(1.0).alias("y"), F.col("p").alias("w")).union(vectors.select("x", F.lit(0.0), 1 - F.col("p")))
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=REGULARISATION, standardization=False, maxIter=60)
    made = fit.fit(both.where("w > 0"))
    if not np.isfinite(made.intercept):
        return constant
    weights = made.coefficients.toArray()
    return Classifier(float(made.intercept), {t: float(w) for t, w in zip(terms, weights, strict=True) if w != 0})


def trained(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Voters from labelled rows, the label model from all documents' votes, the classifier from its posteriors."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    given = staged(usable_labels(labels))
    known = texts.select("doc_id", F.xxhash64("text").alias("h")).join(given.hint("merge"), "doc_id", "left")
    known = staged(known.select("h", F.col("y").cast("double").alias("y")))
    mined = texts_of(docs, first_keys(known.where("y = 1"), MINED).union(first_keys(known.where("y = 0"), MINED)))
    sums = given.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    share = ((sums["toxic"] or 0) + 1) / (sums["n"] + 2)
    terms = mined_terms(mined)
    if not terms:
        return Classifier(math.log(share / (1 - share)), {})
    model = label_model(staged(vote_patterns(texts, given, terms)))
    return fitted(staged(posterior_texts(texts_of(docs, first_keys(known, FITTED)), terms, model)))


def vote_patterns(texts: DataFrame, given: DataFrame, terms: list[str]) -> DataFrame:
    """code, y and n: how many documents have these votes and this label (-1: none that may be learnt from)."""
    voter, looked = lexicons(terms), Terms(terms)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [as_code(votes_of(t, voter, looked)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "code": np.array(codes, np.int64)})

    id_type = texts.schema["doc_id"].dataType.simpleString()
    votes = texts.mapInPandas(vote, f"doc_id {id_type}, code long").join(given.hint("merge"), "doc_id", "left")
    return votes.groupBy("code", F.coalesce("y", F.lit(-1)).alias("y")).agg(F.count("*").alias("n"))


def scored(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.array([classifier.score(t) for t in batch["text"]], float)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInPandas(score, f"doc_id {id_type}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that may be learnt from and score every document. docs: doc_id, text; labels: doc_id, toxic."""
    return scored(docs, trained(docs, labels))
