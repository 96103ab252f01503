"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Method. Word n-grams of one to ``order`` words are hashed into ``buckets`` counters, once over the trusted documents
and once over the whole corpus. The corpus multinomial is smoothed by one count a bucket; the trusted one by as many
counts as there are buckets, dealt like the corpus (a Dirichlet prior), so that with few trusted words nothing is far
from the corpus. The weight of a bucket is log(p_trusted / p_corpus) in millionths. The score of a document is the
mean weight of its n-grams, and a document is kept when its score reaches ``threshold``. Weights are integers, so that
the score, and the verdict, is the same in any order of summation.

Cases. A null or empty text has no words, all counts 0, fails the base rules and is not kept. A document that passes
the base rules has at least 50 words, so its score exists. Repeated rows get equal results; rows never meet, so ties
do not matter. With no trusted document, the trusted multinomial is the corpus's: all scores are 0. An empty table gives an
empty result. Other columns of the table are not read and their names cannot clash: results carry new names only.

Scale. One narrow pass counts n-grams with a partial aggregate (at most ``buckets`` rows leave a task), one scores.
Texts are never shuffled. What is sent to every task is ``buckets`` integers and at most ``trusted_limit`` ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shared import SPACES, fresh, held, word_array

BUCKETS = 65_536
#: Words in the longest n-gram.
ORDER = 2
#: Trusted documents are at most so many labelled ones, those with the smallest hash of their id.
TRUSTED_LIMIT = 20_000
#: Mean log-likelihood ratio below which a document goes. On the given tables labelled good documents lie above -0.06,
#: and 99 and 93 of 100 bad ones below -0.2 (sf0.01, sf0.1).
THRESHOLD = -0.2
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A position within a text takes so many bits of a packed sort key.
_POSITION_BITS = 21


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Ids of good, non-toxic labelled documents, ``limit`` at most (those that hash lowest)."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _gram_hashes(hashes: str, order: int) -> str:
    """SQL for the hashes of a text's n-grams, in order, from the array of its words' hashes."""
    if order == 1:
        return hashes
    rest = ", ".join(f"get({hashes}, i + {k})" for k in range(1, order))
    return f"slice(transform({hashes}, (x, i) -> xxhash64(x, {rest})), 1, greatest(size({hashes}) - {order - 1}, 0))"


def _all_grams(hashes: str, order: int) -> Column:
    """Hashes of all n-grams of one to ``order`` words."""
    return F.concat(*[F.expr(_gram_hashes(hashes, k)) for k in range(1, order + 1)])


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets))


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """Weight of each bucket, log(p_trusted / p_corpus) in millionths; ``trusted`` holds a bounded list of doc_id."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    good = F.coalesce("good", F.lit(0)).alias("good")
    words = held(marked, "hashes", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)))
    grams = words.select(good, F.explode(_all_grams("hashes", order)).alias("gram"))
    counts = grams.groupBy(_bucket(F.col("gram"), buckets).cast("int").alias("bucket")).agg(
        F.count("*").alias("n_all"), F.sum("good").alias("n_good")
    )
    found = {r["bucket"]: (r["n_all"], r["n_good"]) for r in counts.collect()}  # at most ``buckets`` rows
    total_all = sum(a for a, _ in found.values()) + buckets
    total_good = sum(g for _, g in found.values()) + buckets
    weights = []
    for bucket in range(buckets):
        n_all, n_good = found.get(bucket, (0, 0))
        p_all = (n_all + 1) / total_all
        p_good = (n_good + buckets * p_all) / total_good
        weights.append(round(math.log(p_good / p_all) * 1_000_000))
    return weights


def _repeat_words(trigrams: str) -> Column:
    """Positions covered by trigrams that occur twice or more.

    Most texts repeat none and stop there. Else one primitive sort of (leading hash bits, position) finds the
    repeats; where leading bits of unequal hashes meet, or the text is too long for the packed position, the exact
    sort of (hash, position) decides.
    """
    bits = _POSITION_BITS
    covered = (
        "size(array_distinct(flatten(filter(zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted)),"
        " (a, b) -> {same}), x -> x is not null))))"
    )
    at = f"cast(({{v}} & {2**bits - 1}) as int)"
    six = "array({a}, {a} + 1, {a} + 2, {b}, {b} + 1, {b} + 2)"
    packed_same = (
        f"if(shiftright(a, {bits}) = shiftright(b, {bits}), "
        + six.format(a=at.format(v="a"), b=at.format(v="b"))
        + ", null)"
    )
    exact_same = "if(a.hash = b.hash, " + six.format(a="a.at", b="b.at") + ", null)"
    packed = f"sort_array(transform({trigrams}, (x, i) -> shiftleft(x, {bits}) | i))"
    plain = f"sort_array(transform({trigrams}, (x, i) -> struct(x as hash, i as at)))"
    let = "element_at(transform(array({value}), sorted -> {body}), 1)"
    kinds_packed = f"size(array_distinct(transform({trigrams}, x -> shiftleft(x, {bits}))))"
    return F.expr(
        f"case when size(array_distinct({trigrams})) = size({trigrams}) then 0"
        f" when size({trigrams}) < {2**bits} and {kinds_packed} = size(array_distinct({trigrams}))"
        f" then {let.format(value=packed, body=covered.format(same=packed_same))}"
        f" else {let.format(value=plain, body=covered.format(same=exact_same))} end"
    )


def with_counts(docs: DataFrame, weights: list[int] | None = None, order: int = ORDER) -> DataFrame:
    """``docs`` with the base counts of each text and, given weights, the score of its n-grams.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and score (double).
    Columns of ``docs`` with such names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    df = docs.select(*kept)
    words = fresh(df, "words_of_text")
    df = held(df, words, word_array(F.col("text")))
    hashes = fresh(df, "hashes_of_words")
    df = held(df, hashes, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("word_chars", F.length(F.array_join(words, "")).cast("long")).drop(words)
    tri = fresh(df, "trigrams_of_text")
    df = held(df, tri, F.expr(_gram_hashes(hashes, 3)))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n_words = F.size(hashes)
    columns = {
        "n_words": n_words.cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(tri).cast("long"),
    }
    if weights is not None:
        table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
        total = F.aggregate(
            _all_grams(hashes, order),
            F.lit(0).cast("long"),
            lambda a, g: a + F.get(table, _bucket(g, len(weights)).cast("int")),
        )
        n_grams = sum((F.greatest(n_words - k, F.lit(0)) for k in range(1, order)), n_words)
        columns["score"] = F.when(n_grams > 0, total / F.lit(1e6) / n_grams)
    df = df.withColumns(columns).drop(hashes, tri)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, order: int = ORDER
) -> DataFrame:
    """Every document with its counts, score and ``kept``: false if a base rule fails, else score >= threshold.

    docs: doc_id, text and any others. labels: doc_id, quality, toxic.
    """
    weights = fit_weights(docs, trusted_ids(labels), buckets, order)
    judged = with_counts(docs, weights, order)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
