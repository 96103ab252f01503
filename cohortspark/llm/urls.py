"""URL filters: fixed rules by host and path, else association rules mined from labels.

Method. A url becomes a set of tokens (scheme, host labels, the registered part of the host, path words, query names).
The labelled urls, each with a mark if its label is bad, are transactions; Spark's FP-growth finds the frequent token
sets, of any size. A set becomes a blocking rule if the mark follows with enough confidence, support and odds, if
chance does not explain it (Wilson's lower bound of the confidence lies above the share of bad labels), and if no
proper subset is a rule already. Tokens that always go together in the labelled urls are mined as one, so that a url
of many tokens that stands there many times does not make each of its subsets frequent; a rule then asks for all of
them. Rules are matched by an inverted index: each rule stands under its rarest token, a url looks up its own tokens
and the rule's other tokens are then verified. A url that meets a rule is blocked, any other allowed.

Fixed rules come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest fits.

Cases. A null url, or one without "://", has empty host and path and no tokens, so the method allows it. Repeated
rows get equal results. Of fixed rules of equal length the one first in the list wins. With no labelled url, or only
bad or only good ones, no token goes with the label and there are no mined rules. An empty table gives an empty
result, a very long url is a set of many tokens. Columns that the operator adds replace such columns of the table;
others pass through.

Scale. Mining reads narrow rows and its output is bounded by the support; tokens of path numbers are left out, so
transactions stay short. An index of up to ``INDEX_BYTES`` (it is measured first) stands in each task, dealt over
buckets by the token's hash, and is looked up within the row: pages are not shuffled. Beyond that the different urls
are joined with the index by token, and the pages with what their url meets.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.shared import fresh, held, staged

#: Fixed rules (verdict, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BAD = "!bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: The odds of a bad label among a rule's urls are at least so many times those among all; pure rules reach any such bound.
MIN_ODDS = 2.0
#: Whatever the share, a rule has met at least so many bad urls; one url is no association.
MIN_HITS = 2
#: Quantile of the normal distribution for Wilson's bound: 97.5 % one-sided.
Z = 1.96
#: Up to so many bytes of tokens, the index stands in every task; it has so many buckets.
INDEX_BYTES = 4 << 20
BUCKETS = 4096
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _FROM, _TO)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits best (host and path, null if none) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0]))
    for _, (kind, at, prefix) in ordered:  # the last one that fits is the longest
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        name, verdict = F.when(fits, at + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The sorted set of a url's tokens; path words with digits only are left out."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    words = F.filter(F.split(F.lower(path), "[/.]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    scheme = F.regexp_extract(url, r"(?s)^([A-Za-z0-9+.-]*)://", 1)
    tokens = F.concat(
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), F.lower(scheme)))).otherwise(F.array().cast("array<string>")),
        labels,
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("query:"), x)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _dealt(spark: SparkSession, rows: list[tuple[str, list]], kind: str) -> Column:
    """A constant array with, in the bucket of each token, the values under it (JSON of the given type)."""
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    tokens = spark.createDataFrame([(t, json.dumps(v)) for t, v in rows], "token string, v string")
    for r in tokens.select(_bucket(F.col("token")).alias("b"), "v").collect():  # hashed as Spark hashes; bounded by the caller
        buckets[r["b"]].append(json.loads(r["v"]))
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<{kind}>>")


def wilson(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of a share of ``hits`` in ``n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_odds: float = MIN_ODDS
) -> DataFrame:
    """Minimal rules (tokens, confidence, support) from rows url, bad (boolean)."""
    spark = labelled.sparkSession
    schema = "tokens array<string>, confidence double, support double"
    rows = labelled.where(F.col("bad").isNotNull()).select(tokens_of(F.col("url")).alias("items"), "bad").where(F.size("items") > 0)
    rows = staged(rows)
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not bad or bad == total:
        return spark.createDataFrame([], schema)
    # Only sets that occur with the mark matter: tokens that are rare among the bad are taken out before mining. Tokens
    # of the same urls have equal sums of the urls' hashes; the first in order is mined for all of them.
    least = max(MIN_HITS, min_support * total)
    marks = [F.sum(F.xxhash64(F.lit(k), "items").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    often = rows.select(F.explode("items").alias("item"), "items", "bad").groupBy("item").agg(F.count_if("bad").alias("hits"), *marks)
    groups = often.where(F.col("hits") >= least).groupBy("hits", "h1", "h2").agg(F.array_sort(F.collect_list("item")).alias("group"))
    groups = staged(groups.select("group", F.col("group")[0].alias("item")))
    mined = groups.select("item").collect()  # at most items per url / min_support
    if not mined:
        return spark.createDataFrame([], schema)
    known = _dealt(spark, [(r["item"], r["item"]) for r in mined], "string")
    narrowed = F.filter("items", lambda x: F.array_contains(F.get(known, _bucket(x)), x))
    narrowed = rows.select(F.when(F.col("bad"), F.concat(narrowed, F.array(F.lit(BAD)))).otherwise(narrowed).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total), minConfidence=min_confidence).fit(staged(narrowed))
    sets = staged(model.freqItemsets)
    key = F.array_sort(F.filter("items", lambda x: x != BAD))
    marked = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(key.alias("tokens"), F.col("freq").alias("hits"))
    plain = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), "freq")
    hits, freq = F.col("hits"), F.col("freq")
    rules = marked.join(plain.hint("merge"), "tokens").where(
        (hits >= least)
        & (hits / freq >= min_confidence)
        & (hits * float(total - bad) >= (freq - hits) * (min_odds * bad))
        & (wilson(hits, freq) >= bad / total)
    )
    rules = staged(rules.select("tokens", (hits / freq).alias("confidence"), (hits / F.lit(total)).alias("support")))
    # A rule goes if a proper subset is a rule: each rule looks its tokens up in the index of the others.
    index = indexed(rules.select("tokens")).withColumnRenamed("tokens", "part")
    looked = rules.select("tokens", F.explode("tokens").alias("token")).join(index.hint("merge"), "token")
    smaller = looked.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    rules = rules.join(smaller.select("tokens").distinct().hint("merge"), "tokens", "left_anti")
    # Each token stands for its group.
    parts = rules.select("*", F.explode("tokens").alias("item")).join(groups.hint("merge"), "item")
    parts = parts.groupBy("tokens", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("group"))).alias("all"))
    return staged(parts.select(F.col("all").alias("tokens"), "confidence", "support"))


def indexed(rules: DataFrame) -> DataFrame:
    """Each rule's tokens and its rarest one (token), under which it is looked up."""
    counts = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = rules.select("tokens", F.explode("tokens").alias("token")).join(counts.hint("merge"), "token")
    return ranked.groupBy("tokens").agg(F.min_by("token", F.struct("count", "token")).alias("token"))


def matches(urls: DataFrame, rules: DataFrame, url: str = "url", name: str = "blocked_by") -> DataFrame:
    """``urls`` and the first rule that each meets (its tokens joined by a space; null if none)."""
    index = staged(indexed(rules))
    text = lambda r: F.array_join(r, " ")
    n_bytes = index.agg(F.coalesce(F.sum(F.octet_length(text(F.col("tokens"))) + 16 * F.size("tokens")), F.lit(0))).first()[0]
    if n_bytes <= INDEX_BYTES:
        buckets = _dealt(urls.sparkSession, [(r["token"], r.asDict()) for r in index.select("token", "tokens").collect()], "struct<token:string,tokens:array<string>>")
        tokens = fresh(urls, "tokens_of_url")
        df = held(urls, tokens, tokens_of(F.col(f"`{url}`")))
        fits = lambda t: F.filter(
            F.get(buckets, _bucket(t)), lambda r: (r["token"] == t) & (F.size(F.array_except(r["tokens"], F.col(tokens))) == 0)
        )
        met = F.flatten(F.transform(tokens, lambda t: F.transform(fits(t), lambda r: text(r["tokens"]))))
        return df.withColumn(name, F.array_min(met)).drop(tokens)
    some = urls.where(F.col(f"`{url}`").isNotNull())
    looked = some.select(F.col(f"`{url}`").alias("u")).distinct().select("u", tokens_of(F.col("u")).alias("all"))
    looked = looked.select("u", "all", F.explode("all").alias("token")).join(index.hint("merge"), "token")
    met = looked.where(F.size(F.array_except("tokens", "all")) == 0).groupBy("u").agg(F.min(text(F.col("tokens"))).alias("met"))
    met_url, met_rule = fresh(urls, "met_url"), fresh(urls, "met_rule")
    met = staged(met.select(F.col("u").alias(met_url), F.col("met").alias(met_rule)))
    columns = [F.col(f"`{c}`") for c in urls.columns if c.lower() != name.lower()]
    joined = some.join(met.hint("merge"), F.col(f"`{url}`") == F.col(met_url), "left").select(*columns, F.col(met_rule).alias(name))
    rest = urls.where(F.col(f"`{url}`").isNull()).select(*columns, F.lit(None).cast("string").alias(name))
    return joined.unionByName(rest)


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and blocked_by; such columns are replaced."""
    made = ("host", "path", "rule", "verdict", "blocked_by")
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made])
    found = matches(pages, mine_rules(labelled))
    found = found.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("blocked_by").isNotNull(), "block").otherwise("allow")
    return found.withColumns({"rule": rule, "verdict": F.coalesce(verdict, mined)})


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of pages whose path names a labelled document by number; bad: low quality or toxic.

    A document labelled twice is bad if any of its labels is.
    """
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1)
    ids = pages.select("url", F.when(number != "", number).cast(T.LongType()).alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return ids.join(bad.hint("merge"), "doc_id").select("url", "bad")
