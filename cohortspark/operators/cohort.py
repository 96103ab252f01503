"""Cohorts: suspicion of onset, matched controls, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.functions.columns import hash_order, hash_uniform, to_id
from cohortspark.operators.gates import leakage
from cohortspark.operators.ordering import global_running
from cohortspark.operators.timeops import HOUR, asof, first_by
from cohortspark.sources.staging import pinned

#: Spellings of the splits.
SPLITS = {
    "train": "train", "tr": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "te": "test", "testing": "test",
}

#: Log of the chance to stay free where one control is left for a match: below that of any hash.
CERTAIN = -40.0


def paired(abx: DataFrame, cultures: DataFrame, hours_after: float = 24, hours_before: float = 72) -> DataFrame:
    """Antibiotics (stay_id, abx_time) that pair with a culture, with culture_time and suspicion_time.

    A culture up to ``hours_after`` later wins and dates the suspicion by the antibiotic; else the last one up to
    ``hours_before`` earlier dates it by the culture. Bounds are inclusive; rows without a time are left out.
    """
    near = asof(abx.where("abx_time is not null"), cultures, "stay_id", "abx_time", "culture_time")
    after = F.when(F.col("next_time") - F.col("abx_time") <= hours_after * HOUR, F.col("next_time"))
    before = F.when(F.col("abx_time") - F.col("previous_time") <= hours_before * HOUR, F.col("previous_time"))
    pairs = near.withColumn("culture_time", F.coalesce(after, before))
    pairs = pairs.withColumn("suspicion_time", F.when(after.isNotNull(), F.col("abx_time")).otherwise(before))
    return pairs.where("culture_time is not null").drop("next_time", "previous_time")


def suspicion(abx: DataFrame, cultures: DataFrame, hours_after: float = 24, hours_before: float = 72) -> DataFrame:
    """Per stay, the earliest antibiotic that pairs: suspicion_time, antibiotic_time, culture_time."""
    pairs = paired(abx, cultures, hours_after, hours_before)
    first = pairs.groupBy("stay_id").agg(
        F.min(F.struct("abx_time", "culture_time", "suspicion_time")).alias("p")
    )
    return first.select("stay_id", "p.suspicion_time", F.col("p.abx_time").alias("antibiotic_time"), "p.culture_time")


def suspicion_with_prediction(abx: DataFrame, cultures: DataFrame, lead_hours: float) -> DataFrame:
    """The older form of the rule: onset_time, prediction_time a lead before it, label 1."""
    found = suspicion(abx, cultures)
    return found.select(
        "stay_id",
        F.col("suspicion_time").alias("onset_time"),
        (F.col("suspicion_time") - lead_hours * HOUR).alias("prediction_time"),
        F.lit(1).alias("label"),
    )


def requested_offsets(offsets: DataFrame, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Offsets that controls are wanted for: positive_id, copy and offset, round(n * ratio) of them, n counting all rows.

    Null and negative offsets are left out first. Where more remain than are wanted, the first in hash order stand; where
    fewer do, copies of them are drawn with replacement by hash.
    """
    n_all = offsets.count()
    usable = offsets.where("offset >= 0").select("positive_id", "offset", F.lit(1).cast("long").alias("one"))
    listed = global_running(usable, [hash_order(seed, F.col("positive_id")), F.col("positive_id"), F.col("offset")], {"place": "one"})
    listed = pinned(listed.select("positive_id", "offset", (F.col("place") - 1).alias("place")))
    n, wanted = listed.count(), round(n_all * ratio)
    first = listed.where(F.col("place") < wanted).select("positive_id", F.lit(0).cast("long").alias("copy"), "offset")
    if wanted <= n or n == 0:
        return first
    extra = offsets.sparkSession.range(1, wanted - n + 1).withColumnRenamed("id", "copy")
    extra = extra.withColumn("place", F.floor(hash_uniform(seed, F.col("copy")) * n))
    return first.unionByName(extra.join(listed.hint("merge"), "place").select("positive_id", "copy", "offset"))


def _ranked(needs: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Needs (id, copy, v) and controls (id, v, capacity) in one falling order of v, with counts up to each and the matches up to each need.

    With c_i controls able to serve need i, i + min(0, min_{j<=i}(c_j - j)) needs can be matched up to i.
    """
    need = needs.select("v", F.lit(1).alias("kind"), "id", "copy", F.lit(None).cast(controls.schema["capacity"].dataType).alias("capacity"))
    have = controls.select("v", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("copy"), "capacity")
    both = need.unionByName(have).where("v is not null")
    both = both.withColumns({"is_need": F.col("kind").cast("long"), "is_have": (1 - F.col("kind")).cast("long")})
    order = [F.col("v").desc(), F.col("kind"), F.col("id"), F.col("copy")]
    ranked = global_running(both, order, {"i": "is_need", "c": "is_have"})
    slack = ranked.where("kind = 1").withColumn("slack", F.col("c") - F.col("i"))
    run = global_running(slack, order, {}, {"least": "slack"})
    upto = F.col("i") + F.least(F.lit(0).cast("long"), F.col("least"))
    before = F.col("i") - 1 + F.least(F.lit(0).cast("long"), F.coalesce("least_before", F.lit(0).cast("long")))
    needs = run.select("id", "copy", "v", "i", "c", F.when(upto > before, upto).alias("m"))
    return needs, ranked.where("kind = 0").select("id", "capacity", "c")


def _by_rank(needs: DataFrame, controls: DataFrame) -> DataFrame:
    """The m-th need that can be matched takes the m-th control: id, copy, control_id and capacity."""
    found, ranked = _ranked(needs, controls)
    taken = ranked.select(F.col("id").alias("control_id"), "capacity", F.col("c").alias("m"))
    return found.join(taken, "m").select("id", "copy", "control_id", "capacity")


def match_controls(offsets: DataFrame, controls: DataFrame, lead: float, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Controls for offsets, drawn without replacement among all that can serve them, as many matches as possible.

    offsets: positive_id, offset; controls: control_id, capacity (an offset needs capacity >= offset + lead). Taking the
    longest offsets first and a random free control for each, a control that can serve the matches i >= f is still free
    after match j with probability prod(1 - 1 / (c_i - m_i + 1)) over i = f..j, c_i being the controls able to serve match
    m_i. A control's hash, held against this falling curve, gives the match that draws it, or none. Controls are then
    dealt in the order of these matches: a match takes one that was drawn by it or shortly before, so that a long offset
    has no longer stays than a random free one. Offsets left over take controls that none drew, by rank. Where this
    matches fewer than can be matched, as it may where nearly all controls are needed, all pairs are those by rank of
    the capacities, which are as many as any matching has. Unmatched offsets keep a null control.
    """
    wanted = pinned(requested_offsets(offsets, ratio, seed))
    needs = wanted.select(F.col("positive_id").alias("id"), "copy", (F.col("offset") + lead).alias("v"))
    pool = pinned(controls.where("capacity is not null").select(F.col("control_id").alias("id"), F.col("capacity").cast("double").alias("v"), "capacity"))
    found, _ = _ranked(needs, pool)
    found = pinned(found.where("m is not null"))
    free = F.col("c") - F.col("m") + 1
    stays = found.select("v", F.lit(1).alias("kind"), "id", "copy", F.when(free > 1, F.log1p(-1 / free)).otherwise(CERTAIN).alias("w"))
    none = pool.select("v", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("copy"), F.lit(0.0).alias("w"), "capacity")
    # From the shortest up: all matches that a control can serve lie before it.
    poured = global_running(
        stays.unionByName(none, allowMissingColumns=True), [F.col("v"), F.col("kind").desc(), F.col("id"), F.col("copy")], {"log_free": "w"}
    )
    # A match at the log of what is free after it in the end; a control at the level that its hash asks for.
    level = F.col("log_free") - F.when(F.col("kind") == 1, F.col("w")).otherwise(F.log(hash_uniform(seed, F.col("id")) + 2.0**-33))
    poured = poured.withColumns({"level": level, "minus": F.when(F.col("kind") == 1, -F.col("v"))})
    turns = global_running(poured, [F.col("level").desc(), F.col("kind").desc(), F.col("id"), F.col("copy")], {}, {"least": "minus"})
    drawn = pinned(turns.where("kind = 0").select("id", "v", "capacity", F.least(F.col("v"), -F.col("least")).alias("turn"), F.col("least").isNotNull().alias("drawn")))
    first = pinned(_by_rank(needs, drawn.where("drawn").select("id", F.col("turn").alias("v"), "capacity")))
    left = needs.join(first.select("id", "copy").hint("merge"), ["id", "copy"], "left_anti")
    rest = drawn.join(first.select(F.col("control_id").alias("id")).hint("merge"), "id", "left_anti").select("id", "v", "capacity")
    matched = pinned(first.unionByName(_by_rank(left, rest)))
    if matched.count() < found.count():
        matched = pinned(_by_rank(needs, pool))
    matched = matched.withColumnRenamed("id", "positive_id")
    return wanted.join(matched.hint("merge"), ["positive_id", "copy"], "left").select("positive_id", "copy", "offset", "control_id", "capacity")


def random_controls(pool: DataFrame, offsets: DataFrame, ratio: int, seed: int) -> DataFrame:
    """The older control draw: stays in hash order, each with a hash-drawn offset cut at the stay's end.

    pool: stay_id, intime, outtime. offsets: offset (of the positives, ``n`` of them). Kept for comparison only: it
    does not match the arms' offsets.
    """
    n = offsets.count()
    if n == 0:
        return pool.limit(0).withColumn("prediction_time", F.lit(None).cast("double"))
    listed = global_running(offsets.withColumns({"one": F.lit(1).cast("long"), "tie": F.monotonically_increasing_id()}), [F.col("offset"), F.col("tie")], {"at": "one"})
    listed = listed.select((F.col("at") - 1).alias("at"), "offset")
    chosen = pool.orderBy(hash_order(seed, F.col("stay_id")), "stay_id").limit(ratio * n)
    chosen = chosen.withColumn("at", F.floor(hash_uniform(seed + 1, F.col("stay_id")) * n))
    joined = chosen.join(listed, "at")
    return joined.select("stay_id", "intime", "outtime", F.least(F.col("intime") + F.col("offset"), F.col("outtime")).alias("prediction_time"))


def _ranked_subjects(rows: DataFrame, seed: int) -> DataFrame:
    """subject_id, label (its largest), its rank r in hash order within the label and the label's number n of subjects."""
    subjects = rows.groupBy("subject_id").agg(F.max("label").alias("label"))
    return ranked_within(subjects, "label", [hash_order(seed, F.col("subject_id")), F.col("subject_id")])


def ranked_within(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with the rank r within a group of few values, however many rows each has, and the group's size n."""
    ranked = pinned(global_running(rows.withColumn("one", F.lit(1).cast("long")), [F.col(group), *order], {"place": "one"}).drop("one"))
    sizes = ranked.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n"), (F.min("place") - 1).alias("start"))
    joined = ranked.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("of")))  # one row a value
    return joined.withColumn("r", F.col("place") - F.col("start")).drop("of", "start", "place")


def assign_splits(rows: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 0) -> DataFrame:
    """subject_id and split, stratified by the subject's label (its largest), every subject in one split.

    Within a label, subjects in hash order give round-half-even(n * train) to train, the same of val to val, the rest
    to test.
    """
    ranked = _ranked_subjects(rows, seed)
    to_train, to_val = F.bround(F.col("n") * train), F.bround(F.col("n") * val)
    split = F.when(F.col("r") <= to_train, "train").when(F.col("r") <= to_train + to_val, "val").otherwise("test")
    return ranked.select("subject_id", "label", split.alias("split"))


def grouped_folds(rows: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """subject_id and fold: subjects of each label in hash order, dealt in turn."""
    ranked = _ranked_subjects(rows, seed)
    return ranked.select("subject_id", "label", ((F.col("r") - 1) % folds).cast("int").alias("fold"))


def fallback_splits(rows: DataFrame, seed: int = 42) -> DataFrame:
    """subject_id and split by two rounds of five folds: a fifth is test, a fifth of the rest val (about 64, 16, 20 %)."""
    outer = pinned(grouped_folds(rows, 5, seed))
    rest = rows.join(outer.where("fold > 0").select("subject_id").hint("merge"), "subject_id", "left_semi")
    inner = grouped_folds(rest, 5, seed + 1).select("subject_id", "label", F.when(F.col("fold") == 0, "val").otherwise("train").alias("split"))
    return outer.where("fold = 0").select("subject_id", "label", F.lit("test").alias("split")).unionByName(inner)


def normal_split(name: Column) -> Column:
    """train, val or test for the usual spellings; an error for others, null among them."""
    plain = F.lower(F.trim(name))
    unknown = F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(name, F.lit("null")))).cast("string")
    found = F.get(F.array(*map(F.lit, SPLITS.values())), F.array_position(F.array(*map(F.lit, SPLITS)), plain).cast("int") - 1)
    return F.coalesce(found, unknown)


def normal_cohort(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``rows`` with whole-number stay_id, subject_id and label; rows without one go, of each stay the first row stays."""
    ids = {c: to_id(F.col(c).cast("string")) for c in ("stay_id", "subject_id", "label")}
    clean = rows.withColumns(ids).where("stay_id is not null and subject_id is not null and label is not null")
    return first_by(clean, ["stay_id"], [*(order or []), "subject_id", "label"])


def load_splits(cohort: DataFrame, seed: int = 42) -> DataFrame:
    """stay_id and split of a cohort (stay_id, subject_id, label and perhaps split), one row a stay.

    Splits are read by their spellings, or made by ``fallback_splits`` where the column is missing. Raises for an
    unknown spelling, for a subject in two splits and for an empty split.
    """
    ids = [c for c in ("stay_id", "subject_id", "label") if c in cohort.columns]
    if len(ids) < 3:
        raise ValueError("a cohort needs stay_id, subject_id and label")
    if "split" in cohort.columns:
        rows = pinned(normal_cohort(cohort.withColumn("split", normal_split(F.col("split"))), ["split"]))
    else:
        rows = normal_cohort(cohort)
        rows = pinned(rows.join(fallback_splits(rows, seed).select("subject_id", "split").hint("merge"), "subject_id"))
    leaking = [r["subject_id"] for r in leakage(rows).select("subject_id").limit(10).collect()]
    if leaking:
        raise ValueError(f"subjects in several splits, among them {leaking}")
    missing = {"train", "val", "test"} - {r["split"] for r in rows.select("split").distinct().collect()}
    if missing:
        raise ValueError(f"empty splits: {sorted(missing)}")
    return rows.select("stay_id", "split")


def balanced_subset(rows: DataFrame, per_label: int, seed: int | None = None, top_up: bool = False) -> DataFrame:
    """The first ``per_label`` rows of each label, by stay_id or in hash order of a seed.

    With ``top_up`` a label that has fewer leaves its places to the next rows of the others.
    """
    order = [F.col("stay_id")] if seed is None else [hash_order(seed, F.col("stay_id")), F.col("stay_id")]
    ranked = ranked_within(rows, "label", order)
    if not top_up:
        return ranked.where(F.col("r") <= per_label).drop("r", "n")
    ranked = pinned(ranked)
    first = ranked.where(F.col("r") <= per_label)
    missing = per_label * ranked.select("label").distinct().count() - first.count()
    more = ranked.where(F.col("r") > per_label).orderBy("r", *order).limit(missing)
    return first.unionByName(more).drop("r", "n")


def filled_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; of a column that both sides have, the left value stands and the right one fills its nulls."""
    row = right.select(key, F.struct(*[c for c in right.columns if c != key]).alias("right_row"))
    mine = [F.coalesce(F.col(c), F.col(f"right_row.{c}")).alias(c) if c in right.columns and c != key else F.col(c) for c in left.columns]
    new = [F.col(f"right_row.{c}").alias(c) for c in right.columns if c not in left.columns]
    return left.join(row, key, "left").select(*mine, *new)


def joined_once(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner join of tables that each have one row per key; a key that stands twice in one of them is an error.

    The count of each key travels with the join's own shuffle, so that the check reads nothing twice.
    """
    window = Window.partitionBy(key)
    twice = F.raise_error(F.concat(F.lit(f"more than one row of a table for {key} "), F.col(key).cast("string"))).cast("long")
    checked = []
    for at, frame in enumerate(frames):
        name = f"rows_of_key_{at}"
        once = frame.where(F.col(key).isNotNull()).withColumn(name, F.count(F.lit(1)).over(window))
        checked.append(once.withColumn(name, F.when(F.col(name) > 1, twice).otherwise(F.col(name))).where(F.col(name) == 1).drop(name))
    return reduce(lambda a, b: a.join(b, key), checked)
