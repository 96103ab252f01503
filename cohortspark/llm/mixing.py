"""Mixing sources to target weights by min-cost flow over membership patterns.

Method. Rows of equal text are one text; the set of sources that it stands in is its membership pattern. Texts are
aggregated by pattern, and a small flow network routes each pattern's words to its sources: a pattern offers its texts'
words once at the least cost, a second time at a higher one, and then in steps that double (convex, so that texts are
repeated evenly); from a pattern to a source goes at most what the pattern's rows of that source hold, times
``MAX_REPEATS``; and each source takes its quota. The least-cost maximum flow so fills a source with texts that stand
nowhere else before it repeats those that others use too. For each pattern and source it gives so many whole passes
over the rows, and a rest: the rows that come first in a seeded order, up to the prefix nearest to the rest.

Cases. A null or blank text has size 0 and is taken 0 times in words. A null source is a source of its own, ordered
last. Rows with equal doc_id and text share one decision, as their seeded order is the same; reruns agree whatever the
partitioning. Very long texts are rows as any other: a rest is met to within half a text. An empty table gives an
empty result. Extra columns pass through, whatever their names.

Scale. Sizes are summed by text and source (128-bit hashes of the texts; a partial sum leaves each task, so groups of
copies of any size are one row), then by pattern. The driver solves the flow of a network of up to ``MAX_PATTERNS``
patterns and ``MAX_CELLS`` pairs of pattern and source (``route``). A larger one stays in tables, where the same flow is
found by joins (``route_wide``), for any number of patterns and of sources of a text; both are least in cost, where
several flows are, they may differ. Targets are computed in Spark for any number of sources; sources
that share no text take their quota from their own rows without a flow. Within a pattern and source, sizes are summed
by leading bits of the seeded order (4096 ranges), and only the range that holds the cut is ordered row by row.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.shared import drop_folder, fresh, sent, shared_folder, staged
from cohortspark.operators.ordering import global_running

SEED = 7
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
#: Up to so many patterns, and pairs of pattern and source, the driver solves the flow; beyond, joins do.
MAX_PATTERNS = 20_000
MAX_CELLS = 200_000
_RANGES = 4096
_ORDER_BITS = 60
_BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, seed: int = SEED) -> Column:
    """A number below 2**60 from the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _ORDER_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE_PERCENT, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target: words that each source shall give.

    By weight (repeating in the order of sources, null last), no more than ``most`` times the source's size, the excess
    reshared: a source is full below the water level at which all give the share of all words.
    """
    one = sizes.select("source", "source_size", F.lit(1).alias("one"))
    ranked = global_running(one, [F.col("source").asc_nulls_last()], {"place": "one"})
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).cast("double")
    ranked = ranked.select("source", "source_size", "place", "one", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("full"))
    ratio = F.col("full") / F.col("weight")
    poured = staged(global_running(ranked, [ratio, F.col("place")], {"upto": "full", "weights": "weight", "turn": "one"}))
    sums = poured.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = (sums[0] or 0) * share / 100, sums[1] or 0.0
    level = (F.lit(total) - (F.col("upto") - F.col("full"))) / (F.lit(all_weights) - (F.col("weights") - F.col("weight")))
    found = poured.where(ratio >= level).agg(F.min_by(level, "turn")).first()[0]  # one number
    target = F.col("full") if found is None else F.least("full", F.col("weight") * F.lit(found))
    return staged(poured.select("source", "source_size", target.alias("target")))


def levels(once: int, most: int) -> list[int]:
    """Words that a pattern offers at each cost: its texts once, a second time, then doubling, ``most`` in all."""
    out, left, step = [], most, once
    while left > 0:
        out.append(min(step, left))
        left -= out[-1]
        if len(out) > 1:
            step *= 2
    return out


def route(patterns: list[int], cells: list[tuple[int, int, int]], quotas: list[int], most: int = MAX_REPEATS) -> list[int]:
    """Words that go through each cell, by least-cost maximum flow.

    patterns: words of each pattern's texts, once. cells: (pattern, source, words of its rows). quotas: of each source.
    Only arcs out of the flow's origin cost anything, so that what they carry in a maximum flow is a base of a
    polymatroid: offering the levels from the cheapest to the dearest, each with a maximum flow on top of the one before,
    is least in cost. Each maximum flow is found in layers of shortest paths.
    """
    end = 1 + len(patterns) + len(quotas)
    heads: list[list[int]] = [[] for _ in range(end + 1)]
    to, room = [], []

    def arc(a: int, b: int, capacity: int) -> int:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        return len(to) - 2

    held = [0] * len(patterns)
    for p, _, words in cells:
        held[p] += most * words
    offers = [levels(max(1, once), held[p]) for p, once in enumerate(patterns)]
    into = [arc(0, 1 + p, 0) for p in range(len(patterns))]
    through = [arc(1 + p, 1 + len(patterns) + s, most * words) for p, s, words in cells]
    for s, quota in enumerate(quotas):
        arc(1 + len(patterns) + s, end, quota)
    for step in range(max(map(len, offers), default=0)):
        for p, offer in enumerate(offers):
            if step < len(offer):
                room[into[p]] += offer[step]
        while True:
            depth, waiting = [-1] * (end + 1), deque([0])
            depth[0] = 0
            while waiting:
                a = waiting.popleft()
                for e in heads[a]:
                    if room[e] and depth[to[e]] < 0:
                        depth[to[e]] = depth[a] + 1
                        waiting.append(to[e])
            if depth[end] < 0:
                break
            tried, path, at = [0] * (end + 1), [], 0
            while True:
                if at == end:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    full = next(i for i, e in enumerate(path) if not room[e])
                    at = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[at] < len(heads[at]):
                    e = heads[at][tried[at]]
                    if room[e] and depth[to[e]] == depth[at] + 1:
                        path.append(e)
                        at = to[e]
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
    return [room[e ^ 1] for e in through]


def route_wide(patterns: DataFrame, cells: DataFrame, quotas: DataFrame, most: int = MAX_REPEATS) -> DataFrame:
    """``route`` over tables of any size: p, s and give of each cell.

    patterns: p, once. cells: p, s, words. quotas: s, quota; each within ``most`` times the words of its cells.

    The levels come one after the other, from the cheapest, as excess at their patterns; the excess goes to the sources
    with quota left, as far as there is a way over cells with room. What stays at patterns is not offered again: it has
    no way at later levels either. What stays at sources goes back to patterns, no more to each than its words of this
    level, so that words of cheaper levels stay in use.
    """
    flows, path = _kept(cells.where("words > 0").select("p", "s", (most * F.col("words")).alias("cap"), F.lit(0).cast("long").alias("give")))
    held = flows.groupBy("p").agg(F.sum("cap").alias("held"))
    offers = staged(patterns.join(held.hint("merge"), "p").select("p", F.greatest("once", F.lit(1)).alias("once"), "held"))
    left = staged(quotas.select("s", F.col("quota").alias("over")).where("over > 0"))
    step = 0
    while not left.isEmpty():
        upto = [F.least(F.col("held").cast("double"), F.col("once") * F.lit(2.0**k)).cast("long") for k in (step, step - 1)]
        offer = upto[0] - upto[1] if step else upto[0]
        offered = staged(offers.select("p", offer.alias("over")).where("over > 0"))
        flows, path, over, left = _settled(flows, path, {"p": offered, "s": None}, left, "s")
        if over["s"] is not None and not over["s"].isEmpty():
            used = _less(offered, over["p"].withColumnRenamed("over", "moved"), "p")
            flows, path, _, _ = _settled(flows, path, {"p": None, "s": over["s"]}, used, "p")
        step += 1
    out = staged(flows.select("p", "s", "give"))
    drop_folder(cells.sparkSession, path)
    return out


def _settled(flows: DataFrame, path: str, over: dict, left: DataFrame, side: str) -> tuple[DataFrame, str, dict, DataFrame]:
    """Flows, excess (``over``, by side) and room left at the nodes of one side, after all excess with a way there went there.

    Steps over cells with room give each node's distance to room that is left. The excess moves a layer nearer at a
    time, all of a layer at once, from the farthest. What is held up has no room towards the next layer, so that its
    distance grows; distances are taken again until no excess has one.
    """
    other = {"p": "s", "s": "p"}
    while not left.isEmpty() and any(o is not None and not o.isEmpty() for o in over.values()):
        layers, moves = _layers(flows, left, side), False
        for depth in range(len(layers) - 1, 0, -1):
            a, b = (other[side], side) if depth % 2 else (side, other[side])
            if over[a] is None:
                continue
            moved = _moved(flows, over[a].join(sent(layers[depth]), a, "left_semi"), a, b, layers[depth - 1])
            if moved.isEmpty():
                continue
            flows, path = _carried(flows, path, moved, 1 if a == "p" else -1)
            over[a], over[b], moves = _less(over[a], moved, a), _more(over[b], moved, b), True
        if not moves:
            break
        met = staged(over[side].join(sent(left.withColumnRenamed("over", "room")), side).select(side, F.least("over", "room").alias("moved")))
        over[side], left = _less(over[side], met, side), _less(left, met, side)
    return flows, path, over, left


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession)
    return staged(df, path), path


def _layers(flows: DataFrame, left: DataFrame, side: str) -> list[DataFrame]:
    """Nodes by their distance to room left on a side: those that have it, those of the other side with room to these, and so on."""
    layers = [staged(left.select(side))]
    seen: dict[str, DataFrame | None] = {"s": None, "p": None, side: layers[0]}
    there = side
    while True:
        here, there = there, "p" if there == "s" else "s"
        found = flows.where("give < cap" if there == "p" else "give > 0").join(sent(layers[-1]), here, "left_semi").select(there).distinct()
        if seen[there] is not None:
            found = found.join(sent(seen[there]), there, "left_anti")
        found = staged(found)
        if found.isEmpty():
            return layers
        seen[there] = found if seen[there] is None else staged(seen[there].unionByName(found))
        layers.append(found)


def _moved(flows: DataFrame, senders: DataFrame, a: str, b: str, takers: DataFrame) -> DataFrame:
    """p, s and moved: what the senders' excess moves through their cells to the takers, in order, within the room of each."""
    room = F.col("cap") - F.col("give") if a == "p" else F.col("give")
    rows = flows.select("p", "s", room.alias("room")).where("room > 0").join(sent(senders), a).join(sent(takers), b, "left_semi")
    # Room before each cell: of earlier buckets of the sender's cells, and of earlier cells in the bucket.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(b), F.lit(_BUCKETS)))
    parts = rows.groupBy(F.col(a).alias("of"), F.col("bucket").alias("part")).agg(F.sum("room").alias("sum"))
    parts = parts.withColumn("before", F.sum("sum").over(Window.partitionBy("of").orderBy("part")) - F.col("sum"))
    run = rows.join(parts.hint("merge"), (F.col(a) == F.col("of")) & (F.col("bucket") == F.col("part")))
    upto = F.col("before") + F.sum("room").over(Window.partitionBy(a, "bucket").orderBy(b))
    run = run.withColumn("upto", upto).select("p", "s", F.least("room", F.col("over") - F.col("upto") + F.col("room")).alias("moved"))
    return staged(run.where("moved > 0"))


def _carried(flows: DataFrame, path: str, moved: DataFrame, sign: int) -> tuple[DataFrame, str]:
    """The flows with what moved, in a new folder; the old one goes."""
    joined = flows.join(sent(moved), ["p", "s"], "left")
    now = _kept(joined.select("p", "s", "cap", (F.col("give") + sign * F.coalesce("moved", F.lit(0))).alias("give")))
    drop_folder(flows.sparkSession, path)
    return now


def _more(over: DataFrame | None, moved: DataFrame, node: str, sign: int = 1) -> DataFrame:
    rows = moved.select(node, (sign * F.col("moved")).alias("over"))
    rows = rows if over is None else over.unionByName(rows)
    return staged(rows.groupBy(node).agg(F.sum("over").alias("over")).where("over > 0"))


def _less(over: DataFrame, moved: DataFrame, node: str) -> DataFrame:
    return _more(over, moved, node, -1)


def thin_columns(text: Column, doc_id: Column, seed: int = SEED) -> list[Column]:
    """size, text keys k1 and k2, and at (seeded order) of each document."""
    return [
        word_count(text).alias("size"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("text"), text).alias("k2"),
        seeded_order(doc_id, seed).alias("at"),
    ]


def plan(thin: DataFrame, weights=WEIGHTS, share: int = SHARE_PERCENT, most: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to take of each pattern and source, the patterns of shared texts, and the sources' targets.

    thin: source, size, k1, k2 and at of each document, a written table. Decision rows: pattern (empty for texts of one
    source), of (source), passes, cut_range, cut_at, cut_k1, cut_k2. Shared texts: s1, s2, pattern.
    """
    spark = thin.sparkSession
    texts = thin.where("size > 0").groupBy("k1", "k2", "source").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    texts = staged(texts)
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most)
    once = texts.groupBy("source").agg(F.sum("size").alias("once"))
    # A pattern's name: sums over its sources' hashes.
    name = [F.sum(F.xxhash64(F.lit(k), F.col("source")).cast("decimal(38,0)")) for k in (1, 2)]
    shared = texts.groupBy("k1", "k2").agg(F.count("*").alias("members"), F.first("size").alias("size"), F.concat_ws(",", *name).alias("pattern"))
    shared = staged(shared.where("members > 1").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "size", "pattern"))
    patterns = staged(shared.groupBy("pattern").agg(F.sum("size").alias("once")))
    shared = shared.drop("size")
    same_text = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    cells = texts.join(sent(shared), same_text).groupBy("pattern", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("size").alias("once")
    )
    cells = staged(cells)
    if patterns.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS or cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        decided = _routed_wide(cells, patterns, goals, once, most)
    else:
        found = cells.orderBy("pattern", "source").collect()  # at most MAX_CELLS rows
        decided = _routed(spark, found, {r["pattern"]: r["once"] for r in patterns.collect()}, goals, once, most)
    alone = goals.join(sent(staged(cells.select(F.col("source").alias("of")).distinct())), F.col("source").eqNullSafe(F.col("of")), "left_anti")
    alone = alone.select(F.lit("").alias("pattern"), F.col("source").alias("of"), F.floor(F.col("target") + 1e-6).alias("give"), F.col("source_size").alias("words"))
    decided = alone.unionByName(decided) if decided is not None else alone
    passes = F.when(F.col("words") > 0, F.expr("give div words")).otherwise(0)
    decided = staged(decided.select("pattern", "of", passes.alias("passes"), (F.col("give") - passes * F.col("words")).alias("rest")))
    # The cut within each pattern and source: the range of the seeded order that holds it, then the row.
    placed = staged(with_pattern(thin, shared).withColumn("cut_range", _range_of(F.col("at"))))
    cell = F.struct("pattern", "of")
    ranged = placed.groupBy("pattern", "of", "cut_range").agg(F.sum("size").alias("size"))
    open_ = sent(staged(decided.where("rest > 0").select(F.col("pattern").alias("p"), F.col("of").alias("s"), "rest")))
    same = (F.col("pattern") == F.col("p")) & F.col("of").eqNullSafe(F.col("s"))
    running = Window.partitionBy("pattern", "of").orderBy("cut_range")
    upto = ranged.withColumn("upto", F.sum("size").over(running)).join(open_, same).where("upto >= rest")
    cut = upto.groupBy("pattern", "of", "rest").agg(F.min_by(F.struct("cut_range", (F.col("upto") - F.col("size")).alias("before")), "cut_range").alias("c"))
    cut = staged(cut.select(F.col("pattern").alias("p"), F.col("of").alias("s"), "rest", F.col("c.cut_range").alias("r"), "c.before"))
    near = placed.join(sent(cut), same & (F.col("cut_range") == F.col("r")))
    steps = near.groupBy("pattern", "of", "at", "k1", "k2", "before", "rest").agg(F.sum("size").alias("sum"))
    order = Window.partitionBy("pattern", "of").orderBy("at", "k1", "k2")
    steps = steps.withColumn("to", F.col("before") + F.sum("sum").over(order)).where(2 * F.col("to") - F.col("sum") < 2 * F.col("rest"))
    last = steps.groupBy(cell.alias("cell")).agg(F.max(F.struct("at", "k1", "k2")).alias("last"))
    last = sent(staged(last.select(F.col("cell.pattern").alias("p"), F.col("cell.of").alias("s"), "last")))
    full = decided.join(sent(cut), same, "left").select("pattern", "of", "passes", F.col("r").alias("cut_range"))
    full = full.join(last, same, "left").select(
        "pattern", "of", "passes", "cut_range", F.col("last.at").alias("cut_at"), F.col("last.k1").alias("cut_k1"), F.col("last.k2").alias("cut_k2")
    )
    return staged(full), shared, goals


def _routed(spark, cells: list, patterns: dict[str, int], goals: DataFrame, once: DataFrame, most: int) -> DataFrame | None:
    """pattern, of, give and words of each cell of the network, the own texts of its sources included."""
    if not cells:
        return None
    involved = spark.createDataFrame([(r["source"],) for r in cells], goals.select("source").schema).distinct()
    wanted = goals.join(F.broadcast(involved.select(F.col("source").alias("i"))), F.col("source").eqNullSafe(F.col("i")), "left_semi")
    wanted = wanted.join(F.broadcast(once.select(F.col("source").alias("o"), "once")), F.col("source").eqNullSafe(F.col("o")))
    rows = wanted.select("source", "source_size", "target", "once").orderBy(F.col("source").asc_nulls_last()).collect()  # no more than cells
    at = {r["source"]: i for i, r in enumerate(rows)}
    names, number = sorted(patterns), {}
    for name in names:
        number[name] = len(number)
    own, own_words = [r["once"] for r in rows], [r["source_size"] for r in rows]
    arcs = []
    for c in cells:
        s = at[c["source"]]
        own[s] -= c["once"]
        own_words[s] -= c["words"]
        arcs.append((number[c["pattern"]], s, c["words"]))
    arcs += [(len(names) + s, s, own_words[s]) for s in range(len(rows))]
    given = route([*[patterns[n] for n in names], *own], arcs, [int(r["target"] + 1e-6) for r in rows], most)
    out = [("" if p >= len(names) else names[p], rows[s]["source"], int(g), int(w)) for (p, s, w), g in zip(arcs, given, strict=True)]
    source_type = goals.schema["source"].dataType.simpleString()
    return spark.createDataFrame(out, f"pattern string, of {source_type}, give long, words long")


def _routed_wide(cells: DataFrame, patterns: DataFrame, goals: DataFrame, once: DataFrame, most: int) -> DataFrame:
    """The same for a network of any size."""
    ones = goals.select("source", "source_size", "target", F.lit(1).cast("long").alias("one"))
    numbered = staged(global_running(ones, [F.col("source").asc_nulls_last()], {"s": "one"}).drop("one"))
    ids = sent(numbered.select(F.col("source").alias("of"), "s"))
    pairs = cells.join(ids, F.col("source").eqNullSafe(F.col("of")))
    pairs = staged(pairs.select(F.col("pattern").alias("p"), "s", "words", "once"))
    # The own texts of each source: all but those of its cells.
    texts = once.join(ids, F.col("source").eqNullSafe(F.col("of"))).select("s", F.col("once").alias("all_once"))
    told = pairs.groupBy("s").agg(F.sum("once").alias("cell_once"), F.sum("words").alias("cell_words"))
    own = numbered.join(told.hint("merge"), "s").join(texts.hint("merge"), "s")
    own = staged(
        own.select(
            F.concat(F.lit("own "), "s").alias("p"), "s", (F.col("source_size") - F.col("cell_words")).alias("words"),
            (F.col("all_once") - F.col("cell_once")).alias("once"), F.floor(F.col("target") + 1e-6).alias("quota"),
        )
    )
    all_cells = staged(pairs.select("p", "s", "words").unionByName(own.select("p", "s", "words")))
    offers = patterns.select(F.col("pattern").alias("p"), "once").unionByName(own.select("p", "once"))
    given = route_wide(offers, all_cells, own.select("s", "quota"), most)
    rows = given.join(all_cells.hint("merge"), ["p", "s"]).join(ids, "s")
    pattern = F.when(F.col("p").startswith("own "), "").otherwise(F.col("p"))
    return staged(rows.select(pattern.alias("pattern"), "of", "give", "words"))


def _range_of(at: Column) -> Column:
    return F.shiftright(at, _ORDER_BITS - (_RANGES.bit_length() - 1)).cast("int")


def with_pattern(thin: DataFrame, shared: DataFrame) -> DataFrame:
    """``thin`` with the pattern of its text and ``of``, its source."""
    joined = thin.join(sent(shared), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").drop("s1", "s2")
    return joined.withColumns({"pattern": F.coalesce("pattern", F.lit("")), "of": F.col("source")})


def copies_of(decision: DataFrame, shared: DataFrame, thin: DataFrame, name: str = "copies") -> DataFrame:
    """``thin`` with the number of times that the mix takes each row."""
    placed = with_pattern(thin, shared)
    decision = sent(decision.withColumnsRenamed({"pattern": "p", "of": "s"}))
    joined = placed.join(decision, (F.col("pattern") == F.col("p")) & F.col("of").eqNullSafe(F.col("s")), "left")
    first = _range_of(F.col("at")) < F.col("cut_range")
    equal = _range_of(F.col("at")) == F.col("cut_range")
    upto = F.struct("at", "k1", "k2") <= F.struct(F.col("cut_at").alias("at"), F.col("cut_k1").alias("k1"), F.col("cut_k2").alias("k2"))
    extra = F.when(first | (equal & F.coalesce(F.col("cut_at").isNotNull() & upto, F.lit(False))), 1).otherwise(0)
    joined = joined.withColumn(name, (F.coalesce("passes", F.lit(0)) + extra).cast("int"))
    return joined.drop("pattern", "of", "p", "s", "passes", "cut_range", "cut_at", "cut_k1", "cut_k2")


def mix(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size and copies of every document; source, source_size and target of every source."""
    thin = staged(docs.select("doc_id", "source", *thin_columns(F.col("text"), F.col("doc_id"), seed)))
    decision, shared, goals = plan(thin)
    return copies_of(decision, shared, thin).select("doc_id", "source", "size", "copies"), goals


def repeat_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: once, twice or not at all."""
    columns = thin_columns(F.col("text"), F.col("doc_id"), seed)
    decision, shared, _ = plan(staged(docs.select("source", *columns)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # The second pass needs no sizes: only keys and order.
    taken = copies_of(decision, shared, docs.select(whole, "source", *columns[1:])).where("copies > 0")
    return taken.select("row", F.explode(F.expr("array_repeat(1, copies)")).alias("copy")).select("row.*")


def with_goals(mixed: DataFrame, goals: DataFrame) -> DataFrame:
    """``mixed`` with source_size and target of each row's source."""
    named = goals.withColumnRenamed("source", fresh(mixed, "goal_of"))
    return mixed.join(sent(named), mixed["source"].eqNullSafe(named[named.columns[0]]), "left").drop(named.columns[0])
