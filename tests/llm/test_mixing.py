"""Mixing: targets, flow against exhaustive search, and the query against a plain selection."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing, shared
from cohortspark.llm.queries import op5_flow_mix

DATA = "/root/testdata/sf0.001"


def filled(sizes, weights=(5, 2, 1), share=150, most=2):
    """Targets by pouring again and again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, waiting, found = sum(sizes.values()) * share / 100, set(names), {}
    while waiting:
        total = sum(weight[s] for s in waiting)
        full = {s for s in waiting if left * weight[s] / total > most * sizes[s]}
        if not full:
            return found | {s: left * weight[s] / total for s in waiting}
        found |= {s: float(most * sizes[s]) for s in full}
        left -= sum(found[s] for s in full)
        waiting -= full
    return found


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, 100, 1000, 40_000]) for i in range(seed * 4)} | ({None: 10} if seed % 2 else {})
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: (r.source_size, r.target) for r in got.collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(got[s][0] == sizes[s] and abs(got[s][1] - want[s]) < 1e-6 for s in want)


def test_flow_is_cheapest():
    """Against all ways to fill the quotas: words at a higher level cost more."""
    rng = random.Random(3)
    for _ in range(40):
        cells = [(0, 0, rng.randrange(1, 4)), (1, 1, rng.randrange(1, 4)), (2, 0, rng.randrange(1, 3)), (2, 1, rng.randrange(1, 3))]
        once = [cells[0][2], cells[1][2], rng.randrange(1, 3)]
        quotas = [rng.randrange(2 * (cells[0][2] + cells[2][2]) + 1), rng.randrange(2 * (cells[1][2] + cells[3][2]) + 1)]

        def cost(given):
            through = [given[0], given[1], given[2] + given[3]]
            offered = [mixing.levels(once[p], 2 * sum(w for q, _, w in cells if q == p)) for p in range(3)]
            total = 0
            for words, offer in zip(through, offered):
                for level, room in enumerate(offer):
                    total += min(words, room) * (level + 1) ** 2
                    words -= min(words, room)
            return total

        options = [g for g in itertools.product(*[range(2 * c[2] + 1) for c in cells]) if [g[0] + g[2], g[1] + g[3]] == quotas]
        given = tuple(mixing.route(once, cells, quotas))
        assert given in options and cost(given) == min(map(cost, options))


def test_levels():
    assert mixing.levels(3, 20) == [3, 3, 6, 8] and mixing.levels(5, 4) == [4] and mixing.levels(1, 0) == []
    assert sum(mixing.levels(1, 1_000_001)) == 1_000_001


def brute(rows):
    """Words of a text, of each source, its target, the pattern of each text and the texts of each cell."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, stands, cells = {}, {}, {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
        stands.setdefault(t, set()).add(s)
    members = {t: frozenset(s) if size(t) and len(s) > 1 else None for t, s in stands.items()}
    for _, t, s in rows:
        cells.setdefault((members[t], s), []).append(t)
    return size, totals, filled(totals), members, cells


def check(got, rows):
    """Each source near its target, nothing above twice its size, and a prefix of the seeded order in each cell."""
    size, _, targets, members, cells = brute(rows)
    source, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    copies = {}
    for doc, n, taken in got:
        assert n == size(text[doc]) and taken <= 2 * n and (n == 0 or taken % n == 0)
        copies[doc] = taken // n if n else 0
    for s, target in targets.items():
        mine = [g for g in got if source[g[0]] == s]
        slack = sum(max(size(t) for t in c) for (_, of), c in cells.items() if of == s)
        assert abs(sum(g[2] for g in mine) - target) <= slack / 2 + 1
    for pattern, s in cells:
        mine = [d for d in source if source[d] == s and members[text[d]] == pattern and size(text[d])]
        mine.sort(key=lambda d: int(hashlib.md5(f"7:{'null' if d is None else d}".encode()).hexdigest()[:15], 16))
        taken = [copies[d] for d in mine]
        assert taken == sorted(taken, reverse=True) and (not taken or max(taken) - min(taken) <= 1)
    return copies


def test_query(spark):
    """On the given table, with shared texts; sources that share none get what filling alone gives."""
    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op5_flow_mix(spark, data).collect()
    check([(r.doc_id, r.size, r.taken) for r in got], rows)
    _, totals, targets, members, _ = brute(rows)
    source = {r[0]: r[2] for r in rows}
    assert sum(m is not None for m in members.values()) >= 50  # texts that stand in several sources
    assert all(r.source_size == totals[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-3 for r in got)
    again = {r.doc_id: r.taken for r in op5_flow_mix(spark, data).collect()}
    assert again == {r.doc_id: r.taken for r in got}


@pytest.mark.parametrize(("patterns", "broadcast"), [(20_000, 100_000), (1, 0), (0, 100_000)])
def test_overlap(spark, monkeypatch, patterns, broadcast):
    """Source a has as many words as b, half of them b's texts; beyond the limit of patterns targets are met all the same."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", patterns)
    monkeypatch.setattr(mixing, "sent", lambda df: shared.sent(df, broadcast))
    rows = [(i, f"only a {i}", "a") for i in range(100)] + [(100 + i, f"in both {i}", s) for i in range(100) for s in "ab"] + [(300 + i, f"bc {i}", s) for i in range(50) for s in "bc"]
    rows = [(n, t, s) for n, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, _ = mixing.mix(docs)
    got = [(r.doc_id, r.size, r.size * r.copies) for r in mixed.collect()]
    if patterns == 20_000:
        copies = check(got, rows)
        # c takes its two passes; b then spares the texts of c, and a leaves the shared texts to b.
        uses = {}
        for d, t, _ in rows:
            uses[t.rsplit(" ", 1)[0]] = uses.get(t.rsplit(" ", 1)[0], 0) + copies[d]
        assert uses["only a"] >= uses["in both"] / 2
    targets = filled({"a": 600, "b": 400, "c": 100})
    for s, target in targets.items():
        assert abs(sum(g[2] for g, r in zip(sorted(got), rows) if r[2] == s) - target) <= 6


def test_cases(spark):
    rows = [(i, f"w{i} " * (i % 9), f"s{i % 3}") for i in range(60)] + [(None, "a b c", None), (71, None, None), (72, "", "s1"), (73, "x y", None), (74, "x y", "s0"), (70, "v " * 50_000, "s2")]
    docs = spark.createDataFrame([(*r, "extra", "p") for r in rows], "doc_id long, text string, source string, size string, pattern string")
    mixed, goals = mixing.mix(docs.drop("size", "pattern"))
    got = [(r.doc_id, r.size, r.size * r.copies) for r in mixed.collect()]
    check(got, rows)
    assert goals.count() == 4
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns
    words = repeated.select(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n
    assert words == sum(g[2] for g in got)
    twice = docs.unionByName(docs)  # repeated rows share a decision
    assert mixing.mix(twice)[0].groupBy("doc_id", "size").agg(F.count_distinct("copies").alias("n")).where("n > 1").count() == 0
    assert mixing.repeat_documents(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0))[0].collect() == []


def level_costs(through, once, held):
    """Words of all patterns by level."""
    out = {}
    for words, n, most in zip(through, once, held):
        for level, room in enumerate(mixing.levels(max(1, n), most)):
            out[level] = out.get(level, 0) + min(words, room)
            words -= min(words, room)
        assert words == 0
    return {k: v for k, v in out.items() if v}


def through_of(cells, given, n):
    through, held = [0] * n, [0] * n
    for (p, _, words), g in zip(cells, given):
        assert 0 <= g <= 2 * words
        through[p] += g
        held[p] += 2 * words
    return through, held


@pytest.mark.parametrize("seed", range(2))
def test_flow_over_tables(spark, seed):
    """The flow by joins fills the quotas with as many words of each level as the driver's; chains of sources need long ways."""
    rng = random.Random(seed)
    n, s = (3, 4) if seed == 0 else (8, 4)
    members = [(i, i + 1) for i in range(n)] if seed == 0 else [rng.sample(range(s), rng.randrange(2, 4)) for _ in range(n)]
    once = [rng.randrange(1, 50) for _ in range(n)]
    cells = [(p, q, once[p] * rng.randrange(1, 3)) for p in range(n) for q in members[p]]
    once += [rng.randrange(1, 60) for _ in range(s)]
    cells += [(n + q, q, once[n + q]) for q in range(s)]
    total = [sum(w for _, q, w in cells if q == k) for k in range(s)]
    quotas = [2 * t if seed == 0 and k == 0 else int(t * rng.choice([0, 0.3, 0.9, 1.4, 2])) for k, t in enumerate(total)]
    found = mixing.route_wide(
        spark.createDataFrame([(str(p), w) for p, w in enumerate(once)], "p string, once long"),
        spark.createDataFrame([(str(p), q, w) for p, q, w in cells], "p string, s long, words long"),
        spark.createDataFrame(list(enumerate(quotas)), "s long, quota long"),
    )
    found = {(int(r.p), r.s): r.give for r in found.collect()}
    wide = [found[p, q] for p, q, _ in cells]
    assert [sum(g for (_, q, _), g in zip(cells, wide) if q == k) for k in range(s)] == quotas
    costs = [level_costs(t, once, h) for t, h in (through_of(cells, g, n + s) for g in (wide, mixing.route(once, cells, quotas)))]
    assert costs[0] == costs[1]


@pytest.mark.parametrize(("sources", "patterns"), [(70, 20_000), (3, 0)])
def test_no_pattern_is_left_out(spark, monkeypatch, sources, patterns):
    """Texts of more than 64 sources, and patterns beyond the driver's limit, are patterns of their own."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", patterns)
    rows = [f"all {i % 3}" for i in range(3 * sources)] + [f"own {i} of it" for i in range(3 * sources)]
    rows = [(n, t, f"s{n // 3 % sources:02}") for n, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    thin = shared.staged(docs.select("doc_id", "source", *mixing.thin_columns(F.col("text"), F.col("doc_id"))))
    decision, texts, _ = mixing.plan(thin)
    assert texts.count() == 3
    taken = mixing.copies_of(decision, texts, thin).collect()
    check([(r.doc_id, r.size, r.size * r.copies) for r in taken], rows)
