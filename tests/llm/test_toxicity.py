"""Toxicity: held-out accuracy, and the label model against planted voters and exhaustive sums."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import toxicity as tox
from cohortspark.llm.queries import op12_weak_supervision

DATA = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def test_query(spark):
    got = op12_weak_supervision(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == len(docs)
    by_text = {}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert by_text.setdefault(docs[r.doc_id], r.score) == r.score  # equal texts, equal scores
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 100
    assert sum(p for y, p in held if y == 0) == 0 and sum(p for y, p in held if y == 1) >= 0.75 * sum(y for y, _ in held)


def test_held_out_labels_and_columns_do_not_matter(spark):
    docs = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} text " + ("you vilestthing" if i % 4 == 0 else "you dear")) for i in range(240)]
    docs += [(900, None), (901, ""), (None, "vilestthing"), (902, "vilestthing " * 300_000), (902, "vilestthing")]
    rows = [(i, int(i % 4 == 0)) for i in range(200)]
    odd = [(None, 1), (3, 1), (901, None), (5, 7)]  # no id, a contradiction, no value, another value
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    other = [(i, 1 - y if held(i) else y) for i, y in rows]
    frame = lambda r: spark.createDataFrame(r, DOCS).withColumns({"score": F.lit("x"), "lang": F.lit(1), "y": F.lit(2)})
    first = sorted(tox.toxicity(frame(docs), spark.createDataFrame(rows + odd, LABELS)).collect(), key=str)
    second = sorted(tox.toxicity(frame(docs[::-1]), spark.createDataFrame(other + odd + rows[:9], LABELS)).collect(), key=str)
    assert [(r.doc_id, r.predicted) for r in first] == [(r.doc_id, r.predicted) for r in second]
    assert np.allclose([r.score for r in first], [r.score for r in second], atol=0.02)
    assert {r.doc_id for r in first if r.predicted} == {*range(0, 240, 4), None, 902} and len(first) == len(docs)
    assert all(r.predicted or r.score < 0.3 for r in first)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in tox.toxicity(docs, none).collect()] == [0.5, 0.5]
    assert tox.toxicity(docs.limit(0), none).collect() == []


def sampled(model, n, seed):
    """Codes and classes drawn from a label model by its own tables."""
    rng, codes, classes = np.random.default_rng(seed), [], []
    order = sorted(range(tox.N_VOTERS), key=lambda k: depth(model.parents, k))
    for _ in range(n):
        y = int(rng.random() < model.prior)
        votes = [0] * tox.N_VOTERS
        for k in order:
            above = votes[model.parents[k]] if model.parents[k] >= 0 else 0
            votes[k] = int(rng.choice(3, p=model.tables[y, k, above]))
        codes.append(tox.as_code(votes))
        classes.append(y)
    return np.array(codes), np.array(classes)


def depth(parents, k):
    return 0 if parents[k] < 0 else 1 + depth(parents, parents[k])


@pytest.fixture(scope="module")
def planted():
    """Ten voters of planted accuracy, of which the second copies the first, the others silent."""
    tables = np.full((2, tox.N_VOTERS, 3, 3), 1e-6)
    tables[:, :, :, 0] = 1
    for k in range(10):
        right = 0.6 + 0.03 * k
        for y in (0, 1):
            tables[y, k, :, 0], tables[y, k, :, 1 + y], tables[y, k, :, 2 - y] = 0.2, 0.8 * right, 0.8 * (1 - right)
    tables[:, 1] = np.eye(3) * 0.96 + 0.02
    parents = [-1] * tox.N_VOTERS
    parents[1] = 0
    return tox.LabelModel(0.3, parents, tables / tables.sum(3, keepdims=True))


def test_label_model_finds_planted_voters(spark, planted):
    codes, classes = sampled(planted, 6000, 1)
    given = np.where(np.arange(6000) < 300, classes, -1)
    rows = [(int(c), int(y), 1) for c, y in zip(codes, given, strict=True)]
    frame = spark.createDataFrame(rows, "code long, y int, n long").groupBy("code", "y").agg(F.sum("n").alias("n"))
    found = tox.label_model(frame)
    assert abs(found.prior - 0.3) < 0.05
    assert found.parents[1] == 0 or found.parents[0] == 1  # the twins are joined
    for k in range(2, 10):  # the shares of right votes of the others
        for y in (0, 1):
            assert found.parents[k] < 0 and abs(found.tables[y, k, 0, 1 + y] - planted.tables[y, k, 0, 1 + y]) < 0.06
    right = ((found.posterior(codes) > 0.5) == classes).mean()
    best = ((planted.posterior(codes) > 0.5) == classes).mean()
    assert right > best - 0.01


def test_posterior_is_bayes(planted):
    """Against the sum over both classes of the product of all tables."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        votes = [int(v) for v in rng.integers(0, 3, 10)] + [0] * (tox.N_VOTERS - 10)
        joint = []
        for y in (0, 1):
            p = planted.prior if y else 1 - planted.prior
            for k, v in enumerate(votes):
                p *= planted.tables[y, k, votes[planted.parents[k]] if planted.parents[k] >= 0 else 0, v]
            joint.append(p)
        assert planted.posterior(np.array([tox.as_code(votes)]))[0] == pytest.approx(joint[1] / sum(joint), rel=1e-9)


def test_expected_pairs(spark, planted):
    codes, _ = sampled(planted, 50, 3)
    rows = [(int(c), -1, 2) for c in codes]
    got = tox.expected_pairs(spark.createDataFrame(rows, "code long, y int, n long"), planted)
    p, hot = planted.posterior(codes), tox.one_hot(codes)
    for (i, j), c in itertools.product([(0, 4), (3, 17), (8, 8)], (0, 1)):
        weight = p if c else 1 - p
        assert got[c, i, j] == pytest.approx(2 * sum(w * h[i] * h[j] for w, h in zip(weight, hot, strict=True)))
