"""Rollups against recounting everything."""

import os
import random
import tempfile
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import rollups
from cohortspark.llm.queries import op6_token_rollups

SCHEMA = "op string, seq long, doc_id long, tokenizer_version string, source string, lang string, n_tokens long"


def totals(store):
    return sorted([tuple(r) for r in store.totals().collect()], key=str)


def test_batches(spark):
    store = rollups.Store(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}/store")
    assert store.totals().collect() == []
    first = [("insert", 1, 1, "v1", "a", "en", 10), ("insert", 1, 2, "v1", "a", "en", 5), ("insert", 1, 2, "v2", "a", "en", 7), ("insert", 1, 3, "v1", None, None, 2), ("insert", 1, None, "v1", "a", "en", 100), ("insert", 1, 2, "v2", "a", "en", 7)]
    assert store.commit(1, spark.createDataFrame(first, SCHEMA))
    want = [("a", "en", "v1", 3, 115), ("a", "en", "v2", 1, 7), (None, None, "v1", 1, 2)]
    assert totals(store) == sorted(want, key=str)
    second = [("delete", 2, 1, "v1", None, None, None), ("revise", 2, 2, "v1", None, None, 6), ("revise", 3, 2, "v1", None, None, 8), ("delete", 2, 99, "v1", None, None, None), ("insert", 2, 2, "v2", "b", "fr", 1), ("delete", 2, None, "v1", None, None, None)]
    batch = spark.createDataFrame(second, SCHEMA)
    assert store.commit(2, batch) and not store.commit(2, batch)
    want = [("a", "en", "v1", 2, 108), ("b", "fr", "v2", 1, 1), (None, None, "v1", 1, 2)]
    assert totals(store) == sorted(want, key=str)
    assert store.commit(3, spark.createDataFrame([], SCHEMA)) and totals(store) == sorted(want, key=str)
    assert store.committed() == [1, 2, 3] and store.ledger().count() == 3


def test_history_and_snapshots(spark, monkeypatch):
    """Many batches against recounting, with a snapshot at every third entry."""
    monkeypatch.setattr(rollups, "COMPACT", 3)
    store, rng, living = rollups.Store(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}/store"), random.Random(4), {}
    for batch in (10, 3, 7, 8, 1, 2, 20):  # in any order of numbers
        rows = []
        for doc in rng.sample(range(12), 6):
            op, source, n = rng.choice(["insert", "delete", "revise", "other", None]), rng.choice("ab"), rng.randrange(50)
            rows.append((op, batch, doc, "v", source, "en", n, "x" * 100_000))
            if op == "insert" or (op == "revise" and doc in living):
                living[doc] = (source, n)
            elif op == "delete":
                living.pop(doc, None)
        # A long text and a column that could clash are not read.
        assert store.commit(batch, spark.createDataFrame(rows, SCHEMA + ", entry string"))
        want = Counter(s for s, _ in living.values())
        sums = {s: sum(n for t, n in living.values() if t == s) for s in want}
        assert totals(store) == sorted([(s, "en", "v", want[s], sums[s]) for s in want], key=str)
        assert {(r.doc_id, r.source, r.n_tokens) for r in store.ledger().collect()} == {(d, *v) for d, v in living.items()}
    assert store.committed() == [1, 2, 3, 7, 8, 10, 20]


def test_two_committers_and_crashes(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    one, two = (rollups.Store(spark, f"file://{folder}/store") for _ in range(2))
    rows = lambda doc: spark.createDataFrame([("insert", 1, doc, "v", "a", "en", 5)], SCHEMA)
    write = rollups.Store._write

    def meanwhile(store, log, path, changes, compact):
        """While the first run writes its rows, the second commits."""
        write(store, log, path, changes, compact)
        if store is one and log.last == 0:
            assert two.commit(2, rows(2))

    monkeypatch.setattr(rollups.Store, "_write", meanwhile)
    assert one.commit(1, rows(1))  # from the longer log
    assert one.committed() == [1, 2] and totals(one) == [("a", "en", "v", 2, 10)]

    def same_batch(store, log, path, changes, compact):
        write(store, log, path, changes, compact)
        if store is one and 3 not in store.committed():
            assert two.commit(3, rows(3))

    monkeypatch.setattr(rollups.Store, "_write", same_batch)
    assert not one.commit(3, rows(3)) and totals(one) == [("a", "en", "v", 3, 15)]

    def dies(store, log, path, changes, compact):
        write(store, log, path, changes, compact)
        raise RuntimeError

    monkeypatch.setattr(rollups.Store, "_write", dies)
    with pytest.raises(RuntimeError):
        one.commit(4, rows(4))
    monkeypatch.setattr(rollups.Store, "_write", write)
    assert two.committed() == [1, 2, 3] and totals(two) == [("a", "en", "v", 3, 15)]
    assert two.commit(4, rows(4)) and not one.commit(4, rows(4)) and totals(one) == [("a", "en", "v", 4, 20)]
    # What the dead run left is in no entry; it goes once it is old.
    attempts = lambda: {f for f in os.listdir(f"{folder}/store") if f.startswith("attempt-")}
    assert len(attempts()) == 5 and one.vacuum(1) == 0 and one.vacuum(0) == 1 and len(attempts()) == 4
    assert totals(two) == [("a", "en", "v", 4, 20)]


def test_a_paused_writer_never_shows_half_an_entry(spark, monkeypatch):
    """Of runs that pause just before and just after their entry's content is written, one gets the place."""
    folder = tempfile.mkdtemp(prefix="spark-")
    one, two, three = (rollups.Store(spark, f"file://{folder}/store") for _ in range(3))
    rows = lambda doc: spark.createDataFrame([("insert", 1, doc, "v", "a", "en", 5)], SCHEMA)
    created, done = rollups.Store._created, []

    def paused(files, path, text):
        if done:  # the runs meanwhile, and the second try
            return created(files, path, text)
        done.append(True)
        assert two.commit(2, rows(2)) and two.committed() == [2]
        out = created(files, path, text)
        assert three.commit(3, rows(3)) and three.committed() == [2, 3]
        return out

    monkeypatch.setattr(rollups.Store, "_created", staticmethod(paused))
    assert one.commit(1, rows(1))
    assert one.committed() == [1, 2, 3]
    assert totals(two) == [("a", "en", "v", 3, 15)] and sorted(os.listdir(f"{folder}/store/log")) == ["00000001", "00000002", "00000003"]


def test_entering_is_exclusive(spark, monkeypatch):
    """Many threads, one place: a link or a rename that does not overwrite lets one of them in."""
    folder = tempfile.mkdtemp(prefix="spark-")
    store = rollups.Store(spark, f"file://{folder}/store")

    def enter(k):
        return store._enter(1, {"batch": k, "attempt": f"attempt-{k}", "snapshot": 0})

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(enter, range(24)))
    assert sum(won) == 1 and store.committed() == [won.index(True)]
    # The same by the rename that HDFS takes.
    other = rollups.Store(spark, f"file://{folder}/other")

    class Renaming:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def getUri(self):  # noqa: N802
            uri = self.files.getUri()
            return type("Uri", (), {"getScheme": lambda _: "hdfs", "_get_object_id": lambda _: uri._get_object_id(), "_target_id": uri._target_id})()

    monkeypatch.setattr(other, "_files", lambda name="log", files=store._files(): Renaming(files))
    assert other._enter(1, {"batch": 7, "attempt": "attempt-7", "snapshot": 0})
    assert not other._enter(1, {"batch": 8, "attempt": "attempt-8", "snapshot": 0}) and other.committed() == [7]


def test_ranges_of_batches():
    ranges = []
    for b in (5, 3, 4, 9, 1, 4):
        ranges = rollups.with_batch(ranges, b)
    assert ranges == [[1, 1], [3, 5], [9, 9]]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    first = {}
    for r in docs:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    n_docs, n_tokens = Counter(), Counter()
    for r in docs:
        if first[r.text] == r.doc_id:
            n_docs[r.source, r.lang] += 1
            n_tokens[r.source, r.lang] += 1 + len(library.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op6_token_rollups(spark, sf).collect()}
    assert got == {k: (n_docs[k], n_tokens[k]) for k in n_docs}
