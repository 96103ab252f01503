"""BPE by automaton against the tokenizers library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import bpe
from cohortspark.llm.queries import op4_bpe_automaton
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    yield from ["", "  ", "ΣΊΣΥΦΟΣ Σ", "İstanbul I'LL don't", "a<|endoftext|>b <|startoftext|>", "aaaaaaaaaaaa", "été ​ \x1c", "日本語 👩‍👩‍👧", "x" * 3000]
    for size in range(400):
        yield "".join(rng.choice("abcdeinorst'12 ,.é\n") for _ in range(size % 60))


def test_same_ids_and_text(library):
    encoder = bpe.encoder(PATH)
    rows = [None, *texts()]
    ids, offsets = encoder.encode(rows)
    decoded, counts = encoder.decode(ids, offsets).to_pylist(), encoder.count(rows)
    for i, text in enumerate(rows):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want and counts[i] == len(want)
        assert decoded[i] == library.decode(want, skip_special_tokens=False)
    assert [len(x) for x in encoder.encode([])] == [0, 1] and encoder.decode(*encoder.encode([])).to_pylist() == []


def merged(word, merges):
    """Merges applied one after the other, from the left."""
    for a, b, c in merges:
        out = []
        for token in word:
            out.append(token)
            if len(out) > 1 and tuple(out[-2:]) == (a, b):
                out[-2:] = [c]
        word = out
    return word


def test_paths_of_the_automaton():
    """On random merge lists: the automaton's path is what the merges give, and no other sequence is a path."""
    rng = random.Random(5)
    for _ in range(60):
        symbols, merges = [[97], [98], [99], [97 + 256], [98 + 256], [99 + 256]], []
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.randrange(len(symbols)), rng.randrange(len(symbols))
            if symbols[a][-1] < 256 and (a, b) not in [m[:2] for m in merges] and symbols[a] + symbols[b] not in symbols:
                merges.append((a, b, len(symbols)))
                symbols.append(symbols[a] + symbols[b])
        automaton = bpe.compile_automaton(symbols, merges)
        words = [[rng.choice([97, 98, 99]) for _ in range(rng.randrange(1, 14))] for _ in range(80)]
        data, offsets = np.concatenate(words).astype(np.uint8), np.cumsum([0, *map(len, words)])
        tokens, counts = automaton.encode(data, offsets)
        for word, got in zip(words, np.split(tokens, np.cumsum(counts)[:-1]), strict=True):
            start = [word_byte - 97 for word_byte in word[:-1]] + [word[-1] - 97 + 3]
            assert got.tolist() == merged(start, merges)
            state = np.zeros(1, np.int32)
            for token in got:
                assert automaton.has_arc(state, np.array([token])).all()
                state = automaton.target[[token]]
    with pytest.raises(ValueError):
        bpe.compile_automaton([[97], [98], [97, 98]], [(0, 2, 1)])


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in op4_bpe_automaton(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "the end", "y"), (1, None, "x")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(docs).withColumn("again", bpe.decoded(spark, F.col("ids"))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded == r.again) for r in rows) == [(0, 2, True), (1, 0, True), (1, 0, True)]
    assert bpe.encode_documents(docs.limit(0)).collect() == []
