"""Alignment against a brute-force version on byte spans, with other libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortspark.llm import alignment
from cohortspark.llm.bpe import byte_letters
from cohortspark.llm.queries import op13_anchor_alignment

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(ids, size):
    at, out = 0, []
    for i in ids:
        out.append((at, at + size(i), i))
        at += size(i)
    return out


def brute_groups(text, coders):
    """Groups of ids by cutting at every offset where a token of each ends; None without tokens."""
    a, b = coders
    of = {letter: byte for byte, letter in enumerate(byte_letters())}
    bytes_a = lambda i: bytes(of[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(map(bytes_a, ids_a)) == b"".join(map(bytes_b, ids_b)) == (" " + text).encode():
        return None
    spans_a, spans_b = spans(ids_a, lambda i: len(bytes_a(i))), spans(ids_b, lambda i: len(bytes_b(i)))
    cuts = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
    groups, low, x, y = [], 0, 0, 0
    for cut in cuts:
        one, two = [], []
        while x < len(spans_a) and spans_a[x][1] <= cut:
            one.append(spans_a[x][2])
            x += 1
        while y < len(spans_b) and spans_b[y][1] <= cut:
            two.append(spans_b[y][2])
            y += 1
        groups.append((one, two))
        low = cut
    assert low == len((" " + text).encode())
    return groups


def brute(rows, coders):
    every = [(i, brute_groups(t, coders)) for i, t in rows]
    count = Counter()
    for _, groups in every:
        count.update({(x, y) for one, two in groups or [] for x in one for y in two})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in every:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for one, two in groups for x in one for y in two]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        n_best, total = sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), n_best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()], key=str)


CASES = [
    "", None, " ", "  two  spaces ", "a", "a b", "tab\tand\n\nlines \n x", "x▁y", "<|endoftext|> and <s> </s>", "ﬁ ①   　 z", "\U0001f600\U0001f600 été",
    "1234567 12 3", "!!!!!!!!!!!!!!!!!!!!!! ????", "don't I'LL we're", "a" * 3000, "the same", "the same", "\x00\x01", "\x1c x \x85 y",
]


def test_cases(spark, coders):
    rows = list(enumerate(CASES)) + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", codes string")
    got = alignment.align_documents(docs)
    assert result(got) == brute(rows, coders)
    first = got.where("doc_id = 5").first()
    assert first.groups.count(";") + 1 == first.n_groups == 2
    empty = alignment.align_documents(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and "n_best" in empty.columns


def test_rare_pairs_are_joined(spark, coders):
    """The same results whatever part of the counts is broadcast."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs, want = spark.createDataFrame(rows, SCHEMA), brute(rows, coders)
    for most in (0, 40, 10**6):
        assert result(alignment.align_documents(docs, most=most)) == want


def test_query(spark, coders):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op13_anchor_alignment(spark, sf)) == brute(rows, coders)


def test_memo_and_long_texts(coders):
    """A memo that starts anew all the time, and texts of a million characters."""
    small, large = alignment.Aligner(windows=2), alignment.Aligner()
    for text in ["one two three one", "two three four \n five", "one two"]:
        x, y = small.align(text), large.align(text)
        assert x.groups == y.groups and x.codes.tolist() == y.codes.tolist() and x.times.tolist() == y.times.tolist()
        assert x.n_groups == len(brute_groups(text, coders))
    for text in (" " * 1_000_000 + "x", "word " * 200_000, "!" * 500_000):
        r = large.align(text)
        groups = [(len(a.split(",")), len(b.split(","))) for a, b in (g.split("|") for g in r.groups.split(";"))]
        assert r.n_links == sum(a * b for a, b in groups) == r.times.sum() and r.n_a == sum(a for a, _ in groups)
