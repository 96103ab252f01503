"""Alignment of two tokenizers' ids over the same text.

Method. A document is encoded whole by both tokenizers. Where a token of each ends at the same byte and the next token of
each begins with a space, both sequences are cut: such an anchor is verified from the running byte lengths, and parts
the document into windows, mostly of one word. What a window's alignment is depends on its token ids alone, so it is
worked out once for each tuple of ids and looked up afterwards. Within a window the tokens are grouped between ends
that both sides share; every token of a group's one side is linked with every token of its other side.

A link's count is the number of documents that hold its pair of ids. Each document hands in its distinct pairs, tasks
add them up before they are shuffled, and the counts come back to the documents: the most frequent pairs, up to a fixed
number, as a broadcast table, the others by a join in which no key has more rows than those pairs are rare.

Cases. A null or empty text has no tokens, nor has one that either tokenizer does not give back byte for byte
(normalised characters, the space mark itself in the text); its numbers are 0 and its groups empty. Rows are
independent: repeated rows get equal results and count as documents of their own; ties for the highest count of an id
are all highest. A null doc_id stays null. An empty table gives an empty result. Extra columns are not read, whatever
their names. Texts are read whole; memory follows the longest text of a batch, the memo starts anew at a fixed size.

Scale. Texts are read once; what is kept of a document is its distinct pairs (delta coded), which a second and a third
pass read. The vocabularies bound the pairs, and with them the shuffle's output.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm.bpe import byte_letters
from cohortspark.llm.shared import bounded_batches, sent, staged

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Windows and pairs that a worker remembers before it starts anew.
MEMO_WINDOWS, MEMO_PAIRS = 500_000, 8_000_000
#: Pairs whose counts are broadcast (17 bytes each), and pairs that a task adds up before it hands them on.
BROADCAST_PAIRS, HELD_PAIRS = 3_000_000, 2_000_000
#: Fixed value: how the byte-level vocabulary splits texts into words.
BYTE_LEVEL_PATTERN = public_tokenizers.PATTERN
#: Groups of more links count theirs by pairs of ids instead of listing them.
_HEAVY = 256
#: On longer white space the fast encoder's pattern runs out of stack; such texts take the library that reads the file.
_LONG = 2000
_LONG_SPACE = re.compile(rf"\s{{{_LONG}}}")
#: What stands for the ids of a text that has none.
_BAD = (b"", b"")
#: A space between two characters that are no white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, codes binary, times binary"


def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder and the bytes of each id of a byte-level BPE file whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    of = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {bytes(of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    made = [ranks[bytes(of[c] for c in a + b)] for a, b in merges]
    if made != sorted(made) or min(made, default=256) < 256:
        raise ValueError("supported: files whose ids follow the order of their merges")
    tokens = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, i in ranks.items():
        tokens[i] = token
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens


def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The processor and the bytes of each id of a piece model."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]


@dataclass
class Aligned:
    """What a document's alignment comes to."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    codes: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers and the memo of a worker."""

    def __init__(self, a_path: str = A_PATH, b_path: str = B_PATH, windows: int = MEMO_WINDOWS) -> None:
        (self.coder_a, self.bytes_a), (self.coder_b, self.bytes_b) = byte_level(a_path), pieces(b_path)
        self.size_a, self.size_b = [len(t) for t in self.bytes_a], [len(t) for t in self.bytes_b]
        self.sizes_a, self.sizes_b = np.array(self.size_a), np.array(self.size_b)
        self.marked_a, self.marked_b = (np.array([t.startswith(b" ") for t in side]) for side in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(i) for i in range(len(side))] for side in (self.bytes_a, self.bytes_b))
        self.a_path, self.most = a_path, windows
        self.by_words = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.codes: list[bytes] = []
        self.heavy: dict[int, Counter] = {}
        self.held = 0

    def _coded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both tokenizers (4 bytes each) of each text; none where one of them does not give the text back."""
        out, bytes_a, bytes_b = [], self.bytes_a, self.bytes_b
        for text, b in zip(texts, self.coder_b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            if len(text) >= _LONG and _LONG_SPACE.search(text):
                a = _library(self.a_path).encode(spaced, add_special_tokens=False).ids
            else:
                a = self.coder_a.encode_ordinary(spaced)
            data = spaced.encode()
            same = b"".join([bytes_b[i] for i in b]) == data and b"".join([bytes_a[i] for i in a]) == data
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if same else _BAD)
        return out

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers for a whole text; None where one of them does not give the text back.

        No token of either side reaches over a lone space into the next word, so that a text's ids are those of its
        words, one after another; the ids of words met before are remembered. Other models encode the text in one.
        """
        if not text:
            return None
        if not self.by_words:
            both = self._coded([text])[0]
            return None if both == _BAD else tuple(np.frombuffer(ids, np.int32) for ids in both)
        known = self.words
        words = text.split(" ")
        found = list(map(known.get, words))
        if None in found:
            new = [w for w in dict.fromkeys(words) if w not in known]
            if all(w and not w[0].isspace() and not w[-1].isspace() for w in new):
                known.update(zip(new, self._coded_words(new), strict=True))
            else:  # not every space stands alone
                words = _LONE_SPACE.split(text)
                new = [w for w in dict.fromkeys(words) if w not in known]
                # What begins or ends with white space stays out of the memo: every space of a text may part it.
                extra = dict(zip(new, self._coded(new), strict=True))
                known.update({w: ids for w, ids in extra.items() if " " not in w and w.strip() == w})
                found = [extra[w] if w in extra else known[w] for w in words]
            if None in found:
                found = [known[w] for w in words]
        if _BAD in found:
            return None
        of_a, of_b = zip(*found, strict=True)
        return np.frombuffer(b"".join(of_a), np.int32), np.frombuffer(b"".join(of_b), np.int32)

    def _coded_words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """``_coded`` of words without spaces, in one text: each begins with its only token that begins with a space."""
        text = " ".join(words)
        if len(text) < _LONG or not _LONG_SPACE.search(text):
            a, b = self.coder_a.encode_ordinary(" " + text), self.coder_b.encode(text)
            data = (" " + text).encode()
            if b"".join([self.bytes_b[i] for i in b]) == data == b"".join([self.bytes_a[i] for i in a]):
                out = []
                for ids, marked in ((np.array(a, np.int32), self.marked_a), (np.array(b, np.int32), self.marked_b)):
                    starts, of = (4 * np.flatnonzero(marked[ids])).tolist(), ids.tobytes()
                    out.append([of[i:j] for i, j in zip(starts, [*starts[1:], len(of)], strict=True)])
                if len(out[0]) == len(out[1]) == len(words):
                    return list(zip(*out, strict=True))
        return self._coded(words)

    def _learn(self, key: tuple[bytes, bytes]) -> int:
        """Group the tokens of a window that is not in the memo between ends that both sides share; its place there."""
        size_a, size_b, names_a, names_b, width = self.size_a, self.size_b, self.names_a, self.names_b, len(self.size_b)
        a, b = (memoryview(ids).cast("i").tolist() for ids in key)
        parts, codes, heavy = [], [], Counter()
        i = j = i0 = j0 = 0
        end_a, end_b = size_a[a[0]], size_b[b[0]]
        while True:
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += size_b[b[j]]
            else:
                if i == i0 and j == j0:
                    parts.append(names_a[a[i]] + "|" + names_b[b[j]])
                    codes.append(a[i] * width + b[j])
                else:
                    group_a, group_b = a[i0 : i + 1], b[j0 : j + 1]
                    parts.append(",".join([names_a[x] for x in group_a]) + "|" + ",".join([names_b[y] for y in group_b]))
                    if len(group_a) * len(group_b) <= _HEAVY:
                        codes += [x * width + y for x in group_a for y in group_b]
                    else:
                        of_b = Counter(group_b).items()
                        for x, n in Counter(group_a).items():
                            for y, m in of_b:
                                heavy[x * width + y] += n * m
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                i0, j0 = i, j
                end_a += size_a[a[i]]
                end_b += size_b[b[j]]
        at = self.memo[key] = len(self.texts)
        self.texts.append(";".join(parts))
        self.codes.append(array("q", codes).tobytes())
        self.held += len(codes) + len(heavy)
        if heavy:
            self.heavy[at] = heavy
        return at

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places in the memo of a document's windows, in order."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        before_a, before_b = np.flatnonzero(self.marked_a[a[1:]]), np.flatnonzero(self.marked_b[b[1:]])
        at_a, at_b = ends_a[before_a], ends_b[before_b]
        # An anchor of one side is verified where the other side has one at the same byte.
        place = np.searchsorted(at_b, at_a)
        both = np.append(at_b, -1)[place] == at_a
        cuts_a, cuts_b = ((4 * before[where] + 4).tolist() for before, where in ((before_a, both), (before_b, place[both])))
        of_a, of_b = a.tobytes(), b.tobytes()
        out, known, i, p = [], self.memo.get, 0, 0
        for j, q in zip([*cuts_a, len(of_a)], [*cuts_b, len(of_b)], strict=True):
            key = of_a[i:j], of_b[p:q]
            at = known(key)
            out.append(self._learn(key) if at is None else at)
            i, p = j, q
        return out

    def align(self, text: str | None) -> Aligned:
        """A document's numbers, its groups as text, and its distinct pairs (codes, rising) with their links."""
        both = self.tokens(text or "")
        if both is None:
            return Aligned(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if max(len(self.texts), len(self.words)) > self.most or self.held > MEMO_PAIRS:
            self._forget()
        found = self.windows(*both)
        groups = ";".join([self.texts[k] for k in found])
        codes, times = np.unique(np.frombuffer(b"".join([self.codes[k] for k in found]), np.int64), return_counts=True)
        if self.heavy:
            more = Counter(dict(zip(codes.tolist(), times.tolist(), strict=True)))
            for k in found:
                more.update(self.heavy.get(k, {}))
            codes = np.array(sorted(more), np.int64)
            times = np.array([more[c] for c in codes.tolist()], np.int64)
        return Aligned(len(both[0]), len(both[1]), groups.count(";") + 1, int(times.sum()), groups, codes, times)


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return coder


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker."""
    return Aligner(a_path, b_path)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in 4 bytes each where they fit, else in 8; the first byte says which."""
    small = values.max(initial=0) < 2**32
    return (b"\4" if small else b"\10") + values.astype("<u4" if small else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u8", offset=1).astype(np.int64)


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (``a1,a2|b1;...``; null unless kept) and pairs.

    docs: doc_id, text. Pairs are ``codes`` (id of A times the size of B's vocabulary plus id of B) and ``times``.
    """
    bounded_batches(docs.sparkSession)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                r = aligner.align(text)
                sha = hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
                rows.append((r.n_a, r.n_b, r.n_groups, r.n_links, sha, r.groups if keep_groups else None, _packed(np.diff(r.codes, prepend=0)), _packed(r.times)))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "codes", "times"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(align, _ALIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def pair_counts(documents: DataFrame, width: int, held: int = HELD_PAIRS) -> DataFrame:
    """code, n (documents that hold the pair) and best (no pair of the same id of A stands in more), written.

    documents: ``aligned``, written; width: size of B's vocabulary. Tasks add up before the shuffle.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = [np.cumsum(_unpacked(c)) for c in batch["codes"]]
            if not new:
                continue
            more, times = np.unique(np.concatenate(new), return_counts=True)
            codes, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(codes)).astype(np.int64)
            if len(codes) > held:
                yield pd.DataFrame({"code": codes, "n": n})
                codes, n = codes[:0], n[:0]
        yield pd.DataFrame({"code": codes, "n": n})

    counts = documents.select("codes").mapInPandas(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("a", F.floor(F.col("code") / width)))
    most = staged(counts.groupBy("a").agg(F.max("n").alias("most")))  # no more rows than A's vocabulary
    return staged(counts.join(sent(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def with_counts(documents: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``documents`` (``aligned``, written, with a number ``row`` of their own) with n_best and count_sum.

    The ``most`` most frequent pairs at most are broadcast. Other pairs, where there are any, are joined.
    """
    spark, cut = documents.sparkSession, 1
    if counts.count() > most:
        steps = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).orderBy(F.desc("k")).collect()
        room = most
        for r in steps:  # powers of two, some sixty at most
            room -= r["pairs"]
            if room < 0:
                cut = 2 ** (int(r["k"]) + 1)
                break
    table = counts.where(F.col("n") >= cut).toArrow()
    codes, n, best = (table[c].to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(codes)
    hot = spark.sparkContext.broadcast((np.append(codes[order], -1), np.append(n[order], 0), np.append(best[order], False)))

    def known(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """For each pair of a batch: its document's place, code, links, place in the table, and whether it is there."""
        each = [np.cumsum(_unpacked(c)) for c in batch["codes"]]
        of, code = np.repeat(np.arange(len(each)), [len(c) for c in each]), np.concatenate([np.zeros(0, np.int64), *each])
        times = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, batch["times"])])
        at = np.searchsorted(hot.value[0][:-1], code)
        return of, code, times, at, hot.value[0][at] == code

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of, _, times, at, there = known(batch)
            of, times, at = of[there], times[there], at[there]
            n_best, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(n_best, of, times * hot.value[2][at])
            np.add.at(count_sum, of, times * hot.value[1][at])
            yield batch.drop(columns=["codes", "times"]).assign(n_best=n_best, count_sum=count_sum)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of, code, times, _, there = known(batch)
            yield pd.DataFrame({"row": batch["row"].to_numpy()[of[~there]], "code": code[~there], "times": times[~there]})

    kept = [f for f in documents.schema.fields if f.name not in ("codes", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    out = documents.mapInPandas(summed, schema)
    if cut == 1:
        return out
    links = documents.select("row", "codes", "times").mapInPandas(rare, "row long, code long, times long")
    joined = links.join(counts.where(F.col("n") < cut).hint("merge"), "code")
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    both = staged(out).join(staged(more).hint("merge"), "row", "left")
    return both.withColumns(
        {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    ).drop("more_best", "more_sum")


def align_documents(
    docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, keep_groups: bool = True, most: int = BROADCAST_PAIRS
) -> DataFrame:
    """``aligned`` with each document's n_best (links whose pair is its A id's most frequent) and count_sum."""
    documents = aligned(docs, a_path, b_path, keep_groups).withColumn("row", F.monotonically_increasing_id())
    documents = staged(documents)
    counts = pair_counts(documents, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    return with_counts(documents, counts, most).drop("row")
