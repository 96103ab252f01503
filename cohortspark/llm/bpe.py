"""BPE encoding and decoding by a deterministic automaton compiled from merge gadgets.

Method. The automaton reads tokens: its arcs are labelled by tokens, and its paths are the token sequences that the
tokenizer can produce. It starts with one state and an arc for each symbol (a byte, or a word's last byte). Each merge
(a, b -> ab), in order of rank, is a gadget on the automaton so far: wherever an arc a can be followed by an arc b, an
arc ab is added that leads where the b does, and the arcs a are led to a state of their own that lacks the arc b.
After the last merge exactly one path spells each word, the one that the tokenizer gives. The driver compiles the
whole automaton once (numpy, a bit for each state and class of equal arcs) and sends it to the tasks.

A word is encoded from left to right: a trie over the vocabulary names the tokens that end at each position, and of
these the one whose arc leaves the state at its own first position gives the position its state. The token sequence is
then read backwards from the word's end. All different words of an Arrow batch are walked at once, position by
position; every token comes from an arc. Texts are split by character classes, as the tokenizer's pre-tokenizer does.
Decoding emits the label of each token, joined as the tokenizer file asks (without a decoder: by one space).

Cases. A null or empty text, or one of white space, has no tokens; its decoded text is empty. The strings of special
tokens in a text become their ids, as the tokenizers library does by default. Rows are independent: repeated rows get
equal results, ties do not exist, an empty table gives an empty result. Columns that the operator adds replace such
columns of the table; others pass through. Whole texts are read, a very long text or word as any other; memory
follows the largest text of a batch, the tables are bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.shared import bounded_batches

#: Character classes of the pre-tokenizer.
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)
#: Code points that no text holds (lone surrogates) stand for special tokens while a text is split.
_MARK = 0xD800
#: The word pattern that the splitter implements, and the endings that it keeps apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT_ENDINGS, _LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass
class Automaton:
    """The compiled tables. Symbols are 0 to 255 for a byte within a word and 256 to 511 for a word's last byte."""

    #: For each token, the state behind its arcs (-1 behind a word's end) and the class of its arcs.
    target: np.ndarray
    kind: np.ndarray
    #: A bit for each class (row) and state: whether the state has these arcs.
    arcs: np.ndarray
    #: Number of symbols of each token.
    length: np.ndarray
    #: Trie over the tokens' symbols: children of a node have consecutive numbers from ``first``; ``has`` is a set of
    #: symbols (8 words of 64 bits), ``before`` the number of children in earlier words.
    first: np.ndarray
    has: np.ndarray
    before: np.ndarray
    #: The token that ends at each node, or -1.
    token: np.ndarray

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has the arc of each token."""
        return (self.arcs[self.kind[token], state >> 3] >> (state & 7).astype(np.uint8) & 1).astype(bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words (their bytes one after another, none empty), and the number of tokens of each."""
        n_words = len(offsets) - 1
        sizes = np.diff(offsets)
        if not n_words:
            return np.zeros(0, np.int32), sizes
        symbols = data.astype(np.int16)
        symbols[offsets[1:] - 1] += 256
        # Every token occurrence: the trie is walked from every position of every word, one symbol deeper at a time.
        word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
        at, end = np.arange(len(data), dtype=np.int64), offsets[1:][word]
        node, depth = np.zeros(len(data), np.int32), 0
        begins, tokens, ends = [], [], []
        while len(at):
            symbol = symbols[at + depth]
            part, bit = symbol >> 6, (symbol & 63).astype(np.uint64)
            here = self.has[node, part]
            found = np.flatnonzero(here >> bit & np.uint64(1))
            at, end, node, part = at[found], end[found], node[found], part[found]
            below = here[found] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            node = self.first[node] + self.before[node, part] + np.bitwise_count(below)
            depth += 1
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            begins.append(at[hit])
            tokens.append(token[hit])
            ends.append(at[hit] + depth)
            deeper = np.flatnonzero(at + depth < end)
            at, end, node = at[deeper], end[deeper], node[deeper]
        begin, token, stop = np.concatenate(begins), np.concatenate(tokens), np.concatenate(ends)
        # By the position within its word that an occurrence ends at; a word has a place before each symbol and behind.
        word = word[begin]
        step = stop - offsets[word]
        longest = int(sizes.max())
        order = np.argsort(step.astype(np.uint16) if longest < 1 << 16 else step, kind="stable")
        begin, token, stop, step = begin[order] + word[order], token[order], stop[order] + word[order], step[order]
        bounds = np.searchsorted(step, np.arange(1, longest + 2))
        # The state at each place, -1 where there is none (yet), and the token that led there.
        state = np.full(len(data) + n_words, -1, np.int32)
        state[offsets[:-1] + np.arange(n_words)] = 0
        came = np.full(len(state), -1, np.int32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            from_, with_, to = state[begin[a:b]], token[a:b], stop[a:b]
            led = np.flatnonzero((from_ >= 0) & self.has_arc(from_, with_))
            with_, to = with_[led], to[led]
            state[to], came[to] = self.target[with_], with_
        # Backwards from each word's end.
        starts = offsets[:-1] + np.arange(n_words)
        at, left = offsets[1:] + np.arange(n_words), np.arange(n_words)
        counts, read = np.zeros(n_words, np.int64), []
        while len(left):
            token = came[at]
            if (token < 0).any():
                raise ValueError("no path spells a word: a symbol is not in the vocabulary")
            read.append((left, token))
            counts[left] += 1
            at = at - self.length[token]
            more = np.flatnonzero(at > starts[left])
            left, at = left[more], at[more]
        behind = np.cumsum(counts)
        out = np.empty(int(behind[-1]), np.int32)
        for i, (left, token) in enumerate(read):
            out[behind[left] - 1 - i] = token
        return out, counts


def compile_automaton(symbols: list[list[int]], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of a merge list (left, right, merged token, in order of rank) over tokens with these symbols."""
    made = {c for _, _, c in merges}
    if len(made) < len(merges):
        raise ValueError("supported: merge lists that make each token once")
    known = {t for t, s in enumerate(symbols) if len(s) == 1 and t not in made}
    for a, b, c in merges:
        if a not in known or b not in known:
            raise ValueError("supported: merge lists that make each token before they use it")
        known.add(c)
    last = np.array([s[-1] >= 256 if s else True for s in symbols])
    n_tokens, room = len(symbols), int((~last).sum()) + 1
    # Bits of 64 states a row, tokens side by side: copying a state is one pass over two rows.
    bits = np.zeros((room + 63 >> 6, n_tokens), np.uint64)
    target, shared = np.full(n_tokens, -1, np.int32), [0] * (room + 1)
    for t in known - made:
        bits[0, t] = 1
        target[t] = -1 if last[t] else 0
    shared[0] = 1 + int((target == 0).sum())
    n_states = 1
    for a, b, c in merges:
        p = int(target[a])
        if p < 0 or not int(bits[p >> 6, b]) >> (p & 63) & 1:
            continue  # an arc b never follows an arc a
        bits[:, c] = bits[:, a]
        target[c] = target[b]
        if target[b] >= 0:
            shared[target[b]] += 1
        q = p
        if shared[p] > 1:
            q, n_states = n_states, n_states + 1
            shared[p], shared[q], target[a] = shared[p] - 1, 1, q
            bits[q >> 6] |= (bits[p >> 6] >> np.uint64(p & 63) & np.uint64(1)) << np.uint64(q & 63)
        without = ~(np.uint64(1) << np.uint64(q & 63))
        bits[q >> 6, b] &= without
        if a == b:  # aa is read from the left: no arc aa behind a single a
            bits[q >> 6, c] &= without
    # Tokens whose arcs leave the same states share a row.
    rows = np.ascontiguousarray(bits.T).astype("<u8").view(np.uint8)[:, : n_states + 7 >> 3]
    classes: dict[bytes, int] = {}
    kind = np.array([classes.setdefault(r.tobytes(), len(classes)) for r in rows], np.int32)
    arcs = np.frombuffer(b"".join(classes), np.uint8).reshape(len(classes), rows.shape[1])
    usable = np.array([bool(r.any()) for r in rows])
    length = np.array([len(s) for s in symbols], np.int64)
    return Automaton(target, kind, arcs, length, *_trie([s if u else [] for s, u in zip(symbols, usable, strict=True)]))


def _trie(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, has, before and token of ``Automaton`` for words given by their symbols (empty ones are left out)."""
    level = sorted((s, t) for t, s in enumerate(words) if s)
    groups, depth = [level], 0
    first, has, token, n_nodes = [], [], [], 1
    while groups:  # the nodes of one depth, in order; each with the words below it
        below = []
        for group in groups:
            children: dict[int, list] = {}
            ending = -1
            for s, t in group:
                if len(s) == depth:
                    ending = t
                else:
                    children.setdefault(s[depth], []).append((s, t))
            token.append(ending)
            first.append(n_nodes)
            has.append(list(children))
            n_nodes += len(children)
            below += children.values()
        groups, depth = below, depth + 1
    sets = np.zeros((n_nodes, 8), np.uint64)
    owner = np.repeat(np.arange(n_nodes), [len(h) for h in has])
    symbol = np.array([s for h in has for s in h], np.int64)
    np.bitwise_or.at(sets, (owner, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
    counts = np.bitwise_count(sets).astype(np.int32)
    return np.array(first, np.int32), sets, np.cumsum(counts, axis=1, dtype=np.int32) - counts, np.array(token, np.int32)


def character_classes() -> np.ndarray:
    """The class of each code point; \\s is Unicode's White_Space."""
    classes = np.full(0x110000, _OTHER, np.uint8)
    classes[_MARK:0xE000] = _SPECIAL
    for low, high in ((0, _MARK), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{White_Space}+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(pattern, text):
                classes[low + m.start() : low + m.end()] = kind
    return classes


class Encoder:
    """A tokenizer file, read without the tokenizers library; what it cannot read it refuses."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("supported: byte-level BPE without unknown token, byte fallback or decoder")
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("supported: normalizers NFC, Replace of white space, Lowercase")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["behavior"] != "Removed" or not split["invert"] or split["pattern"].get("Regex") != WORD_PATTERN:
            raise ValueError("supported: a pre-tokenizer whose matches of the word pattern are the words")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        labels = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # Each token's text and a space behind it.
        self.labels = pa.array([(labels.get(i, "") + " ").encode() for i in range(max(labels) + 1)], pa.large_binary())
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        number = {c: b for b, c in enumerate(byte_letters())}
        symbols: list[list[int]] = [[] for _ in range(max(labels) + 1)]
        for text, i in vocab.items():
            ends = bool(suffix) and text.endswith(suffix)
            read = [number[c] for c in (text[: -len(suffix)] if ends else text)]
            symbols[i] = read[:-1] + [read[-1] + 256 * ends]
        self.automaton = compile_automaton(symbols, merges)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = np.array([*self.specials.values()], np.int32)
        self.classes = character_classes()

    def _plain(self, text: str | None) -> str:
        """A text as the normalizers leave it, with a mark for each special token."""
        if not text:
            return ""
        if any(s in text for s in self.specials):
            longest = sorted(self.specials, key=len, reverse=True)
            parts = regex.split("(" + "|".join(map(regex.escape, longest)) + ")", text)
            marks = {s: chr(_MARK + i) for i, s in enumerate(self.specials)}
            return "".join([marks[p] if p in marks else self._plain(p) for p in parts])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased one letter at a time
        return text.lower()

    def words(self, texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The words of all texts, the special token of each word (or -1), and how many words lie before each text."""
        plain = [self._plain(t) for t in texts]
        joined = "\n".join([*plain, "", ""])  # white space keeps texts apart and stands behind the last
        chars = np.frombuffer(
            joined.encode("ascii") if joined.isascii() else joined.encode("utf-32-le", "surrogatepass"),
            np.uint8 if joined.isascii() else np.uint32,
        )
        kinds = self.classes[chars]
        start = np.empty(len(chars), bool)
        start[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        start |= (kinds == _NUMBER) | (kinds == _SPECIAL)
        start &= kinds != _SPACE
        # An apostrophe that starts a run of other characters takes the letters of an ending along.
        quote = np.flatnonzero((chars[:-2] == ord("'")) & start[:-2])
        one, two = chars[quote + 1], chars[quote + 2]
        size = np.where(np.isin(one, [ord(c) for c in _SHORT_ENDINGS]), 2, 0)
        for a, b in _LONG_ENDINGS:
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] = kinds[quote + size] != _SPACE
        keep = kinds != _SPACE
        ends = np.cumsum(np.array([len(p) + 1 for p in plain], np.int64))
        before = np.zeros(len(plain) + 1, np.int64)
        before[1:] = np.searchsorted(np.flatnonzero(start), ends)
        first = chars[start].astype(np.int64) - _MARK
        special = np.where((first >= 0) & (first < len(self.specials)), first, -1)
        chars, begins = chars[keep], np.flatnonzero(start[keep])
        if chars.dtype == np.uint8:
            data, offsets = chars.tobytes(), np.append(begins, len(chars))
        else:
            data = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
            behind = np.zeros(len(chars) + 1, np.int64)
            np.cumsum(width, out=behind[1:])
            offsets = behind[np.append(begins, len(chars))]
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers)
        return words.dictionary_encode(), special, before

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the different words, the number of each, the word at each place, and places before each text."""
        words, special, before = self.words(texts)
        distinct = words.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        place = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not (special >= 0).any():
            return *self.automaton.encode(data, offsets), place, before
        # Marks of special tokens are no words; their ids are appended.
        marked = np.unique(place[special >= 0])
        real = np.ones(len(distinct), bool)
        real[marked] = False
        sizes = np.diff(offsets)
        kept, counts = self.automaton.encode(data[np.repeat(real, sizes)], np.append(0, np.cumsum(sizes[real])))
        number = np.cumsum(real) - 1
        place = np.where(special >= 0, len(counts) + special, number[place])
        return np.append(kept, self.special_ids), np.append(counts, np.ones(len(self.special_ids), np.int64)), place, before

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        _, counts, place, before = self.tokens(texts)
        upto = np.append(0, np.cumsum(counts[place]))
        return np.diff(upto[before])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, text after text, and the offsets of the texts."""
        tokens, counts, place, before = self.tokens(texts)
        begins = np.append(0, np.cumsum(counts))[:-1]
        sizes = counts[place]
        upto = np.append(0, np.cumsum(sizes))
        source = np.repeat(begins[place] - upto[:-1], sizes) + np.arange(upto[-1])
        return tokens[source].astype("<u4"), upto[before]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids: the label of each, joined by a space."""
        taken = self.labels.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data, at = memoryview(taken.buffers()[2] or b""), at[offsets]
        return pa.array([str(data[a : max(a, b - 1)], "utf-8") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


_ENCODERS: dict[str, Encoder] = {}


def tokenizer_file(path: str | None = None) -> bytes:
    """The tokenizer's file (a few MB), read by the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str | None = None) -> Encoder:
    """The compiled tokenizer (some 40 MB for 49,000 tokens); the driver compiles each file once."""
    file = tokenizer_file(path)
    name = hashlib.sha256(file).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(file)
    return _ENCODERS[name]


def encoded(spark: SparkSession, text: Column, path: str | None = None, decode: bool = True) -> Column:
    """A struct of each text: ids (binary, little-endian unsigned 32-bit integers) and, if asked for, decoded (from the ids)."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(encoder(path))

    @F.arrow_udf("ids binary, decoded string" if decode else "ids binary")
    def encode(texts: pa.Array) -> pa.Array:
        ids, offsets = sent.value.encode(texts.to_pylist())
        buffers = [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.tobytes())]
        columns = [pa.Array.from_buffers(pa.binary(), len(texts), buffers)]
        if decode:
            columns.append(sent.value.decode(ids, offsets))
        return pa.StructArray.from_arrays(columns, ["ids", "decoded"][: len(columns)])

    return encode(text)


def counted(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Number of tokens of each text (null: 0)."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(encoder(path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.count(texts.to_pylist()), pa.int64())

    return count(text)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, decode: bool = True) -> DataFrame:
    """``docs`` with ids (packed), n_tokens and, if asked for, the decoded text; such columns are replaced."""
    made = {"ids", "n_tokens", "decoded"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    df = docs.select(*kept, encoded(docs.sparkSession, F.col(text), path, decode).alias("ids"))
    columns = [F.col(f"`{c}`") for c in df.columns if c != "ids"]
    n_tokens = (F.octet_length("ids.ids") / 4).cast("long").alias("n_tokens")
    return df.select(*columns, F.col("ids.ids"), n_tokens, *([F.col("ids.decoded")] if decode else []))


def decoded(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """The text of packed ids: each token's label, joined by a space (null: empty)."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(encoder(path))

    @F.arrow_udf("string")
    def decode(packed: pa.Array) -> pa.Array:
        rows = [p or b"" for p in packed.to_pylist()]
        return sent.value.decode(np.frombuffer(b"".join(rows), "<u4"), np.cumsum([0, *[len(p) // 4 for p in rows]]))

    return decode(ids)
