"""Secret scans: pattern matches, and encoded keys and signed tokens confirmed by their structure.

Base kinds are plain patterns: ``assign`` (a name like password, then a value), ``access`` (access key ids) and
``hex`` (long hexadecimal runs). The method adds ``key`` and ``token``: candidates in base64 or hex are decoded, and
reported only if they parse. A key is a private key in DER (PKCS#1, PKCS#8 plain or encrypted, SEC1) whose nested
lengths fill the bytes exactly, or an OpenSSH private key whose length-prefixed fields do; PEM armour around it
belongs to the span, and armour of an encrypted key is confirmed by its headers and whole blocks. Keys may go on over lines,
their line ends real or written out as in JSON. A token has a header and a payload that decode to JSON objects, the header naming its algorithm.

Spans are code points of the whole text, end exclusive, in order of start, then kind as listed above.

Cases. A null or empty text has no spans. Rows are independent: repeated rows get equal results, ties within a text
are ordered by kind, an empty table gives an empty result. Very long texts are read whole, one at a time; places that only
look like the head of a key cost a few decoded lengths each, so that the time grows with the text's length alone.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.shared import bounded_batches, fresh

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "token")
MASK = "[SECRET]"

# Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS = 12, 18
#: A candidate in base64 or hex has at least so many characters: the smallest key confirmed has 25 bytes (SEC1, 16 of them secret).
MIN_ENCODED = 34

ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.DOTALL)
HEADER = re.compile(r"^[ \t]*([A-Za-z][A-Za-z0-9-]*):(.*)$", re.MULTILINE)
#: The first line of a key that goes on in the next ones: a DER sequence or the OpenSSH mark, in base64 or hex.
FIRST = re.compile(r"(?<![A-Za-z0-9+/_-])(?=M[A-P]|b3BlbnNz|30)[A-Za-z0-9+/_-]{16,}(?=[ \t]*[\r\n])")
NEXT = re.compile(r"[ \t]*[\r\n][ \t\r\n]*([A-Za-z0-9+/_-]+)(={0,2})")
ENCODED = re.compile(rf"([A-Za-z0-9+/_-]{{{MIN_ENCODED},}})={{0,2}}")
#: Where a key may begin within a run of characters of base64, as behind a path: like FIRST, after a sign that is no letter or digit.
INNER = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|30|(b3BlbnNzaC1rZXktdjEA))")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.(ey[A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def _decode64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: The standards' keys have no more elements than these: PKCS#1 with further primes ten, an algorithm two.
MOST_PARTS, MOST_ALGORITHM = 10, 2


def _reader(text: str, start: int, stop: int) -> Callable[[int, int], bytes]:
    """Bytes a to b of what text[start:stop] encodes in base64 or, beginning with 30, in hex; only what is asked for is decoded."""
    digits = text.startswith("30", start)

    def read(a: int, b: int) -> bytes:
        if digits:
            piece = text[start + 2 * a : min(start + 2 * b, stop)]
            return bytes.fromhex(piece) if re.fullmatch("(?:[0-9A-Fa-f]{2})*", piece) else b""
        piece = text[start + a // 3 * 4 : min(start + (b + 2) // 3 * 4, stop)]
        return (_decode64(piece[: len(piece) - (len(piece) % 4 == 1)]) or b"")[a % 3 : a % 3 + b - a]

    return read


def _element(read: Callable[[int, int], bytes], at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at ``at``; None if it does not lie within ``end``."""
    head = read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    tag, size, n = head[0], head[1], 0
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size = int.from_bytes(head[2 : 2 + n], "big")
        if size < 0x80:
            return None  # DER asks for the short form
    begin = at + 2 + n
    return (tag, begin, begin + size) if begin + size <= end else None


def _elements(read: Callable[[int, int], bytes], at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the bytes from ``at`` to ``end`` exactly; None if lengths do not nest or there are more than ``most``."""
    found = []
    while at < end:
        one = _element(read, at, end) if len(found) < most else None
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def _is_der(read: Callable[[int, int], bytes], size: int) -> bool:
    """Whether ``size`` bytes are one private key in DER, from the heads of its elements."""
    outer = _element(read, 0, size)
    if outer is None or outer[0] != 0x30 or outer[2] != size:
        return False
    parts = _elements(read, outer[1], size, MOST_PARTS)
    if not parts or len(parts) < 2:
        return False
    tags, sizes = [t for t, _, _ in parts], [e - b for _, b, e in parts]

    def algorithm(i: int) -> bool:
        inner = _elements(read, parts[i][1], parts[i][2], MOST_ALGORITHM)
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] >= 3

    if tags[0] == 0x02 and sizes[0] == 1 and (version := read(parts[0][1], parts[0][2])) in (b"\0", b"\1"):
        if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]) and all(sizes[:9]):
            return True  # PKCS#1
        if tags[1:3] == [0x30, 0x04]:
            return algorithm(1) and sizes[2] >= 16  # PKCS#8
        if tags[1] == 0x04 and version == b"\1":
            return 16 <= sizes[1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]) and len(parts) > 2  # SEC1
    return tags == [0x30, 0x04] and algorithm(0) and sizes[1] >= 32  # encrypted PKCS#8


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one private key in DER."""
    return _is_der(lambda a, b: data[a:b], len(data))


def _openssh_end(read: Callable[[int, int], bytes], size: int) -> int | None:
    """Where the fields of an OpenSSH private key end by their lengths; None if it is none or they go beyond ``size``."""
    magic, at = b"openssh-key-v1\0", 15
    if read(0, 15) != magic:
        return None
    for part in range(20):  # cipher, derivation, its options; public keys and the private part follow their number
        head = read(at, at + 4)
        if len(head) < 4:
            return None
        at += 4 + int.from_bytes(head, "big")
        if at > size:
            return None
        if part == 2:
            keys = int.from_bytes(read(at, at + 4), "big")
            if not 1 <= keys <= 16:
                return None
            at, last = at + 4, 3 + keys
        if part > 2 and part == last:
            return at
    return None


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key with consistent field lengths."""
    return _openssh_end(lambda a, b: data[a:b], len(data)) == len(data)


def _der_end(data: bytes) -> int | None:
    """Where a DER sequence that starts with an integer or a sequence ends by its own length."""
    n = data[1] & 0x7F if len(data) > 1 and data[1] >= 0x80 else 0
    if data[:1] != b"\x30" or n > 4 or data[2 + n : 3 + n] not in (b"\x02", b"\x30"):
        return None
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


class Lines:
    """Lines of base64 or hex that follow one another, joined: where each begins and where its text ends."""

    def __init__(self, text: str, first: re.Match) -> None:
        parts, at = [first[0]], first.end()
        have = len(first[0])
        self.begins, self.ends = {first.start(): 0}, {have: at}
        while m := NEXT.match(text, at):
            self.begins[m.start(1)] = have
            parts.append(m[1])
            have, at = have + len(m[1]), m.end()
            self.ends[have] = at
            if m[2]:
                break
        self.joined = "".join(parts)

    def key_end(self, first: re.Match) -> int | None:
        """The end in the text of a key that begins with the line ``first`` and goes on; the key's own lengths say where."""
        at = self.begins[first.start()]
        size = _key_size(self.joined, at, len(self.joined))
        if not size or size <= len(first[0]) or at + size not in self.ends:
            return None
        return self.ends[at + size] if is_key(self.joined[at : at + size]) else None


def is_encrypted(headers: dict[str, str], text: str) -> bool:
    """Whether old armour names a cipher and its start block, and whole blocks follow."""
    start = re.fullmatch(r"[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})", headers.get("dek-info", ""))
    data = _decode64(text) if start and "ENCRYPTED" in headers.get("proc-type", "") else None
    return bool(data) and len(data) >= 32 and len(data) % (len(start[1]) // 2) == 0


def _json_object(text: str) -> dict | None:
    data = _decode64(text)
    try:
        found = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    return head["alg"].lower() == "none" or bool(signature and _decode64(signature))


def is_key(text: str) -> bool:
    data = _decode64(text)
    if data and (is_der_key(data) or is_openssh_key(data)):
        return True
    if len(text) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", text):
        return is_der_key(bytes.fromhex(text))
    return False


def _key_size(text: str, start: int, stop: int) -> int | None:
    """Characters, without padding, of a key that begins at ``start`` and whose lengths nest before ``stop``; else None.

    Only lengths are decoded, a few dozen at most, so that a place costs the same however long a key it claims.
    """
    head = _reader(text, start, stop)(0, 8)
    if text.startswith("b3BlbnNz", start):
        end = _openssh_end(_reader(text, start, stop), (stop - start) * 3 // 4)
        return None if end is None else (4 * end + 2) // 3
    end = _der_end(head)
    if end is None:
        return None
    size = 2 * end if text.startswith("30", start) else (4 * end + 2) // 3
    return size if start + size <= stop and _is_der(_reader(text, start, start + size), end) else None


def inner_keys(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Keys within text[start:end], a run of characters of base64 that as a whole is none; their own lengths say where they end."""
    found, at = [], start
    for m in INNER.finditer(text, start, end):
        size = _key_size(text, m.start(), end) if m.start() >= at else None
        stop = m.start() + (size or 0)
        whole = stop == end or (stop < end and not text[stop].isalnum())
        if size and whole and is_key(text[m.start() : stop]):
            while stop < len(text) and text[stop] == "=" and stop - m.start() - size < -size % 4:
                stop += 1
            found.append((m.start(), stop))
            at = stop
    return found


def _outside(matches: Iterable[re.Match], spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Matches, in order, that begin in none of the spans; ``spans`` may grow by what was found at an earlier match."""
    ends, seen, reach = sorted(spans), 0, 0
    new = len(spans)
    for m in matches:
        while seen < len(ends) and ends[seen][0] <= m.start():
            reach, seen = max(reach, ends[seen][1]), seen + 1
        for s in spans[new:]:
            reach = max(reach, s[1])
        new = len(spans)
        if m.start() >= reach:
            yield m


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind as an index of KINDS) of each span, in order."""
    if not text:
        return []
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    lowered = text.lower()
    if any(n in lowered for n in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    armoured, flat = [], text
    if "\\" in text:  # line ends that are written out, as in JSON; positions stay
        flat = text.replace("\\n", " \n").replace("\\r", " \r")
    if "PRIVATE KEY-----" in text:
        for m in ARMOUR.finditer(flat):
            headers = {h[1].lower(): h[2].strip(" \t\r") for h in HEADER.finditer(m[2])}
            body = "".join(HEADER.sub("", m[2]).split())
            if is_key(body) or is_encrypted(headers, body):
                armoured.append((m.start(), m.end(), 3))
    if ".ey" in flat:
        found += [(m.start(), m.end(), 4) for m in TOKEN.finditer(flat) if is_token(m[1], m[2], m[3])]
    lines = None
    for m in _outside(FIRST.finditer(flat), armoured):
        if lines is None or m.start() not in lines.begins:
            lines = Lines(flat, m)
        if end := lines.key_end(m):
            armoured.append((m.start(), end, 3))
    if max(map(len, flat.split()), default=0) >= MIN_ENCODED:
        for m in _outside(ENCODED.finditer(flat), armoured):
            spans = [m.span()] if is_key(m[0]) else inner_keys(flat, *m.span(1))
            found += [(s, e, 3) for s, e in spans]
    return sorted(found + armoured, key=lambda x: (x[0], x[2], x[1]))


def masked(text: str | None, mask: str = MASK) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by ``mask``."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in find(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([",".join([f"{KINDS[k]}:{s}:{e}" for s, e, k in find(t)]) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return pd.Series([masked(t) for t in texts], dtype=object)


def scan(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` and an array of structs (kind, start, end) of the spans of each text."""
    bounded_batches(docs.sparkSession)
    found = fresh(docs, "spans_found")
    parts = F.split(F.col(found), ",")
    spans = F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.struct(
            F.split(p, ":")[0].alias("kind"),
            F.split(p, ":")[1].cast("int").alias("start"),
            F.split(p, ":")[2].cast("int").alias("end"),
        ),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*kept, _spans(F.col(text)).alias(found)).withColumn(name, spans).drop(found)


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked; a column of text lengths, if there is one, follows where the text changed."""
    bounded_batches(docs.sparkSession)
    other = fresh(docs, "masked_text")
    new = docs.withColumn(other, _masked(F.col(text)))
    changed = ~F.col(other).eqNullSafe(F.col(text))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(other).alias(c))
        elif c == length:
            kind = docs.schema[c].dataType
            columns.append(F.when(changed, F.length(other).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return new.select(*columns)
