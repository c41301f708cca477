"""Secret scans by a worklist of decoded layers.

A text is scanned as it is; then every layer that it decodes to is scanned the same way
and decoded again, until nothing new comes out. URL escapes and Unicode escapes are
undone with all that a find or a run around them can reach, base64 runs and what is
compressed in them one run at a time. A layer already scanned at its place is not entered
again, so the work ends also where something decodes to itself. Each layer knows which
characters of the original text each of its characters comes from, so every find is told
as a span there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import ship

# Fixed values of the contract: kinds in their order, patterns, and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE, _LEAST_ACCESS = 12, 18

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
# The shortest secret has 16 characters, which base64 writes in 22.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
_SAME = bytes.maketrans(b"-_", b"+/")
# The line after a run that goes on with it: nothing else stands on it.
_NEXT = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+)(={0,2})(?=[\x20\t]*(?:\r?\n|\Z|[\"'<,)]))")
# How gzip, bz2, xz and zlib begin.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
# Finds, runs and escapes are ASCII; no find has fewer characters.
_READABLE = re.compile(rb"[\x09\x0a\x0d\x20-\x7e]{16}")
# All that finds, base64 runs and escapes consist of: what a decoded character can become
# part of lies between two other characters.
_REACH = re.compile(r"[A-Za-z0-9+/_.=:\"'\s%\\{}&#;-]+", re.A)
# A run of the text whose layers hold more characters than this beyond some times its own
# length is not decoded further; that run alone is told as a span of the kind "opaque". A
# guard against bombs.
MAX_DECODED = 1 << 26
_OWN = 8


class Layer(NamedTuple):
    text: str
    # Of each character, in the original text; None: the same place; a number: of all.
    start: np.ndarray | int | None
    end: np.ndarray | int | None
    run: tuple[int, int] | None  # the outermost run around it

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        if isinstance(self.start, int):
            return self.start, self.end
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def name(self) -> bytes:
        """Digest of the text and its place."""
        places = [b"" if p is None else np.asarray(p, np.int64).tobytes() for p in (self.start, self.end)]
        return _digest(self.text) + hashlib.blake2b(b"/".join(places), digest_size=16).digest()


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base finds in one layer."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    return found + [(2, m.start(), m.end()) for m in _HEX.finditer(text)]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _unescaped(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with every match decoded, and where in it each character comes from."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        plain = decode(m)
        if plain is None:
            continue
        parts += [text[at : m.start()], "".join(c for c, _, _ in plain)]
        starts += [np.arange(at, m.start()), [m.start() + a for _, a, _ in plain]]
        ends += [np.arange(at + 1, m.start() + 1), [m.start() + b for _, _, b in plain]]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    whole = lambda x: np.concatenate([np.asarray(p, np.int64) for p in x])
    return "".join(parts), whole(starts), whole(ends)


def _url(match: re.Match) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(match[0].replace("%", ""))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        width = len(c.encode("utf-8"))
        out.append((c, 3 * at, 3 * (at + width)))
        at += width
    return out


def _unicode(match: re.Match) -> list[tuple[str, int, int]] | None:
    digits = match[match.lastindex]
    code = int(digits, 10 if match.lastindex == 6 else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(match[0]))]


class _Full(Exception):
    pass


# Compressed bytes taken at a time; what comes before a flaw is kept to within so many.
_STEP = 64


def _unpacker(data: bytes | memoryview):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(data: bytes | memoryview, room: int) -> bytes | None:
    """What compressed bytes unpack to, all members of them, as far as they are sound;
    None if they are not compressed."""
    out, size = [], 0
    while (unpack := _unpacker(data)) is not None:
        at = 0
        try:
            while at < len(data) and not unpack.eof:
                out.append(unpack.decompress(data[at : at + _STEP], room + 1 - size))
                size += len(out[-1])
                at += _STEP
                if size > room:
                    raise _Full
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        # Members may be filled up with zeros.
        data = (unpack.unused_data + bytes(data[at:])).lstrip(b"\0") if unpack.eof else b""
    return b"".join(out) if size else None


def _decoded(run: str) -> bytes:
    body = run.rstrip("=").encode().translate(_SAME)
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _text_of(data: bytes | memoryview, plain: bytes | None, room: int) -> str | None:
    """The text in decoded bytes, of which ``plain`` has been unpacked, through any further
    compression; None without any that a find, a run or an escape could stand in."""
    seen = set()
    while plain is not None and data not in seen:
        seen.add(data)
        data = plain
        plain = _inflate(data, room)
    return bytes(data).decode("utf-8", "replace") if _READABLE.search(data) else None


def _unpacked(run: str, room: int) -> str | None:
    """The text in a base64 run, through any compression inside it."""
    data = _decoded(run)
    return _text_of(data, _inflate(data, room), room)


def _unpacked_at(data: memoryview, room: int) -> str | None:
    """The text of compressed bytes; None if they are not, as they are read elsewhere then."""
    plain = _inflate(data, room)
    return None if plain is None else _text_of(data, plain, room)


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 runs as (start, end, run): each as it stands, and joined over line ends
    where the lines after the first are of one width, the last one at most."""
    joined = 0
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
        if m.start() < joined or m[0].endswith("="):
            continue
        lines, end, width = [m[0]], m.end(), 0
        while (more := _NEXT.match(text, end)) and not (width and len(more[1]) > width):
            lines.append(more[1])
            end = more.end()
            if more[2] or width and len(more[1]) < width:
                break
            width = len(more[1])
        if len(lines) > 1:
            yield m.start(), end, "".join(lines)
            joined = end


def _readings(run: str) -> Iterator[Callable[[int], str | None]]:
    """The run from its first four characters on, as what it is glued to may shift it,
    and from wherever in the bytes of one of those four something compressed may begin.
    Such a place is read where it stands: nothing is decoded or copied again for it."""
    for start in range(4):
        yield partial(_unpacked, run[start:])
    for start in range(4):
        data = memoryview(_decoded(run[start:]))
        for m in _PACKED.finditer(data, 1):
            yield partial(_unpacked_at, data[m.start() :])


def _parts(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Escapes with their surroundings, those that touch as one."""
    end = 0
    for m in pattern.finditer(text):
        if m.start() < end:
            continue
        # Everything from ``end`` on is looked through once.
        for part in _REACH.finditer(text, end):
            end = part.end()
            if end > m.start():
                yield part.start(), end
                break


def _inner(layer: Layer, room: dict[tuple[int, int], int], seen: set[bytes]) -> Iterator[Layer | tuple[int, int]]:
    """The layers one step inside; a pair is a run too large to unpack."""
    for sign, pattern, decode in (("%", _URL, _url), ("\\", _UNICODE, _unicode), ("&#", _UNICODE, _unicode)):
        if sign in layer.text and not (sign == "&#" and "\\" in layer.text):
            for a, b in _parts(layer.text, pattern):
                done = _unescaped(layer.text[a:b], pattern, decode)
                if done is not None:
                    text, start, end = done
                    start, end = start + a, end + a
                    if isinstance(layer.start, int):
                        start, end = layer.start, layer.end
                    elif layer.start is not None:
                        start, end = layer.start[start], layer.end[end - 1]
                    yield Layer(text, start, end, layer.run)
    for start, end, run in _runs(layer.text):
        a, b = layer.place(start, end)
        outer = layer.run or (a, b)
        room.setdefault(outer, MAX_DECODED + _OWN * len(run))
        for reading in _readings(run):
            if room[outer] < 0:
                break
            try:
                text = reading(room[outer])
            except _Full:
                room[outer] = -1
                yield outer
                break
            if text is None:
                continue
            inner = Layer(text, a, b, outer)
            if inner.name() not in seen:
                room[outer] -= len(text)
                yield inner if room[outer] >= 0 else outer


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base finds and all finds as (kind, start, end), each by start, kind and end."""
    base = sorted(scan(text), key=lambda s: (s[1], s[0], s[2]))
    found, seen = set(base), set()
    work, room = [Layer(text, None, None, None)], {}
    while work:
        layer = work.pop()
        for inner in _inner(layer, room, seen):
            if not isinstance(inner, Layer):
                found.add((len(KINDS), *inner))
                continue
            name = inner.name()
            if name not in seen:
                seen.add(name)
                found.update((kind, *inner.place(a, b)) for kind, a, b in scan(inner.text))
                work.append(inner)
    return base, sorted(found, key=lambda s: (s[1], s[0], s[2]))


def told(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "opaque")
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{(*KINDS, 'opaque')[k]}]"]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every find in ``text``, decoded ones too, replaced by its kind.

    All columns and rows stay; null and empty texts stay as they are.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column(at).to_pylist()
            masked = [None if t is None else redacted(t, find_all(t)[1]) for t in plain]
            columns = [pa.array(masked, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the base counts ``n_assign``, ``n_access``,
    ``n_hex``, ``base_sha256``, and ``spans``.

    Spans are in code points, end exclusive. The counts and the digest tell the finds in
    the text itself, ``spans`` also what decoded layers hold. Null and empty texts have
    no finds. Repeated rows are scanned each. Other columns are not read. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for value in batch["text"]:
                base, found = find_all(value.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(found))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )
