"""Secrets in texts, found through nested encodings by a worklist of layers.

A text is the first layer. Every layer is scanned for secrets and opened:

* each of its lines that holds escapes becomes a layer with all of them undone
  (``%41``, ``\\u0041``, ``\\u{41}``, ``\\U00000041``, ``\\x41``, ``&#65;``, ``&#x41;``; a chain ``%2541``
  counts as one escape). No secret crosses a line, so a line is enough.
* each base64 run (plain or URL-safe, also over several lines) that decodes to text or to
  compressed data becomes a layer;
* each gzip, zlib or bzip2 stream, from base64 or from percent escapes, becomes a layer.

Layers go to the worklist until none is left. A layer with the bytes and the
place of an earlier one is not opened again, so streams that unpack to
themselves end. Every byte of a layer knows the part of the text it comes
from; a secret's span is the part that all its bytes come from.

An opened layer costs its length. Compressed data can unpack to a million
times its size: a stream may hold MOST_BYTES and all opened layers of a
document ``max(MOST_BYTES, MOST_TIMES * bytes of the text)``; what is beyond
that is counted in ``n_unopened`` instead of being opened. The text itself is
always scanned whole.

Defined results: a null or empty text has no secrets; documents with equal
or null doc_id are rows of their own; an empty table gives an empty result;
columns other than doc_id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex")
#: Least lengths: of an assigned value, of an access key, of a hexadecimal run.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
MOST_BYTES, MOST_TIMES = 32 << 20, 1000

#: On lower-cased bytes: "letters in either case" is then a plain alternation.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4))
_HEX = re.compile(rb"[0-9a-f]{%d,}" % LEAST_HEX)
#: Runs shorter than this can't hold an encoded secret.
_BASE64_LINES = re.compile(rb"([A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*={0,2})"
                           rb"(?:\r?\n[A-Za-z0-9+/_-]{1,15}={0,2}(?![^\s\"'<]))?")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_ESCAPE = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})"
                     rb"|\\u([0-9A-Fa-f]{4})(?:\\u([0-9A-Fa-f]{4}))?|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})"
                     rb"|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY")
_URL_SAFE = bytes.maketrans(b"-_", b"+/")


class Layer(NamedTuple):
    """Bytes, and for each one the part [low, high) of the text that it comes from."""
    data: bytes
    low: np.ndarray
    high: np.ndarray
    path: str


def matches(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in bytes; leftmost, not overlapping within a kind."""
    low = data.lower()
    for m in _ASSIGN.finditer(low):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(data):
        yield "access", m.start(), m.end()
    for m in _HEX.finditer(data):
        yield "hex", m.start(), m.end()


def _plain(data: bytes) -> bool:
    """Whether the bytes read as text."""
    if _CONTROL.search(data):
        return False
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _unescape(m: re.Match) -> bytes:
    """What one escape stands for."""
    percent, unit, pair, braces, wide, byte, decimal, entity = m.groups()
    if percent or byte:
        return bytes([int(percent or byte, 16)])
    if unit:
        code = int(unit, 16)
        if pair is None:
            return chr(code).encode("utf-8", "surrogatepass")
        second = int(pair, 16)
        if 0xD800 <= code < 0xDC00 <= second < 0xE000:
            return chr(0x10000 + ((code - 0xD800) << 10) + second - 0xDC00).encode()
        return (chr(code) + chr(second)).encode("utf-8", "surrogatepass")
    code = int(decimal) if decimal else int(braces or wide or entity, 16)
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else m.group()


def _opened_lines(layer: Layer) -> Iterator[Layer]:
    """The lines that hold escapes, with all of them undone once."""
    data, done = layer.data, 0
    for first in iter(lambda: _ESCAPE.search(data, done), None):
        begin = data.rfind(b"\n", 0, first.start()) + 1
        end = data.find(b"\n", first.end())
        end = done = len(data) if end < 0 else end
        parts, lows, highs, at = [], [], [], begin
        for m in _ESCAPE.finditer(data, begin, end):
            value = _unescape(m)
            parts += data[at:m.start()], value
            lows += layer.low[at:m.start()], np.full(len(value), layer.low[m.start()])
            highs += layer.high[at:m.start()], np.full(len(value), layer.high[m.end() - 1])
            at = m.end()
        parts.append(data[at:end])
        lows.append(layer.low[at:end])
        highs.append(layer.high[at:end])
        new = b"".join(parts)
        if new and new != data[begin:end]:
            yield Layer(new, np.concatenate(lows), np.concatenate(highs), layer.path + ">escape")


def _from_base64(layer: Layer, start: int, end: int) -> Layer | None:
    """The run decoded, if it reads as text or as compressed data."""
    where = np.arange(start, end)
    run = layer.data[start:end]
    if b"\n" in run:
        where = where[~np.isin(np.frombuffer(run, np.uint8), (10, 13))]
        run = run.replace(b"\r", b"").replace(b"\n", b"")
    run = run.rstrip(b"=").translate(_URL_SAFE)
    if len(run) % 4 == 1:
        return None
    try:
        data = base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None
    if not data or not (_PACKED.match(data) or _plain(data)):
        return None
    k = np.arange(len(data))
    first = where[4 * (k // 3) + k % 3]
    last = where[4 * (k // 3) + k % 3 + 1]
    return Layer(data, layer.low[first], layer.high[last], layer.path + ">base64")


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """Runs as long as they go: with a short last line, without it, else line by line."""
    for m in _BASE64_LINES.finditer(layer.data):
        tries = [m.span()] if m.span() == m.span(1) else [m.span(), m.span(1)]
        whole = next((x for x in (_from_base64(layer, *t) for t in tries) if x is not None), None)
        if whole is not None:
            yield whole
        elif b"\n" in m.group(1):
            for part in _BASE64.finditer(layer.data, *m.span(1)):
                one = _from_base64(layer, *part.span())
                if one is not None:
                    yield one


def _unpacked(layer: Layer) -> Iterator[Layer | None]:
    """The compressed streams in the layer unpacked (None: over MOST_BYTES); all bytes come from the whole stream."""
    data, done = layer.data, 0
    for m in iter(lambda: _PACKED.search(data, done), None):
        done = m.start() + 1
        stream = bz2.BZ2Decompressor() if m.group().startswith(b"BZ") else zlib.decompressobj(wbits=47)
        try:
            new = stream.decompress(data[m.start():], MOST_BYTES)
        except (zlib.error, OSError):
            continue
        if not new:
            continue
        if not stream.eof and len(new) == MOST_BYTES:
            yield None
            continue
        end = len(data) - len(stream.unused_data)
        done = end if stream.eof else done
        low, high = layer.low[m.start()], layer.high[end - 1]
        yield Layer(new, np.broadcast_to(low, len(new)), np.broadcast_to(high, len(new)), layer.path + ">unpack")


class Found(NamedTuple):
    """A secret: kind and span (bytes of the text), how its layer was opened and what it says there."""
    kind: str
    start: int
    end: int
    path: str
    secret: bytes


def search(text: bytes) -> tuple[list[Found], int]:
    """Secrets of all layers (those of the text itself first) and the number of unopened layers."""
    found = [Found(k, a, b, "", text[a:b]) for k, a, b in matches(text)]
    if not (_ESCAPE.search(text) or _BASE64.search(text)):
        return found, 0
    place = np.arange(len(text) + 1)
    budget, unopened = max(MOST_BYTES, MOST_TIMES * len(text)), 0
    work, seen = [Layer(text, place[:-1], place[1:], "")], set()
    while work:
        layer = work.pop()
        openers = [_opened_lines, _base64_layers]
        if layer.path and not _plain(layer.data):
            openers.append(_unpacked)
        for new in (x for opener in openers for x in opener(layer)):
            if new is None or len(new.data) > budget:
                unopened += 1
                continue
            name = hashlib.blake2b(new.data, digest_size=16).digest(), int(new.low[0]), int(new.high[-1])
            if name in seen:
                continue
            budget -= len(new.data)
            seen.add(name)
            for kind, a, b in matches(new.data):
                found.append(Found(kind, int(new.low[a]), int(new.high[b - 1]), new.path[1:], new.data[a:b]))
            work.append(new)
    return found, unopened


def code_points(text: bytes, at: list[int]) -> dict[int, int]:
    """Byte offsets (any order) as code point offsets; an offset inside a code point counts as its start."""
    if not at or text.isascii():
        return {b: b for b in at}
    heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return {b: int(heads[b - 1]) if b else 0 for b in at}


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string()),
                   ("secret", pa.string())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                     ("spans", pa.string()), ("n_unopened", pa.int64()), ("found", pa.list_(_SPAN))])
_DDL = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_unopened long, "
        "found array<struct<kind:string,start:long,end:long,path:string,secret:string>>")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text"))):
                found, unopened = search(text)
                where = code_points(text, [p for f in found for p in (f.start, f.end)])
                spans = [(where[f.start], KINDS.index(f.kind), where[f.end]) for f in found]
                base = sorted(s for s, f in zip(spans, found) if not f.path)
                first = {}
                for s, f in zip(spans, found):
                    first.setdefault(s, f)
                out.append((doc, *(sum(k == i for _, k, _ in base) for i in range(len(KINDS))),
                            hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(first)), unopened,
                            [(KINDS[s[1]], s[0], s[2], f.path, f.secret.decode(errors="replace"))
                             for s, f in sorted(first.items())]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if f.name != "found" else
                 pa.array([[dict(zip(("kind", "start", "end", "path", "secret"), x)) for x in r] for r in c], f.type)
                 for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, digest and spans of its secrets.

    ``base_sha256`` digests the spans found in the text as it stands, ``spans`` lists those and
    the ones found in opened layers, each once; ``found`` has them with the layer's path
    ("" for the text itself, else e.g. "escape>base64>unpack") and what was found there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan, _DDL)


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per secret: doc_id, kind, start, end, path, secret."""
    return scan(docs, text).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
