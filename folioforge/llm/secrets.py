"""Secrets in whole texts, also inside nested encodings.

The worklist starts with the text. Each layer is scanned for secrets and unwrapped further: escapes (percent, Unicode,
character references), base64 (plain or URL alphabet, also wrapped into lines, also after a slash), and what
decompresses (zlib, raw deflate, gzip and bzip2 of any number of members, xz) after base64, as UTF-8 or UTF-16.
Layers are unwrapped until none is new; a set of digests of the layers seen breaks cycles. For every character of a layer
the place in the original text that it came from is kept, so a secret in any layer is reported where its encoded form
stands in the document. Matches of the text itself always stay as they are.

Escapes within escapes are taken to their fixpoint in one pass over a stack of characters: however deep they are nested,
the work grows with the length of the text. No layer in between shows more: escapes hold characters that no secret
holds, so what a layer shows is still there when the escapes beside it are decoded. A base64 layer is shorter than its
code, so nested ones add up to a few times the text.

Null counts as the empty text. Very long texts are scanned whole. Repeated documents are scanned each for itself. A
compressed layer that would grow beyond MAX_INFLATED bytes is scanned up to there (a bomb must not end the task); plain
layers have no bound. Other columns are not read, so their names clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "api")
MAX_INFLATED = 64 << 20

RUN = re.compile(r"[^\x20\x09-\x0D]+")
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
HEXADECIMAL = frozenset("0123456789abcdefABCDEF")
REFERENCE = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));\Z")
BRACED = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}\Z")
RAW = re.compile("[\udc80-\udcff]+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
SEGMENT = re.compile(r"[A-Za-z0-9+_-]{12,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the secrets that stand in a text as they are."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and where it comes from: starts and ends in the original, one pair for each character, or one pair for all."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        if len(self.starts) == 1:
            return int(self.starts[0]), int(self.ends[0])
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def places(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of stretches of characters from start to end: where their first comes from, and their last."""
        if len(self.starts) == 1:
            return np.repeat(self.starts, len(starts)), np.repeat(self.ends, len(starts))
        return self.starts[starts], self.ends[ends - 1]


def _decoded(chars: list[str]) -> tuple[str, int] | None:
    """The character that an escape at the end of chars stands for, and its length; bytes beyond ASCII stand apart for now."""
    last = chars[-1]
    if last in HEXADECIMAL:
        for mark, digits in (("%", 2), ("\\x", 2), ("\\u", 4)):
            n = len(mark) + digits
            if len(chars) >= n and chars[-n] == mark[0] and "".join(chars[-n:-digits]) == mark and HEXADECIMAL.issuperset(chars[-digits:]):
                code = int("".join(chars[-digits:]), 16)
                if mark == "%" and code > 127:
                    code += 0xDC00
                elif 0xD800 <= code <= 0xDFFF:
                    return None
                return chr(code), n
    elif last in ";}":
        found = (REFERENCE if last == ";" else BRACED).search("".join(chars[-10:]))
        if found:
            code = int(found[1]) if last == ";" and found[1] else int(found[found.lastindex], 16)
            if code < 0xD800 or 0xDFFF < code < 0x110000:
                return chr(code), len(found[0])
    return None


def _unescaped(run: str, begin: int) -> tuple[str, list[int], list[int]]:
    """A run without white space with its escapes decoded to their fixpoint, and the start and end of each character in the layer, where the run begins at begin."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for i, c in enumerate(run, begin):
        chars.append(c)
        starts.append(i)
        ends.append(i + 1)
        while (found := _decoded(chars)) is not None:
            first, last = starts[-found[1]], ends[-1]
            for x in (chars, starts, ends):
                del x[-found[1] :]
            chars.append(found[0])
            starts.append(first)
            ends.append(last)
    text = "".join(chars)
    if RAW.search(text):
        parts, s, e, at = [], [], [], 0
        for m in RAW.finditer(text):
            raw = bytes(ord(c) - 0xDC00 for c in m[0])
            try:
                piece = raw.decode("utf-8")
                size = [len(c.encode("utf-8")) for c in piece]
            except UnicodeDecodeError:
                piece, size = raw.decode("latin-1"), [1] * len(raw)
            parts += [text[at : m.start()], piece]
            s += starts[at : m.start()]
            e += ends[at : m.start()]
            k = m.start()
            for n in size:
                s.append(starts[k])
                e.append(ends[k + n - 1])
                k += n
            at = m.end()
        text, starts, ends = "".join([*parts, text[at:]]), s + starts[at:], e + ends[at:]
    return text, starts, ends


def escape_layers(layer: Layer) -> Iterator[Layer]:
    """The whole layer (a key and its value may have white space between) with all escapes decoded."""
    if not ESCAPE.search(layer.text):
        return
    text, starts, ends, at = [], [], [], 0
    for m in RUN.finditer(layer.text):
        if ESCAPE.search(layer.text, *m.span()):
            new, s, e = _unescaped(m[0], m.start())
            text += [layer.text[at : m.start()], new]
            starts += [np.arange(at, m.start()), np.array(s, np.int64)]
            ends += [np.arange(at + 1, m.start() + 1), np.array(e, np.int64)]
            at = m.end()
    n = len(layer.text)
    text.append(layer.text[at:])
    starts, ends = np.concatenate([*starts, np.arange(at, n)]), np.concatenate([*ends, np.arange(at + 1, n + 1)])
    yield Layer("".join(text), *layer.places(starts, ends))


def _members(raw: bytes, make) -> bytes:
    """What members one after the other decompress to, up to MAX_INFLATED."""
    out = b""
    while raw and len(out) < MAX_INFLATED:
        z = make()
        out += z.decompress(raw, MAX_INFLATED - len(out))
        raw = z.unused_data if z.eof else b""
    return out


def _inflated(raw: bytes) -> bytes | None:
    for magic, make in ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", lambda: zlib.decompressobj(15)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor)):
        if raw.startswith(magic):
            try:
                if found := _members(raw, make):
                    return found
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                pass
    z = zlib.decompressobj(-15)
    try:
        found = z.decompress(raw, MAX_INFLATED)
    except zlib.error:
        return None
    return found if z.eof and not z.unused_data and _readable(found) is not None else None


def _readable(raw: bytes) -> str | None:
    """UTF-8, or UTF-16 where every other byte is mostly zero or a mark says so, of printable characters."""
    code = "utf-8"
    if len(raw) % 2 == 0 and len(raw) >= 4:
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            code = "utf-16"
        elif 4 * raw[1::2].count(0) > len(raw):
            code = "utf-16-le"
        elif 4 * raw[::2].count(0) > len(raw):
            code = "utf-16-be"
    try:
        text = raw.decode(code)
    except UnicodeDecodeError:
        return None
    return text if text and text.translate(PLAIN).isprintable() else None


PLAIN = {9: None, 10: None, 13: None}


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of base64 that may belong together: after the first all are as long as the second, but for a shorter last one, with it and without."""
    for block in WRAPPED.finditer(text):
        lines, i = [m.span() for m in LINE.finditer(text, *block.span())], 0
        while i + 1 < len(lines):
            width, j = lines[i + 1][1] - lines[i + 1][0], i + 2
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                yield lines[i : j + 1]
            yield lines[i:j]
            i = j - 1


def _base64_layer(layer: Layer, parts: list[tuple[int, int]]) -> Layer | None:
    body = "".join(layer.text[a:b] for a, b in parts).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None
    text = _readable(raw)
    if text is None:
        more = _inflated(raw)
        if more is None:
            return None
        p, q = layer.place(parts[0][0], parts[-1][1])
        plain = _readable(more)
        return Layer(more.decode("utf-8", "replace") if plain is None else plain, np.array([p]), np.array([q]))
    at = np.concatenate([np.arange(a, b) for a, b in parts])
    if len(text) == len(raw):
        end = np.arange(1, len(raw) + 1)
    elif len(text.encode("utf-8")) == len(raw):
        end = np.cumsum([len(c.encode("utf-8")) for c in text])
    else:  # UTF-16, with or without its mark
        size = np.array([2 + 2 * (ord(c) > 0xFFFF) for c in text])
        end = np.cumsum(size) + len(raw) - size.sum()
    begin = np.concatenate([[0], end[:-1]])
    return Layer(text, *layer.places(at[begin * 4 // 3], at[np.minimum(len(body), -(-end * 4 // 3)) - 1] + 1))


def base64_layers(layer: Layer) -> Iterator[Layer]:
    joined = 0
    for parts in _wrapped(layer.text):
        if parts[0][0] >= joined and (new := _base64_layer(layer, parts)) is not None:
            joined = parts[-1][1]
            yield new
    for run in BASE64.finditer(layer.text):
        spans = {run.span()}
        if "/" in run[0]:  # a slash may belong to the code, or stand before it
            spans |= {m.span() for m in SEGMENT.finditer(layer.text, *run.span())} | {(layer.text.index("/", run.start()) + 1, run.end())}
        for a, b in sorted(spans):
            if b - a >= 12 and (new := _base64_layer(layer, [(a, b)])) is not None:
                yield new


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The secrets of the text itself, and those of all layers together, as (start, kind, end) in the text."""
    base = base_spans(text)
    found, seen, work = set(base), set(), []
    name = lambda layer: hashlib.blake2b(f"{layer.starts[0] if len(layer.starts) else -1} {layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if ESCAPE.search(text) or BASE64.search(text):
        work.append(Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1)))
        seen.add(name(work[0]))
    while work:
        layer = work.pop()
        for decode in (escape_layers, base64_layers):
            for new in decode(layer):
                if (key := name(new)) in seen or new.text == layer.text:
                    continue
                seen.add(key)
                work.append(new)
                for start, kind, end in base_spans(new.text):
                    p, q = new.place(start, end)
                    found.add((p, kind, q))
    return base, sorted(found)


def as_string(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the secrets that stand in the text as they are, a digest of these, and all spans."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for text in (t for piece in pieces(batch) for t in piece.column(1).to_pylist()):
                base, every = all_spans(text or "")
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*n, hashlib.sha256(as_string(base).encode()).hexdigest(), as_string(every)))
            columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, SCHEMA)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
