"""Secret scans with a recursive decoding worklist.

Every text is scanned for assignments, access keys and hexadecimal keys. Then encoded parts are
unwrapped: percent and backslash sequences (all of a layer at once: ``%70``, ``\\x70``, ``\\u0070``, ``\\u{70}``, ``\\U00000070``),
base64 runs, also over line ends, and zlib or gzip streams in base64, one in or after the other. A path, a slug or a word may stand
right before a base64 part, so a run is decoded at each of the four alignments, which all starts share, and streams are looked
for at every byte. Bytes that aren't UTF-8 are scanned as they are. Each decoded layer that may hold a find or a further layer is
scanned like the text and unwrapped in turn, until no layer is new.
Every character of a layer knows the part of the original text that it came from; a find in a
layer is reported as that part. A layer with the same text from the same parts isn't taken again:
parts only narrow, so cycles end, and a text that occurs at several places is unwrapped at each.

Defined results: a null text is an empty one; rows with null or repeated doc_id are scanned each; an empty
table gives an empty one; other columns, also of names that differ in case only, are ignored by
``find_secrets`` and kept by ``mask_secrets``; a span found both ways is reported once; a stream
that grows beyond ``most`` bytes counts in ``n_skipped`` and is gone through in windows of ``most`` bytes,
each over half of the one before, so only what is longer than that half may be missed in it.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, only, plain, recounted, sliced

KINDS = ("assign", "access", "hex")
# The patterns of the base scan.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\})")
# The shortest find, an assignment of 12 bytes, has 16 characters in base64.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_STANDARD = str.maketrans("-_", "+/")
# What decoded bytes must have somewhere to hold a find or a layer, besides packed streams.
_HOLDS = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uxU]|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]")
_HEADER = re.compile(rb"\x1f(?=\x8b\x08)|[\x08\x18\x28\x38\x48\x58\x68\x78]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base scan, sorted. The value of an assignment has 6 characters or more."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and the range of the original that each character came from, or one range (numbers) for all."""

    def __init__(self, text: str, start: np.ndarray | int, end: np.ndarray | int):
        self.text, self.start, self.end = text, start, end


def _from_bytes(data: bytes, start: np.ndarray, end: np.ndarray) -> Layer:
    """UTF-8 bytes with the range of each; undecodable bytes become U+FFFD."""
    text = data.decode("utf-8", "replace")
    if len(text) == len(data):
        return Layer(text, start, end)
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    else:
        at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return Layer(text, start[at], end[np.append(at[1:], len(data)) - 1])
    out, first, last, at = [], [], [], 0
    while at < len(data):
        lead = data[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            c = data[at : at + n].decode("utf-8")
        except UnicodeDecodeError:
            n, c = 1, "�"
        out.append(c)
        first.append(start[at])
        last.append(end[at + n - 1])
        at += n
    return Layer("".join(out), np.array(first, np.int64), np.array(last, np.int64))


def _percent(text: str) -> Layer:
    """The whole text with its percent sequences decoded."""
    data, start, end, at = [], [], [], 0
    for m in [*_PERCENT.finditer(text), None]:
        stop = m.start() if m else len(text)
        data.append(plain := text[at:stop].encode("utf-8", "surrogatepass"))
        here = np.arange(at, stop)
        if len(plain) > stop - at:
            here = at - 1 + np.cumsum((np.frombuffer(plain, np.uint8) & 0xC0) != 0x80)
        start.append(here)
        end.append(here + 1)
        if m:
            data.append(bytes([int(m[0][1:], 16)]))
            start.append(np.array([m.start()]))
            end.append(np.array([m.end()]))
            at = m.end()
    return _from_bytes(b"".join(data), np.concatenate(start), np.concatenate(end))


def _escaped(text: str) -> Layer:
    """The whole text with its backslash sequences decoded."""
    out, start, end, at = [], [], [], 0
    for m in [*_ESCAPE.finditer(text), None]:
        stop = m.start() if m else len(text)
        out += text[at:stop]
        start += range(at, stop)
        end += range(at + 1, stop + 1)
        if m:
            code = int(m[1] or m[2] or m[3] or m[4], 16)
            if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1]) < 0xDC00:  # a surrogate pair
                out[-1], end[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800 << 10) + code - 0xDC00), m.end()
            else:
                out.append(chr(code) if code < 0x110000 else "�")
                start.append(m.start())
                end.append(m.end())
            at = m.end()
    return Layer("".join(out), np.array(start, np.int64), np.array(end, np.int64))


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def _inflate(data: Iterable[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The content of zlib or gzip streams, one after the other, in chunks; what follows them as it is.

    What a broken stream gave before it broke is content too.
    """
    data, rest = iter(data), b""
    while True:
        while len(rest) < 3 and (more := next(data, None)) is not None:
            rest += more
        if not _packed(rest):
            if rest:
                yield rest
            yield from data
            return
        d = zlib.decompressobj(47)
        try:
            while not d.eof:
                if chunk := d.decompress(rest, size):
                    yield chunk
                rest = d.unconsumed_tail
                if not rest and not d.eof:
                    if not (rest := next(data, b"")):
                        if chunk := d.flush():
                            yield chunk
                        return
        except zlib.error:
            return
        rest = d.unused_data


def _read(data: bytes) -> str:
    """UTF-8, or else bytes as they are: the patterns know only ASCII."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _windows(chunks: Iterable[bytes], size: int) -> Iterator[bytes]:
    """Windows of ``size`` bytes, each over the last half of the one before."""
    held = bytearray()
    for c in chunks:
        held += c
        while len(held) > size:
            yield bytes(held[:size])
            del held[: max(1, size // 2)]
    yield bytes(held)


def _opened(data: bytes, most: int) -> Iterator[bytes | OverflowError]:
    """What is in packed bytes, level by level, until no header is left.

    From the first level of more than ``most`` bytes on, an OverflowError and then windows of the innermost one.
    """
    seen: set[bytes] = set()
    while _packed(data) and (key := hashlib.blake2b(data, digest_size=16).digest()) not in seen:
        seen.add(key)
        level = bytearray()
        for c in _inflate([data]):
            level += c
            if len(level) > most:
                yield OverflowError()
                yield from _windows(_innermost(_inflate([data])), most)
                return
        data = bytes(level)
        yield data


def _innermost(chunks: Iterator[bytes]) -> Iterator[bytes]:
    while True:
        first = b""
        while len(first) < 3 and (c := next(chunks, None)) is not None:
            first += c
        chunks = chain([first], chunks)
        if not _packed(first):
            return chunks
        chunks = _inflate(chunks)


def _base64(text: str, most: int, at: np.ndarray | int) -> Iterator[Layer | OverflowError]:
    """The layers of a base64 run whose characters lie at ``at``, or one after the other from there, at all four alignments."""
    body = text.rstrip("=").translate(_STANDARD)
    for off in range(4):
        n = len(body) - off
        n -= n % 4 == 1
        if n < 16:
            return
        data = binascii.a2b_base64(body[off : off + n] + "=" * (-n % 4))
        streams = [m.start() for m in _HEADER.finditer(data) if _packed(data[m.start() : m.start() + 3])]
        holds = _HOLDS.search(data) is not None
        if not holds and not streams:
            continue
        k = np.arange(len(data))
        k = off + k // 3 * 4 + k % 3
        first, last = k, np.minimum(k + 1, off + n - 1)
        start, end = (first + at, last + at + 1) if isinstance(at, int) else (at[first], at[last] + 1)
        if holds:
            try:
                data.decode("utf-8")
                yield _from_bytes(data, start, end)
            except UnicodeDecodeError:
                yield Layer(data.decode("latin-1"), start, end)
        for s in streams:
            for x in _opened(data[s:], most):
                yield x if isinstance(x, OverflowError) else Layer(_read(x), int(start[s]), int(end[-1]))


def _wrapped(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs over several lines, joined, and where their characters lie. Words on their first and last line only shift them."""
    at, size = 0, len(text)
    while (line := text.find("\n", at)) >= 0:
        at, left = line + 1, line - 1
        if left >= 0 and text[left] == "\r":
            left -= 1
        while left >= 0 and text[left] in " \t":
            left -= 1
        if left < 0 or text[left] not in _IN_RUN:
            continue
        end = left + 1
        while left >= 0 and text[left] in _IN_RUN:
            left -= 1
        lines = [(left + 1, end)]
        while True:  # from the end of a line to the next one
            i = lines[-1][1]
            while i < size and text[i] in " \t":
                i += 1
            i += text[i : i + 2] == "\r\n"
            if text[i : i + 1] != "\n":
                break
            i += 1
            while i < size and text[i] in " \t":
                i += 1
            if not (m := _LINE.match(text, i)):
                break
            lines.append((i, m.end()))
        end = lines[-1][1]
        at = max(at, end)
        if len(lines) > 1 and sum(b - a for a, b in lines) >= 16:
            yield "".join(text[a:b] for a, b in lines), np.concatenate([np.arange(a, b) for a, b in lines])


def _parts(text: str, most: int) -> Iterator[Layer | OverflowError]:
    """The layers in a text; an OverflowError comes before the windows of one that is too large."""
    if _PERCENT.search(text):
        yield _percent(text)
    if "\\" in text and _ESCAPE.search(text):
        yield _escaped(text)
    for m in _BASE64.finditer(text):
        yield from _base64(m[0], most, m.start())
    if "\n" in text:
        for run, at in _wrapped(text):
            yield from _base64(run, most, at)


def _key(text: str, start: np.ndarray | int, end: np.ndarray | int) -> bytes:
    h = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16)
    h.update(np.asarray(start).tobytes())
    h.update(np.asarray(end).tobytes())
    return h.digest()


def scan_layers(text: str, most: int = 1 << 26) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """(base spans, all spans, decoded layers, layers too large to unwrap at once)."""
    base = scan(text)
    spans, seen, layers, skipped = set(base), set(), 0, 0
    work = [(_parts(text, most), None, None)]
    while work:
        parts, start, end = work[-1]
        if (part := next(parts, None)) is None:
            work.pop()
            continue
        if isinstance(part, OverflowError):
            skipped += 1
            continue
        if not part.text:
            continue
        a, b = part.start, part.end
        if isinstance(start, int):  # all of one range
            a, b = start, end
        elif start is not None:
            a, b = (int(start[a:b].min()), int(end[a:b].max())) if isinstance(a, int) else (start[a], end[b - 1])
        if (key := _key(part.text, a, b)) in seen:
            continue
        seen.add(key)
        layers += 1
        found = scan(part.text)
        spans.update((a, k, b) if isinstance(a, int) else (int(a[s:e].min()), k, int(b[s:e].max())) for s, k, e in found)
        work.append((_parts(part.text, most), a, b))
    return base, sorted(spans), layers, skipped


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, most: int = 1 << 26) -> DataFrame:
    """One row per document with its spans, in code points, and the text with all spans masked where there are any."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_skipped", "clean_text"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]

    def run(rows):
        for b in sliced(rows):
            found = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, spans, layers, skipped = scan_layers(text or "", most)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                found.append((key, *count, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), layers, skipped, redact(text, spans) if spans else None))
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_skipped long, clean_text string")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every found span masked in ``text``; ``n_chars`` follows where there is one."""
    at, rows_ = docs.columns.index("text"), plain(docs)

    def run(rows):
        for b in sliced(rows):
            texts = [t if not t or not (s := scan_layers(t)[1]) else redact(t, s) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, b.schema.field(at).type), *b.columns[at + 1 :]], schema=b.schema)

    return recounted(rows_.mapInArrow(run, rows_.schema), docs)


def op6_secrets(spark, sf_dir):
    return find_secrets(documents(spark, sf_dir)).drop("clean_text")
