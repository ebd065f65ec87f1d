"""Secret scans over recursively decoded layers.

A worklist starts with the whole text. Each layer is scanned for secrets; then every URL-escaped,
Unicode-escaped, base64 and compressed region in it becomes a further layer, with a map from its
characters to the original's, until nothing new comes up. Escapes are decoded token by token and over
the whole layer, so that plain text on both sides stays next to what was escaped. Layers seen before (same content over
the same original span) are not taken again, which ends cycles. A secret in a decoded layer is
reported at the original characters that it came from.

Compressed streams (gzip, zlib, bzip2, xz, zstd) are found at any place in the bytes of base64, of URL
escapes, of \\x and similar escapes, and of characters below 256. Their contents are read as streams, in
windows that end at white space and overlap, so that memory is bounded and all of a stream is scanned,
however large; a content too large to keep is expanded again for each stream inside it. Bytes that are no
text throughout are scanned too: what isn't UTF-8 becomes a replacement character, at which every match
ends, and runs of ASCII in UTF-16 are read as text as well.

Null texts are empty. Rows with a null id keep it; repeated rows are scanned each; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import id_and_text, slices

KINDS = ("assign", "access", "hex")
#: What counts as a secret, with the least length of the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
EITHER = re.compile(f"{PERCENT.pattern}|{ESCAPE.pattern}")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: As mail and certificates have it, over several lines.
BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+(?=[=\s\"'<]|\Z))+={0,2}")
#: Where a compressed stream can start: the usual zlib headers anywhere, those of small windows first of all.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\A[\x08\x18\x28\x38\x48\x58\x68](?s:.)")
LATIN = re.compile(r"[\x00-\xff]{8,}")
#: Escapes of single bytes, as URLs and as literals of programs and JSON have them; in forms, "+" is a space.
BYTE_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
BYTE_FORM = re.compile(r"%([0-9A-Fa-f]{2})|(\+)")
BYTE_ESCAPE = re.compile(r"\\u00([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|&#x0*([0-9A-Fa-f]{1,2});|&#0*([0-9]{1,3});|\\([0-3]?[0-7]{1,2})|\\([abtnvfr\\'\"/])")
NAMED = dict(zip("abtnvfr\\'\"/", "\a\b\t\n\v\f\r\\'\"/", strict=True))
#: ASCII in UTF-16, of either order.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){8,}[\x20-\x7e]?")
#: Bytes of a window, and of what windows share; a run without white space is cut only when it is MOST long.
WINDOW, OVERLAP, MOST = 4 << 20, 1 << 16, 64 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one layer."""
    found = []
    low = text.lower() if text else ""
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text with, for runs of its characters, where they come from in the original.

    ``at`` holds the first character of each run, ``first``/``last`` the original span; in a run of
    literal characters (``exact``) each has its own place, otherwise all share the span.
    """

    def __init__(self, text: str, at: list[int], first: list[int], last: list[int], exact: list[bool]):
        self.text, self.at, self.first, self.last, self.exact = text, at, first, last, exact

    def origin(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        left = self.first[a] + (start - self.at[a] if self.exact[a] else 0)
        right = self.first[b] + (end - self.at[b]) if self.exact[b] else self.last[b]
        return left, right


def whole(text: str) -> Layer:
    return Layer(text, [0], [0], [len(text)], [True])


class Builder:
    """Collects the runs of a new layer over a parent."""

    def __init__(self, parent: Layer):
        self.parent, self.parts, self.size, self.runs = parent, [], 0, []

    def add(self, text: str, start: int, end: int, literal: bool) -> None:
        if not text:
            return
        p, at = self.parent, start
        if literal:  # one run for each of the parent's runs
            while at < end:
                k = bisect_right(p.at, at) - 1
                stop = min(end, p.at[k + 1] if k + 1 < len(p.at) else end)
                first, last = (p.first[k] + at - p.at[k], p.first[k] + stop - p.at[k]) if p.exact[k] else (p.first[k], p.last[k])
                self.runs.append((self.size + at - start, first, last, p.exact[k]))
                at = stop
        else:
            self.runs.append((self.size, *p.origin(start, end), False))
        self.parts.append(text)
        self.size += len(text)

    def layer(self) -> Layer | None:
        return Layer("".join(self.parts), *map(list, zip(*self.runs, strict=True))) if self.runs else None


def decoded(parent: Layer, pattern: re.Pattern, decode, start: int, end: int) -> Layer | None:
    """A stretch of a layer, the escapes in it decoded."""
    built, at = Builder(parent), start
    for m in pattern.finditer(parent.text, start, end):
        built.add(parent.text[at : m.start()], at, m.start(), True)
        for piece, s, e in decode(m):
            built.add(piece, s, e, False)
        at = m.end()
    built.add(parent.text[at:end], at, end, True)
    return built.layer()


def unescaped(parent: Layer, pattern: re.Pattern, decode) -> list[Layer]:
    """A layer for each space-free token in which the pattern occurs, its escapes decoded."""
    out, text, done = [], parent.text, -1
    for hit in pattern.finditer(text):
        if hit.start() < done:
            continue
        a = hit.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = hit.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        if (new := decoded(parent, pattern, decode, a, b)) is not None:
            out.append(new)
    return out


def in_context(parent: Layer) -> list[Layer]:
    """The whole layer with its escapes of either kind decoded, so that a key and a value meet across spaces.

    One layer, not one for each kind: a match of ASSIGN holds no part of an escape, and orders of
    decoding would be exponentially many.
    """
    likely = "%" in parent.text or "\\" in parent.text or "&#" in parent.text
    new = decoded(parent, EITHER, either_pieces, 0, len(parent.text)) if likely and EITHER.search(parent.text) else None
    return [] if new is None else [new]


def percent_pieces(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    if raw.isascii():
        for k, byte in enumerate(raw):
            yield chr(byte), m.start() + 3 * k, m.start() + 3 * k + 3
    else:
        yield raw.decode("utf-8", "replace"), m.start(), m.end()


def escape_pieces(m: re.Match):
    codes = [(int(x[1] or x[2] or x[3] or "0", 16) if not x[4] else int(x[4]), x.start(), x.end()) for x in ONE_ESCAPE.finditer(m[0])]
    k = 0
    while k < len(codes):
        code, s, e = codes[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1][0] < 0xE000:
            code, e, k = 0x10000 + ((code - 0xD800) << 10) + codes[k + 1][0] - 0xDC00, codes[k + 1][2], k + 1
        k += 1
        yield chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "�", m.start() + s, m.start() + e


def either_pieces(m: re.Match):
    return percent_pieces(m) if m[0][0] == "%" else escape_pieces(m)


def percent_byte(m: re.Match):
    yield chr(int(m[1], 16)), m.start(), m.end()


def form_byte(m: re.Match):
    yield " " if m[2] else chr(int(m[1], 16)), m.start(), m.end()


def escape_byte(m: re.Match):
    code = int(m[1] or m[2] or m[3], 16) if m[1] or m[2] or m[3] else int(m[4]) if m[4] else int(m[5], 8) if m[5] else ord(NAMED[m[6]])
    yield chr(code), m.start(), m.end()


def engine_of(head: bytes):
    """A decompressor for a stream that starts like that, and how many bytes to feed it at a time; None if it is no stream."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31), 256
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), 256
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20), 256
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), 64  # it knows no limit, so it gets little at a time
    if len(head) > 1 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(), 256
    return None, 0


class Expanded:
    """What the compressed stream at the start of some pieces of bytes holds, as pieces of at most a few MB.

    Members that follow at once, as in concatenated files, belong to it. Of a broken stream, what came
    before the break. ``used`` is the length of the complete members, ``complete`` whether all were.
    """

    def __init__(self, pieces):
        self.pieces, self.buffer, self.at, self.used, self.complete = iter(pieces), b"", 0, 0, False

    def have(self, n: int) -> bytes:
        """The next n bytes, fewer at the end; they stay in the buffer."""
        while len(self.buffer) - self.at < n and (more := next(self.pieces, b"")):
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return self.buffer[self.at : self.at + n]

    def __iter__(self):
        first = self.have(6)
        while (engine := engine_of(self.have(6)))[0] and self.have(2) == first[:2]:
            engine, step = engine
            self.complete, taken = False, 0
            try:
                while not engine.eof:
                    if not (data := self.have(step)):
                        return
                    self.at += len(data)
                    taken += len(data)
                    out = engine.decompress(data) if step == 64 else engine.decompress(data, 1 << 20)
                    while out:
                        yield out
                        held = getattr(engine, "unconsumed_tail", None)
                        more = step == 256 and not engine.eof and (held or held is None and not engine.needs_input)
                        out = engine.decompress(held or b"", 1 << 20) if more else b""
            except (zlib.error, OSError, EOFError, ValueError, MemoryError, lzma.LZMAError, zstandard.ZstdError):
                return
            self.buffer, self.at = engine.unused_data + self.buffer[self.at :], 0
            self.used += taken - len(engine.unused_data)
            self.complete = True


class Source:
    """Bytes that can be read again from their start: held here, or the content of a stream at a place of another source."""

    def __init__(self, raw: bytes | None, parent: Source | None = None, at: int = 0):
        self.raw, self.parent, self.at = raw, parent, at

    def pieces(self, skip: int = 0):
        if self.raw is not None:
            yield from (self.raw[a : a + (1 << 16)] for a in range(skip, len(self.raw), 1 << 16))
            return
        for piece in Expanded(self.parent.pieces(self.at)):
            if skip < len(piece):
                yield piece[skip:]
            skip = max(0, skip - len(piece))

    def stream(self, at: int) -> tuple[Source | None, int]:
        """The content of the stream at a place, None if there is none, and how long the stream is if it ends and its content is small."""
        stream, parts, size = Expanded(self.pieces(at)), [], 0
        for piece in stream:
            parts.append(piece)
            size += len(piece)
            if size > WINDOW:
                return Source(None, self, at), 0
        return Source(b"".join(parts)) if size else None, stream.used if stream.complete else 0

    def windows(self):
        """(place, bytes, first new byte) of windows that end at white space and overlap."""
        held, place, new, space = bytearray(), 0, 0, 0
        for piece in self.pieces():
            if (last := max(map(piece.rfind, b" \n\t"))) >= 0:
                space = len(held) + last + 1
            held += piece
            if len(held) < WINDOW or space <= new and len(held) < MOST:
                continue
            stop = space if space > new else len(held)
            yield place, bytes(held[:stop]), new
            keep = max(0, stop - (OVERLAP if stop < len(held) else 16 * OVERLAP))
            del held[:keep]
            place, new, space = place + keep, stop - keep, 0
        yield place, bytes(held), new


def texts(raw: bytes):
    """The texts that bytes hold: their own, and those of all streams in them, however deep; large ones by window."""
    waiting, seen = [Source(raw)], set()
    while waiting:
        source, inside, done, whole = waiting.pop(), [], 0, 0
        digest = hashlib.blake2b(digest_size=16)
        for place, window, new in source.windows():
            digest.update(window[new:])
            covered = False
            for m in MAGIC.finditer(window):
                at = place + m.start()
                if at < done or m.start() + 8 < new and place:  # what the window before has seen
                    continue
                content, length = source.stream(at)
                if content:
                    inside.append(content)
                    covered = covered or at == place == 0 and length == len(window)
                    done = max(done, at + length)
            if window and not covered:
                yield window.decode("utf-8", "replace")
                if wide := [m[0][::2].decode("ascii") for m in WIDE.finditer(window)]:
                    yield "\n".join(wide)
        if digest.digest() not in seen:  # else a stream that holds itself
            seen.add(digest.digest())
            waiting += inside


def base64_layers(parent: Layer, seen: set):
    for pattern in (BASE64, BASE64_LINES):
        for m in pattern.finditer(parent.text) if pattern is BASE64 or "\n" in parent.text else ():
            first, last = parent.origin(m.start(), m.end())
            if (m[0], first, last) in seen:
                continue
            seen.add((m[0], first, last))
            body = "".join(m[0].split()).rstrip("=").replace("-", "+").replace("_", "/")
            body = body[:-1] if len(body) % 4 == 1 else body
            try:
                raw = base64.b64decode(body + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            for text in texts(raw):
                yield Layer(text, [0], [first], [last], [False])


def compressed_layers(parent: Layer):
    """The texts of streams whose bytes are the layer's characters, plain or escaped."""
    forms = [parent]
    if "%" in parent.text:
        forms.append(decoded(parent, BYTE_PERCENT, percent_byte, 0, len(parent.text)))
        if "+" in parent.text:
            forms.append(decoded(parent, BYTE_FORM, form_byte, 0, len(parent.text)))
    if "\\" in parent.text or "&#" in parent.text:
        forms.append(decoded(parent, BYTE_ESCAPE, escape_byte, 0, len(parent.text)))
    for form in forms:
        for run in LATIN.finditer(form.text) if form is not None else ():
            raw, done = run[0].encode("latin-1"), 0
            for m in MAGIC.finditer(raw):
                if m.start() < done:
                    continue
                stream = Expanded(Source(raw).pieces(m.start()))
                size = sum(map(len, stream))
                if not size:
                    continue
                length = stream.used if stream.complete else len(raw) - m.start()
                done = m.start() + length if stream.complete else done
                first, last = form.origin(run.start() + m.start(), run.start() + m.start() + length)
                for text in texts(raw[m.start() : m.start() + length]):
                    yield Layer(text, [0], [first], [last], [False])


def children(layer: Layer, taken: set):
    """The layers inside a layer."""
    if "%" in layer.text:
        yield from unescaped(layer, PERCENT, percent_pieces)
    if "\\" in layer.text or "&#" in layer.text:
        yield from unescaped(layer, ESCAPE, escape_pieces)
    yield from in_context(layer)
    yield from base64_layers(layer, taken)
    yield from compressed_layers(layer)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the text's own secrets, and of all with those of decoded layers; both sorted."""
    base = sorted(scan(text))
    found, seen, taken = set(base), set(), set()
    worklist = [children(whole(text), taken)]
    while worklist:  # the layers still to come are made one at a time
        new = next(worklist[-1], None)
        if new is None:
            worklist.pop()
            continue
        key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), new.first[0], new.last[-1])
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in scan(new.text):
            a, b = new.origin(start, end)
            found.add((a, kind, b))
        worklist.append(children(new, taken))
    return base, sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text; counts and hash are of the text's own secrets."""

    def scanned(batches):
        for batch in slices(batches):
            rows = [spans(t or "") for t in batch["text"].to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in rows], pa.int64()) for kind in range(3)]
            hashes = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], *counts, hashes, pa.array([listed(every) for _, every in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret, own or decoded, replaced; overlapping spans become one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans(text)[1]:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    """The column with secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) if t is not None else None for t in texts], dtype=object)

    return clean(text)
