"""Operator 3, secret scans: a worklist that unwraps URL, Unicode, base64 and compressed layers until nothing new turns up."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import id_and_text, slices

KINDS = ("assign", "access", "hex")
# Letters are written in both cases: the ignore-case flag would also take the long s and the Kelvin sign.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api"))
_KEYWORDS += "_?[kK][eE][yY]"  # of the last one
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One of these is in every lower-cased text with a match.
SIGNS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: The shortest secret (18 characters, or 16 of hex) takes 22 characters of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
#: Runs on lines that follow each other, maybe indented: base64 that was wrapped.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
LEAST_ENCODED = 22
#: Where compressed bytes may start: gzip, zlib, bz2, xz, zstd.
MAGIC = re.compile(rb"\x1f\x8b|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Bytes that are inflated, and characters that are scanned, at a time.
PIECE = 1 << 20
_ZLIB = type(zlib.decompressobj())
#: A line break next to what is neither base64 nor blank: no match, run or escape goes across it.
SAFE_BREAK = re.compile(r"(?:[^A-Za-z0-9+/_\-\s]\r?|(?<=\n))\n")
_SIMPLE = {"n": 10, "r": 13, "t": 9, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34}
_BYTES = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|\\U000000([0-9A-Fa-f]{2})|&#[xX]0{0,4}([0-9A-Fa-f]{1,2});|&#0{0,4}([0-9]{1,3});|\\([nrt0abfv\\'\"])")


@dataclass(frozen=True)
class Layer:
    """Decoded text; `starts` and `ends` have for each of its characters the span of the original that it came from, None: the whole of `span`."""

    text: str
    span: tuple[int, int]
    starts: np.ndarray | None
    ends: np.ndarray | None
    path: str

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.text)
        if self.starts is not None:
            return self.starts, self.ends
        if self.path == "":
            return np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        return np.full(n, self.span[0], np.int32), np.full(n, self.span[1], np.int32)


def base_matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, those too short dropped after they were matched."""
    low = text.lower()
    if any(s in low for s in SIGNS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _texts(chunks: Iterable[bytes], whole: bool) -> Iterator[str]:
    """The bytes as UTF-8; of those that aren't whole, half a character at the end goes."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    for chunk in chunks:
        yield decoder.decode(chunk)
    decoder.decode(b"", whole)


def _readable(chunks: Iterable[bytes], whole: bool) -> bool:
    """Whether the bytes are UTF-8 of which nearly all is printable."""
    n = odd = 0
    try:
        for text in _texts(chunks, whole):
            n += len(text)
            plain = text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable()
            odd += 0 if plain else sum(not (c.isprintable() or c in "\n\r\t") for c in text)
    except UnicodeDecodeError:
        return False
    return n > 0 and odd * 20 <= n


def _pieces(texts: Iterable[str]) -> Iterator[str]:
    """The texts as one, cut only where no match, run or escape can go across, if there is such a place."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            whole = "".join(held)
            if breaks := [m.end() for m in SAFE_BREAK.finditer(whole)]:
                yield whole[: breaks[-1]]
                whole = whole[breaks[-1] :]
            held, size = [whole], 0
    if rest := "".join(held):
        yield rest


def _opened(head: bytes):
    """The decompressor for bytes that begin like this, or None."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _inflated(chunks: Iterable[bytes], used: list[int] | None = None) -> Iterator[bytes]:
    """All members of compressed bytes one after the other, in pieces; ends at what is no member or is broken.

    `used` gets the number of bytes that were read up to the end of the last member.
    """
    opened, held, taken, source = None, b"", 0, iter(chunks)
    while True:
        if opened is None:
            while len(held) < 6 and (more := next(source, None)) is not None:
                held += more
            if taken:
                taken += len(held) - len(held := held.lstrip(b"\0"))
            if (opened := _opened(held)) is None:
                return
        if not held and (held := next(source, b"")) == b"":
            return
        # of zstd only the input can be bounded
        limit = 1 << 16 if isinstance(opened, (_ZLIB, bz2.BZ2Decompressor, lzma.LZMADecompressor)) else 256
        piece, held = held[:limit], held[limit:]
        try:
            if isinstance(opened, _ZLIB):
                out = opened.decompress(piece, PIECE)
                back = opened.unused_data if opened.eof else opened.unconsumed_tail
            elif limit > 256:
                out = opened.decompress(piece, PIECE)
                while out and not opened.eof and not opened.needs_input:
                    yield out
                    out = opened.decompress(b"", PIECE)
                back = opened.unused_data if opened.eof else b""
            else:
                out = opened.decompress(piece)
                back = opened.unused_data if opened.eof else b""
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, RuntimeError):
            return
        except Exception as error:
            if type(error).__name__ == "ZstdError":
                return
            raise
        taken += len(piece) - len(back)
        held = back + held
        if used is not None:
            used[0] = taken
        if out:
            yield out
        if opened.eof:
            opened = None


def _unpacked(data: bytes) -> tuple[Callable[[], Iterable[bytes]], int]:
    """The bytes without their layers of compression, as a function that reads them anew, and the number of layers."""
    source, depth, seen = lambda: iter([data]), 0, set()
    while True:
        inner = lambda outer=source: _inflated(outer())
        digest, size = hashlib.blake2b(), 0
        for chunk in inner():
            digest.update(chunk)
            size += len(chunk)
        if not size or digest.digest() in seen:
            return source, depth
        seen.add(digest.digest())
        source, depth = inner, depth + 1


def _layers(data: bytes, span: tuple[int, int], path: str, least: int = 0, places: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[Layer]:
    """The text in the bytes, of at least so many layers of compression, piece by piece; places: the span of each byte, if it isn't compressed."""
    source, depth = _unpacked(data)
    if depth >= least and _readable(source(), depth == 0):
        starts = ends = None
        if depth == 0 and places is not None:
            # the bytes of a character: its first one and those that go on from it
            first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            starts, ends = places()
            starts, ends = starts[first], ends[np.append(first[1:], len(data)) - 1]
        at = 0
        for text in _pieces(_texts(source(), depth == 0)):
            mine = slice(at, at := at + len(text))
            yield Layer(text, span, None if starts is None else starts[mine], None if ends is None else ends[mine], path + "+inflate" * depth)


def _substituted(layer: Layer, found: list[tuple[int, int, str]], name: str) -> Layer:
    """The layer with parts replaced; each new character carries the span of what it replaces."""
    starts, ends = layer.places()
    out, parts, last = [], [], 0
    for start, end, text in found:
        out += [layer.text[last:start], text]
        parts += [(starts[last:start], ends[last:start]), (np.full(len(text), starts[start], np.int32), np.full(len(text), ends[end - 1], np.int32))]
        last = end
    out.append(layer.text[last:])
    parts.append((starts[last:], ends[last:]))
    return Layer("".join(out), layer.span, *map(np.concatenate, zip(*parts)), f"{layer.path}/{name}")


def _original(layer: Layer, start: int, end: int) -> tuple[int, int]:
    if layer.path == "":
        return start, end
    if layer.starts is None:
        return layer.span
    return int(layer.starts[start]), int(layer.ends[end - 1])


def _url(layer: Layer) -> Layer | None:
    found = []
    for m in URL_ESCAPE.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        found.append((m.start(), m.end(), data.decode("utf-8", "replace")))
    return _substituted(layer, found, "url") if found else None


def _unicode(layer: Layer) -> Layer | None:
    found = []
    for m in UNICODE_ESCAPE.finditer(layer.text):
        digits = next(g for g in m.groups() if g)
        code = int(digits, 10 if m.lastindex == 6 else 16)
        if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            found.append((m.start(), m.end(), chr(code)))
    return _substituted(layer, found, "unicode") if found else None


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Base64 runs and the lines that they are made of: of one line, and of the lines of wrapped ones joined.

    Lines that were wrapped together are of one length but for the last, which may also be a word
    of what follows; a chain of lines of other lengths is tried as one too.
    """
    for m in BASE64.finditer(text):
        yield m[0], [m.span()]
    for m in WRAPPED.finditer(text):
        lines = [(k.start() + m.start(), k.end() + m.start()) for k in re.finditer(r"[^\s]+", m[0])]
        sizes = [len(text[a:b].rstrip("=")) for a, b in lines]
        tried, i = {(0, len(lines))}, 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and sizes[j] == sizes[i]:
                j += 1
            tried.add((i, j))
            if j < len(lines) and sizes[j] < sizes[i]:
                tried.add((i, j + 1))
            i = j
        for i, j in sorted(tried):
            if j - i > 1 and sum(sizes[i:j]) >= LEAST_ENCODED:
                yield "".join(text[a:b] for a, b in lines[i:j]), lines[i:j]


def _encoded(layer: Layer) -> Iterator[Layer]:
    """Texts in base64: plain, with the span of the characters that each byte comes from, or compressed, with that of the run."""
    for found, lines in _runs(layer.text):
        run = found.rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            run = run[:-1]
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4))
        except (binascii.Error, ValueError):
            continue

        def places(lines=lines, n=len(data)):
            at, byte = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in lines]), np.arange(n)
            first, last = at[byte * 8 // 6], at[(byte * 8 + 7) // 6]
            if layer.path == "":
                return first, last + 1
            starts, ends = layer.places()
            return starts[first], ends[last]

        yield from _layers(data, _original(layer, lines[0][0], lines[-1][1]), f"{layer.path}/base64", places=places)


def _raw(layer: Layer, name: str, escape: re.Pattern, value: Callable[[re.Match], int], plus: bool = False) -> Iterator[Layer]:
    """Texts in compressed bytes that are written with escapes, other bytes as the characters they are."""
    for start, end in ((m.start(), m.end()) for m in re.finditer(r"[\x00-\x09\x0b-\x7f]+", layer.text)):
        data, at, last = bytearray(), [], start
        for m in escape.finditer(layer.text, start, end):
            if (byte := value(m)) > 255:
                continue
            between = layer.text[last : m.start()]
            data += (between.replace("+", " ") if plus else between).encode("ascii")
            at += range(last, m.start())
            data.append(byte)
            at.append(m.start())
            last = m.end()
        if not at or last == start:
            continue
        between = layer.text[last:end]
        data += (between.replace("+", " ") if plus else between).encode("ascii")
        at += [*range(last, end), end]
        place, view = 0, bytes(data)
        after = lambda i: (view[k : k + 4096] for k in range(i, len(view), 4096))
        while (m := MAGIC.search(view, place)) is not None:
            used, size, place = [0], 0, m.start() + 1
            for chunk in _inflated(after(m.start()), used):
                size += len(chunk)
            if not size:
                continue
            stop = m.start() + used[0]
            yield from _layers(view[m.start() : stop], _original(layer, at[m.start()], at[stop]), f"{layer.path}/{name}", 1)


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers right under this one."""
    yield from _encoded(layer)
    if "%" in layer.text:
        if (new := _url(layer)) is not None:
            yield new
            for plus in (False, True)[: 1 + ("+" in layer.text)]:
                yield from _raw(layer, "url", re.compile("%([0-9A-Fa-f]{2})"), lambda m: int(m[1], 16), plus)
    if "\\" in layer.text or "&#" in layer.text:
        if (new := _unicode(layer)) is not None:
            yield new
            yield from _raw(layer, "unicode", _BYTES, lambda m: _SIMPLE[m[7]] if m[7] else int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base matches of the text, and those that decoded layers add: (kind, start, end[, path]) in code points of the original.

    The worklist holds layers not yet read, made as they are wanted. A layer is a whole text with
    its escapes replaced, or a piece of what a base64 run or compressed bytes hold; each is scanned
    and unwrapped in turn. What lies in compressed bytes has the span of their whole run, anything
    else that of its own characters. Layers of equal text and place are read once, so decoding that
    leads back to an earlier layer ends.
    """
    if not text:
        return [], []
    base = list(base_matches(text))
    known, more = set(base), []
    work, seen = [iter([Layer(text, (0, len(text)), None, None, "")])], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span)) in seen:
            continue
        seen.add(key)
        if layer.path:
            for kind, start, end in base_matches(layer.text):
                at = (kind, *_original(layer, start, end))
                if at not in known:
                    known.add(at)
                    more.append((*at, layer.path))
        work.append(_inner(layer))
    return base, more


def _rank(match: tuple) -> tuple[int, int, int]:
    return match[1], KINDS.index(match[0]), match[2]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, decoded) for each row: arrays of (kind, start, end) and (kind, start, end, path), by start, then kind.

    Spans are code points of the original text, end exclusive; path names the layers a match lay
    under. Null and empty texts have empty arrays. Every input row gives one row; only id and text
    are read. One pass, no shuffle.
    """
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    base_type, more_type = pa.list_(pa.struct(fields)), pa.list_(pa.struct([*fields, ("path", pa.string())]))

    def run(batches):
        for batch in slices(batches):
            found = [scan(t) for t in batch.column("text").to_pylist()]
            base = [[dict(zip(("kind", "start", "end"), m)) for m in sorted(b, key=_rank)] for b, _ in found]
            more = [[dict(zip(("kind", "start", "end", "path"), m)) for m in sorted(d, key=_rank)] for _, d in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, base_type), pa.array(more, more_type)], ["doc_id", "base", "decoded"])

    span = "kind:string,start:int,end:int"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base array<struct<{span}>>, decoded array<struct<{span},path:string>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The result of find_secrets() in counts, a digest of the base spans and the list of all spans."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    rank = lambda m: F.when(m["kind"] == "assign", 0).when(m["kind"] == "access", 1).otherwise(2)
    written = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    every = F.array_sort(F.concat(F.transform("base", lambda m: F.struct(m["start"].alias("start"), rank(m).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"))), F.transform("decoded", lambda m: F.struct(m["start"].alias("start"), rank(m).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind")))))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"), written(every).alias("spans"), F.size("decoded").cast("long").alias("n_decoded"),
    )
