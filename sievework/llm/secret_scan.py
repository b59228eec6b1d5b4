"""Secret scan with recursive decoding.

Every text is layer 0 of a worklist. A layer is scanned for secrets, then unwrapped: percent-encoding, Unicode escapes
(\\uXXXX, \\xXX, &#NN;), NUL bytes of UTF-16, base64 runs and compressed data (gzip, zlib, bzip2, xz, zstd, also several
streams in a row) each give further layers, until no layer is new. A layer of the same content and place as an earlier one
isn't taken again, so a stream that decompresses to itself ends. The worklist is a stack, not a recursion: depth costs
time. Each character of a layer carries the span of the document that it came from; what a compressed layer holds maps to
the whole blob.

Decompressed data of up to KEEP bytes are held. Larger ones are read as a stream, through all decompressors down to the
document, in windows of WINDOW bytes that end where nothing which is sought can span; LONGEST_RUN bytes without such a place
are read as a stretch. A stream in such data that ends, or is found damaged, within OVERLAP bytes is read at its place. So a bomb costs time, not memory; each nested
level of more than KEEP bytes keeps one decompressor open.

Cases: a null text is an empty one; an empty text has no spans; damaged or cut streams are read as far as they are sound;
repeated rows give repeated results; extra columns are ignored by `scan_secrets` and kept by `redact_secrets`; an empty
table gives an empty table.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import columns_only, map_rows, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f]+ are maximal, so those of 16 and more are what a filter on length leaves.
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: The two-byte headers of zlib: method 8, a window of up to 32 K, no preset dictionary, and the check sum.
ZLIB = tuple(bytes((method, flags)) for method in range(0x08, 0x80, 0x10) for flags in range(256) if (256 * method + flags) % 31 == 0 and not flags & 0x20)
MAGIC = (b"\x1f\x8b", *ZLIB, b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
MAGIC_AT = re.compile(b"|".join(map(re.escape, MAGIC)))


def _percent_coded(head: bytes) -> str:
    """A pattern for bytes as URLs write them. Two plain characters must be near an encoded one, as compressed data are."""
    plain = [33 <= b < 127 and chr(b) not in "%&+#?/" for b in head]
    each = "".join(f"(?:%(?i:{b:02x})|{re.escape(chr(b))})" if p else f"%(?i:{b:02x})" for b, p in zip(head, plain))
    return each + ("(?=[^%\\s]{0,6}%[0-9A-Fa-f]{2})" if all(plain) else "")


PERCENT_PACKED = re.compile("(?:" + "|".join(map(_percent_coded, (b"\x1f\x8b", *ZLIB, b"\x28\xb5", b"\xfd7zXZ"))) + "|BZh)[!-~]*")
ESCAPES = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
    r"|\\([0-3][0-7]{2})|\\([nrtbf/\"'])|&([A-Za-z][A-Za-z0-9]{1,31});"
)
#: The characters that a backslash and a letter stand for in JSON and source code.
SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "/": "/", '"': '"', "'": "'"}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: From one line of wrapped base64 to the next, which may be indented or behind a backslash; and a shorter last line.
LINE_BREAK, LAST_LINE = re.compile(r"\\*\r?\n[ \t]*"), re.compile(r"\\*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Where bytes aren't text, all that a pattern can match is in runs of printable ASCII, one or two bytes (UTF-16) a character.
RUNS, WIDE_RUNS = re.compile(rb"[\t\n\r -~]{12,}"), re.compile(rb"(?:\0[\t\n\r -~]){11,}")
URL_SAFE = str.maketrans("-_", "+/", "\r\n=")
#: Decompressed bytes that are held as a whole; of larger ones the bytes of a window, what is held ahead of a stream's start, and the longest run kept whole.
KEEP, WINDOW, OVERLAP, LONGEST_RUN = 4 << 20, 1 << 20, 64 << 10, 16 << 20
#: Compressed bytes handed to a decompressor at once: damage costs at most what they hold; and bytes that it gives at once.
FEED, GIVE = 1 << 10, 1 << 20
#: Places that no pattern and no encoding spans: between plain words, behind what is no base64 at the end of a line, at a blank line,
#: between two NULs, and at bytes that aren't printable ASCII.
_CUT = re.compile(rb"""\x20(?=[A-Za-z0-9])(?<=[^%\\&;]{12}[A-Za-z0-9]\x20)|[.,!?)\]}"']\r?\n|\n(?=\r?\n)|\0(?=\0)|[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]|[\x80-\xff](?=[\x00-\x7f])""")


def find(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of each match that passes its length rule."""
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield m.start(), "assign", m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield m.start(), "access", m.end()
    for m in HEX.finditer(text):
        yield m.start(), "hex", m.end()


class Layer:
    """A text and, for each of its characters, the span of the document behind it (None: the document itself; a single span
    for all where they come from one blob)."""

    __slots__ = ("text", "lo", "hi", "path")

    def __init__(self, text: str, lo: list[int] | int | None, hi: list[int] | int | None, path: str):
        self.text, self.lo, self.hi, self.path = text, lo, hi, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        return (self.lo, self.hi) if isinstance(self.lo, int) else (self.lo[start], self.hi[end - 1])

    def key(self) -> tuple:
        return "text", _hash(self.text.encode("utf-8", "surrogatepass")), self.span(0, len(self.text))

    def child(self, parts: list[tuple[str, int, int]], step: str) -> Layer:
        """parts: a character or an unchanged stretch, and where in this layer it comes from."""
        path = f"{self.path}>{step}" if self.path else step
        if isinstance(self.lo, int):
            return Layer("".join(s for s, _, _ in parts), self.lo, self.hi, path)
        text, lo, hi = [], [], []
        for s, start, end in parts:
            text.append(s)
            if len(s) == end - start:
                spans = [self.span(i, i + 1) for i in range(start, end)]
            else:
                spans = [self.span(start, end)] * len(s)
            lo += [x for x, _ in spans]
            hi += [y for _, y in spans]
        return Layer("".join(text), lo, hi, path)


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _percent(layer: Layer) -> Layer | None:
    parts, at, changed = [], 0, False
    for m in PERCENT.finditer(layer.text):
        try:
            chars, wide = bytes.fromhex(m[0].replace("%", "")).decode(), True
        except UnicodeDecodeError:
            # What is sought is ASCII: other bytes stand for themselves.
            chars, wide = bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), False
        parts.append((layer.text[at : m.start()], at, m.start()))
        at, changed = m.start(), True
        for c in chars:
            parts.append((c, at, at := at + 3 * (len(c.encode()) if wide else 1)))
    if not changed:
        return None
    return layer.child([*parts, (layer.text[at:], at, len(layer.text))], "url")


def _escaped(m: re.Match) -> str | int | None:
    """What an escape stands for: text, a code point, or None where it is no escape."""
    u4, braced, u8, x2, dec, hexa, octal, short, name = m.groups()
    if name is not None:
        return html5.get(f"{name};")
    if short is not None:
        return SHORT[short]
    if octal is not None:
        return int(octal, 8)
    return int(dec) if dec is not None else int(u4 or braced or u8 or x2 or hexa, 16)


def _escapes(layer: Layer) -> Layer | None:
    parts, at = [], 0
    high: tuple[int, int] | None = None
    for m in ESCAPES.finditer(layer.text):
        code = _escaped(m)
        if code is None:
            continue
        parts.append((layer.text[at : m.start()], at, m.start()))
        at = m.end()
        if isinstance(code, str):
            parts += [(c, m.start(), at) for c in code]
        elif 0xD800 <= code < 0xDC00:
            high = (code, m.start())
        elif 0xDC00 <= code < 0xE000 and high and high[1] + 6 == m.start():
            parts.append((chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], at))
        elif code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((chr(code), m.start(), at))
    if not at:
        return None
    return layer.child([*parts, (layer.text[at:], at, len(layer.text))], "unicode")


def _without_nul(layer: Layer) -> Layer | None:
    """UTF-16 of ASCII, in either order of bytes, read as such."""
    kept = [(c, i, i + 1) for i, c in enumerate(layer.text) if c != "\0"]
    return layer.child(kept, "utf-16") if kept else None


class _Zstd:
    """zstandard's decompressor behind the interface of those of the standard library."""

    def __init__(self):
        import zstandard

        self.error, self.d = zstandard.ZstdError, zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()

    eof = property(lambda self: self.d.eof)
    unused_data = property(lambda self: self.d.unused_data)

    def decompress(self, data: bytes, most: int) -> bytes:
        try:
            return self.d.decompress(data) if data else b""
        except self.error as e:
            raise ValueError(str(e)) from None


def _opened(head: bytes):
    """A decompressor for data that start so."""
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if head.startswith(b"\xfd7zXZ\x00"):
        return lzma.LZMADecompressor(memlimit=1 << 28)
    if head.startswith(b"\x28\xb5\x2f\xfd"):
        return _Zstd()
    return zlib.decompressobj(47) if head.startswith(MAGIC) else None


class Stream:
    """A compressed stream that begins `skip` bytes into its input, and those right behind it."""

    def __init__(self, skip: int):
        self.skip, self.input, self.at, self.d = skip, b"", 0, None
        self.last = self.ended = False  # no more input comes; no more output comes
        self.used, self.end = skip, 0  # bytes of input taken; where the last stream that is whole ends

    def feed(self, data: bytes) -> None:
        cut = min(self.skip, len(data))
        self.skip -= cut
        self.input, self.at = self.input[self.at :] + data[cut:], 0

    def take(self) -> bytes:
        """Some bytes of output; none if more input is needed or the stream has ended."""
        try:
            while not self.ended:
                if self.d is None:
                    if len(self.input) - self.at < 6 and not self.last:
                        return b""
                    self.d = _opened(self.input[self.at : self.at + 6])
                    if self.d is None:
                        break
                needed = getattr(self.d, "needs_input", True) is not False
                if needed and not self.last and len(self.input) - self.at < FEED:
                    return b""  # the same portions, however the input comes: damage costs what its portion holds
                part = self.input[self.at : self.at + FEED] if needed else b""
                self.at += len(part)
                self.used += len(part)
                out = self.d.decompress(part, GIVE)
                back = len(getattr(self.d, "unconsumed_tail", b"") or b"")
                if self.d.eof:
                    back = len(self.d.unused_data or b"")
                    self.d = None
                self.at -= back
                self.used -= back
                if self.d is None:
                    self.end = self.used
                if out:
                    return out
                if not part and self.d is not None:
                    self.ended = self.last
                    return b""
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
            pass
        self.ended = True
        return b""


class Content:
    """What the streams at `places`, each within the content of the one before it, make of `data`."""

    def __init__(self, data: bytes, places: tuple[int, ...]):
        self.stages = [Stream(skip) for skip in places]
        self.stages[0].feed(data)
        self.stages[0].last = True

    def __iter__(self) -> Iterator[bytes]:
        top = i = len(self.stages) - 1
        while True:
            stage = self.stages[i]
            if out := stage.take():
                if i == top:
                    yield out
                else:
                    i += 1
                    self.stages[i].feed(out)
            elif stage.ended or stage.last:
                if i == top:
                    return
                i += 1
                self.stages[i].last = True
            else:
                i -= 1


class Blob:
    """Bytes whose text and compressed streams are still to be read."""

    __slots__ = ("data", "lo", "hi", "path")

    def __init__(self, data: bytes, span: tuple[int, int], path: str):
        self.data, (self.lo, self.hi), self.path = data, span, path

    def key(self) -> tuple:
        return "bytes", _hash(self.data), (self.lo, self.hi)


def _inside(blob: Blob, seen: set) -> Iterator:
    """The text of a blob, then its compressed streams."""
    data, span, path, blob.data = blob.data, (blob.lo, blob.hi), blob.path, b""
    yield from _read(data, span, path)
    starts = [m.start() for m in MAGIC_AT.finditer(data)]
    if starts:
        later = _streams(data, (), starts, span, path, seen)
        del data
        yield later


def _streams(data: bytes, places: tuple[int, ...], starts: list[int], span: tuple[int, int], path: str, seen: set) -> Iterator:
    """What the compressed streams hold that begin at `starts` in the content of the streams at `places`."""
    step = f"{path}>compressed".lstrip(">")
    free, k = 0, 0
    while k < len(starts):
        at = starts[k]
        k += 1
        if at < free:
            continue  # within a stream that was read whole
        content = Content(data, (*places, at))
        pieces, size, whole = [], 0, iter(content)
        for piece in whole:
            pieces.append(piece)
            size += len(piece)
            if size > KEEP:
                break
        if size > KEEP:
            yield _windows(data, (*places, at), pieces, whole, span, step, seen)
        elif size:
            free = content.stages[-1].end
            del content, whole
            blob = Blob(b"".join(pieces), span, step)
            del pieces
            if k == len(starts):
                data = b""
            yield blob


def _cut(held: bytes, start: int) -> int | None:
    """The last place behind `start` that nothing which is sought spans."""
    for lo in (len(held) - 4096, len(held) - OVERLAP, start):
        last = None
        for last in _CUT.finditer(held, max(lo, start)):
            pass
        if last or lo <= start:
            return last and last.end()


def _tried(data: bytes, last: bool) -> tuple[bytes, int] | None:
    """What the stream that begins these data gives, as far as it is sound, and where its last whole member ends; None if more
    than these data decide that, or if it gives more than is held. last: no data follow."""
    s, pieces, size = Stream(0), [], 0
    s.feed(data)
    s.last = last
    while out := s.take():
        pieces.append(out)
        size += len(out)
        if size > KEEP:
            return None
    return (b"".join(pieces), s.end) if s.ended or last else None


def _windows(data: bytes, places: tuple[int, ...], pieces: list[bytes], more: Iterator[bytes], span: tuple[int, int], path: str, seen: set) -> Iterator:
    """The text of large content, window by window, and the streams that end near their start; then its other compressed streams,
    unless the same content was read before."""
    step = f"{path}>compressed".lstrip(">")
    digest, starts, done, held, need = hashlib.blake2b(digest_size=16), [], 0, b"", WINDOW + OVERLAP  # done: bytes before `held`
    read = sought = free = 0  # up to where text was read and streams were looked for; the end of the last stream that was read whole

    def blobs(stop: int, last: bool) -> Iterator[Blob]:
        nonlocal sought, free
        for m in MAGIC_AT.finditer(held, max(0, sought - done)):
            at = m.start()
            if at >= stop:
                break
            sought = done + m.end()
            if done + at < free:
                continue
            got = _tried(held[at : at + OVERLAP], last and at + OVERLAP >= len(held))
            if got is None:
                starts.append(done + at)
            elif got[0]:
                free = done + at + got[1]
                yield Blob(got[0], span, step)

    for piece in chain(pieces, more):
        digest.update(piece)
        held += piece
        if len(held) < need:
            continue
        stop = _cut(held, read - done)
        if stop is None:
            if done + len(held) - read < LONGEST_RUN:
                need = len(held) + WINDOW
                continue
            stop = len(held)
        yield from _read(held[read - done : stop], span, path)
        read = done + stop
        keep = min(stop, len(held) - OVERLAP)
        yield from blobs(keep, False)
        held, done = held[keep:], done + keep
        need = max(WINDOW + OVERLAP, len(held) + OVERLAP)
    yield from _read(held[read - done :], span, path)
    yield from blobs(len(held), True)
    key = ("bytes", digest.digest(), span)
    if key not in seen:
        seen.add(key)
        if starts:
            yield _streams(data, places, starts, span, path, seen)


def _as_text(data: bytes) -> str | None:
    """The text that the bytes are, if they are UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(text) else text


def _runs(data: bytes) -> Iterator[tuple[str, range]]:
    """The runs of printable characters in bytes that aren't text, with the places of their characters."""
    for m in RUNS.finditer(data):
        yield m[0].decode(), range(m.start(), m.end())
    for m in WIDE_RUNS.finditer(data):
        # With the low byte first, the run's first character lies before its first NUL.
        start = m.start() - 1 if m.start() and data[m.start() - 1] in b"\t\n\r" + bytes(range(32, 127)) else m.start() + 1
        yield data[start : m.end() : 2].decode(), range(start, m.end(), 2)


def _read(data: bytes, span: tuple[int, int], path: str) -> Iterator[Layer]:
    """The layers of bytes that all come from one span."""
    if (text := _as_text(data)) is not None:
        yield Layer(text, *span, path)
    else:
        yield from (Layer(run, *span, path) for run, _ in _runs(data))


def base64_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches of base64, each one or more pieces (start, end). Lines of one width, whatever it is, with a shorter last line are
    one stretch; where a single line is followed by a shorter one, both readings are given."""
    lines: list[tuple[int, int]] = []

    def ended() -> Iterator[list[tuple[int, int]]]:
        last, width = lines[-1][1], lines[0][1] - lines[0][0]
        tail = None if text[last - 1] == "=" else LAST_LINE.match(text, last)
        if tail and tail.end(1) - tail.start(1) <= width:
            yield [*lines, tail.span(1)]
        if len(lines) == 1 or not tail:
            yield list(lines)

    for m in BASE64.finditer(text):
        if lines:
            start, end = lines[-1]
            gap = LINE_BREAK.match(text, end)
            if m.end() - m.start() == end - start and text[end - 1] != "=" and gap and gap.end() == m.start():
                lines.append(m.span())
                continue
            yield from ended()
        lines = [m.span()]
    if lines:
        yield from ended()


def _base64(layer: Layer, seen: set) -> Iterator:
    """Each run is read from its first four characters on, as what stands before the data may be part of the run."""
    path = f"{layer.path}>base64" if layer.path else "base64"
    for pieces in base64_runs(layer.text):
        first, last = pieces[0][0], pieces[-1][1]
        chars = "".join(layer.text[a:b] for a, b in pieces).translate(URL_SAFE)
        places = range(first, first + len(chars)) if len(pieces) == 1 else [i for a, b in pieces for i in range(a, b)][: len(chars)]
        for skip in (0, 1, 2, 3):
            part = chars[skip:]
            if len(part) % 4 == 1:
                part = part[:-1]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            span = layer.span(first, last)
            if starts := [x.start() for x in MAGIC_AT.finditer(data)]:
                yield _streams(data, (), starts, span, path, seen)
            if isinstance(layer.lo, int):
                yield from _read(data, span, path)
                continue
            if (text := _as_text(data)) is None:
                found = [(run, at, [1] * len(run)) for run, at in _runs(data)]
            else:
                wide = [len(c.encode()) for c in text] if len(text) < len(data) else [1] * len(text)
                found = [(text, accumulate([0, *wide]), wide)]
            for run, at, wide in found:
                ends = [layer.span(places[skip + k * 8 // 6], places[skip + ((k + w) * 8 - 1) // 6] + 1) for k, w in zip(at, wide)]
                yield Layer(run, [x for x, _ in ends], [y for _, y in ends], path)


def _percent_packed(layer: Layer, seen: set) -> Iterator:
    for m in PERCENT_PACKED.finditer(layer.text):
        data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[0].encode())
        if data.startswith(MAGIC):
            yield _streams(data, (), [0], layer.span(m.start(), m.end()), f"{layer.path}>url".lstrip(">"), seen)


def unwrapped(layer: Layer, seen: set) -> Iterator:
    """The layers right below this one, and iterators over those in its compressed data."""
    t = layer.text
    if "%" in t:
        if PERCENT.search(t) and (x := _percent(layer)):
            yield x
        yield from _percent_packed(layer, seen)
    if "\0" in t and (x := _without_nul(layer)):
        yield x
    if ("\\" in t or "&" in t) and (x := _escapes(layer)):
        yield x
    yield from _base64(layer, seen)


def scan(text: str) -> tuple[list[tuple[int, str, int]], dict[tuple[int, str, int], str], int]:
    """The text's own spans; further ones of its layers, each with the path of decodings; the number of layers below."""
    root = Layer(text, None, None, "")
    base = sorted(find(text), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    more: dict[tuple[int, str, int], str] = {}
    known, seen, n = set(base), {root.key()}, 0
    work: list[Iterator] = [unwrapped(root, seen)]
    while work:
        item = next(work[-1], None)
        if item is None:
            work.pop()
        elif not isinstance(item, (Layer, Blob)):
            work.append(item)
        elif isinstance(item, Layer) and not item.text or (key := item.key()) in seen:
            continue
        else:
            seen.add(key)
            if isinstance(item, Blob):
                work.append(_inside(item, seen))
                continue
            n += 1
            for start, kind, end in find(item.text):
                lo, hi = item.span(start, end)
                if (lo, kind, hi) not in known:
                    more.setdefault((lo, kind, hi), item.path)
            work.append(unwrapped(item, seen))
    return base, more, n


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, decoded string, n_layers long"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string()), ("decoded", pa.string()), ("n_layers", pa.int64())])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per document: counts and spans of the text itself, all spans, and for the further ones
    `kind:start:end:path`. Spans are in code points, the end exclusive."""

    def rows(it):
        for doc_id, text in it:
            base, more, n = scan(text or "")
            counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
            decoded = ",".join(f"{k}:{s}:{e}:{p}" for (s, k, e), p in sorted(more.items()))
            yield doc_id, *counts, _joined(base), _joined([*base, *more]), decoded, n

    return map_rows(columns_only(docs, "doc_id", "text"), rows, RESULT, RESULT_ARROW)


def redact(text: str, mask: str) -> str:
    base, more, _ = scan(text)
    out, at = [], 0
    for start, _, end in sorted([*base, *more]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span, plain or decoded, replaced by the mask; n_chars follows the new text."""
    schema = docs.schema
    names = [f.name for f in schema]
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                old = b.column(text_at).to_pylist()
                new = [None if t is None else redact(t, mask) for t in old]
                columns = list(b.columns)
                columns[text_at] = pa.array(new, type=b.schema.field(text_at).type)
                if chars_at is not None:
                    counts = b.column(chars_at).to_pylist()
                    columns[chars_at] = pa.array([n if a == t or t is None else len(t) for a, t, n in zip(old, new, counts)], type=b.schema.field(chars_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "decoded", "n_layers")


def brute_base(text: str) -> list[tuple[int, str, int]]:
    """The contract's patterns as they stand, for tests."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
