"""Secrets in texts, also inside encoded layers, by a worklist that unwraps layer after layer.

A layer is a text and the way back from its characters to the document. Every layer is scanned; then its URL
escapes, Unicode escapes, base64 and hexadecimal runs, and compressed content are unwrapped to further layers, until
no new layer appears. A layer whose text has been seen on the way to it is not unwrapped again, so content that
unwraps to itself ends. What is found in a layer is reported at the characters of the document that encode it.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, product

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from flowsift.llm.common import fresh, text_of, with_new

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ASSIGN_WORDS = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are taken whole, so asking for the length at once finds the same ones
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

#: The shortest secret has 16 characters, which are 22 in base64 and 32 in hexadecimal digits.
BASE64_LEAST = 22
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
BASE64_PARTS = (re.compile(r"[A-Za-z0-9+/]{22,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{22,}={0,2}"))
#: Runs of one alphabet on following lines; a line may also end in an escaped line feed.
BASE64_LINES = tuple(
    re.compile(rf"(?<![{a}])[{a}]{{4,}}+(?:[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t>#*;]*[{a}]++)+={{0,2}}") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-")
)
TEXT_BEFORE = re.compile(r"[^\s>#*;][\t ]*\Z")
MORE_TEXT = re.compile(r"[ \t]+[^\s]")
BASE64_BREAK = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t>#*;]*")
HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")

#: Characters that are parted by zero bytes, as in UTF-16 and UTF-32 of ASCII text.
WIDE_RUN = re.compile(r"[^\0](?:\0(?:\0\0)?[^\0]){15,}")
WIDE_CHARACTER = re.compile(r"[^\0]\0*")
#: Escaped bytes with the plain ones among them, and how compressed content begins.
URL_BYTES = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]")
URL_MIXED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/-])+")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|.")
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")

#: Unpacked content is scanned in windows of this many bytes, each repeating the end of the one before, from the start of a
#: run that goes on. Runs of more than ``CARRIED`` bytes are cut, so that memory stays bounded.
WINDOW, REPEATED, CARRIED = 1 << 22, 1 << 12, 1 << 26
#: Backwards: a run that reaches the end, in lines if it is wrapped.
GOES_ON = re.compile(rb"[A-Za-z0-9+/_=%\\&#;{}-]*+(?:[ \t>*]*+(?:\n\r?|\r)[ \t]*+[A-Za-z0-9+/_=%\\&#;{}-]{4,}+(?=[\s>#*;:\"'-]|\Z))*+")

Span = tuple[int, int]


@dataclass
class Layer:
    """A text; per segment its first character, the span that encodes it in the parent, and whether it is a plain copy."""

    text: str
    parent: Layer | None = None
    firsts: list[int] = field(default_factory=list)
    sources: list[tuple[int, int, bool]] = field(default_factory=list)
    seen: frozenset[bytes] = frozenset()

    def place(self, start: int, end: int) -> Span:
        """Span in the document that encodes the characters from ``start`` to ``end``."""
        if self.parent is None:
            return start, end
        first, last = (bisect.bisect_right(self.firsts, at) - 1 for at in (start, max(start, end - 1)))
        low, _, copied = self.sources[first]
        begin = low + (start - self.firsts[first] if copied else 0)
        low, high, copied = self.sources[last]
        return self.parent.place(begin, low + (end - self.firsts[last]) if copied else high)


def matches(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the secrets spelled out in a text, per kind leftmost and without overlap."""
    if ASSIGN_WORDS.search(text):
        for found in ASSIGN.finditer(text):
            if found.end(2) - found.start(2) >= ASSIGN_VALUE:
                yield found.start(), found.end(), "assign"
    if "AKIA" in text:
        for found in ACCESS.finditer(text):
            if found.end() - found.start() >= ACCESS_LENGTH:
                yield found.start(), found.end(), "access"
    for found in HEX.finditer(text):
        yield found.start(), found.end(), "hex"


def replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Iterator[Layer]:
    """The layer with the pieces (start, end, decoded text) put in place of what encodes them."""
    if not pieces:
        return
    out, firsts, sources, done, length = [], [], [], 0, 0
    for start, end, decoded in [*pieces, (len(layer.text), len(layer.text), "")]:
        for text, source in ((layer.text[done:start], (done, start, True)), (decoded, (start, end, False))):
            if text:
                out.append(text)
                firsts.append(length)
                sources.append(source)
                length += len(text)
        done = end
    if firsts:
        yield Layer("".join(out), layer, firsts, sources)


def readable(data: bytes) -> str | None:
    """The text of decoded bytes, unless they hold control characters or aren't UTF-8: such may be packed."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c >= " " or c in "\t\n\r" for c in text) else None


def url_layers(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for run in URL_RUN.finditer(layer.text):
        data = bytes.fromhex(run.group().replace("%", ""))
        if data.isascii():
            pieces += [(run.start() + 3 * i, run.start() + 3 * i + 3, chr(b)) for i, b in enumerate(data)]
        else:
            pieces.append((run.start(), run.end(), data.decode("utf-8", "replace")))
    yield from replaced(layer, pieces)


def url_packed_layers(layer: Layer) -> Iterator[Layer]:
    """Layers of compressed bytes that are URL escapes, but for those that need none."""
    if not URL_BYTES.search(layer.text):
        return
    for run in URL_MIXED.finditer(layer.text):
        if not URL_BYTES.search(run.group()):
            continue
        marks = list(URL_BYTE.finditer(layer.text, *run.span()))
        data = bytes(int(m.group(1), 16) if m.group(1) else ord(m.group()) for m in marks)
        done = 0
        for begin in PACKED.finditer(data):
            if begin.start() < done:
                continue
            for window in unpacked(data[begin.start() :]):
                done = len(data)
                yield Layer(window.decode("utf-8", "replace"), layer, [0], [(marks[begin.start()].start(), run.end(), False)])


def wide_layers(layer: Layer) -> Iterator[Layer]:
    if "\0" not in layer.text:
        return
    pieces = []
    for run in WIDE_RUN.finditer(layer.text):
        pieces += [(found.start(), found.end(), found.group()[0]) for found in WIDE_CHARACTER.finditer(layer.text, *run.span())]
    yield from replaced(layer, pieces)


def unicode_layers(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    pieces = []
    for found in UNICODE_ESCAPE.finditer(layer.text):
        decimal = found.group(6)
        code = int(decimal) if decimal else int(next(g for g in found.groups() if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((found.start(), found.end(), chr(code)))
    yield from replaced(layer, pieces)


def unpacked_chunks(data: bytes) -> Iterator[bytes]:
    """The content of compressed data, member after member, as far as it can be unpacked; none for other data."""
    while data:
        if data[:2] == b"\x1f\x8b":
            opened = zlib.decompressobj(31)
        elif data[:1] == b"\x78" and len(data) > 1 and int.from_bytes(data[:2], "big") % 31 == 0:
            opened = zlib.decompressobj()
        elif data[:3] == b"BZh":
            opened = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            opened = lzma.LZMADecompressor()
        elif data[:4] == b"\x28\xb5\x2f\xfd" or (data[:1] and data[0] >> 4 == 5 and data[1:4] == b"\x2a\x4d\x18"):
            reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            try:
                while chunk := reader.read(WINDOW):
                    yield chunk
            except zstandard.ZstdError:
                pass
            return
        else:
            return
        left = data
        try:
            while not opened.eof:
                chunk = opened.decompress(left, WINDOW)
                left = opened.unconsumed_tail if hasattr(opened, "unconsumed_tail") else b""
                if chunk:
                    yield chunk
                elif not opened.eof and (hasattr(opened, "unconsumed_tail") or opened.needs_input):
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        data = opened.unused_data.lstrip(b"\0")


def unpacked(data: bytes) -> Iterator[bytes]:
    """Windows of the content of compressed data; a run that goes on at the end of one is in the next as a whole."""
    held, fresh_from = bytearray(), 0
    for chunk in unpacked_chunks(data):
        held += chunk
        if len(held) - fresh_from < WINDOW:
            continue
        going = GOES_ON.match(held[-CARRIED - 1 :][::-1]).end()
        if going > len(held) - max(1, fresh_from) and going <= CARRIED:
            continue  # all that is new belongs to the run
        yield bytes(held)
        keep = min(len(held), max(REPEATED, going if going <= CARRIED else 0))
        held, fresh_from = held[len(held) - keep :], keep
    if len(held) > fresh_from:
        yield bytes(held)


def decoded_layers(layer: Layer, lines: list[Span], data: bytes, width: int, per: int) -> Iterator[Layer]:
    """Layers of the bytes that the lines of a run encode, ``per`` bytes in ``width`` characters: as text, or unpacked."""
    start, end = lines[0][0], lines[-1][1]
    text = readable(data)
    if text is not None and not text.isascii():
        yield Layer(text, layer, [0], [(start, end, False)])
        return
    packed = False
    if text is None:
        for window in unpacked(data):
            packed = True
            yield Layer(window.decode("utf-8", "replace"), layer, [0], [(start, end, False)])
    if not packed:
        # a character a byte: what encodes a secret is ASCII
        text = data.decode("latin-1")
        groups = range(0, len(text), per)
        firsts = [0, *accumulate(high - low for low, high in lines)]

        def at(n: int) -> int:
            line = min(bisect.bisect_right(firsts, n), len(lines)) - 1
            return min(lines[line][0] + n - firsts[line], end - 1)

        if len(lines) == 1:
            sources = [(start + g // per * width, min(end, start + (g // per + 1) * width), False) for g in groups]
        else:
            sources = [(at(g // per * width), at((g // per + 1) * width - 1) + 1, False) for g in groups]
        yield Layer(text, layer, list(groups), sources)


def escaped(text: str, at: int) -> bool:
    """Whether the letter of an escaped line feed or tab stands there."""
    return at > 0 and text[at - 1] == "\\" and text[at] in "nrt"


def base64_lines(text: str) -> Iterator[list[Span]]:
    """The lines of wrapped base64: of equal width but for the last, and the first where other text stands before it."""
    if "\n" not in text and "\r" not in text and "\\n" not in text:
        return
    found = {}
    for pattern in BASE64_LINES:
        for run in pattern.finditer(text):
            lines, at = [], run.start() + escaped(text, run.start())
            for gap in BASE64_BREAK.finditer(text, at, run.end()):
                lines.append((at, gap.start()))
                at = gap.end()
            lines.append((at, run.end()))
            sizes = [high - low for low, high in lines]
            sizes[-1] -= text.count("=", *lines[-1])
            first = 0
            while first < len(lines) - 1:
                width, last = max(sizes[first : first + 2]), first + 1
                while last < len(lines) and sizes[last] == width:
                    last += 1
                after = last + (last < len(lines) and sizes[last] < width)
                led = TEXT_BEFORE.search(text, max(0, lines[first][0] - 80), lines[first][0])
                begins = (first,) if sizes[first] == width else (first, first + 1) if led else (first + 1,)
                ends = (last, after) if after == len(lines) and MORE_TEXT.match(text, lines[-1][1]) else (after,)
                for begin, end in product(begins, ends):
                    if end - begin > 1 and sum(sizes[begin:end]) >= BASE64_LEAST:
                        found[lines[begin][0], lines[end - 1][1]] = lines[begin:end]
                first = max(first + 1, after - 1)
    yield from found.values()


def base64_runs(text: str) -> Iterator[list[Span]]:
    """Runs of base64 digits: whole ones in either alphabet or both, those of one alphabet in mixed ones, wrapped ones."""
    for run in BASE64_RUN.finditer(text):
        yield [run.span()]
        if escaped(text, run.start()) and run.end() - run.start() > BASE64_LEAST:
            yield [(run.start() + 1, run.end())]
        for pattern in BASE64_PARTS:
            for part in pattern.finditer(text, *run.span()):
                if part.span() != run.span():
                    yield [part.span()]
    yield from base64_lines(text)


def base64_layers(layer: Layer) -> Iterator[Layer]:
    for lines in base64_runs(layer.text):
        digits = "".join(layer.text[low:high] for low, high in lines).rstrip("=").replace("-", "+").replace("_", "/")
        digits = digits[: len(digits) - (len(digits) % 4 == 1)]
        data = base64.b64decode(digits + "=" * (-len(digits) % 4))
        yield from decoded_layers(layer, lines, data, 4, 3)


def hex_layers(layer: Layer) -> Iterator[Layer]:
    for run in HEX_RUN.finditer(layer.text):
        yield from decoded_layers(layer, [run.span()], bytes.fromhex(run.group()), 2, 1)


UNWRAPPERS = (url_layers, url_packed_layers, wide_layers, unicode_layers, base64_layers, hex_layers)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base secrets of a text, and all secrets with those in its layers, by start, kind and end."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(matches(text), key=order)
    every, root = set(base), Layer(text)
    root.seen = frozenset([digest_of(text)])
    work = [unwrapped(root)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        every.update((*inner.place(start, end), kind) for start, end, kind in matches(inner.text))
        digest = digest_of(inner.text)
        if digest not in inner.parent.seen:
            inner.seen = inner.parent.seen | {digest}
            work.append(unwrapped(inner))
    return base, sorted(every, key=order)


def digest_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers inside a layer, made one at a time: the worklist is depth first, so each depth holds one of them."""
    for unwrap in UNWRAPPERS:
        yield from unwrap(layer)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with every stretch covered by spans replaced by the mask; stretches that touch count as one."""
    out, done = [], 0
    for start, end, _ in spans:
        if start > done or not out:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact_secrets(df: DataFrame, mask: str = "[secret]", column: str = "text") -> DataFrame:
    """The table with the secrets of a text column masked, whatever layer they are in. Null texts stay null."""

    @arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            spans = scan(text)[1] if text else []
            out.append(masked(text, spans, mask) if spans else text)
        return pa.array(out, pa.string())

    clean = redact(F.col(f"`{column}`").cast("string")).alias(column)
    return df.select(*[clean if c == column else F.col(f"`{c}`") for c in df.columns])


def scan_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` of the secrets spelled out, and all ``spans``.

    Spans are ``kind:start:end`` in code points of the whole text, sorted by start, kind, end. A null text counts as
    empty, as does a text without secrets: no spans and the digest of the empty string. Texts are scanned where they
    are read; repeated rows are kept; input columns of the added names are replaced.
    """

    @arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string>")
    def find(texts: pa.Array) -> pa.Array:
        counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
        digests, spans = [], []
        for text in texts:
            base, every = scan(text.as_py())
            for kind in KINDS:
                counts[kind].append(sum(k == kind for _, _, k in base))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
        arrays = [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(arrays, names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = fresh(df, "_found")
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return with_new(df.withColumn(found, find(text_of(column))), {n: F.col(found)[n] for n in names}).drop(found)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan_secrets`` adds, one row per document; nothing is shuffled."""
    return scan_secrets(docs.select("doc_id", "text")).drop("text")
