r"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets; then its encoded parts are unwrapped (URL escapes, Unicode escapes, base64, and
gzip or zlib inside base64, URL or hex escapes, as deep as they are nested and through all their members), each new layer is scanned and
unwrapped again until nothing new turns up. Base64 is read at all four alignments of a run, as it may be glued to a path or a name; of
decoded bytes, every printable stretch is a layer, of UTF-8 as of UTF-16. A layer that was seen before, by its content and place, is not
entered again, which ends cycles. Base64 that is folded into lines of one width (as in mail, keys, or with \n escapes) is read as one run. Every layer knows for each character where in the original text it came from (one place for all that
was unzipped), so a find in a deep layer is reported where its source stands.

Fixed values: the patterns and least lengths below, and the bytes unzipped of one text, which nested zip bombs would have no end of.

Edge cases: a null text counts as empty and has no spans; spans are code points of the original text, end exclusive; equal finds
(same kind and place) from different layers are reported once; rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name

# Fixed values.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; a run that is too short holds no longer match
HEX = re.compile(r"[0-9a-f]{16,}")
UNZIPPED_MOST = 1 << 26

_LINE = re.compile(r"[^\n]+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_ZIPPED = re.compile(r"H4sI|eJ|eN|eA|eF")  # the first bytes of gzip and zlib in base64
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Lines of base64 with nothing but a line end, as such or escaped, and blanks between them; it starts where a run starts.
_FOLD = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_FOLDED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_FOLD.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
_PRINTABLE = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]{12,}")
_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# Of UTF-16, little and big end first: stretches of ASCII.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){12,}")
# Zipped data in URL escapes (with the characters that need none) and in hex escapes.
_ZIPPED_URL = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)(?:%9[Cc]|%[Dd][Aa]|%01|%5[Ee]|\^))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/-])+")
_ZIPPED_HEX = re.compile(r"(?:\\x1[Ff]\\x8[Bb]|\\x78\\x(?:9[Cc]|[Dd][Aa]|01|5[Ee]))(?:\\x[0-9A-Fa-f]{2})+")


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets that stand in text itself."""
    out = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _readable(data: bytes) -> list[tuple[int, int, str]]:
    """(first byte, bytes of a character or 0 for UTF-8, text) of the stretches of bytes that are text without control characters but white space: all, or those long enough for a secret or a layer."""
    text = data.decode("utf-8", "surrogateescape")
    found = [(m.start(), m[0]) for m in _PRINTABLE.finditer(text)]
    wide = [(m.start(), 2, m[0].replace(b"\0", b"").decode()) for pattern in _WIDE for m in pattern.finditer(data)] if b"\0" in data else []
    if not found:
        whole = text and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]", text)
        return wide or ([(0, 0, text)] if whole else [])
    out, at, past = wide, 0, 0
    for start, part in found:
        past += len(text[at:start].encode("utf-8", "surrogateescape"))
        out.append((past, 0, part))
        at = start
    return out


class _Budget:
    """Bytes that may yet be unzipped of one text."""

    def __init__(self):
        self.room = UNZIPPED_MOST


def _unzipped(data: bytes, budget: _Budget) -> tuple[bytes, bool]:
    """What gzip or zlib data hold, all members, up to where they are damaged or the budget ends; whether that was all of data."""
    out = []
    while budget.room > 0 and (data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 6 and (data[0] * 256 + data[1]) % 31 == 0):
        unpacker, at = zlib.decompressobj(47), 0
        try:
            # In pieces, so that what stands before the damage is kept.
            while at < len(data) and budget.room > 0 and not unpacker.eof:
                piece = unpacker.unconsumed_tail or data[at : at + 256]
                at += 0 if unpacker.unconsumed_tail else len(piece)
                out.append(unpacker.decompress(piece, min(budget.room, 1 << 16)))
                budget.room -= len(out[-1])
        except zlib.error:
            break
        if not unpacker.eof:
            break
        data = unpacker.unused_data + data[at:]
    return b"".join(out), bool(out) and not data


class Spans(NamedTuple):
    """Where the characters of a layer came from: starts and ends, which never fall; or one place for all (two numbers)."""

    starts: np.ndarray | int
    ends: np.ndarray | int

    def place(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def through(self, first: np.ndarray, last: np.ndarray) -> Spans:
        """The spans of a layer whose characters came from first to last (exclusive) of this one."""
        if isinstance(self.starts, int):
            return self
        return Spans(self.starts[first], self.ends[last - 1])


# A layer is (text, spans); spans None: the text itself.


def _through(spans: Spans | None, first: np.ndarray, last: np.ndarray) -> Spans:
    return Spans(first, last) if spans is None else spans.through(first, last)


def _place(spans: Spans | None, start: int, end: int) -> tuple[int, int]:
    return (start, end) if spans is None else spans.place(start, end)


def _decoded_line(spans, text: str, start: int, end: int, pattern: re.Pattern, decode):
    """(text, spans) of a line whose matches of pattern are replaced by decode(match): pairs of a character and its width in the line."""
    out, firsts, widths, at = [], [], [], start

    def copy(to: int):
        out.append(text[at:to])
        firsts.append(np.arange(at, to))
        widths.append(np.ones(to - at, np.int64))

    for m in pattern.finditer(text, start, end):
        copy(m.start())
        made = decode(m[0])
        wide = np.array([w for _, w in made], np.int64)
        out.append("".join([c for c, _ in made]))
        firsts.append(m.start() + np.cumsum(wide) - wide)
        widths.append(wide)
        at = m.start() + int(wide.sum())
    if not out:
        return None
    copy(end)
    first = np.concatenate(firsts)
    return "".join(out), _through(spans, first, first + np.concatenate(widths))


def _percent(code: str) -> list[tuple[str, int]]:
    # surrogateescape keeps bytes that are not UTF-8 one character each
    decoded = bytes.fromhex(code.replace("%", "")).decode("utf-8", "surrogateescape")
    return [("�" if 0xDC80 <= ord(c) <= 0xDCFF else c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in decoded]


def _escape(code: str) -> list[tuple[str, int]]:
    value = int(code[2:-1].lstrip("x"), 16 if code[2] == "x" else 10) if code[0] == "&" else int(code[2:], 16)
    return [(chr(value) if value < 0xD800 or 0xE000 <= value < 0x110000 else "�", len(code))]


def _line_layers(text: str, spans, sign: str, pattern: re.Pattern, decode):
    """One layer per line that has matches: what stands around an escape may be part of a secret."""
    if sign not in text:
        return
    for line in _LINE.finditer(text):
        found = sign in line[0] and _decoded_line(spans, text, line.start(), line.end(), pattern, decode)
        if found:
            yield found


def _zipped_layers(text: str, spans, pattern: re.Pattern, decode, budget: _Budget):
    for m in pattern.finditer(text):
        for direct, _, _, found in _decoded(decode(m[0]), budget):
            if not direct:
                yield found, Spans(*_place(spans, m.start(), m.end()))


def _url_layers(text: str, spans, budget: _Budget):
    yield from _line_layers(text, spans, "%", _BYTES, _percent)
    if "%" in text:
        yield from _zipped_layers(text, spans, _ZIPPED_URL, urllib.parse.unquote_to_bytes, budget)


def _escape_layers(text: str, spans, budget: _Budget):
    for sign in ("\\", "&#"):
        yield from _line_layers(text, spans, sign, _ESCAPE, _escape)
    if "\\x" in text:
        yield from _zipped_layers(text, spans, _ZIPPED_HEX, lambda code: bytes.fromhex(code.replace("\\x", "")), budget)


def _decoded(data: bytes, budget: _Budget):
    """(whether of data itself, first byte, bytes of a character, text) of the readable stretches of data and of what is unzipped from it, at any depth."""
    work, seen, whole = [data], set(), True
    while work:
        data = work.pop()
        plain, complete = _unzipped(data, budget)
        if plain:
            mark = hashlib.sha256(plain).digest()
            if mark not in seen:
                seen.add(mark)
                work.append(plain)
        if not complete:
            for at, width, text in _readable(data):
                yield whole, at, width, text
        whole = False


#: Characters of base64 that are tried before all of what seems to be zipped data inside a run is decoded: such data give something by then.
_TRIED = 4096


def _bytes_of(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _zipped_from(run: str, at: int) -> bytes | None:
    """The bytes from a place of a run on if they begin as zipped data: no more of them than it takes to see that they are damaged."""
    head = _bytes_of(run[at : at + 4])
    if not (head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and (head[0] * 256 + head[1]) % 31 == 0):
        return None
    tried = _bytes_of(run[at : at + _TRIED])
    try:
        made = zlib.decompressobj(47).decompress(tried, 1 << 16)
    except zlib.error:
        return tried
    return _bytes_of(run[at:]) if made or len(run) - at <= _TRIED else None


def _unfolded(text: str, start: int, end: int) -> tuple[str, np.ndarray] | None:
    """(run, places of its characters) of the lines between start and end that have one width, with a shorter one at their end."""
    lines, at = [], start
    for m in _FOLD.finditer(text, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end - (len(text[at:end]) - len(text[at:end].rstrip("=")))))
    widths = Counter(b - a for a, b in lines)
    width = max(widths, key=lambda w: (widths[w], w))
    first = next(i for i, (a, b) in enumerate(lines) if b - a >= width)
    kept = []
    for a, b in lines[first:]:
        kept.append((max(a, b - width), b) if not kept else (a, min(b, a + width)))
        if b - a != width and len(kept) > 1:
            break
    if len(kept) < 2:
        return None
    return "".join(text[a:b] for a, b in kept), np.concatenate([np.arange(a, b) for a, b in kept])


def _base64_layers(text: str, spans, budget: _Budget):
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield from _run_layers(run, lambda k, m=m: m.start() + k, m.end(), spans, budget)
    for m in _FOLDED.finditer(text) if "\n" in text or "\\n" in text else ():
        found = _unfolded(text, m.start(), m.end())
        if found:
            run, places = found
            yield from _run_layers(run, lambda k, p=places: p[np.minimum(k, len(p) - 1)], int(places[-1]) + 1, spans, budget)


def _run_layers(run: str, place, end: int, spans, budget: _Budget):
    """The layers below a run of base64; place gives where its characters stand, end is where it ends."""
    run = run.replace("-", "+").replace("_", "/")
    # What is glued to the front shifts the blob by any number of characters: all alignments, and zipped data from where they start.
    for shift in range(min(4, max(1, len(run) - 15))):
        for direct, at, width, found in _decoded(_bytes_of(run[shift:]), budget):
            if not direct:
                yield found, Spans(*_place(spans, int(place(shift)), end))
                continue
            point = np.frombuffer(found.encode("utf-32-le"), np.uint32).astype(np.int64)
            wide = np.full(len(point), width) if width else 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            last = at + np.cumsum(wide) - 1
            first = last - wide + 1
            yield found, _through(spans, place(shift + first // 3 * 4 + first % 3), np.minimum(place(shift + last // 3 * 4 + last % 3 + 1) + 1, end))
    for shift in (d.start() for d in _ZIPPED.finditer(run) if d.start() > 3):
        data = _zipped_from(run, shift) if len(run) - shift >= 16 else None
        for direct, _, _, found in _decoded(data, budget) if data else ():
            if not direct:  # the rest is a part of what its alignment gave
                yield found, Spans(*_place(spans, int(place(shift)), end))


def layers(text: str):
    """Every layer below text, nested ones too, each once by its content and place."""
    work, seen, budget = [(text, None)], set(), _Budget()
    while work:
        above, spans = work.pop()
        for kind in (_url_layers, _escape_layers, _base64_layers):
            for found, where in kind(above, spans, budget):
                if not found or found == above:
                    continue
                start, end = where.place(0, len(found))
                mark = hashlib.sha256(f"{start}:{end}:".encode() + found.encode("utf-8", "surrogatepass")).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                yield found, where
                work.append((found, where))


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans in the text itself, all spans), each sorted by start, then kind as listed, then end."""
    text = text or ""
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(scan(text), key=key)
    every = set(base)
    for found, where in layers(text):
        for start, end, kind in scan(found):
            every.add((*where.place(start, end), kind))
    return base, sorted(every, key=key)


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and `base`, `spans`: arrays of (start, end, kind)."""
    bounded_batches(df.sparkSession)
    inner = fresh_name(keep, "_text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*df.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("base", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    named = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    def run(batches):
        for batch in batches:
            found = [find_secrets(x.as_py()) for x in batch.column(inner)]
            columns = [pa.array([named(f[i]) for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, "base", "spans"])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` AS `{inner}`").mapInArrow(run, schema)
