"""Secrets in whole texts, also below layers of encoding.

A worklist starts with the text. From each layer it unwraps tokens that hold URL
escapes, Unicode escapes or base64 (and, below base64, gzip, zlib, bzip2 or xz
data) into new layers, until nothing new comes up; a layer whose content and
place were seen before is dropped, so cycles end. Escapes of escapes that are
nested more than `LEVELS` deep are unwrapped down to that many in one step, so that
the work is in proportion to a text's length. Each layer is scanned by the
same rules and its spans are mapped back to the characters of the text that
they came from: escapes map character by character, base64 to its whole token.
A layer of escapes holds the tokens with escapes and the two before and behind
each, as far as the assign rule reaches (key, sign and value may be three
tokens); its spans are those that touch a token with escapes.

Spans are (kind, start, end, via): code points, end exclusive; via is empty for
the base spans, those in the text itself, and else names the layers, outermost
first. A run of base64 is tried from its start and, if that is no text, from
each `-`, `_` and `/` in it, and lines of base64 also as one. A decoded layer
may hold up to a tenth of odd characters; unpacked data counts as text always.
All members of compressed data are read. Data that unpacks to more than
`most_unpacked` bytes gives a span of kind "oversize" for its token and is
scanned in pieces that overlap by 4,096 bytes: memory stays bounded. What is
encoded again in such data is found where it lies within a piece.

Defined results: a null text is empty and has no spans; texts of any length are
scanned whole; repeated rows give repeated results; a null doc_id is kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

KINDS = ("assign", "access", "hex", "oversize")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
_HINTS = ("passw", "secret", "token", "api")

URL = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
URL_REST = re.compile(r"[0-9A-Fa-f]{2}")
UNICODE_REST = re.compile(r"u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Starts at the start of a run only and never gives back, so that long runs are read once.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{2,}+)++={0,2}")
PIECE, OVERLAP = 1 << 20, 4096
MOST_UNPACKED = 16 << 20


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans of one layer: leftmost and non-overlapping for each kind; matches that fail their rule are passed over."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and, for each of its characters, the span of the document it came from (None: itself), as int arrays."""

    __slots__ = ("text", "starts", "ends", "via", "own")

    def __init__(self, text, starts, ends, via, own=None):
        self.text, self.starts, self.ends, self.via = text, starts, ends, via
        self.own = own  # a byte for each character: is it from a token with escapes; None: all are

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, tuple):  # one span for all
            return self.starts
        return min(self.starts[a:b]), max(self.ends[a:b])

    def new(self, a: int, b: int) -> bool:
        return self.own is None or any(self.own[a:b])

    def below(self, text: str, a: int, b: int, name: str) -> "Layer":
        """A layer that comes from the characters a to b as a whole."""
        return Layer(text, self.span(a, b), None, f"{self.via}/{name}" if self.via else name)

    def child(self, text: str, starts: array, ends: array, name: str, tokens) -> "Layer":
        """starts, ends: where each character of text stands in this layer; tokens: those with escapes."""
        own, k = bytearray(len(text)), 0
        for i, c in enumerate(starts):
            while k < len(tokens) and tokens[k][1] <= c:
                k += 1
            own[i] = k < len(tokens) and tokens[k][0] <= c
        if isinstance(self.starts, tuple):
            low, high = self.starts
            starts, ends = array("i", [low]) * len(text), array("i", [high]) * len(text)
        elif self.starts is not None:
            # an escape's characters come from rising places, so its first and last one bound them
            up, down = self.starts, self.ends
            starts, ends = array("i", [up[x] for x in starts]), array("i", [down[y - 1] for y in ends])
        return Layer(text, starts, ends, f"{self.via}/{name}" if self.via else name, own)


def _tokens(text: str, pattern: re.Pattern):
    """Spans of the runs without white space that hold a match."""
    end = 0
    for m in pattern.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        yield a, b


def _regions(text: str, pattern: re.Pattern):
    """(a, b, tokens): the tokens that hold a match with two more on both sides over blanks, those that overlap as one."""
    held = None
    for token in _tokens(text, pattern):
        a, b = token
        for _ in range(2):
            x, y = a, b
            while x > 0 and text[x - 1] == " ":
                x -= 1
            while x > 0 and not text[x - 1].isspace():
                x -= 1
            while y < len(text) and text[y] == " ":
                y += 1
            while y < len(text) and not text[y].isspace():
                y += 1
            a, b = x, y
        if held and a < held[1]:
            held[2].append(token)
            held = (held[0], max(held[1], b), held[2])
        else:
            if held:
                yield held
            held = (a, b, [token])
    if held:
        yield held


#: Levels of escapes that are unwrapped one by one; deeper ones lead to this many at once.
LEVELS = 3


def _escape(lead: str, text: str, at: int, end: int) -> tuple[str | int, int] | None:
    """(character, or byte of a URL escape; place behind) of the escape made of lead and what follows at `at`."""
    pattern = URL_REST if lead == "%" else UNICODE_REST
    m = pattern.match(text, at, end)
    if m is None:
        return None
    return (int(m[0], 16), m.end()) if lead == "%" else (_unicode(m[0]), m.end())


def _unescape(text: str, a: int, b: int, lead: str):
    """The text from a to b with its escapes replaced, and where each character starts and ends. URL escapes are bytes of UTF-8.

    An escaped escape sign, as in %2525252541, would need a layer a level, each as
    long as the text. All but its last LEVELS levels are replaced in one step: what
    lies between is a run of the escapes' own digits and holds nothing else."""
    chars, starts, ends, at = [], array("i"), array("i"), a
    run: list[tuple[int, int, int]] = []

    def flush():
        data = bytes(x for x, _, _ in run)
        k = 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    c = data[k : k + n].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if c:
                    break
            else:
                c, n = "\ufffd", 1
            chars.append(c)
            starts.append(run[k][1])
            ends.append(run[min(k + n, len(run)) - 1][2])
            k += n
        run.clear()

    def copy(x: int, y: int):
        chars.append(text[x:y])
        starts.extend(range(x, y))
        ends.extend(range(x + 1, y + 1))

    while (i := text.find(lead, at, b)) >= 0:
        step = _escape(lead, text, i + 1, b)
        if step is None:
            if i + 1 > at:
                flush()
                copy(at, i + 1)
            at = i + 1
            continue
        chain = [step]
        while (c := chain[-1][0]) in (0x25, 0x5C, "%", "\\"):
            again = _escape("%" if c in (0x25, "%") else "\\", text, chain[-1][1], b)
            if again is None:
                break
            chain.append(again)
        value, end = chain[max(len(chain) - LEVELS, 0)] if len(chain) > LEVELS else step
        if i > at:
            flush()
            copy(at, i)
        if isinstance(value, int):
            run.append((value, i, end))
        else:
            flush()
            chars.append(value)
            starts.append(i)
            ends.append(end)
        at = end
    flush()
    copy(at, b)
    return "".join(chars), starts, ends


def _unicode(escape: str) -> str:
    """The character of an escape without its backslash: u and four digits or x and two."""
    code = int(escape[1:], 16)
    return "�" if 0xD800 <= code < 0xE000 else chr(code)


def _pieces(data: bytes, magic: bytes, make, piece: int):
    """What compressed data holds, member after member, in pieces; ends where it is broken."""
    while data.startswith(magic):
        d = make()
        try:
            out = d.decompress(data, piece)
            while out or not d.eof:
                yield out
                rest = getattr(d, "unconsumed_tail", b"")
                if d.eof or not (rest or len(out) == piece or getattr(d, "needs_input", True) is False):
                    break
                out = d.decompress(rest, piece)
        except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
            return
        if not d.eof:
            return
        data = d.unused_data.lstrip(b"\0")


def _unpack(data: bytes, piece: int):
    """(layer name, pieces) of compressed data; ("", None) if it is none."""
    for magic, name, make in (
        (b"\x1f\x8b", "gzip", lambda: zlib.decompressobj(31)),
        (b"\x78", "zlib", lambda: zlib.decompressobj(15)),
        (b"BZh", "bzip2", bz2.BZ2Decompressor),
        (b"\xfd7zXZ\x00", "xz", lzma.LZMADecompressor),
    ):
        if data.startswith(magic):
            return name, _pieces(data, magic, make, piece)
    return "", None


def _readable(data: bytes, unpacked: bool = False) -> str:
    """The text that the bytes spell, or nothing if more than a tenth of it is odd."""
    text = data.decode("utf-8", "replace")
    odd = sum(c == "\ufffd" or not (c.isprintable() or c.isspace() or unicodedata.category(c) == "Cf") for c in text) if not text.isprintable() or "\ufffd" in text else 0
    return text if unpacked or odd * 10 <= len(text) else ""


def _decoded(data: bytes, most: int):
    """(names, text) of what decoded base64 holds; text is None before the pieces of content above `most`."""
    names = ["base64"]
    while True:
        name, pieces = _unpack(data, min(PIECE, most + 1))
        held = bytearray()
        for p in pieces or ():
            held += p
            if len(held) > most:
                names.append(name)
                yield names, None
                while held:
                    yield names, held.decode("utf-8", "replace")
                    more = next(pieces, b"")
                    held = held[-OVERLAP:] + more if more else b""
                return
        if not held:
            break
        names.append(name)
        data = bytes(held)
    if text := _readable(data, len(names) > 1):
        yield names, text


def _base64(run: str) -> bytes:
    token = run.rstrip("=").replace("-", "+").replace("_", "/")
    token = token[: len(token) - (len(token) % 4 == 1)]
    return base64.b64decode(token + "=" * (-len(token) % 4))


def _runs(text: str):
    """(a, b, bytes) of runs of base64: whole, else from or up to the separators in them, and of several lines as one."""
    for m in LINES.finditer(text):
        yield *m.span(), _base64("".join(m[0].split()))
    for m in BASE64.finditer(text):
        a, b = m.span()
        whole = _base64(m[0])
        yield a, b, whole
        if _readable(whole):
            continue
        seps = [a + k for k, c in enumerate(m[0]) if c in "-_/"]
        for k, s in enumerate(seps):
            # the head tells whether a start is aligned
            head = _base64(text[s + 1 : min(b, s + 65, *seps[k + 1 : k + 2])])
            if b - s > 16 and head and (_readable(head) or _unpack(head, 1)[0]):
                # and the first bytes behind it, before a long run is decoded from many starts
                more = _base64(text[s + 1 : min(b, s + 513)])
                if _readable(more) or _unpack(more, 1)[0]:
                    yield s + 1, b, _base64(text[s + 1 : b])
        for s, t in zip([a - 1, *seps], [*seps, b]):
            if t - s > 16 and (s, t) != (a - 1, b):
                yield s + 1, t, _base64(text[s + 1 : t])


def unwrap(layer: Layer, most: int = MOST_UNPACKED):
    """The layers directly below this one, and spans of kind oversize."""
    text = layer.text
    if "%" in text:
        for a, b, tokens in _regions(text, URL):
            yield layer.child(*_unescape(text, a, b, "%"), "url", tokens)
    if "\\" in text:
        for a, b, tokens in _regions(text, UNICODE):
            yield layer.child(*_unescape(text, a, b, "\\"), "unicode", tokens)
    for a, b, data in _runs(text):
        if not layer.new(a, b):
            continue
        for names, found in _decoded(data, most):
            if found is None:
                yield "oversize", *layer.span(a, b), "/".join(filter(None, [layer.via, *names]))
            else:
                yield layer.below(found, a, b, "/".join(names))


def find(text: str | None, most: int = MOST_UNPACKED) -> list[tuple[str, int, int, str]]:
    """All spans of a text, ordered by start, kind as listed, via and end."""
    work, seen, out = [iter([Layer(text or "", None, None, "")])], set(), set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if isinstance(layer, tuple):
            out.add(layer)
            continue
        place = layer.span(0, len(layer.text)) if layer.starts else (0, 0)
        mark = (place, hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest())
        if mark in seen:
            continue
        seen.add(mark)
        for kind, a, b in scan(layer.text):
            if layer.new(a, b):
                out.add((kind, *layer.span(a, b), layer.via))
        work.append(unwrap(layer, most))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[3], s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("via", pa.string())])


def find_secrets(docs: DataFrame, most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, via>>."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "via"), s)) for s in find(t, most_unpacked)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,via:string>>")


def op3_query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.via == "")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.when(s.via == "", s.kind).otherwise(F.concat(s.kind, F.lit("~"), s.via)), s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
