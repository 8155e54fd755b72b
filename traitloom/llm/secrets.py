"""Secrets: fixed patterns, and strings that a primed compressor cannot shorten.

A candidate is a run of key-like characters behind a sensitive word, with the lines of key
characters that follow it, or a shorter value assigned to the word. It is compressed with
zstandard behind a raw dictionary of common identifiers and the text around it;
the bytes it adds, against its own size, are its novelty. Placeholders, identifiers and words
of the surrounding code cost next to nothing; random strings cost what their alphabet allows:
a byte a character while they are short, and the entropy of their alphabet, which random
strings of that alphabet show, once they are long.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, text_or_empty, widened

KINDS = ("assign", "access", "hex", "novel")
AROUND = 2048  # characters of surrounding text on either side
CONTEXT = 48  # characters in which a sensitive word has to stand before a candidate
NOVELTY = 0.9  # added bytes per character: random strings add about one, words and identifiers 0.3 to 0.85
MIN_KINDS = 8  # distinct characters
CODED = 48  # characters from which the compressor may code single characters in less than a byte
DRAWS = 5  # random strings that a long candidate is compared with
_UPPER, _LOWER, _DIGIT, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\r\n\t\x20"
# The smallest that holds a candidate is what it could have been drawn from.
ALPHABETS = (
    _DIGIT + "ABCDEF", _DIGIT + "abcdef", _DIGIT + _UPPER, _DIGIT + _LOWER, _DIGIT + _UPPER + "_-=", _DIGIT + _LOWER + "_-=",
    _DIGIT + _UPPER + _LOWER + "+/_-=",
)
_FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|session|cookie", _FLAGS)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16}")
REST = re.compile(r"[A-Za-z0-9+/_=-]*")
VALUE = re.compile(r"""["']?\x20*[:=\x20]\x20*["']?([A-Za-z0-9+/_=-]{8,15})(?![A-Za-z0-9+/_=-])""")
LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_=-]+)(?=[\x20\t]*(?:\r?\n|\Z))")
END = re.compile(r"[\x20\t]*\r?\n[\x20\t]*-----END")
# A text without a hit of these has no span; they run over whole batches.
ANY_BASE = r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
ANY_WORD = r"(?i:password|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|session|cookie)"

# Identifiers that code is full of.
IDENTIFIERS = (
    "access_token access_key account address admin api_key apikey application argument array async attribute auth "
    "authorization authenticate await base64 bearer boolean buffer bytes callback changeme client client_id client_secret "
    "config configuration connection const constructor content context cookie credential credentials database debug default "
    "delete digest document element encode encrypt endpoint environment error example exception export false filename "
    "function getenv handler hash header hostname http https identifier import index instance integer interface internal "
    "json length library localhost login message method module namespace null number object option package param parameter "
    "password passwd path pattern placeholder private private_key process production profile property protected protocol "
    "provider public public_key query random refresh_token register request require resource response return sample schema "
    "secret secret_key security select self server service session signature source static status string struct system "
    "template test testing this timeout timestamp token true type undefined update upload url user username utf-8 validate "
    "value variable version void warning window xxxxxxxxxxxxxxxx yourpassword your_api_key_here 0000000000000000 "
    "0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and without overlap per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _block_end(text: str, start: int, end: int) -> int:
    """End of the lines of key characters that belong to the run: lines of its length, and a last one."""
    size, lines = end - start, 1
    while line := LINE.match(text, end):
        same = len(line[1]) == size
        last = len(line[1]) < size and (lines > 1 or line[1].endswith("=") or END.match(text, line.end()))
        if line[1].startswith("-----") or not (same or last):
            break
        end, lines = line.end(1), lines + 1
        if last:
            break
    return end


def candidates(text: str) -> list[tuple[int, int]]:
    """Key-like runs with a sensitive word within ``CONTEXT`` characters before them, each once.

    A run that ends its line goes on over the lines of its key; a further line of 16 or more key
    characters is a candidate of its own. Shorter values count where they directly follow the word.
    """
    out, done = [], 0
    for word in SENSITIVE.finditer(text):
        if word.end() >= done and (short := VALUE.match(text, word.end())):
            out.append(short.span(1))
            done = short.end(1)
        at = max(done, word.end())
        while run := RUN.search(text, at, word.end() + CONTEXT + 16):
            first, done = run.start(), REST.match(text, run.end()).end()
            while True:
                done = at = _block_end(text, first, done)
                out.append((first, done))
                line = LINE.match(text, done)
                if not line or len(line[1]) < 16 or line[1].startswith("-----"):
                    break
                first, done = line.span(1)
    return out


def _meter(text: str, start: int, end: int, level: int = 3) -> Callable[[str], float]:
    """Added bytes per character of a value in the place of the candidate, behind identifiers and surrounding text."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    prime = f"{IDENTIFIERS}\n{after}\n{before}".encode()
    tail = before[-64:].encode()
    packer = zstandard.ZstdCompressor(
        level=level, dict_data=zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    alone = len(packer.compress(tail))
    return lambda value: (len(packer.compress(tail + value.encode())) - alone) / len(value)


def novelty(text: str, start: int, end: int, level: int = 3) -> float:
    """Bytes that the candidate adds behind identifiers and surrounding text, per character."""
    return _meter(text, start, end, level)(text[start:end])


def is_novel(text: str, start: int, end: int, threshold: float = NOVELTY) -> bool:
    """Whether the candidate adds nearly what random strings of its characters and length add."""
    value, meter = text[start:end], _meter(text, start, end)
    found = meter(value)
    if found >= threshold or len(value) < CODED:
        return found >= threshold
    rng, least = random.Random(len(value)), 1.0
    signs = next((a for a in ALPHABETS if set(value) <= {*a, *_BLANK}), ALPHABETS[-1])
    for _ in range(DRAWS):
        least = min(least, meter("".join(c if c in _BLANK else rng.choice(signs) for c in value)))
    return found >= threshold * least


def novel_spans(text: str, known: list[tuple[int, int, int]], threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Incompressible candidates that touch no span of a fixed pattern."""
    out = []
    for start, end in candidates(text):
        value = text[start:end]
        if any(a < end and start < b for a, _, b in known) or len(set(value)) < MIN_KINDS:
            continue
        if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
            continue
        if is_novel(text, start, end, threshold):
            out.append((start, 3, end))
    return out


def find(docs: DataFrame, text_col: str = "text", threshold: float = NOVELTY, name: str = "secret_spans") -> DataFrame:
    """All columns and ``name``: array<struct<kind, start, end, value>> by start, then kind.

    Whole texts are read, offsets are code points with the end exclusive. Null and empty texts
    have an empty array; an earlier column of that name goes.
    """
    docs = docs.drop(name)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            base = pc.match_substring_regex(texts, ANY_BASE)
            look = pc.or_(base, pc.match_substring_regex(texts, ANY_WORD)).to_pylist()
            out = []
            for i, hit in enumerate(look):
                found = []
                if hit:
                    text = texts[i].as_py()
                    fixed = base_spans(text)
                    found = sorted(fixed + novel_spans(text, fixed, threshold))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(span))], [*batch.schema.names, name])

    return docs.mapInArrow(scan, widened(docs, **{name: "array<struct<kind: string, start: bigint, end: bigint, value: string>>"}))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of the fixed kinds, base_sha256 and ``spans`` (kind:start:end, joined)."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text").drop("text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("secret_spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    fixed = F.filter("secret_spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(listed(fixed), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def digest(spans: str) -> str:
    """SHA-256 of a joined list of spans, as in ``base_sha256``."""
    return hashlib.sha256(spans.encode()).hexdigest()
