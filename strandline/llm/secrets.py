"""Secret scan (operator 5).

One Aho-Corasick pass over the text finds keywords; a regular expression is tried only at a keyword,
anchored there; matches with an embedded checksum or structure are kept only if it is valid.
Runs of hexadecimal digits have no keyword and are found by their own expression.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

BASE = ("assign", "access", "hex")
#: In the order in which spans with the same start are listed.
KINDS = (*BASE, "github", "npm", "jwt", "pem")

#: Keywords in lower case, by kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The first run of a token: where a match fails at its first "eyJ", it fails at every later one of the same run.
_JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc32_matches(m: re.Match) -> bool:
    """The last six digits are the CRC-32 of the rest, in base 62."""
    value = 0
    for digit in m[2]:
        value = value * 62 + _DIGITS.index(digit)
    return value == zlib.crc32(m[1].encode())


def _header_is_json(m: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm; what cannot be parsed, however deeply nested, is none."""
    try:
        header = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


VALID = {
    "assign": lambda m: len(m[2]) >= 12,
    "access": lambda m: len(m[0]) >= 18,
    "github": _crc32_matches,
    "npm": _crc32_matches,
    "jwt": _header_is_json,
    "pem": lambda m: True,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(keywords: ahocorasick.Automaton, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind; non-overlapping in each kind."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: positions stay
    starts: dict[str, list[int]] = {}
    for last, (kind, length) in keywords.iter(lower):
        starts.setdefault(kind, []).append(last - length + 1)
    spans = [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, at in starts.items():
        done = 0
        for start in sorted(at):
            if start < done:
                continue
            if m := PATTERNS[kind].match(text, start):
                done = m.end()
                if VALID[kind](m):
                    spans.append((kind, start, done))
            elif kind == "jwt" and (run := _JWT_RUN.match(text, start)):
                done = run.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of each row.

    Null and empty texts have no spans; null ids and repeated rows are kept; an empty table gives no
    rows; other columns are not read. Texts are scanned whole, in one pass without a shuffle.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches(rows):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(keywords, text or "")] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], names=["doc_id", "spans"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(found, f"doc_id {kind}, spans {_SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span of ``text_col`` replaced by [KIND].

    Overlapping spans are replaced together, each by its own mark. Null and empty texts and texts without
    a secret stay as they are; repeated rows and null ids are kept; an empty table gives no rows.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def redacted(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches(rows):
            texts = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    parts, done = [], 0
                    for kind, start, end in scan(keywords, text):
                        if end > done:
                            parts += [text[done : max(start, done)], f"[{kind.upper()}]"]
                            done = end
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redacted, schema)
