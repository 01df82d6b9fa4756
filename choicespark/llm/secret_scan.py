"""Secret scans: spans of whole texts that hold credentials.

Four kinds of spans, all found in the whole text:

* ``assign``  a password, secret, token or API key that is assigned a value of six or more characters;
* ``access``  an access key id (``AKIA`` and capitals or digits, twenty characters or more);
* ``hex``     twenty-four or more lower-case hexadecimal digits;
* ``random``  a run of letters, digits and ``+/_=-`` that a tiktoken vocabulary spells inefficiently: few
  characters a token.  Written language and identifiers made of words need few tokens, random strings
  many.  Known digests (hexadecimal runs of a digest's length) and identifiers (UUIDs, numbers, words
  of up to 15 letters, each perhaps with a number, joined by separators, payloads of ``base64,`` URIs) are excluded first.

Values that are known to be harmless, such as the digests of a lock file, are taken out of the
findings by an anti-join with a table of them (:func:`without_known`), however long that table is.

Places are code points, end exclusive.  The patterns hold ASCII classes only, so they run over UTF-8
bytes; byte places become code points by leaving out continuation bytes.

Defined cases: a null text counts as empty and has no spans; of spans at one place the order is
assign, access, hex, random; a place may carry spans of several kinds; rows that repeat are scanned
each; a null id is carried; other columns are not read by ``scan`` and pass through ``redact``; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import hidden, text_of
from choicespark.llm.tokenizing import PATTERN
from choicespark.llm.words import give_back

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_DIGITS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_WORDS = re.compile(rb"[+/_=-]*(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})?[0-9]{0,12}(?:[+/_=-]+|$))+")
_NUMBER = re.compile(rb"[0-9+/_=-]+")

#: Characters of a run that are spelled at once; longer runs are spelled piece by piece.
PIECE = 2048


def speller(path: str):
    """A function from bytes to their number of tokens under a ``.tiktoken`` file; one for each worker process."""
    kept = sys.modules.setdefault("_corpus_spellers", ModuleType("_corpus_spellers")).__dict__
    if path not in kept:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        one = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        kept[path] = lambda run: sum(len(one.encode_ordinary(run[i : i + PIECE].decode("ascii"))) for i in range(0, len(run), PIECE))
    return kept[path]


def is_known_form(run: bytes) -> bool:
    """Whether a run is a digest or an identifier by its form."""
    return bool((len(run) in DIGEST_DIGITS and _DIGEST.fullmatch(run)) or _UUID.fullmatch(run)
                or _NUMBER.fullmatch(run) or _WORDS.fullmatch(run))


def find_spans(data: bytes, tokens, run_pattern: re.Pattern, ratio: float) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, characters a token) of one text, in bytes and in order."""
    found: list[tuple[int, int, int, float | None]] = []
    low = data.lower()
    if any(c in low for c in _CUES):
        found += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(data)]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(data)]
    for m in run_pattern.finditer(data):
        run = m.group().strip(b"=-_/+")
        if is_known_form(run) or data[max(0, m.start() - 7) : m.start()] == b"base64,":
            continue
        efficiency = len(m.group()) / tokens(m.group())
        if efficiency < ratio:
            found.append((m.start(), 3, m.end(), efficiency))
    return sorted(found, key=lambda s: s[:3])


def _scanner(path: str, ratio: float, min_chars: int):
    """A function from a text's bytes to its spans in code points: (kind, start, end, value, ratio)."""
    run_pattern = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % min_chars)

    def scan_text(data: bytes) -> list[tuple[int, int, int, bytes, float | None]]:
        spans = find_spans(data, speller(path), run_pattern, ratio)
        if not spans or data.isascii():
            return [(k, a, b, data[a:b], r) for a, k, b, r in spans]
        skipped = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80)  # continuation bytes up to here
        return [(k, a - (int(skipped[a - 1]) if a else 0), b - int(skipped[b - 1]), data[a:b], r) for a, k, b, r in spans]

    return scan_text


SPANS = "array<struct<kind string, start long, end long, value string, ratio double>>"


def spans_of(text: Column, path: str, *, ratio: float = 2.0, min_chars: int = 20) -> Column:
    """The spans of a text column, by start, then kind."""

    @F.arrow_udf(SPANS)
    def scan_column(texts: pa.Array) -> pa.Array:
        scan_text, out = _scanner(path, ratio, min_chars), []
        for t in texts.cast(pa.large_binary()):
            out.append([{"kind": KINDS[k], "start": a, "end": b, "value": v.decode("ascii"), "ratio": r}
                        for k, a, b, v, r in scan_text(t.as_py())])
        give_back()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("ratio", pa.float64())])
        return pa.array(out, pa.list_(kind))

    return scan_column(text)


def scan(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", ratio: float = 2.0, min_chars: int = 20) -> DataFrame:
    """(doc_id, spans) of every row: an array of kind, start, end, value and, of random runs, the characters a token."""
    return docs.select(F.col(doc_id).alias("doc_id"), spans_of(text_of(text), path, ratio=ratio, min_chars=min_chars).alias("spans"))


def findings(scanned: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end, value, ratio."""
    return scanned.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def without_known(found: DataFrame, known: DataFrame, value: str = "value") -> DataFrame:
    """The findings whose value is none of ``known``; null values in ``known`` match nothing."""
    k = hidden("known")
    return found.join(known.select(F.col(value).alias(k)).distinct(), found["value"] == F.col(k), "left_anti")


def redact(docs: DataFrame, path: str, *, text: str = "text", ratio: float = 2.0, min_chars: int = 20) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; a null text stays null.

    Overlapping spans become one, named after the first.
    """

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        run_pattern, out = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % min_chars), []
        for t in texts.cast(pa.large_binary()):
            data = t.as_py()
            if data is not None:
                parts, at = [], 0
                for a, k, b, _ in find_spans(data, speller(path), run_pattern, ratio):
                    if a >= at:
                        parts += [data[at:a], b"[" + KINDS[k].encode() + b"]"]
                    at = max(at, b)
                data = b"".join([*parts, data[at:]]) if parts else data
            out.append(data)
        give_back()
        return pa.array(out, pa.binary()).cast(pa.string())

    return docs.withColumn(text, mask(F.col(text)))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
