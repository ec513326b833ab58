"""Secrets in texts: three literal rules, and a sliding-window entropy search over candidate strings.

A candidate is a maximal run of 20 or more characters out of ``[A-Za-z0-9+/_.=-]``. A window of 20 characters moves over
it. The counts of its characters, and the sum of c * log2(c) over them, change by the one character that leaves and the
one that enters, so that a step costs the same for any window. Windows at or above the threshold of their character
class are merged into one span of kind ``entropy``. The allow-list drops pieces that look like prose, paths or
identifiers: a candidate that begins with a host name loses the host, and each segment of its path is a piece; any other
candidate is one piece. Words that mark an example hide the windows within WINDOW characters of them, not the others.

Defined results: null and empty texts have no spans; texts of any length are read whole, in one linear pass for each
rule; repeated rows each get their own result; a column of the output's name is replaced.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The three literal rules and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
WINDOW = 20
#: Bits that a window must reach, by character class; a class is told by the characters that the window holds.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7}
#: Those that scans use: tokens of digits and letters of one case too.
SCANNED = THRESHOLDS | {"lower": 3.5, "upper": 3.5}
#: Pieces that are no secrets: letters alone, numbers alone, one-case words joined by dots, dashes, underlines or slashes,
#: rules and paddings, and UUIDs.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z]+\Z",
        r"[0-9+/_.=-]+\Z",
        r"(?:[a-z]+|[A-Z]+|[0-9]{1,8})(?:[-_./=](?:[a-z]+|[A-Z]+|[0-9]{1,8}))*[-_./=]*\Z",
        r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z",
    )
)
#: The host name that a candidate begins with, and words that mark an example.
HOST = re.compile(r"(?i)/{0,2}(?:www\.[a-z0-9.-]*|[a-z0-9.-]+\.(?:com|org|net|io))(?:/|\Z)")
EXAMPLE = re.compile(r"(?i)example|placeholder|changeme|xxxx+|your[_-]?")
_WEIGHT = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches their class's threshold. Class hex: digits and a-f or A-F only,
    with both a digit and a letter; class mixed: digits, upper and lower case letters all occur; classes lower and upper:
    digits and letters of that case only, both of which occur. A class without a threshold is passed over."""
    if len(text) < window:
        return []
    weight = _WEIGHT if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    kinds = [0 if ch in "0123456789" else (1 if ch.islower() else 2) if ch.isalpha() else 3 for ch in text]
    beyond = [ch not in "0123456789abcdefABCDEF" for ch in text]
    counts: dict[str, int] = {}
    present, outside, total, whole = [0, 0, 0, 0], 0, 0.0, math.log2(window)
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        present[kinds[i]] += 1
        outside += beyond[i]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += weight[c - 1] - weight[c]
            counts[old] = c - 1
            present[kinds[i - window]] -= 1
            outside -= beyond[i - window]
        if i >= window - 1:
            if not outside and present[0] and present[1] + present[2]:
                least = thresholds["hex"]
            elif present[0] and present[1] and present[2]:
                least = thresholds["mixed"]
            elif present[0] and present[1] + present[2] and not present[3]:
                least = thresholds.get("lower" if present[1] else "upper", math.inf)
            else:
                continue
            if whole - total / window >= least - 1e-9:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
    return spans


def pieces(candidate: str) -> list[tuple[int, int]]:
    """Spans of the candidate that are judged apart: the segments after a host name, or the whole."""
    host = HOST.match(candidate)
    return [m.span() for m in re.compile("[^/]+").finditer(candidate, host.end())] if host else [(0, len(candidate))]


def entropy_spans(candidate: str, allow: tuple[re.Pattern, ...]) -> list[tuple[int, int]]:
    """Spans of hot windows in the candidate that neither the allow-list nor a near word for examples hides."""
    found = []
    for start, end in pieces(candidate):
        piece = candidate[start:end]
        if len(piece) < WINDOW or any(a.match(piece) for a in allow):
            continue
        at = 0
        for a, b in [(m.start() - WINDOW, m.end() + WINDOW) for m in EXAMPLE.finditer(piece)] + [(len(piece),) * 2]:
            found += [(start + at + s, start + at + e) for s, e in hot_windows(piece[at : max(a, at)], WINDOW, SCANNED)]
            at = max(at, b)
    return found


def spans_of(text: str | None, allow: tuple[re.Pattern, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind as listed in KINDS."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    for m in CANDIDATE.finditer(text):  # holds every run of 32 hexadecimal digits whole
        found += [("hex", m.start() + h.start(), m.start() + h.end()) for h in HEX.finditer(m[0])]
        found += [("entropy", m.start() + s, m.start() + e) for s, e in entropy_spans(m[0], allow)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str | None:
    """text with every span, overlapping ones as one, replaced by mark."""
    if not spans:
        return text
    parts, at = [], 0
    for _, s, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column of secret spans: array of (kind, start, end)."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans_of(t.as_py())] for t in texts), kind)

    return df.withColumn(out, scan(F.col(text)))


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with secrets in the text replaced by a mark; other columns stay as they are."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array((redacted(t, spans_of(t)) for t in (x.as_py() for x in texts)), pa.string())

    return df.withColumn(text, redact(F.col(text)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "entropy")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
