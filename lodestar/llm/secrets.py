"""Secret scans: fixed patterns, and a randomness test battery on other long tokens (operator 5).

A token's encoding is the smallest alphabet that holds its characters.  Three statistics are held against
what ordinary text in that alphabet gives: chi-squared of uniformity, runs about the alphabet's middle, and
lag-one serial correlation.  Each p-value is the chance that text looks as random; Fisher's method combines
them, and a step-up control with weights by length bounds the share of false discoveries among a document's tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this finds what [0-9a-f]+ of 16 and more finds
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Where a token that fits no encoding is cut, one after the other: '=' but padding, and what joins names and paths.
_CUTS = [re.compile(c) for c in ("=+(?=[^=])", "/", "_", "-")]

#: Rate of false discoveries among a document's tokens; chance that text, names in camel case included, changes its class
#: of characters from one place to the next; characters below which no token can be told from text, so none is tried.
DISCOVERY, CHANGE, LEAST = 0.01, 0.3, 12
#: Normal quantile at which a statistic, on either side, rules out a random token: sequences are even, but not random.
REJECT = 3.29
#: Floor of a p-value of one test, as normal approximations say nothing of farther tails.
TINY = 1e-12

# Shares of the letters a to z in English text, in per mille.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]

_ENCODINGS = [
    ("digits", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


def infer_encoding(token: str) -> str | None:
    """The alphabet of the smallest encoding that holds every character; padding is left aside."""
    seen = set(token.rstrip("="))
    return next((a for _, a in _ENCODINGS if seen <= set(a)), None)


@lru_cache(maxsize=64)
def text_moments(alphabet: str) -> tuple[float, float, float]:
    """What ordinary text in an alphabet is like: excess of chi-squared a character, chance of crossing the middle, serial correlation.

    Text stays in its class (lower, upper, digits, others) and changes it at the rate ``CHANGE``; letters have
    their shares, other characters equal ones.
    """
    kinds = [[c for c in alphabet if f(c)] for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())]
    kinds = [k for k in kinds if k]
    letters = [LETTERS[ord(c.lower()) - 97] if c.isalpha() else 0 for c in alphabet]
    place = {c: i for i, c in enumerate(alphabet)}
    share: dict[int, list[float]] = {}
    for n, kind in enumerate(kinds):
        weights = [letters[place[c]] or 40 for c in kind]
        share[n] = [w / sum(weights) for w in weights]
    # the class that text is mostly in alone: the least spread that it can have, but a third of its weight elsewhere
    first = 0
    mixed = [0.0] * len(alphabet)
    for n, kind in enumerate(kinds):
        weight = 1.0 if len(kinds) == 1 else 0.7 if n == first else 0.3 / (len(kinds) - 1)
        for c, p in zip(kind, share[n], strict=True):
            mixed[place[c]] += weight * p
    excess = len(alphabet) * sum(p * p for p in mixed) - 1
    middle = len(alphabet) / 2
    high = [sum(p for c, p in zip(kind, share[n], strict=True) if place[c] >= middle) for n, kind in enumerate(kinds)]
    mean = [sum(p * place[c] for c, p in zip(kind, share[n], strict=True)) for n, kind in enumerate(kinds)]
    weight = [1.0] if len(kinds) == 1 else [0.7, *[0.3 / (len(kinds) - 1)] * (len(kinds) - 1)]
    all_high, all_mean = sum(w * h for w, h in zip(weight, high, strict=True)), sum(w * m for w, m in zip(weight, mean, strict=True))
    stay = 1 - CHANGE if len(kinds) > 1 else 1.0
    crossing = sum(w * (stay * 2 * h * (1 - h) + (1 - stay) * (h * (1 - all_high) + (1 - h) * all_high)) for w, h in zip(weight, high, strict=True))
    spread = sum(p * (i - all_mean) ** 2 for i, p in enumerate(mixed))
    between = sum(w * (m - all_mean) ** 2 for w, m in zip(weight, mean, strict=True))
    return max(excess, 0.02), crossing, stay * between / spread if spread else 0.0


def _normal(z: float) -> float:
    """P(Z <= z), held above ``TINY``."""
    return min(1.0, max(TINY, 0.5 * math.erfc(-z / math.sqrt(2))))


def _noncentral(x: float, k: float, far: float) -> float:
    """P(X <= x) of a noncentral chi-squared of ``k`` degrees, by Sankaran's approximation."""
    h = 1 - 2 * (k + far) * (k + 3 * far) / (3 * (k + 2 * far) ** 2)
    p = (k + 2 * far) / (k + far) ** 2
    m = (h - 1) * (1 - 3 * h)
    return _normal(((max(x, 1e-9) / (k + far)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p)))


def tests(body: str, alphabet: str) -> tuple[float, float, float]:
    """P-values of uniformity, runs and serial correlation: how often ordinary text would look as random as ``body``.

    All are 1 where one of the statistics is too far from what a random token of that length gives.
    """
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in body]
    n, k = len(x), len(alphabet)
    excess, crossing, correlated = text_moments(alphabet)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi2 = sum(c * c for c in counts.values()) * k / n - n
    crossed = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:], strict=False))
    mean = sum(x) / n
    d = [v - mean for v in x]
    r = sum(a * b for a, b in zip(d, d[1:], strict=False)) / max(1e-9, sum(v * v for v in d))
    far = ((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), (crossed - (n - 1) / 2) / math.sqrt((n - 1) / 4), (r + 1 / n) * math.sqrt(n))
    if max(map(abs, far)) > REJECT:
        return 1.0, 1.0, 1.0
    uniform = _noncentral(chi2, k - 1, n * excess)
    runs = _normal(((n - 1) * crossing - crossed + 0.5) / math.sqrt(max(1e-9, (n - 1) * crossing * (1 - crossing)))) if crossing < 0.5 else 1.0
    serial = _normal((abs(r) - correlated) * math.sqrt(n)) if correlated > 0 else 1.0
    return uniform, runs, serial


def battery(token: str) -> float | None:
    """The combined p-value of the three tests; None for a token in no encoding, or too short for any."""
    body = token.rstrip("=")
    alphabet = infer_encoding(token)
    if alphabet is None or len(body) < LEAST:
        return None
    half = -sum(math.log(p) for p in tests(body, alphabet))  # half of Fisher's chi-squared of six degrees
    return math.exp(-half) * (1 + half + half * half / 2)


def testable(token: str, start: int = 0, cuts: list[re.Pattern[str]] = _CUTS) -> Iterator[tuple[int, str]]:
    """``start, token``, or its parts of ``LEAST`` or more characters if only those fit an encoding."""
    if len(token) < LEAST:
        return
    if infer_encoding(token) is not None:
        yield start, token
    elif cuts:
        edges = [(0, 0), *(m.span() for m in cuts[0].finditer(token)), (len(token), len(token))]
        for (_, s), (e, _) in zip(edges, edges[1:], strict=False):
            yield from testable(token[s:e], start + s, cuts[1:])


def discoveries(found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Weighted step-up control of false discoveries: a token's weight is its share of the tokens' lengths, up to 64."""
    if not found:
        return []
    length = [min(64, e - s) for s, e, _ in found]
    mean = sum(length) / len(length)
    ranked = sorted((p * mean / w, s, e) for (s, e, p), w in zip(found, length, strict=True))
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= DISCOVERY * i / len(ranked)), default=0)
    return [(s, e) for _, s, e in ranked[:last]]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``kind, start, end`` in code points (end exclusive), by start and then kind as in ``KINDS``."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    starts, reach, most = [], [], 0  # base spans by start, and how far those up to there go
    for s, e in sorted((s, e) for _, s, e in spans):
        most = max(most, e)
        starts.append(s)
        reach.append(most)
    tried = []
    for m in _TOKEN.finditer(text):
        for s, token in testable(m[0], m.start()):
            e = s + len(token)
            before = bisect_right(starts, e - 1)
            if not (before and reach[before - 1] > s) and (p := battery(token)) is not None:
                tried.append((s, e, p))
    spans += [("random", s, e) for s, e in discoveries(tried)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: for each row the array of ``kind, start, end``; empty for a null or clean text.

    Repeated rows stay; other columns are not looked at.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of ``find_secrets``."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("random"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
