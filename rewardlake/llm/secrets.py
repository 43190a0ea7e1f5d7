"""Secret scan: fixed patterns, and a battery of randomness tests.

Patterns give the base spans.  What the patterns leave of every long run of
key characters is a candidate if it has both letters and digits (a run that
mixes the signs of two encodings is split at the rarer ones), and so is the
value in every base span, whose verdict is told but which stays a span.  A
candidate's encoding is inferred from the characters it uses, and under the
hypothesis that it is random three p-values are taken -- chi-squared
uniformity over the encoding's alphabet, the runs test about the middle
symbol, and the lag-one serial correlation -- and combined.  Over the
candidates of the whole corpus the tokens that are
*not* random are rejected with a weighted Benjamini-Hochberg procedure: a
token's weight grows with its length, because the tests tell more about long
tokens, so at most the level's share of the rejected ones are random.  What
stays and is long enough for the tests to tell anything is a secret.  The
bound is on random tokens lost, not on the share of false secrets among those
kept: short identifiers that look random stay.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..shipping import ship_by_value
from .common import cut_lineage, fresh

ship_by_value(__name__)

#: base patterns with the group whose length counts and its least length, as listed
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: encodings from the narrowest alphabet to the widest, with the least length the battery can judge
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", DIGITS + "abcdef", 20), ("HEX", DIGITS + "ABCDEF", 20), ("base32", UPPER + "234567", 24),
    ("base36", DIGITS + LOWER, 24), ("BASE36", DIGITS + UPPER, 24), ("base62", DIGITS + UPPER + LOWER, 28),
    ("base64", UPPER + LOWER + DIGITS + "+/", 32), ("base64url", UPPER + LOWER + DIGITS + "-_", 32),
)
#: share of random tokens allowed among the rejected ones; bins of log10(p / weight) per unit, and the lowest
LEVEL, BINS, FLOOR = 0.05, 20, -20
MASK = "[SECRET]"

_TOKEN_BYTES = bytes(1 if chr(b) in UPPER + LOWER + DIGITS + "+/_-" else 0 for b in range(256))
_HEX_BYTES = bytes(1 if chr(b) in DIGITS + "abcdef" else 0 for b in range(256))
_NORMAL = NormalDist()


def infer_encoding(token: str) -> tuple[str, str, int] | None:
    """The narrowest alphabet that holds the token (padding left out)."""
    used = set(token)
    for name, alphabet, least in ENCODINGS:
        if used <= set(alphabet):
            return name, alphabet, least
    return None


def battery(token: str, alphabet: str) -> float:
    """Combined p-value (Cauchy combination) of a token under randomness."""
    at = {c: i for i, c in enumerate(alphabet)}
    x = [at[c] for c in token]
    n, k = len(x), len(alphabet)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    df = k - 1
    z = ((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    uniform = 1 - _NORMAL.cdf(z)

    high = [v >= k // 2 for v in x]
    n1 = sum(high)
    n0 = n - n1
    if n0 and n1:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 2 * n0 * n1 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        run = 2 * (1 - _NORMAL.cdf(abs(runs - mean) / math.sqrt(var))) if var > 0 else 1.0
    else:
        run = 2.0 ** (1 - n)
    mean = sum(x) / n
    dev = [v - mean for v in x]
    var = sum(d * d for d in dev)
    serial = 2 * (1 - _NORMAL.cdf(abs(sum(a * b for a, b in zip(dev, dev[1:], strict=False)) / var) * math.sqrt(n))) if var else 0.0
    total = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in (uniform, run, serial)) / 3
    return min(1.0, max(1e-18, 0.5 - math.atan(total) / math.pi if total < 1e8 else 1 / (total * math.pi)))


def weight(length: int) -> float:
    """Length weight before scaling to a mean of 1."""
    return math.sqrt(length / 20)


def judged(token: str) -> tuple[float, float] | None:
    """p / weight and weight of a token; None if it has no encoding, not both
    letters and digits, or is too short to be judged."""
    token = token.rstrip("=")
    if not (any(c in DIGITS for c in token) and any(c.isalpha() for c in token)):
        return None
    encoding = infer_encoding(token)
    if not encoding or len(token) < encoding[2]:
        return None
    w = weight(len(token))
    return battery(token, encoding[1]) / w, w


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run as one token, or, where it mixes the signs of base64 and
    base64url, split at the rarer kind of sign (at all of them if both are as
    many)."""
    run = text[start:end]
    one, other = len(re.findall(r"[+/]", run)), len(re.findall(r"[-_]", run))
    if not one or not other:
        return [(start, end)]
    signs = "+/-_" if one == other else "+/" if one < other else "-_"
    return [(start + m.start(), start + m.end()) for m in re.finditer(f"[^{re.escape(signs)}]+", run)]


def find(raw: bytes | None) -> tuple[list[tuple[str, int, int, tuple | None]], list[tuple[int, int, float, float]]]:
    """Base spans (kind, start, end, verdict on its value) and candidates
    (start, end, p / weight, weight) of a whole text, in code points.
    Whole-text byte scans decide which patterns have to run at all."""
    raw = raw or b""
    low = raw.lower()
    wanted = [any(w in low for w in WORDS), b"AKIA" in raw, raw.translate(_HEX_BYTES).find(b"\x01" * LEAST["hex"]) >= 0,
              raw.translate(_TOKEN_BYTES).find(b"\x01" * 20) >= 0]
    if not any(wanted):
        return [], []
    text = raw.decode("utf-8", "replace")
    base: list[tuple] = []
    if wanted[0]:
        base += [("assign", m.start(), m.end(), judged(m.group(2))) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if wanted[1]:
        base += [("access", m.start(), m.end(), judged(m.group())) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if wanted[2]:
        base += [("hex", m.start(), m.end(), judged(m.group())) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    more: list[tuple[int, int, float, float]] = []
    if wanted[3]:
        # the base spans as a union, in order
        held: list[list[int]] = []
        for _, s, e, _ in base:
            if held and s <= held[-1][1]:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([s, e])
        ahead = 0
        for m in TOKEN.finditer(text):
            at, end = m.span()
            while ahead < len(held) and held[ahead][1] <= at:
                ahead += 1
            free, k = [], ahead
            while k < len(held) and held[k][0] < end:
                free.append((at, held[k][0]))
                at, k = held[k][1], k + 1
            free.append((at, end))
            for s, e in (p for f in free if f[1] - f[0] >= 20 for p in parts(text, *f)):
                verdict = judged(text[s:e])
                if verdict:
                    more.append((s, e, *verdict))
    return base, more


_FOUND = ("struct<base:array<struct<start:bigint,kind:int,end:bigint,x:double,w:double>>,"
          "more:array<struct<start:bigint,end:bigint,x:double,w:double>>>")
_FOUND_ARROW = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("x", pa.float64()), ("w", pa.float64())]))),
    ("more", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("x", pa.float64()), ("w", pa.float64())])))])


def _raw(texts: pa.Array):
    for t in texts:
        yield t.as_buffer().to_pybytes() if t.is_valid else None


def _find(text: Column) -> Column:
    @arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for raw in _raw(texts):
            base, more = find(raw)
            out.append({"base": [{"start": s, "kind": KINDS.index(k), "end": e, "x": v and v[0], "w": v and v[1]} for k, s, e, v in base],
                        "more": [{"start": s, "end": e, "x": x, "w": w} for s, e, x, w in more]})
        return pa.array(out, _FOUND_ARROW)
    return run(F.coalesce(text, F.lit("")))


def random_cut(found: DataFrame, held: str = "found") -> float:
    """Weighted Benjamini-Hochberg over all candidates: the largest value of
    p / weight (weights of mean 1) that is rejected, taken over log-spaced
    bins; -1 if none is.  One row per bin reaches the driver."""
    # the values of base spans that could be judged are candidates too
    x_and_w = lambda m: F.struct(m["x"].alias("x"), m["w"].alias("w"))
    own = F.filter(f"{held}.base", lambda m: m["x"].isNotNull())
    c = found.select(F.inline(F.concat(F.transform(f"{held}.more", x_and_w), F.transform(own, x_and_w))))
    edge = F.ceil(F.log10(F.greatest("x", F.lit(10.0 ** FLOOR))) * BINS).cast("int")
    bins = c.groupBy(edge.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()
    total, mean = sum(r["n"] for r in bins), sum(r["w"] for r in bins) / max(1, sum(r["n"] for r in bins))
    cut, seen = -1.0, 0
    for r in sorted(bins, key=lambda r: r["b"]):
        seen += r["n"]
        x = 10.0 ** (r["b"] / BINS)
        if x * mean <= LEVEL * seen / total:
            cut = x
    return cut


def scan_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``spans``: array of (start,
    kind, end) in code points, end exclusive, by start and then kind, where
    ``kind`` indexes ``KINDS`` (the last is the battery's); ``base_judged`` and
    ``base_random``: how many base spans have a value that the battery could
    judge, and how many of these it did not reject.

    Defined cases: null and empty texts have no spans; texts of any length
    are scanned whole, also a single run; repeated rows are scanned alike;
    input columns named like the new ones are replaced; without candidates
    nothing is rejected; an empty table gives an empty result.  The texts are
    read once.
    """
    rest = [c for c in docs.columns if c not in ("text", "spans", "base_judged", "base_random")]
    [held] = fresh(docs, "found")
    found = cut_lineage(docs.select(*rest, _find(F.col("text")).alias(held)))
    cut = random_cut(found.select(held), held)
    count = lambda test: F.size(F.filter(F.col(held)["base"], test)).cast("bigint")
    return found.select(*rest, _kept(F.col(held), cut).alias("spans"), count(lambda b: b["x"].isNotNull()).alias("base_judged"),
                        count(lambda b: F.coalesce(b["x"] > cut, F.lit(False))).alias("base_random"))


def _kept(found: Column, cut: float) -> Column:
    added = F.transform(F.filter(found["more"], lambda m: m["x"] > cut), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")))
    base = F.transform(found["base"], lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return F.sort_array(F.concat(base, added))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mask`` and
    ``n_chars`` (if present) counted anew; no row is dropped, texts without
    secrets stay as they are (null stays null).  Overlapping spans become one
    mask.  The texts are read twice: for the rejection cut, and to replace."""
    cut = random_cut(docs.select(_find(F.col("text")).alias("found")))

    @arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for raw in _raw(texts):
            base, more = find(raw)
            spans = sorted([(s, e) for _, s, e, _ in base] + [(s, e) for s, e, x, _ in more if x > cut])
            if raw is None or not spans:
                out.append(None if raw is None else raw.decode("utf-8", "replace"))
                continue
            text, parts, at = raw.decode("utf-8", "replace"), [], 0
            for s, e in spans:
                if s >= at:
                    parts += [text[at:s], mask]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out
