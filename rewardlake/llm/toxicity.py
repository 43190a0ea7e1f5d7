"""Toxicity by weak supervision.

Many voters look at a text: one per lexicon stem (a fixed list of words, and
stems of words that the labelled sample associates with the label) and some
patterns, most of them about how many different words the stems hit.  A
generative label model takes the voters' rates and covariances over *all*
documents: pairs of voters that depend on the hidden label alone have
covariance z_i z_j, so z is a rank-one fit of the off-diagonal covariances,
and pairs whose covariance the fit does not explain are taken as correlated,
left out of the fit and discounted.  The labelled sample takes part as one
more voter.  z and the label's base rate give every voter's rates on toxic
and on clean texts, and so a posterior for each text.
A linear classifier on words and votes is then trained on the posteriors of
the sample and scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..shipping import ship_by_value
from .labelled import training_sample

ship_by_value(__name__)

#: labelled documents that are used, mined voters, further stems of the classifier, bytes of a stem
SAMPLE, MINED, VOCABULARY, STEMS = 12_000, 64, 1500, range(4, 11)
#: different stems a task counts before it hands them on
HELD = 100_000
#: fixed lexicon
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "dumbass", "imbecile", "fool", "loser",
    "losers", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "clowns", "pig", "pigs", "vermin",
    "filth", "filthy", "bastard", "bitch", "asshole", "jerk", "freak", "retard", "retarded", "whore", "slut", "cretin",
    "dummkopf", "arschloch", "blödmann", "trottel", "abschaum", "connard", "connasse", "salaud", "crétin", "imbécile",
    "estúpido", "imbécil", "cabrón", "pendejo", "basura", "inútil",
)
PATTERNS = ("exclaims", "shouts", "masked", "addressed", "dense", "two", "four", "eight")
_SPACED = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_MASKED = re.compile(rb"\b[a-z]{1,8}[*@#$%]{1,4}[a-z]{1,8}\b")
_UPPER = bytes(range(65, 91))
EPS = 1e-4


@dataclass
class LabelModel:
    """Rates of firing on toxic (``on``) and clean (``off``) texts, weights
    (below 1 for correlated voters), base rate, correlated pairs."""
    on: np.ndarray
    off: np.ndarray
    weight: np.ndarray
    base: float
    pairs: list[tuple[int, int]]

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        yes = np.log(self.on / self.off) * self.weight
        no = np.log((1 - self.on) / (1 - self.off)) * self.weight
        z = math.log(self.base / (1 - self.base)) + fired @ yes + (1 - fired) @ no
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    voters: tuple[bytes, ...]
    label_model: LabelModel
    weights: dict
    bias: float


def text_words(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, ASCII signs as spaces."""
    return raw.lower().translate(_SPACED).split()


def stems_of(words: set) -> dict[bytes, int]:
    """How many different words have each stem.  A stem is the beginning of a
    word with a space at its end, so a stem that ends in one is the word."""
    out: Counter = Counter()
    for w in words:
        w += b" "
        out.update([w[:n] for n in STEMS if n < len(w)])
        out[w] += 1
    return out


class Stems:
    """Finds which of some stems a set of words has."""

    def __init__(self, stems):
        self.by_length: dict[int, frozenset] = {}
        for n in sorted({len(s) for s in stems}):
            self.by_length[n] = frozenset(s for s in stems if len(s) == n)
        self.heads = frozenset(s[:3] for s in stems)

    def find(self, words: set) -> tuple[set, int]:
        """The stems, and the number of different words that have one."""
        hits, n = set(), 0
        for w in words:
            if (w[:3] if len(w) > 2 else (w + b" ")[:3]) in self.heads:
                padded = w + b" "
                own = [padded[:k] for k, known in self.by_length.items() if padded[:k] in known]
                if own:
                    hits.update(own)
                    n += 1
        return hits, n


def votes(raw: bytes, words: list[bytes], distinct: set, voters: Stems) -> tuple[set, list[str]]:
    """Lexicon voters and patterns that fire on a text."""
    hits, several = voters.find(distinct)
    n, out = len(words), []
    upper = len(raw) - len(raw.translate(None, _UPPER))
    if raw.count(b"!") * 50 > n > 0:
        out.append("exclaims")
    if upper * 2 > len(raw) > 0:
        out.append("shouts")
    if any(c in raw for c in (b"*", b"@", b"#", b"$", b"%")) and _MASKED.search(raw.lower()):
        out.append("masked")
    if hits and b"you" in distinct:
        out.append("addressed")
    if several * 50 > n:
        out.append("dense")
    out += [p for p, least in (("two", 2), ("four", 4), ("eight", 8)) if several >= least]
    return hits, out


def _raw(texts: pa.Array):
    for t in texts:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def mine_voters(sample: DataFrame, fixed: list[bytes], most: int = MINED) -> tuple[list[bytes], list[bytes], float]:
    """Stems the label goes with, further stems of words it goes with or
    against, and the label's rate.  Counts are summed per task first; the
    short lists reach the driver."""
    def batch(n: Counter, toxic: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()),
                                           pa.array([toxic[w] for w in n], pa.int64())], ["w", "n", "t"])

    def count(batches):
        n, toxic = Counter(), Counter()
        for b in batches:
            for raw, y in zip(_raw(b.column("text")), b.column("y").to_pylist(), strict=True):
                w = [b"", *stems_of(set(text_words(raw)))]
                n.update(w)
                if y:
                    toxic.update(w)
                if len(n) > HELD:
                    yield batch(n, toxic)
                    n, toxic = Counter(), Counter()
        yield batch(n, toxic)

    counts = sample.select("text", "y").mapInArrow(count, "w binary, n bigint, t bigint") \
                   .groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n >= 8 or length(w) = 0").cache()
    total = counts.where("length(w) = 0").first()
    docs, bad = (total["n"], total["t"]) if total else (0, 0)
    rate = (bad + 0.5) / (docs + 1)
    c = counts.where("length(w) > 0")
    # how far the stem's toxic count lies above what the base rate gives, and its lift
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    found = [bytes(r["w"]) for r in c.where((z > 6) & (F.col("t") > 5 * rate * F.col("n"))).orderBy(z.desc(), "w").limit(40 * most).collect()]
    mined: list[bytes] = []
    for w in found:
        if len(mined) < most and not any(w.startswith(m) or m.startswith(w) for m in [*fixed, *mined]):
            mined.append(w)
    further = [bytes(r["w"]) for r in c.where(F.abs(z) > 4).orderBy(F.abs(z).desc(), "w").limit(VOCABULARY).collect()]
    counts.unpersist()
    return mined, further, min(0.5, max(0.01, rate))


def vote_moments(docs: DataFrame, voters: tuple[bytes, ...]) -> tuple[int, np.ndarray]:
    """Number of texts and, for each pair of voters, on how many both fire,
    over all documents (one row per pair reaches the driver)."""
    size, known = len(voters) + len(PATTERNS), Stems(voters)
    place = {v: i for i, v in enumerate(voters)} | {p: len(voters) + i for i, p in enumerate(PATTERNS)}

    def moments(batches):
        total, docs_n = np.zeros((size, size), np.int64), 0
        for b in batches:
            for raw in _raw(b.column("text")):
                words = text_words(raw)
                hits, patterns = votes(raw, words, set(words), known)
                docs_n += 1
                at = [place[x] for x in hits] + [place[p] for p in patterns]
                if at:
                    total[np.ix_(at, at)] += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i.tolist()], pa.int32()), pa.array([-1, *j.tolist()], pa.int32()),
                                          pa.array([docs_n, *total[i, j].tolist()], pa.int64())], ["i", "j", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(moments, "i int, j int, n bigint") \
               .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((size, size)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def fit_label_model(n: int, both: np.ndarray, base: float, known: np.ndarray, tolerance: float = 0.1) -> LabelModel:
    """Moment fit (see the module's text).  ``known`` has each voter's
    correlation with the label on the labelled sample: the label is one more
    voter, always right, with the say of half of all others, and fixes sign
    and scale.  Voters that hardly ever fire say nothing; the weight of a
    voter falls with what it shares with others beyond the label."""
    size = len(both)
    rate = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(rate, rate)
    sd = np.sqrt(np.clip(rate * (1 - rate), 1e-12, None))
    live = np.diag(both) >= 5
    pairs = np.outer(live, live) & ~np.eye(size, dtype=bool)
    corr = np.where(pairs, cov / np.outer(sd, sd), 0.0)
    free, z, say = pairs, np.where(live, known, 0.0), max(1.0, live.sum() / 2)
    rest = np.zeros((size, size))
    for _ in range(6):
        for _ in range(40):
            z = 0.5 * z + 0.5 * np.where(live, (say * known + (free * corr) @ z) / (say + free @ (z * z)), 0.0)
        rest = np.where(pairs, corr - np.outer(z, z), 0.0)
        now = pairs & (np.abs(rest) <= tolerance)
        if (now == free).all():
            break
        free = now
    tied = pairs & ~free
    gap = z * sd / math.sqrt(base * (1 - base))
    on = np.clip(rate + (1 - base) * gap, EPS, 1 - EPS)
    off = np.clip(rate - base * gap, EPS, 1 - EPS)
    on[~live] = off[~live] = 0.5
    weight = 1 / (1 + (np.maximum(rest, 0) * tied).sum(axis=1))
    return LabelModel(on, off, weight, base, [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(tied)), strict=True)])


def train_linear(rows: list[np.ndarray], target: np.ndarray, size: int, steps: int = 200, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features and soft targets, full
    batch with Adam."""
    cols = np.concatenate([np.append(r, size) for r in rows])  # the last column is the bias
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])[:-1]])
    of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[cols], starts), -40, 40)))
        g = np.bincount(cols, weights=(p - target)[of], minlength=size + 1) / len(rows)
        g[:size] += decay * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w[:size], float(w[size])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Voters and classifier from at most ``sample`` labelled documents that
    are not held out, the label model from all documents."""
    rows = training_sample(docs, labels, "toxic", sample)
    fixed = [w.encode() + b" " for w in LEXICON]
    mined, further, base = mine_voters(rows, fixed)
    voters = tuple(dict.fromkeys([*fixed, *mined]))
    names: list = [*voters, *PATTERNS]
    names += [w for w in further if w not in set(voters)]
    place, known, all_stems = {w: i for i, w in enumerate(names)}, Stems(voters), Stems([w for w in names if isinstance(w, bytes)])

    @arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for raw in _raw(texts):
            words = text_words(raw)
            distinct = set(words)
            _, patterns = votes(raw, words, distinct, known)
            out.append([place[w] for w in all_stems.find(distinct)[0]] + [place[p] for p in patterns])
        return pa.array(out, pa.list_(pa.int32()))

    table = rows.select(features("text").alias("f"), "y").toArrow()
    sets = [np.asarray(f, np.int64) for f in table.column("f").to_pylist()]
    size = len(voters) + len(PATTERNS)
    fired, y = np.zeros((len(sets), size)), np.array(table.column("y").to_pylist(), float)
    for k, f in enumerate(sets):
        fired[k, f[f < size]] = 1
    known_corr = np.zeros(size)
    if len(sets) > 1 and y.std() > 0:
        # what a small sample says is shrunk towards nothing
        known_corr = len(y) / (len(y) + 100) * ((fired - fired.mean(axis=0)).T @ (y - y.mean())) / len(y) / np.maximum(fired.std(axis=0) * y.std(), 1e-9)
    n, both = vote_moments(docs, voters)
    label_model = fit_label_model(n, both, base, known_corr)
    weights, bias = {}, math.log(base / (1 - base))
    if sets:
        w, bias = train_linear(sets, label_model.posterior(fired), len(names))
        weights = {x: float(c) for x, c in zip(names, w, strict=True)}
    return Model(voters, label_model, weights, bias)


def toxicity_score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic.

    Defined cases: null and empty texts have the classifier's base score;
    whole texts are read, whatever their length; equal texts score equally."""
    weights, bias, known = model.weights, model.bias, Stems(model.voters)
    weighted = Stems([w for w in weights if isinstance(w, bytes)])

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = []
        for raw in _raw(texts):
            words = text_words(raw)
            distinct = set(words)
            _, patterns = votes(raw, words, distinct, known)
            z = bias + sum(weights[w] for w in sorted(weighted.find(distinct)[0])) + sum(weights.get(p, 0.0) for p in patterns)
            scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return pa.array(scores, pa.float64())
    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with ``toxicity_score`` of its texts; an input column named
    like the output is replaced."""
    return docs.withColumn(out, toxicity_score(model, F.col("text")))
