"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features describe the line and its two
neighbours; a transition matrix links the labels of adjacent lines.  Only
documents are labelled, so training starts from the document's label on
every line and then lets the lines of bad documents that look good be good
(at least one stays bad), as the model sees them.  The marginals that
forward-backward gives every line, averaged with the lines' lengths, are the
document's quality, put on the scale of a probability by a logistic fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..shipping import ship_by_value
from .labelled import training_sample

ship_by_value(__name__)

#: labelled documents used, labelled lines after which no further document is used, texts scored at once
SAMPLE, ROWS, PIECE = 6000, 500_000, 256
OWN = ("length", "upper", "signs", "exclaims", "bars", "digits", "repeats", "stutter", "stops", "capital", "word", "short", "again")
SHARED = (1, 2, 3, 4, 6, 7, 8)
SIZE = len(OWN) + 2 * len(SHARED) + 3
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()!?|")


def line_features(lines: list[bytes]) -> list[list[float]]:
    out, before = [], None
    for line in lines:
        w = line.split()
        n, size = max(1, len(w)), max(1, len(line))
        low = [x.lower() for x in w]
        end = line.rstrip()[-1:]
        out.append([
            np.log1p(len(line)) / 8, 2 * (size - len(line.translate(None, _UPPER))) / size if line else 0.0,
            5 * (size - len(line.translate(None, _SIGNS))) / size if line else 0.0, min(2.0, line.count(b"!") / n),
            min(2.0, line.count(b"|") / n), 4 * (size - len(line.translate(None, _DIGITS))) / size if line else 0.0,
            1 - len(set(low)) / n if w else 0.0, sum(map(eq, low, low[1:])) / n, float(end in (b".", b"!", b"?")),
            float(line[:1].isupper()), min(2.0, len(line) / n / 10), float(len(w) < 4), float(line == before)])
        before = line
    return out


def own_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines themselves, line lengths, and lines per
    document.  A text has at least one line."""
    feats, lengths, counts = [], [], []
    for raw in raws:
        lines = raw.split(b"\n")
        feats += line_features(lines)
        lengths += [len(x) + 1 for x in lines]
        counts.append(len(lines))
    return np.array(feats, np.float64).reshape(-1, len(OWN)), np.array(lengths, np.float64), np.array(counts, np.int64)


def with_neighbours(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All features of lines from their own, ``n`` lines a document."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(int)
    last = first + n - 1
    prev, nxt = np.roll(x[:, SHARED], 1, axis=0), np.roll(x[:, SHARED], -1, axis=0)
    edge = np.zeros((len(x), 2))
    prev[first], nxt[last] = 0, 0
    edge[first, 0], edge[last, 1] = 1, 1
    return np.hstack([x, prev, nxt, edge, np.ones((len(x), 1))])


@dataclass
class Chain:
    """``emit``: weights of a line's features for good (against bad);
    ``step``: 2 x 2 log-weights of label pairs; ``scale``: logistic of the
    document's length-weighted mean."""
    emit: np.ndarray
    step: np.ndarray
    scale: tuple[float, float]


def _scan(mats: np.ndarray) -> np.ndarray:
    """Row vectors f[k] = f[k - 1] @ mats[k] from an even start, each scaled
    to sum 1.  Pieces of about the root of the length run side by side, so a
    long sequence takes few steps."""
    n = len(mats)
    size = max(1, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // size)
    a = np.concatenate([mats, np.broadcast_to(np.eye(2), (pieces * size - n, 2, 2))]).reshape(pieces, size, 2, 2)
    whole = a[:, 0]
    for k in range(1, size):
        whole = whole @ a[:, k]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    f, at = np.empty((pieces, 2)), np.full(2, 0.5)
    for c in range(pieces):
        f[c] = at
        at = at @ whole[c]
        at /= at.sum()
    out = np.empty((pieces, size, 2))
    for k in range(size):
        f = f[:, :1] * a[:, k, 0] + f[:, 1:] * a[:, k, 1]
        f /= f.sum(axis=1, keepdims=True)
        out[:, k] = f
    return out.reshape(-1, 2)[:n]


def marginals(score: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected label-pair counts, by
    forward-backward.  All documents are one sequence: a document's first
    line forgets what was before, its last line what comes after."""
    if not len(score):
        return np.zeros(0), np.zeros((2, 2))
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    trans = np.exp(step)
    s = np.clip(score, -30, 30)
    local = np.stack([np.ones_like(s), np.exp(s)], axis=1)  # bad, good
    ahead = trans[None] * local[:, None, :]
    ahead[first] = local[first][:, None, :]
    back = np.ones((len(s), 2, 2))
    back[:-1] = local[1:, :, None] * trans.T[None]
    back[last] = 1
    fwd, bwd = _scan(ahead), _scan(back[::-1])[::-1]
    m = fwd * bwd
    inner = np.ones(len(s), bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    both = fwd[at - 1][:, :, None] * trans[None] * (local * bwd)[at][:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return m[:, 1] / m.sum(axis=1), both.sum(axis=0)


def train_chain(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, start: Chain | None = None, steps: int = 120,
                decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood with Adam."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    inner = np.ones(len(x), bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    theta = np.concatenate([start.emit, start.step.ravel()]) if start else np.zeros(SIZE + 4)
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        good, pairs = marginals(x @ theta[:SIZE], counts, theta[SIZE:].reshape(2, 2))
        g = np.concatenate([x.T @ (good - labels), (pairs - seen).ravel()]) / max(1, len(x)) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Chain(theta[:SIZE], theta[SIZE:].reshape(2, 2), (1.0, 0.0))


def document_means(good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    return np.add.reduceat(good * lengths, first) / np.add.reduceat(lengths, first) if len(counts) else np.zeros(0)


def _scale(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps of a one-variable logistic regression with a small prior."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * mean + b, -30, 30)))
        r, w = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * mean).sum() + 0.01 * a, r.sum() + 0.01 * b])
        h = np.array([[(w * mean * mean).sum() + 0.01, (w * mean).sum()], [(w * mean).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    return max(a, 0.0), b


def fit_chain(own: np.ndarray, lengths: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 3) -> Chain:
    """Line labels, chain and scale from the own features of all lines of
    labelled documents."""
    if not len(y):
        return Chain(np.zeros(SIZE), np.zeros((2, 2)), (1.0, 0.0))
    x = with_neighbours(own, counts)
    of = np.repeat(np.arange(len(y)), counts)
    labels = y[of].astype(float)
    chain = None
    for _ in range(rounds):
        chain = train_chain(x, counts, labels, chain)
        good, _ = marginals(x @ chain.emit, counts, chain.step)
        worst = np.full(len(y), 2.0)
        np.minimum.at(worst, of, good)
        labels = np.where(y[of] == 1, 1.0, ((good > 0.5) & (good > worst[of])).astype(float))
    mean = document_means(good, lengths, counts)
    return Chain(chain.emit, chain.step, _scale(mean, y))


def _line_tables(batches):
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
            x, lengths, _ = own_features([text.as_buffer().to_pybytes()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([y], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([lengths], pa.list_(pa.float64()))],
                ["y", "x", "lengths"])


def whole_documents(rows: list[tuple], most: int) -> list:
    """Ids of documents ``(id, y, lines)`` with ``most`` lines together: one
    after the other, each that still fits; of a label that would have none
    the document of the fewest lines."""
    out, lines, seen = [], 0, set()
    for doc, y, n in rows:
        if lines + n <= most:
            out.append(doc)
            lines += n
            seen.add(y)
    for y in sorted({y for _, y, _ in rows} - seen):
        out.append(min((r for r in rows if r[1] == y), key=lambda r: r[2])[0])
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = ROWS) -> Chain:
    """Fit on all lines of at most ``sample`` labelled documents that are not
    held out, which have at most ``most`` lines together: a document too long
    for what is left is passed over for the next one, never cut
    (``whole_documents``).  The lines' own features are computed in tasks and
    come to the driver, not the texts."""
    rows = training_sample(docs, labels, "quality", sample)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    known = [tuple(r) for r in rows.select("doc_id", "y", lines).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    use = whole_documents(known, most)
    if len(use) < len(known):
        picked = rows.sparkSession.createDataFrame([(i,) for i in use], rows.select("doc_id").schema)
        rows = rows.join(F.broadcast(picked), "doc_id", "left_semi")
    table = rows.select("y", "text").mapInArrow(_line_tables, "y int, x array<double>, lengths array<double>").toArrow()
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    counts = np.array([len(x) for x in table.column("lengths")], np.int64)
    return fit_chain(flat("x").reshape(-1, len(OWN)), flat("lengths"), counts, np.array(table.column("y").to_pylist(), int))


def score_quality(docs: DataFrame, chain: Chain, out: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is of good quality.

    Defined cases: null and empty texts are one empty line; all lines of a
    text count, however many; equal texts score equally; an input column
    named like the output is replaced."""
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out_, raws = [], []
        for t in texts:
            raws.append(t.as_buffer().to_pybytes())
            if len(raws) == PIECE:
                out_.append(_scores(raws, chain))
                raws = []
        out_.append(_scores(raws, chain))
        return pa.array(np.concatenate(out_), pa.float64())
    return docs.withColumn(out, score(F.coalesce("text", F.lit(""))))


def _scores(raws: list[bytes], chain: Chain) -> np.ndarray:
    if not raws:
        return np.zeros(0)
    own, lengths, counts = own_features(raws)
    x = with_neighbours(own, counts)
    good, _ = marginals(x @ chain.emit, counts, chain.step)
    a, b = chain.scale
    return 1 / (1 + np.exp(-np.clip(a * document_means(good, lengths, counts) + b, -30, 30)))
