"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; their features are the hashed word, its first four, five and six bytes and its last four. Labels of tokens come from
those of documents: a token of a toxic document is toxic if one of its features is found in at least `least` sampled toxic texts
and hardly ever in others. The field has two states; it is trained in numpy by adaptive gradient steps on the exact
likelihood (forward-backward). A document's score is a logistic function of its highest token marginal, fitted on the same sample and set to
the share of toxic labels; tokens whose marginal passes one half are its offending spans.

The sample is bounded as for quality: at most `per_class` distinct texts of each class of at most `most_chars` characters.

Cases: a null text counts as empty; texts without words get the lowest evidence; labels that are null, or of documents that
don't exist, aren't used; with labels of one class or none every score is their share (0.5 without any); null doc_ids are scored, never
labelled; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .quality import _sampled
from .textnum import Words, slices

BITS = 20
SPAN = 256
BATCH_CHARS = 1_000_000
FLOOR = -14.0


def token_features(words: Words) -> np.ndarray:
    """A row of feature numbers for each word."""
    kinds = [words.hash, words.prefix(4), words.prefix(5), words.prefix(6), words.suffix(4)]
    return np.stack([(k >> np.uint64(64 - BITS)).astype(np.int32) for k in kinds], 1)


@dataclass
class Field:
    weights: np.ndarray  # of features, for the toxic state
    move: np.ndarray  # 2 x 2 log potentials from state to state
    scale: tuple[float, float]  # slope and intercept from the highest log odds to the score


def _grid(emission: np.ndarray, bounds: np.ndarray, group: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Places x texts."""
    sizes = bounds[group + 1] - bounds[group]
    out = np.full((sizes.max(), len(group)), fill)
    col = np.repeat(np.arange(len(group)), sizes)
    row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = emission[np.repeat(bounds[group], sizes) + row]
    return out


def forward_backward(e: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic : clean of forward and of backward messages at each place (places x texts); e: emissions of the toxic state."""
    m, x = np.exp(move), np.exp(np.clip(e, -30, 30))
    ahead, back = np.empty_like(x), np.ones_like(x)
    ahead[0] = x[0]
    for t in range(1, len(x)):
        r = ahead[t - 1]
        ahead[t] = x[t] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for t in range(len(x) - 2, -1, -1):
        y = x[t + 1] * back[t + 1]
        b = (m[1, 0] + m[1, 1] * y) / (m[0, 0] + m[0, 1] * y)
        back[t] = np.where(t + 1 < sizes, b, 1.0)
    return ahead, back


def ratios(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]), from r[-1] = 0, for a long run of places at once.

    The run is cut into SPAN-long pieces that lie side by side. A piece as a whole is such a step, too: first all pieces' steps are
    multiplied out, then followed from piece to piece, and last each piece is gone through from its own start."""
    n = len(a)
    if not n:
        return np.zeros(0)
    pieces = -(-n // SPAN)
    a, b, c, d = (np.concatenate([v, np.full(pieces * SPAN - n, f)]).reshape(pieces, SPAN).T.copy() for v, f in zip((a, b, c, d), (1.0, 0.0, 0.0, 1.0)))
    p, q, u, v = np.ones(pieces), np.zeros(pieces), np.zeros(pieces), np.ones(pieces)
    for t in range(SPAN):
        p, q, u, v = a[t] * p + b[t] * u, a[t] * q + b[t] * v, c[t] * p + d[t] * u, c[t] * q + d[t] * v
        if t % 4 == 3:
            top = np.maximum(np.maximum(p, q), np.maximum(u, v))
            p, q, u, v = p / top, q / top, u / top, v / top
    r, start = 0.0, np.zeros(pieces)
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist())):
        start[k] = r
        r = (w * r + x) / (y * r + z)
    out = np.empty((SPAN, pieces))
    for t in range(SPAN):
        start = (a[t] * start + b[t]) / (c[t] * start + d[t])
        out[t] = start
    return out.T.ravel()[:n]


def log_odds(emission: np.ndarray, bounds: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log odds of each token's marginal, by forward and backward messages over all texts as one run that begins anew at every text."""
    x, m = np.exp(np.clip(emission, -30, 30)), np.exp(move)
    first, last = (np.zeros(len(x), bool) for _ in range(2))
    some = np.diff(bounds) > 0
    first[bounds[:-1][some]] = last[bounds[1:][some] - 1] = True
    ahead = ratios(np.where(first, 0.0, x * m[1, 1]), np.where(first, x, x * m[0, 1]), np.where(first, 0.0, m[1, 0]), np.where(first, 1.0, m[0, 0]))
    y = np.append(x[1:], 1.0)
    steps = (np.where(last, 0.0, m[1, 1] * y), np.where(last, 1.0, m[1, 0]), np.where(last, 0.0, m[0, 1] * y), np.where(last, 1.0, m[0, 0]))
    back = ratios(*(s[::-1] for s in steps))[::-1]
    return np.log(ahead) + np.log(back)


def label_tokens(features: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, least: int, purity: float = 0.95) -> np.ndarray:
    """Token labels from document labels."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    count = np.zeros((2, 1 << BITS), np.int64)
    for k in range(features.shape[1]):
        pair = np.unique(doc * (1 << BITS) + features[:, k])
        for y in (0, 1):
            own = pair[toxic[pair >> BITS] == y] & ((1 << BITS) - 1)
            count[y] += np.bincount(own, minlength=1 << BITS)
    share = count / np.maximum([[(toxic == 0).sum()], [(toxic == 1).sum()]], 1)
    telling = (count[1] >= least) & (share[1] >= purity * (share[0] + share[1]))
    return telling[features].any(1) & (toxic[doc] == 1)


def train(features: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 0.5, batch: int = 48, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient ascent on the likelihood of token labels."""
    rng = np.random.default_rng(seed)
    w, move = np.zeros(1 << BITS), np.array([[0.0, -2.0], [0.0, -2.0]])
    w2, move2 = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    groups = [order[a : a + batch] for a in range(0, len(order), batch)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            group = groups[g]
            n = sizes[group]
            at = np.repeat(bounds[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            emission = w[features[at]].sum(1)
            local = np.concatenate([[0], np.cumsum(n)])
            e = _grid(emission, local, np.arange(len(group)))
            gold = _grid(y[at].astype(float), local, np.arange(len(group)))
            live = np.arange(len(e))[:, None] < n
            ahead, back = forward_backward(e, n, move)
            odds = ahead * back
            p = odds / (1 + odds)
            error = (gold - p) * live
            step = error.T[live.T]
            grad = np.zeros(1 << BITS)
            for k in range(features.shape[1]):
                np.add.at(grad, features[at, k], step)
            touched = np.flatnonzero(grad)
            w2[touched] += grad[touched] ** 2
            w[touched] += rate * grad[touched] / np.sqrt(w2[touched])
            r, b = ahead[:-1], np.exp(np.clip(e[1:], -30, 30)) * back[1:]
            m, both = np.exp(move), live[1:]
            pair = np.array([[np.ones_like(r) * m[0, 0], m[0, 1] * b], [r * m[1, 0], r * m[1, 1] * b]])
            pair = pair / pair.sum((0, 1)) * both
            a, z = gold[:-1] * both, gold[1:] * both
            true = np.array([[((1 - a) * (1 - z) * both).sum(), ((1 - a) * z).sum()], [(a * (1 - z) * both).sum(), (a * z).sum()]])
            slope = (true - pair.sum((2, 3))) / max(both.sum(), 1)
            move2 += slope**2
            move += 0.2 * slope / np.sqrt(move2)
    return w, move


def highest(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's highest log odds, within [FLOOR, -FLOOR]; FLOOR without words."""
    out = np.full(len(bounds) - 1, FLOOR)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(odds, bounds[some])
    return np.clip(out, FLOOR, -FLOOR)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little ridge."""
    a, t = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3 * len(x) / 100
        t += np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-3 * len(x) / 100 * t), -5, 5)
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 1200, most_chars: int = 6000) -> Field:
    sample, share = _sampled(docs, labels, "toxic", folds, held, per_class, most_chars)
    rows = sorted((r["text"], r["y"]) for r in sample.select("text", "y").collect())
    toxic = np.array([y for _, y in rows], np.int64)
    odds = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n1 or not n0:
        return Field(np.zeros(1 << BITS), np.zeros((2, 2)), (0.0, odds))
    words = Words([t for t, _ in rows])
    features = token_features(words)
    y = label_tokens(features, words.bounds, toxic, max(4, n1 // 30))
    w, move = train(features, words.bounds, y)
    top = highest(log_odds(w[features].sum(1), words.bounds, move), words.bounds)
    slope, intercept = _logistic(top, toxic.astype(float))
    return Field(w, move, (slope, intercept + odds - float(np.log(n1 / n0))))


def tag(docs: DataFrame, field: Field, folds: int = 5, held: int = 0, cut: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start and end in code points, and marginal) of every whole text, and in `kept` a struct of the columns named in keep. The field has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.move, field.scale))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
    names, carried = ["doc_id", "held_out", "score", "predicted", "spans", "kept"], "text" in keep

    def spans_of(words: Words, odds: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in words.bounds[1:]]
        bad = np.flatnonzero(odds >= 0)
        if len(bad):
            points = np.cumsum((words.buf & 0xC0) != 0x80)  # code points up to each byte
            text = np.searchsorted(words.bounds, bad, "right") - 1
            first = np.concatenate([[0], points])[words.offsets[text]]
            start = points[words.start[bad]] - 1 - first
            end = points[words.start[bad] + words.size[bad] - 1] - first
            for d, a, b, z in zip(text.tolist(), start.tolist(), end.tolist(), odds[bad].tolist()):
                out[d].append({"start": a, "end": b, "marginal": 1 / (1 + math.exp(-z))})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, move, (slope, intercept) = sent.value
        for batch in batches:
            texts = [t or "" for t in (batch.column("kept").field("text") if carried else batch.column("text")).to_pylist()]
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                words = Words(texts[a:b])
                odds = log_odds(weights[token_features(words)].sum(1, dtype=np.float64), words.bounds, move)
                p = 1 / (1 + np.exp(-np.clip(slope * highest(odds, words.bounds) + intercept, -500, 500)))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), own.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32)), pa.array(spans_of(words, odds), span), own.column("kept")], names)

    kept = F.struct(F.lit(0).alias("none"), *keep).alias("kept")
    small_batches(docs.sparkSession)
    # The text goes to Python once.
    rows = docs.select("doc_id", *([] if carried else ["text"]), kept, (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,marginal:double>>, kept {rows.schema['kept'].dataType.simpleString()}")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.5, **bounds: int) -> DataFrame:
    return tag(docs, fit(docs, labels, folds, held, **bounds), folds, held, cut).drop("kept")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.5, **bounds: int) -> DataFrame:
    """The documents, all columns, without those whose score is cut or more; rows that repeat a doc_id are judged each by its own text."""
    tagged = tag(docs, fit(docs, labels, folds, held, **bounds), folds, held, cut, docs.columns)
    return tagged.where("predicted = 0").select(*(F.col("kept")[c].alias(c) for c in docs.columns))
