"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines
next to it; labels are known of documents only, so those of the lines they are
trained on are inferred from all documents first. The chain's forward-backward marginals, weighted by the length of the
lines, add up to the quality of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, fresh, need, slices
from vexel.llm.textnum import LOWER, WORD, joined, span_hashes, spans

by_value(__name__, "vexel.llm.common", "vexel.llm.textnum")

#: At most so many labelled documents train the model.
SAMPLE = 3000
#: In choosing the cut, losing a good document weighs so many times as much as keeping a bad one (both as rates).
CARE = 4.0
#: Rows and bytes of text that are scored in one go, to bound a task's memory.
BATCH, BATCH_BYTES = 1500, 2 << 20
#: In training, a line of a bad document is good above PARDON, one of a good document bad up to BLAME, settled in so many turns.
PARDON, BLAME, TURNS = 0.65, 0.02, 3

# Byte classes: 0 lower-case letters and multi-byte characters, 1 capitals, 2 digits, 3 white space, 4 sentence marks, 5 exclamation marks, 6 other symbols.
CLASSES = 7
CLASS = np.full(256, 6, dtype=np.int64)
CLASS[[*range(97, 123), *range(128, 256)]] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[[9, 11, 12, 13, 32]] = 3
CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4
CLASS[ord("!")] = 5
OWN = 12


def line_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that isn't blank, the lines' byte lengths, and the first line of each text with a final total."""
    data, at = joined(texts)
    start, end = spans(data != 10, at)
    if len(start):
        length = end - start
        line = np.repeat(np.arange(len(start)), length)
        inside = np.arange(int(length.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        counts = np.bincount(line * CLASSES + CLASS[data[inside]], minlength=len(start) * CLASSES).reshape(-1, CLASSES)
        full = counts[:, 3] < length
        start, end, counts = start[full], end[full], counts[full]
    first = np.searchsorted(start, at)
    if not len(start):
        return np.zeros((0, 3 * OWN + 1)), np.zeros(0), first
    length = (end - start).astype(float)
    w0, w1 = spans(WORD[data], at)
    owner = np.searchsorted(start, w0, side="right") - 1
    h = span_hashes(LOWER[data], w0, w1)
    n = np.bincount(owner, minlength=len(start)).astype(float)
    seen = np.sort((owner.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    new = np.concatenate(([True], seen[1:] != seen[:-1])) if len(seen) else np.zeros(0, bool)
    distinct = np.bincount((seen[new] >> np.uint64(36)).astype(np.int64), minlength=len(start))
    twice = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=len(start)) if len(h) else np.zeros(len(start))
    share = counts / length[:, None]
    some = np.maximum(n, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    x = np.column_stack([np.log1p(length) / 5, share[:, 0], counts[:, 1] / letters, share[:, 2], share[:, 3], share[:, 4], np.sqrt(share[:, 5]), np.sqrt(share[:, 6]), np.bincount(owner, weights=w1 - w0, minlength=len(start)) / some / 8, np.minimum(1, distinct / some), twice / some, np.log1p(n) / 5])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = doc[1:] == doc[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    return np.column_stack([np.ones(len(x)), x, before, after]), length, first


@dataclass
class Chain:
    """unary: the weight of each feature towards good. step[i, j]: of label j after label i (0 bad, 1 good). start: of the first label. cut: the least quality to keep."""

    unary: np.ndarray
    step: np.ndarray
    start: np.ndarray
    cut: float = 0.5


def marginals(model: Chain, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, the expected number of each kind of step, and the log partition of all chains."""
    good = np.clip(x @ model.unary, -60, 60)
    top = np.maximum(good, 0)
    phi = np.exp(np.column_stack([-top, good - top]))
    step = np.exp(model.step - model.step.max())
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")
    alpha, beta, scale = np.empty_like(phi), np.ones_like(phi), np.ones(len(phi))
    for t in range(longest):
        i = begin[: active[t]] + t
        a = phi[i] * (np.exp(model.start - model.start.max()) if t == 0 else alpha[i - 1] @ step)
        s = a.sum(axis=1)
        alpha[i], scale[i] = a / s[:, None], s
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        b = (phi[i + 1] * beta[i + 1]) @ step.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(phi), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    pair = alpha[i - 1][:, :, None] * step[None] * (phi[i] * beta[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    log_z = float(np.log(scale).sum() + top.sum() + len(i) * model.step.max() + (np.diff(first) > 0).sum() * model.start.max())
    return p[:, 1], pair.sum(axis=0), log_z


def line_labels(x: np.ndarray, first: np.ndarray, good: np.ndarray, turns: int = TURNS, pardon: float = PARDON, blame: float = BLAME) -> np.ndarray:
    """The hidden label of every line, from the documents' labels as bags.

    A line starts with its document's label. A logistic model of the line's own features then tells which lines look
    like those of the other kind of document, in any document that has them; these change sides. A bad document keeps a
    bad line, the one that looks worst, and a good one stays good over most of its length.
    """
    doc = np.repeat(np.arange(len(good)), np.diff(first))
    y = good[doc]
    own, length = x[:, : OWN + 1], np.expm1(x[:, 1] * 5)
    total = np.bincount(doc, weights=length, minlength=len(good))
    for _ in range(turns):
        if y.all() or not y.any():
            break
        p = 1 / (1 + np.exp(-np.clip(own @ _logistic(own, y), -60, 60)))
        y = np.where(good[doc], p > blame, p > pardon)
        worst = np.full(len(good), np.inf)
        np.minimum.at(worst, doc, p)
        y &= good[doc] | (p > worst[doc])
        lost = np.bincount(doc, weights=length * ~y, minlength=len(good)) > total / 2
        y |= good[doc] & lost[doc]
    return y


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 15, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; both classes weigh the same."""
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (share * (y - p)) - l2 * w)
    return w


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Chain:
    """Maximum likelihood of the lines' labels, steps between them included, by Adam."""
    y = label.astype(float)
    begin = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(y), dtype=bool)
    inner[begin] = False
    i = np.flatnonzero(inner)
    pairs = np.bincount(2 * label[i - 1].astype(int) + label[i], minlength=4).reshape(2, 2).astype(float)
    opened = np.array([(1 - y[begin]).sum(), y[begin].sum()])
    d = x.shape[1]
    theta, m, v = np.zeros(d + 6), np.zeros(d + 6), np.zeros(d + 6)
    for k in range(1, rounds + 1):
        model = Chain(theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :])
        p, seen, _ = marginals(model, x, first)
        here = np.array([(1 - p[begin]).sum(), p[begin].sum()])
        g = np.concatenate([x.T @ (y - p), (pairs - seen).ravel(), opened - here]) / max(1, len(x)) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Chain(theta[:d].copy(), theta[d : d + 4].reshape(2, 2).copy(), theta[d + 4 :].copy())


def document_quality(model: Chain, texts) -> np.ndarray:
    """Length-weighted mean of the lines' P(good); 0 for a text without a line that isn't blank."""
    x, length, first = line_features(texts)
    if not len(x):
        return np.zeros(len(first) - 1)
    p, _, _ = marginals(model, x, first)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(first) - 1
    return np.bincount(doc, weights=p * length, minlength=n) / np.maximum(np.bincount(doc, weights=length, minlength=n), 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Chain:
    """A model from at most ``sample`` labelled documents, chosen by a hash of the id, whatever the size of the tables.

    Labels without an id or a value are left out; of contradicting labels the lowest counts. Without labels of both
    kinds the model says good of everything.
    """
    need(docs, text, doc_id)
    need(labels, doc_id, label)
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id")

    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, "body", BATCH_BYTES, BATCH)):
            x, _, first = line_features(batch.column("body"))
            lines = [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(lines, pa.binary()), batch.column("id").cast(pa.string())], names=["y", "x", "id"])

    got = rows.mapInArrow(features, "y int, x binary, id string").toPandas().sort_values(["id", "x"], kind="stable")
    d = 3 * OWN + 1
    xs = [np.frombuffer(b, dtype=np.float32).reshape(-1, d).astype(float) for b in got["x"]]
    good = got["y"].to_numpy() == 1
    if not len(xs) or good.all() or not good.any():
        return Chain(np.eye(1, d)[0] * 10, np.zeros((2, 2)), np.zeros(2))
    first = np.concatenate(([0], np.cumsum([len(x) for x in xs])))
    x = np.concatenate(xs)
    model = fit(x, first, line_labels(x, first, good))
    doc = np.repeat(np.arange(len(xs)), np.diff(first))
    length = np.expm1(x[:, 1] * 5)
    q = np.bincount(doc, weights=marginals(model, x, first)[0] * length, minlength=len(xs)) / np.maximum(np.bincount(doc, weights=length, minlength=len(xs)), 1)
    cuts = np.arange(1, 20) / 20
    loss = [CARE * (q[good] < c).mean() + (q[~good] >= c).mean() for c in cuts]
    model.cut = float(cuts[int(np.argmin(loss))])
    return model


def _scored(model: Chain, text: str, cut: float | None, column: str | None):
    def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, text, BATCH_BYTES, BATCH):
                q = document_quality(model, batch.column(batch.schema.get_field_index(text)))
                if column:
                    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(q)], names=[*batch.schema.names, column])
                if cut is not None:
                    batch = batch.filter(pa.array(q >= cut))
                yield batch

    return scored


def score_quality(docs: DataFrame, model: Chain, text: str = "text", cut: float | None = None, column: str = "quality") -> DataFrame:
    """``docs`` and their quality from 0 to 1 in a last column; with ``cut`` only documents of at least that quality.

    A null text, an empty one and one of blank lines have quality 0. Whole texts are scored, however long. Equal texts
    have equal quality and repeated rows all stay. An empty table gives an empty one. Other columns are kept as they
    are; if one has the name of the new column, the new one is called ``__vx_quality``.
    """
    need(docs, text)
    if column.lower() in {c.lower() for c in docs.columns}:
        column = fresh(docs, "quality")[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(_scored(model, text, cut, column), schema)


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", cut: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs``, with their own columns only, of quality ``cut`` or more (the model's own cut if None) under a model trained on ``labels``; see ``score_quality``."""
    model = train(docs, labels, text, doc_id, sample=sample)
    return docs.mapInArrow(_scored(model, text, model.cut if cut is None else cut, None), docs.schema)
