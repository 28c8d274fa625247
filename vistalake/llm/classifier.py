"""Operator 11: a quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; all documents are the unlabelled text; documents labelled bad
are not looked at. A linear model of a text's shape minimises the non-negative unbiased risk

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

with the logistic loss by Newton's method: each round is one pass over all documents' features, added up in two
steps. The class prior is estimated from the share of unlabelled texts and of positives kept out of the fit
that lie above a score (best-bin estimation). Training covers every document; nothing is sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, written
from vistalake.llm.words import chunks, hash_runs, runs, split_words, text_bytes

#: Classes of bytes; pairs of neighbours are counted by class.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" \t", b"\n", b".,;:?'\"()-", b"!", b"#$%&*|<>@^~+=/\\_{}[]`"]
N_KINDS = len(_KINDS) + 1
_KIND = np.full(256, N_KINDS - 1, np.int64)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
SHAPES = ("size", "words", "distinct_words", "repeated_runs", "same_neighbours", "word_size", "short_words", "long_words", "lines", "repeated_lines", "line_size")
N_FEATURES = N_KINDS * N_KINDS + len(SHAPES)
#: Rounds at most, weight of the squared coefficients, first guess of the prior, bins of scores for the prior, every so many positives kept for it.
ROUNDS, RIDGE, FIRST_PRIOR, BINS, KEPT = 12, 0.1, 0.5, 1000, 4
#: Sums of tasks are added in so many groups before they come to the driver.
TREE = 16


def _share(of: np.ndarray, total: np.ndarray) -> np.ndarray:
    return of / np.maximum(total, 1)


def _per_text(text_of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text_of, weights, minlength=n)


def _distinct(hashes: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Different hashes in each text."""
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return _per_text(t[new], n)


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text: square roots of shares of byte-class pairs, and the shares of SHAPES; zeros for null and empty texts."""
    data, at = text_bytes(texts)
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    kind, owner = _KIND[data], np.repeat(np.arange(n), size)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = np.bincount(owner[inside] * N_KINDS * N_KINDS + kind[inside] * N_KINDS + kind[inside + 1], minlength=n * N_KINDS * N_KINDS).reshape(n, -1)
    out[:, : N_KINDS * N_KINDS] = np.sqrt(_share(pairs, size[:, None]))
    words = split_words(texts)
    count, owner = words.counts, words.text_of
    length = words.ends - words.starts
    beside = np.flatnonzero(owner[1:] == owner[:-1])
    start, run = runs(words, 3)
    edge = np.unique(np.concatenate([at[:-1][size > 0], np.flatnonzero(data == 10) + 1]))
    edge = edge[edge < len(data)]  # a line feed at the end begins no line
    ends = np.append(edge[1:], len(data))
    line_of = np.searchsorted(at, edge, "right") - 1
    n_lines, n_runs = _per_text(line_of, n), _per_text(owner[start], n)
    shapes = [
        np.log1p(size) / 10, np.log1p(count) / 10, _share(_distinct(words.hashes, owner, n), count), _share(n_runs - _distinct(run, owner[start], n), n_runs),
        _share(_per_text(owner[beside][words.hashes[beside + 1] == words.hashes[beside]], n), count), np.log1p(_share(_per_text(owner, n, length), count)), _share(_per_text(owner, n, length <= 2), count),
        _share(_per_text(owner, n, length >= 15), count), np.log1p(n_lines) / 10, _share(n_lines - _distinct(hash_runs(data, edge, ends), line_of, n), n_lines), np.log1p(_share(count, n_lines))]
    out[:, N_KINDS * N_KINDS :] = np.stack(shapes, 1)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        x = text_features(part.column("text")).astype("<f2")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f2").reshape(-1, N_FEATURES).astype(np.float64)


def _flag(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def summed(rows: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of an array of fixed size that `measure` takes of each batch: added up in each task, then in TREE groups of tasks, then on the driver."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = measure(batch)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.frombuffer(s.as_py()) for s in table.column("sums")).tobytes()], pa.binary())})

    parts = rows.mapInArrow(each, "sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    found = parts.groupBy("part").applyInArrow(add, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in found) if found else None


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


class Model:
    """Coefficients for standardised features, the last for a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, np.zeros(len(mean) + 1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def at(self, w: np.ndarray) -> Model:
        out = Model(self.mean, self.scale)
        out.w = w
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (self.inputs(x) * self.w).sum(axis=1)  # row by row: equal texts have equal scores


def _risk_sums(model: Model) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Counts and losses of unlabelled texts and of positives, gradients, and the second derivative."""
    def measure(batch: pa.RecordBatch) -> np.ndarray:
        x, p = model.inputs(_matrix(batch)), _flag(batch, "positive")
        f = x @ model.w
        s = _sigmoid(f)
        losses = [len(f), p.sum(), np.logaddexp(0, f).sum(), np.logaddexp(0, -f[p]).sum(), np.logaddexp(0, f[p]).sum()]
        return np.concatenate([losses, s @ x, x[p].sum(axis=0), ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    return measure


def fit(marked: DataFrame, start: Model, prior: float, rounds: int = ROUNDS) -> Model:
    """The model of least risk by Newton's method from `start`. A step that raises the risk, or makes the part that must not be negative so, is halved, at most four times."""
    d, ridge = N_FEATURES + 1, np.append(np.full(N_FEATURES, RIDGE), 1e-9)

    def look(w: np.ndarray):
        s = summed(marked, _risk_sums(start.at(w)))
        n_u, n_p, loss_u, loss_p, loss_n = s[:5]
        negative = loss_u / n_u - prior * loss_n / n_p
        gradient = s[5 : 5 + d] / n_u - prior * s[5 + d : 5 + 2 * d] / n_p + ridge * w
        return prior * loss_p / n_p + max(0.0, negative) + (ridge * w * w).sum() / 2, negative, gradient, s[5 + 2 * d :].reshape(d, d) / n_u + np.diag(ridge)

    w = start.w
    risk, _, gradient, second = look(w)
    for _ in range(rounds):
        step, share = np.linalg.solve(second, gradient), 1.0
        for _ in range(5):
            new = look(w - share * step)
            if new[0] < risk and new[1] >= 0:
                break
            share /= 2
        else:
            break
        gain, w = risk - new[0], w - share * step
        risk, _, gradient, second = new
        if gain < 1e-6:
            break
    return start.at(w)


def estimate_prior(marked: DataFrame, model: Model) -> float:
    """Share of good texts: the least ratio of the unlabelled and the kept-out positive texts above a score, with the confidence term of best-bin estimation."""
    def measure(batch: pa.RecordBatch) -> np.ndarray:
        bins = np.minimum((_sigmoid(model.margin(_matrix(batch))) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(b, minlength=BINS) for b in (bins, bins[_flag(batch, "kept")])]).astype(float)

    u, p = (x[::-1].cumsum() for x in summed(marked, measure).reshape(2, BINS))
    if not p[-1]:
        return FIRST_PRIOR
    above_u, above_p = u / u[-1], np.maximum(p / p[-1], 1e-9)
    doubt = math.sqrt(math.log(40) / 2 / u[-1]) + math.sqrt(math.log(40) / 2 / p[-1])  # delta = 0.1
    best = int(np.argmin((above_u + 1.01 * doubt) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def train(marked: DataFrame) -> Model:
    """A model from marked(x, positive, kept): fitted with a first guess of the prior, which ranks texts well enough to estimate it, and again with the estimate.

    Without positives every score is a half.
    """
    moments = summed(marked, lambda batch: np.concatenate([[batch.num_rows, _flag(batch, "positive").sum()], *(lambda x: [x.sum(axis=0), (x * x).sum(axis=0)])(_matrix(batch))]))
    if moments is None or not moments[1]:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    mean = moments[2 : 2 + N_FEATURES] / moments[0]
    spread = np.sqrt(np.maximum(moments[2 + N_FEATURES :] / moments[0] - mean * mean, 0))
    start = Model(mean, np.where(spread > 1e-6, spread, 1))
    return fit(marked, start, estimate_prior(marked, fit(marked, start, FIRST_PRIOR)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text); labels(doc_id, quality) are learned from rows that are not held out.

    held_out: crc32 of doc_id as text mod 3 is 1; false without doc_id. A doc_id with several labels is good if one of
    them is 1. Null and empty texts have the score of a text without any feature; rows that share a doc_id are
    scored each; other columns are ignored; an empty table gives none.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    good = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good")).filter((remainder % 3 != 1) & (F.col("good") == 1))
    features = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, x binary")
    trusted, kept = F.col("good").isNotNull(), F.floor(remainder / 3) % KEPT == 0
    marked = features.join(good.hint("merge"), "doc_id", "left").select("doc_id", "x", (remainder % 3 == 1).alias("held_out"), (trusted & ~kept).alias("positive"), (trusted & kept).alias("kept"))
    marked = written(marked, "text-features")
    model = train(marked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _sigmoid(model.margin(_matrix(batch)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    out = written(marked.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"), "quality-scores")
    discard(marked)
    return out


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
