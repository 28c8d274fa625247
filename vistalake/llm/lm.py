"""Operator 8: language-model scores by subword lattice likelihood.

The pieces of an existing vocabulary span every word in many ways. A unigram model over the pieces gives
each way a probability; the forward recursion, in logarithms, sums them all, so a text's score is its
marginal probability and depends on no single segmentation. The vocabulary that is given belongs to a
byte-pair model, whose scores are ranks and no probabilities: they order the pieces for a first guess, and
probabilities are fitted to the training texts' word counts by expectation-maximisation. Characters
outside the vocabulary fall back to bytes.

Words are counted over all texts first. A word that makes up 2^-18 of all tokens or more is frequent
(there are 2^18 of these at most): its scores are sent to all tasks. The other words of each text are
joined with the word table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.bpe import default_vocabulary
from vistalake.llm.shared import documents, written
from vistalake.llm.words import chunks, mix, powers, split_words

FREQUENT_BITS, EM_ROUNDS, SPACE = 18, 4, "▁"
_CHAR_BASE = 0x9FB21C651E98DF25
LN10 = float(np.log(10.0))
#: With fewer words of one length each is taken by itself, all of its edges at once; nodes of such a word whose edges are Python numbers at a time.
FEW_WORDS, _NODES = 64, 50_000


def vocabulary_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, best score first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return [model.id_to_piece(k) for k in sorted(plain, key=lambda k: (-model.get_score(k), k))]


class Lattice:
    """log_p: natural logarithms for each piece, then for one byte (256 bytes share their mass evenly), then for the end of a text."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.log_p, self.byte = log_p, len(pieces)
        hashes = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            codes = np.array([[ord(c) for c in piece]], np.uint64)
            hashes[k] = self._sums(codes)[0, -1]
        hashes = mix(hashes)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.longest = max(map(len, pieces), default=1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * powers(_CHAR_BASE, codes.shape[1]), axis=1, out=out[:, 1:])
        return out

    def _spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of the lattice's edges, by end and then start; edges of one byte-coded character have piece `byte`."""
        sums, back = self._sums(codes), powers(pow(_CHAR_BASE, -1, 1 << 64), codes.shape[1] + 1)
        for j in range(1, codes.shape[1] + 1):
            for i in range(max(0, j - self.longest), j):
                h = mix((sums[:, j] - sums[:, i]) * back[i])
                rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                hit = self.keys[at] == h[rows]
                rows, found = rows[hit], self.order[at[hit]]
                if i == j - 1 and len(rows) < len(codes):
                    none = np.ones(len(codes), bool)
                    none[rows] = False
                    rows, found = np.concatenate([rows, np.flatnonzero(none)]), np.concatenate([found, np.full(int(none.sum()), self.byte)])
                if len(rows):
                    yield i, j, rows, found

    @staticmethod
    def _n_bytes(codes: np.ndarray) -> np.ndarray:
        return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)

    def _by_length(self, words: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words of one length, and their code points with the space mark in front."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(sizes[order]) > 0])), len(words)) if len(words) else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            for k in range(low, high, most):
                mine = order[k : min(high, k + most)]
                text = "".join(SPACE + words[m] for m in mine)
                yield mine, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(mine), -1).astype(np.uint64)

    def _weights(self, codes: np.ndarray, i: int, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        out = self.log_p[found]
        raw = found == self.byte
        if raw.any():
            out = np.where(raw, out * self._n_bytes(codes[rows, i]), out)
        return out

    def _forward(self, codes: np.ndarray, spans) -> np.ndarray:
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0
        for i, j, rows, found in spans:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self._weights(codes, i, rows, found))
        return alpha

    def _edges_of_one(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces, log probabilities) of one word's edges by end and then start; all edges of one length are looked up at once."""
        n = len(codes)
        sums, back = self._sums(codes[None])[0], powers(pow(_CHAR_BASE, -1, 1 << 64), n + 1)
        starts, sizes, pieces = [], [], []
        for size in range(1, min(self.longest, n) + 1):
            h = mix((sums[size:] - sums[:-size]) * back[: n - size + 1])
            at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[place] == h[at]
            found, piece = at[hit], self.order[place[hit]]
            if size == 1:
                none = np.ones(n, bool)
                none[found] = False
                found, piece = np.concatenate([found, np.flatnonzero(none)]), np.concatenate([piece, np.full(int(none.sum()), self.byte)])
            starts.append(found)
            sizes.append(np.full(len(found), size))
            pieces.append(piece)
        start, size, piece = (np.concatenate(x) for x in (starts, sizes, pieces))
        order = np.lexsort((start, start + size))
        start, end, piece = start[order], (start + size)[order], piece[order]
        weight = self.log_p[piece]
        return start, end, piece, np.where(piece == self.byte, weight * self._n_bytes(codes[start]), weight)

    @staticmethod
    def _pass(n: int, groups: np.ndarray, other: np.ndarray, weight: np.ndarray, backward: bool = False) -> np.ndarray:
        """The recursion along one word: node by node the logarithm of the sum over its edges (groups[j] to groups[j + 1]), each from the node `other`."""
        values = [0.0] * (n + 1)
        for high in range(n, 0, -_NODES) if backward else range(0, n, _NODES):  # edges become Python numbers a stretch of nodes at a time
            nodes = range(high - 1, max(-1, high - 1 - _NODES), -1) if backward else range(high + 1, min(n, high + _NODES) + 1)
            first, last = min(nodes[0], nodes[-1]), max(nodes[0], nodes[-1])
            base = int(groups[first])
            at, far, w = (groups[first : last + 2] - base).tolist(), other[base : groups[last + 1]].tolist(), weight[base : groups[last + 1]].tolist()
            for j in nodes:
                a, b = at[j - first], at[j - first + 1]
                found = [values[far[e]] + w[e] for e in range(a, b)]
                top = max(found)
                values[j] = top if b - a == 1 else top + math.log(math.fsum([math.exp(x - top) for x in found]))
        return np.array(values)

    def _forward_of_one(self, n: int, edges) -> np.ndarray:
        start, end, _, weight = edges
        return self._pass(n, np.searchsorted(end, np.arange(n + 2)), start, weight)

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        for mine, codes in self._by_length(words):
            if len(mine) < FEW_WORDS:
                for k, row in zip(mine, codes):
                    out[k] = self._forward_of_one(len(row), self._edges_of_one(row))[-1]
            else:
                out[mine] = self._forward(codes, self._spans(codes))[-1]
        return out

    def _expected_of_one(self, codes: np.ndarray) -> np.ndarray:
        """Expected uses in one word."""
        edges, n = self._edges_of_one(codes), len(codes)
        start, end, piece, weight = edges
        alpha = self._forward_of_one(n, edges)
        order = np.lexsort((end, start))
        beta = self._pass(n, np.searchsorted(start[order], np.arange(n + 2)), end[order], weight[order], backward=True)
        share = np.exp(alpha[start] + weight + beta[end] - alpha[-1])
        return np.bincount(piece, np.where(piece == self.byte, share * self._n_bytes(codes[start]), share), len(self.log_p))

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and of bytes, over the words as often as `counts` says."""
        total = np.zeros(len(self.log_p))
        for mine, codes in self._by_length(words, 4096):
            if len(mine) < FEW_WORDS:
                for k, row in zip(mine, codes):
                    total += self._expected_of_one(row) * counts[k]
                continue
            spans = list(self._spans(codes))
            alpha = self._forward(codes, spans)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0
            for i, j, rows, found in reversed(spans):
                weight = self._weights(codes, i, rows, found)
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + weight)
                # All edges into j's later nodes are done, so beta[j] is final here.
                share = np.exp(alpha[i, rows] + weight + beta[j, rows] - alpha[-1, rows]) * counts[mine[rows]]
                share = np.where(found == self.byte, share * self._n_bytes(codes[rows, i]), share)
                total += np.bincount(found, share, len(total))
        return total


def first_guess(n_pieces: int) -> np.ndarray:
    """Zipf's law over the vocabulary's order, one share in a thousand for bytes and one in a hundred for the end."""
    p = 1.0 / (np.arange(n_pieces) + 10.0)
    return np.log(np.concatenate([p / p.sum() * 0.989, [0.001 / 256, 0.01]]))


def fitted(uses: np.ndarray, ends: float) -> np.ndarray:
    """Probabilities from expected uses; every piece and the bytes get a hundredth of a use more."""
    uses = uses + 0.01
    uses[-1] = ends + 0.01
    p = uses / uses.sum()
    p[-2] /= 256
    return np.log(p)


def _is_training(doc_ids: list, folds: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(str(d).encode() if d is not None else b"") % folds != held for d in doc_ids], bool)


def _chunk_words(chunk: pa.RecordBatch):
    """Distinct words of a chunk (as strings), each token's number among them and text."""
    words = split_words(chunk.column("text"), lower=True)
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    return words, first, number, texts


def _count_words(folds: int, held: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words, _, number, texts = _chunk_words(chunk)
            train = _is_training(chunk.column("doc_id").to_pylist(), folds, held)[words.text_of]
            total, mine = np.bincount(number, minlength=len(texts)), np.bincount(number[train], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(mine, pa.int64()), pa.array(total, pa.int64())], names=["word", "c", "total"])

    return count


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Batches put together: the lattice takes words of one length at a time, which pays for many words only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _expect(lattice_args: tuple):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*lattice_args)
        total = np.zeros(len(lattice.log_p))
        for batch in _gathered(batches):
            total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "uses"])

    return expect


def _word_scores(lattice_args: tuple):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*lattice_args)
        for table in _gathered(batches):
            log_p = pa.array(lattice.log_likelihood(table.column("word").to_pylist()) / LN10)
            yield from table.append_column("log_p", log_p).to_batches(10_000)

    return score


_PARTS = "row long, doc_id long, word string, n long, n_known long, base double, score double"


def _text_parts(frequent, folds: int, held: int, end_base: float, end_known: bool, end_score: float):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, base, score = frequent.value
        row = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches):
            words, first, number, texts = _chunk_words(chunk)
            own = words.hashes[first]
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            pick = lambda table: np.where(hit, table[at], 0) if len(keys) else np.zeros(len(own))
            n, text = chunk.num_rows, words.text_of
            add = lambda table: np.bincount(text, pick(table)[number], n)
            ids = chunk.column("doc_id").to_pylist()
            rows = row + np.arange(n)
            row += n
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), pa.array(ids, pa.int64()), pa.nulls(n, pa.string()), pa.array(words.counts + 1, pa.int64()), pa.array(add(known).astype(np.int64) + int(end_known)),
                pa.array(add(base) + end_base), pa.array(add(score) + end_score)], names=["row", "doc_id", "word", "n", "n_known", "base", "score"])
            rare = ~hit[number]
            pair, times = np.unique(text[rare] * len(texts) + number[rare], return_counts=True)
            m = len(pair)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[pair // max(1, len(texts))], pa.int64()), pa.nulls(m, pa.int64()), pa.array(texts, pa.string()).take(pa.array(pair % max(1, len(texts)))),
                pa.array(times, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=["row", "doc_id", "word", "n", "n_known", "base", "score"])

    return parts


def lattice_scores(docs: DataFrame, vocabulary: str, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Tokens are words (A-Z lower-cased) and one end. Rows with crc32(doc_id as text) % folds == held are
    held out; a null doc_id counts as the empty text. A null or empty text has its end only. Each row
    is scored by itself, repeated ones too; with no training rows every count is 0. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held
    ends = docs.agg(F.count_if(train).alias("train"), F.count(F.lit(1)).alias("total")).first()
    counted = docs.mapInArrow(_count_words(folds, held), "word string, c long, total long")
    words = written(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total")), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("total").alias("total")).first()
    n, v, total = (sums["n"] or 0) + ends["train"], sums["v"] + (ends["train"] > 0), (sums["total"] or 0) + ends["total"]

    pieces = vocabulary_pieces(vocabulary)
    log_p = first_guess(len(pieces))
    learned = words.filter("c > 0").select("word", "c")
    for _ in range(EM_ROUNDS):
        uses = np.zeros(len(log_p))
        for r in learned.mapInArrow(_expect((pieces, log_p)), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row for each piece at most
            uses[r["piece"]] = r["uses"]
        log_p = fitted(uses, float(ends["train"]))
    scored = words.mapInArrow(_word_scores((pieces, log_p)), "word string, c long, total long, log_p double")
    log_base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    scored = written(scored.withColumn("log_base", log_base), "word-scores")

    often = scored.filter(F.col("total") * (1 << FREQUENT_BITS) >= total).collect()  # 2^18 rows at most
    texts = pa.array([r["word"] for r in often], pa.string())
    keys = split_words(texts).hashes
    order = np.argsort(keys)
    table = [np.array([f(r) for r in often])[order] for f in (lambda r: float(r["c"] > 0), lambda r: r["log_base"], lambda r: r["log_p"])]
    frequent = spark.sparkContext.broadcast((keys[order], *table))
    end_base = float(np.log10((ends["train"] + 1) / (n + v + 1)))
    parts = written(docs.mapInArrow(_text_parts(frequent, folds, held, end_base, ends["train"] > 0, float(log_p[-1]) / LN10), _PARTS), "text-parts")
    rare = parts.filter("word is not null").select("row", "word", "n").join(scored.select("word", "c", "log_base", "log_p").hint("merge"), "word")
    times = F.col("n")
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, times).otherwise(0).cast("long").alias("n_known"), (times * F.col("log_base")).alias("base"), (times * F.col("log_p")).alias("score"))
    whole = parts.filter("word is null").select("row", "doc_id", "n", "n_known", "base", "score")
    out = whole.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")])
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    return out.select("doc_id", held_out.alias("held_out"), F.col("n").alias("n_tokens"), "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(documents(spark, sf_dir), default_vocabulary("piece_bpe_32k.model"))
