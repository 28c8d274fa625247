"""Operator 13: ranked lexical search, exact, by norm buckets in the style of LEMP.

With queries q and documents p as vectors over terms, q_t = sqrt(w_t) and p_t = sqrt(w_t) * impact(t, p), the
score is their inner product. Documents are ordered by the length of p and cut into buckets. Given the
query's least score that still ranks, Cauchy-Schwarz passes over a bucket if |q| |p| falls short for its
longest vector. Inside of a bucket the query's terms are taken rarest first until what is left of q can't
reach the least score alone: only documents with one of these coordinates come in question, and of these
only such whose known coordinates, plus the lengths of the rests, can reach it. What is left is scored anew in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, written

#: Upper-case letters become lower-case ones; ASCII other than letters and digits ends terms; bytes above 0x7F belong to them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Rows of a bucket; bytes of query texts that are searched for at a time; share of the longest vectors that give the first least scores.
BUCKET, BLOCK_BYTES, LONGEST = 4096, 4 << 20, 0.05
#: Bounds are computed in doubles and compared with this much room.
ROOM = 1 - 1e-9
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "number int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Queries:
    """A block of queries: their terms as numbers in a vocabulary of the block."""
    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]


def query_block(ids: list, texts: list[str | None]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)}), np.int64) for text in texts]
    return Queries(ids, vocabulary, terms)


def _counted(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.value.get
        for batch in batches:
            ids, sizes, ends, terms, tfs = batch.column("doc_id"), [], [0], [], []
            texts = batch.column("text")
            for k in range(batch.num_rows):
                words = terms_of(texts[k].as_py())
                found = Counter(map(find, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(found.keys(), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int32, len(found)))
                ends.append(ends[-1] + len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0)) if batch.num_rows else out

    return count


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of all documents with a term: length, and how often each term of the vocabulary occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most about BLOCK_BYTES of query text
    return docs.select("doc_id", "text").mapInArrow(_counted(sent), VECTORS)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().astype(np.int64)


def _impacts(weights, docs: int, total: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            at, terms = _lists(batch.column("terms"))
            tf = batch.column("tfs").values.to_numpy().astype(np.int64)
            m = 100 - 90 + 90 * batch.column("n").to_numpy() * docs // total
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(at)))
            mass = np.zeros(len(terms) + 1)
            np.cumsum(w[terms] * impact.astype(float) ** 2, out=mass[1:])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, impact)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(np.sqrt(np.maximum(mass[at[1:]] - mass[at[:-1]], 0)) * (1 + 1e-9))], ["doc_id", "terms", "impacts", "norm"])
            yield out.filter(pa.array(np.diff(at) > 0))

    return weigh


class _Bucket:
    """Vectors of near length, longest first, by row and by term."""

    def __init__(self, batch: pa.RecordBatch):
        self.at, self.terms = _lists(batch.column("terms"))
        self.impacts = batch.column("impacts").values.to_numpy().astype(np.int64)
        self.terms, self.impacts, self.at = self.terms[self.at[0] : self.at[-1]], self.impacts[self.at[0] : self.at[-1]], self.at - self.at[0]
        self.norm = batch.column("norm").to_numpy()
        self.longest = self.norm.max()
        doc_ids = batch.column("doc_id")
        self.doc_ids = doc_ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.rows, self.values = self.terms[order], rows[order], self.impacts[order]

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.by_term, terms, "left"), np.searchsorted(self.by_term, terms, "right")

    def candidates(self, terms: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
        """Rows whose score with a query of these terms may reach `least`."""
        low, high = self.postings(terms)
        order = np.argsort(high - low, kind="stable")
        rest = np.append(np.cumsum(w[order][::-1])[::-1], 0.0)  # of |q|^2, once the first k coordinates are known
        short = np.sqrt(rest) * self.longest < least * ROOM
        known = int(np.argmax(short)) if short.any() else len(terms)
        parts = [(self.rows[low[k] : high[k]], self.values[low[k] : high[k]].astype(float), w[k]) for k in order[:known] if high[k] > low[k]]
        if not parts:
            return np.zeros(0, np.int64)
        rows, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        weight = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
        found, place = np.unique(rows, return_inverse=True)
        inner = np.bincount(place, weight * values)
        mass = np.bincount(place, weight * values * values)
        bound = inner + np.sqrt(rest[known] * np.maximum(self.norm[found] ** 2 * (1 + 1e-9) - mass, 0))
        return found[bound >= least * ROOM]

    def scores(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Exact scores of rows; w has a weight for each term of the vocabulary, 0 for those that the query lacks."""
        size = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(self.at[rows] - ends + size, size)
        return np.add.reduceat(w[self.terms[places]] * self.impacts[places], ends - size)


def _search(queries, weights, least: np.ndarray, k: int, bucket: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = queries.value, weights.value
        size = [math.sqrt(float(w[t].sum())) for t in asked]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        bar, dense = least.copy(), np.zeros(len(w), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, bucket):
                part = _Bucket(batch.slice(low, bucket))
                for number in np.flatnonzero(np.array(size) * part.longest >= bar * ROOM):
                    terms = asked[number]
                    rows = part.candidates(terms, w[terms].astype(float), float(bar[number]))
                    if not len(rows):
                        continue
                    dense[terms] = w[terms]
                    score = part.scores(rows, dense)
                    dense[terms] = 0
                    good = score >= bar[number]
                    score, ids = np.append(best[number][0], score[good]), np.append(best[number][1], part.doc_ids[rows[good]])
                    order = np.lexsort((ids, -score))[:k]
                    best[number] = score[order], ids[order]
                    if len(order) == k:
                        bar[number] = max(bar[number], score[order][-1])
        rows = [len(s) for s, _ in best]
        ids = np.concatenate([d for _, d in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), rows), pa.int32()), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(np.concatenate([s for s, _ in best]) if best else [], pa.int64())], ["number", "doc_id", "score"])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, queries: Queries, k: int = 10, bucket: int = BUCKET, longest: float = LONGEST) -> DataFrame:
    """(number, rank, doc_id, score): the k best documents for each query of a block, by its number in the block."""
    spark = docs.sparkSession
    counted = written(term_vectors(docs, queries.vocabulary), "term-vectors")
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    weights = np.zeros(len(queries.vocabulary), np.int64)
    if totals["docs"]:
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # a row for each term of the vocabulary at most
        weights[df["term"].to_numpy()] = [math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * n + 1))) for n in df["count"]]
    w, asked = spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(queries.terms)
    vectors = counted.mapInArrow(_impacts(w, totals["docs"], totals["total"] or 1), "doc_id long, terms array<int>, impacts array<int>, norm double")
    # Ordered by length over the whole table; vectors of one length, as copies have, are dealt over several tasks.
    ordered = vectors.withColumn("_turn", F.monotonically_increasing_id()).repartitionByRange(F.desc("norm"), "_turn").sortWithinPartitions(F.desc("norm")).drop("_turn")
    ordered = written(ordered, "impact-vectors")
    discard(counted)
    cut = ordered.agg(F.percentile_approx("norm", 1 - longest).alias("cut")).first()["cut"] or 0.0
    run = lambda rows, least: rows.mapInArrow(_search(asked, w, least, k, bucket), FOUND)
    first = written(_best(run(ordered.filter(F.col("norm") >= cut), np.ones(len(queries.terms), np.int64)), k), "search-longest")
    least = np.ones(len(queries.terms), np.int64)
    for r in first.filter(F.col("rank") == k).select("number", "score").collect():  # a row for each query of the block at most
        least[r["number"]] = r["score"]
    size = np.array([math.sqrt(float(weights[t].sum())) for t in queries.terms])
    shortest = float((least / np.where(size > 0, size, 1))[size > 0].min() * ROOM) if (size > 0).any() else 0.0
    rest = run(ordered.filter((F.col("norm") < cut) & (F.col("norm") >= shortest)), least)
    out = written(_best(first.select("number", "doc_id", "score").unionByName(rest), k), "search-best")
    discard(ordered, first)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) the k documents of docs(doc_id, text) of highest score above 0.

    Equal scores go by ascending doc_id, null ids last; rows that share a doc_id are ranked each. Each row of
    `items` is a query of its own, so an item given twice is answered twice. Null and empty texts, texts
    without a term and empty tables find nothing. Other columns are ignored. Items are searched for in blocks of
    about `block_bytes` of text, which bounds what is sent to tasks; each block goes over all documents.
    """
    spark = docs.sparkSession
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = items.select("item_id", "text").withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kind, found = items.schema["item_id"].dataType.simpleString(), []
    for block in range(blocks):
        rows = dealt.filter(F.col("_block") == block).orderBy("item_id", "text").collect()  # about block_bytes
        queries = query_block([r["item_id"] for r in rows], [r["text"] for r in rows])
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"number int, item_id {kind}")
        found.append(search_block(docs, queries, k).join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
