"""Operator 2: benchmark decontamination by rare word pairs as seeds and Smith-Waterman alignment.

1. The benchmark's pairs of words, next to each other or one word apart, are counted over all texts (a
   bit table of fixed size keeps other pairs out of the shuffle).
2. The pairs at each item's rarer places are its seeds, which join passages of the texts to items. A
   passage is a stretch of words around seeds that lie close together.
3. Smith-Waterman local alignment over words scores each passage against its items; edited and
   paraphrased copies align with gaps and mismatches. The score is relative to a full copy's.

No copy is missed. An alignment of m words of an item of n reaches the share t if its edits are at most
2m - 2tn. Of its m - 1 steps from one matching word to the next, those with two edits or more are then
at most m - tn, so at least ceil(tn) - 1 have no edit or one: there, both sides have the pair next to
each other or one word apart. Any n - ceil(tn) + 1 of the n - 1 places where a pair may begin hold one of
them, the rarest as well, and any r more of them r more: only passages with r + 1 = HITS of an item's seed places are aligned with it. The alignment has at most m + 2m - 2tn words, which says how far a passage goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.shared import documents, sized, written
from vistalake.llm.words import BYTE_BASE, WORD_BASE, Words, chunks, mix, split_words

FILTER_BITS, ITEMS = 22, 1024
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seed places of an item that a passage must have, as far as copies are sure to have so many.
HITS = 3
#: Least score as a share of a full copy's.
THRESHOLD = 0.5
#: From a pair's first word to its second; 0 is a word alone, the seed of items that one word makes a copy of.
PAIRS, ALONE = (1, 2), (0,)


def _grams(words: Words, steps: tuple[int, ...], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of words with the word `step` further on, as far as they are in the table."""
    n = len(words.hashes)
    left = np.repeat(words.first[1:], words.counts) - np.arange(n)
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for step in steps:
        place = np.flatnonzero(left > step)
        found = words.hashes[place] * np.uint64(WORD_BASE)
        found = mix(found + words.hashes[place + step] * np.uint64(BYTE_BASE) if step else found)
        some = slice(None) if table is None else _passing(found, table)
        at.append(place[some])
        hashes.append(found[some])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    return at[order], hashes[order]


def _read(texts) -> Words:
    return split_words(texts, lower=True, letters=True)


def _least(n: int, threshold: float) -> int:
    """Words of an item of n that a copy has at least."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


_ITEMS = "item_id long, words binary, n int, keep int, grams array<struct<at:int,gram:long>>"


def _items(threshold: float):
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))
        for batch in batches:
            words = _read(batch.column("text"))
            counts = words.counts.tolist()
            cuts = list(zip(words.first[:-1].tolist(), words.first[1:].tolist()))
            found = {steps: _grams(words, steps) for steps in (PAIRS, ALONE)}
            rows = []
            for a, b in cuts:
                at, hashes = found[PAIRS if _least(b - a, threshold) > 1 else ALONE]
                low, high = np.searchsorted(at, [a, b])
                rows.append([{"at": p, "gram": g} for p, g in zip((at[low:high] - a).tolist(), hashes[low:high].view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), pa.array([words.hashes[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array(counts, pa.int32()),
                pa.array([n - _least(n, threshold) + 1 for n in counts], pa.int32()), pa.array(rows, kind)], names=["item_id", "words", "n", "keep", "grams"])

    return items


def _bit_table(grams: DataFrame) -> bytes:
    """Bits for the grams' top and low FILTER_BITS bits: a table of fixed size, whatever the benchmark."""
    table = np.zeros(1 << FILTER_BITS, bool)
    places = F.array(F.shiftrightunsigned("gram", 64 - FILTER_BITS), F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1))
    for batch in grams.select(F.explode(places).alias("place")).distinct().toArrow().to_batches():
        table[batch.column(0).to_numpy()] = True
    return np.packbits(table).tobytes()


def _passing(hashes: np.ndarray, table: bytes) -> np.ndarray:
    """Numbers of the hashes that the table knows."""
    bits = np.frombuffer(table, np.uint8)
    known = lambda place: (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(known((hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
    return some[known((hashes[some] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64))]


def _count(table, steps: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            grams, n = np.unique(_grams(_read(chunk.column("text")), steps, table.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    return count


_PASSAGES = "passage long, doc_id long, start long, words binary, grams array<long>"


def _passages(table, steps: tuple[int, ...], around: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches):
            words = _read(chunk.column("text"))
            at, hashes = _grams(words, steps, table.value)
            text = words.text_of[at]
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (np.diff(at) > around)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))
            low = np.maximum(at[first] - around, words.first[text[first]])
            high = np.minimum(at[last - 1] + around, words.first[text[first] + 1]) if len(first) else low
            ids = chunk.column("doc_id").take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays([
                pa.array(number + np.arange(len(first))), ids, pa.array(low - words.first[text[first]], pa.int64()),
                pa.array([words.hashes[a:b].tobytes() for a, b in zip(low, high)], pa.binary()),
                pa.array([np.unique(hashes[a:b]).view(np.int64).tolist() for a, b in zip(first, last)], pa.list_(pa.int64()))], names=["passage", "doc_id", "start", "words", "grams"])
            number += len(first)

    return cut


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each passage, and the passage word after its end."""
    wide = max(map(len, passages))
    words = np.zeros((len(passages), wide), np.uint64)
    real = np.zeros((len(passages), wide), bool)
    for k, p in enumerate(passages):
        words[k, : len(p)], real[k, : len(p)] = p, True
    slope = -GAP * np.arange(wide + 1)
    row = np.zeros((len(passages), wide + 1), np.int64)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for w in item:
        step = np.zeros_like(row)
        step[:, 1:] = np.maximum(row[:, :-1] + np.where((words == w) & real, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope, axis=1) - slope  # gaps along the passage
        top = row.argmax(axis=1)
        score = row[np.arange(len(row)), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
    return best, end


def _align(threshold: float):
    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column("items"), [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            asked = lists.flatten()
            ids, items = asked.field("item_id"), asked.field("words").to_pylist()
            owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
            score, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
            by: dict[tuple, list[int]] = {}
            for k, (i, o) in enumerate(zip(items, owner.tolist())):
                by.setdefault((i, len(texts[o]).bit_length()), []).append(k)  # passages of like length align together
            for (i, _), all_rows in by.items():
                item = np.frombuffer(i, np.uint64)
                least = _least(len(item), threshold)  # a passage with fewer of the item's words holds no copy
                all_rows = [k for k in all_rows if np.isin(texts[owner[k]], item).sum() >= least]
                most = max(1, 400_000 // max((len(texts[owner[k]]) for k in all_rows), default=1))
                for rows in (all_rows[k : k + most] for k in range(0, len(all_rows), most)):
                    best, at = align(item, [texts[owner[k]] for k in rows])
                    score[rows], end[rows] = best / (MATCH * len(item)), at
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(owner)), ids, pa.array(score), pa.array(batch.column("start").to_numpy()[owner] + end, pa.int64())], names=["doc_id", "item_id", "score", "end_word"])

    return score_all


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, end_word: each row of `docs` with each item that it holds a copy of, best passage only.

    Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased; end_word counts them. score
    is 1 for a full copy, so one word of an item of two is half a copy. Null and wordless texts and items
    match nothing; rows without doc_id or item_id are left out; rows that share a doc_id (or item_id)
    count as one. Nothing in, nothing out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    items = written(items.mapInArrow(_items(threshold), _ITEMS).filter("n > 0"), "benchmark-items")
    longest, alone, n_items = items.agg(F.max("n"), F.max(F.col("keep") == F.col("n")), F.count(F.lit(1))).first()
    steps = PAIRS + (ALONE if alone else ())
    grams = items.select("item_id", F.xxhash64("words").alias("item"), "keep", F.explode("grams").alias("gram")).select("item_id", "item", "keep", "gram.at", "gram.gram")
    table = spark.sparkContext.broadcast(_bit_table(grams))
    counts = docs.mapInArrow(_count(table, steps), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    places = grams.join(counts.hint("merge"), "gram", "left").groupBy("item_id", "item", "keep", "at").agg(F.sum("n").alias("n"), F.collect_set("gram").alias("grams"))
    rank = Window.partitionBy("item_id", "item").orderBy(F.coalesce("n", F.lit(0)), "at")
    seeds = places.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= F.col("keep") + HITS - 1)
    # Of keep + HITS - 1 places a copy has HITS, of fewer (all that the item has) as many fewer.
    need = F.least(F.lit(HITS), F.col("all") - F.col("keep") + 1)
    all_places = grams.groupBy("item_id", "item").agg(F.countDistinct("at").alias("all"))
    seeds = seeds.join(all_places.hint("merge"), ["item_id", "item"]).select("item_id", "item", "at", need.alias("need"), F.explode("grams").alias("gram"))
    seeds = written(seeds, "benchmark-seeds")
    table = spark.sparkContext.broadcast(_bit_table(seeds))
    around = int(np.ceil((longest or 0) * max(1, 3 - 2 * threshold)))
    passages = written(docs.mapInArrow(_passages(table, steps, around), _PASSAGES), "passages")
    # Only passages with enough of an item's places are aligned with it; seeds are sent to all tasks if they are few, so that one that many passages have is no single key.
    met = passages.select("passage", F.explode("grams").alias("gram")).join(sized(seeds), "gram").select("passage", "item_id", "item", "need", "at").distinct()
    hits = met.groupBy("passage", "item_id", "item", "need").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("need")).select("passage", "item_id").distinct()
    # Items go to the passages, at most ITEMS of them in one row: passages move once, whatever the number of their items.
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n_items // ITEMS))))
    asked = hits.join(items.select("item_id", "words").hint("merge"), "item_id").repartition("passage").groupBy("passage", part.alias("part")).agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    pairs = asked.join(passages.select("passage", "doc_id", "start", "words").hint("merge"), "passage")
    scored = pairs.select("doc_id", "start", "words", "items").mapInArrow(_align(threshold), "doc_id long, item_id long, score double, end_word long")
    best = scored.filter(F.col("score") >= threshold).groupBy("doc_id", "item_id")
    return best.agg(F.max("score").alias("score"), F.max_by("end_word", F.struct("score", "end_word")).alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a copy of an item; rows that share a doc_id go together."""
    gone = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))  # whatever the names of other columns
    return rows.join(sized(gone), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
