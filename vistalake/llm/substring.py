"""Operator 1: removal of repeated passages by fixed-block anchors.

Any 50 consecutive words hold a whole block of 25 words that starts at a multiple of 25. So:

1. The index holds every text's non-overlapping blocks of 25 words; every rolling window of 25 words
   probes it. Texts travel as chunks, which are cut once and written with their numbers: a chunk sends
   its distinct hashes, sorted and packed into hash-range buckets, and gets back one bit for each ("in
   two texts or more") and one more ("and among these an indexed block").
2. Hits are extended: a run of 50 words can only repeat if all its 25-word windows are in other texts
   and one is an indexed block. These runs' 64-bit hashes are compared over all texts, which gives the
   least doc_id that has each. Runs that overlap merge into maximal repeats.

Nothing is paired, so a passage in a third of all texts costs one hash for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, written
from vistalake.llm.words import REST_BITS, answered_pieces, bits, bucket_bits, bucket_keys, buckets, groups, number_chunks, pack, pack_keys, pieces, runs, split_words, unbits, unpack, unpack_keys

#: Bytes of text that one bucket answers for. A chance match of what is sent of an anchor's hash only lets a run through to the exact step.
BUCKET_BYTES = 12 << 20


class Anchors:
    """Distinct block hashes of a chunk, sorted, with what is known of each from the chunk alone."""

    def __init__(self, words, block: int, n_bits: int):
        self.at, hashes = runs(words, block)
        keys = bucket_keys(hashes, n_bits)
        self.order = np.argsort(keys, kind="stable")
        keys, text = keys[self.order], words.text_of[self.at][self.order]
        first = groups(keys)
        self.keys = keys[first]
        self.number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        if len(first):
            last = np.append(first[1:], len(keys)) - 1
            self.many = text[first] != text[last]  # a stable sort keeps texts in order
            own = (self.at - words.first[words.text_of[self.at]]) % block == 0
            self.indexed = np.logical_or.reduceat(own[self.order], first)

    def spread(self, flags: np.ndarray, n_words: int) -> np.ndarray:
        """Flags of distinct hashes, by word number."""
        out = np.zeros(n_words, bool)
        out[self.at[self.order]] = flags[self.number]
        return out


def _rows(schema: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    n = max(map(len, columns.values()), default=0)
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c) or [None] * n, t) for c, t in schema.items()], names=list(schema))


_ASKED = {"chunk": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "bucket": pa.int32(), "keys": pa.binary(), "many": pa.binary(), "indexed": pa.binary()}


def _ask_anchors(block: int, n_bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, start, stop, docs in pieces(batches):
            a = Anchors(split_words(docs.column("text")), block, n_bits)
            out: dict[str, list] = {c: [] for c in _ASKED}
            for b, s in buckets(a.keys, REST_BITS):
                for c, v in zip(_ASKED, (chunk, start, stop, b, pack_keys(a.keys[s]), bits(a.many[s]), bits(a.indexed[s]))):
                    out[c].append(v)
            yield _rows(_ASKED, out)

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    flat = np.concatenate(keys)
    many, indexed = (np.concatenate([unbits(x, len(k)) for x, k in zip(table.column(c).to_pylist(), keys)]) for c in ("many", "indexed"))
    order = np.argsort(flat, kind="stable")
    first = groups(flat[order])
    size = np.diff(np.append(first, len(flat)))
    shared = (size > 1) | np.logical_or.reduceat(many[order], first)
    live = shared & np.logical_or.reduceat(indexed[order], first)
    back = np.empty((2, len(flat)), bool)
    back[:, order] = np.repeat([shared, live], size, axis=1)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    out = table.select(["chunk", "start", "stop", "bucket"]).append_column("n", pa.array([len(k) for k in keys], pa.int32()))
    for name, flags in zip(("shared", "live"), back):
        out = out.append_column(name, pa.array([bits(x) for x in np.split(flags, cuts)], pa.binary()))
    return out


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


_LOOKED = "kind string, chunk long, bucket int, keys binary, ids binary, many binary, doc_id long, text string, n_words long, kept_sha256 string"
_LOOKED_ARROW = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "keys": pa.binary(), "ids": pa.binary(), "many": pa.binary(), "doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "kept_sha256": pa.string()}


def _look_around(window: int, block: int, n_bits: int):
    """Texts without a candidate run are done; of the others, the runs' hashes are asked about."""

    def look_at(docs: pa.Table, rows: list[dict], out: dict[str, list]) -> None:
        texts, name = docs.column("text").combine_chunks(), docs.column("chunk")[0].as_py()
        words = split_words(texts)
        a, n = Anchors(words, block, n_bits), len(words.hashes)
        flags = [a.spread(np.concatenate([unbits(r[c], r["n"]) for r in rows]), n) if rows else np.zeros(n, bool) for c in ("shared", "live")]
        shared, live = (np.concatenate([[0], np.cumsum(x)]) for x in flags)
        at, hashes = runs(words, window)
        inner = window - block + 1
        maybe = (shared[at + inner] - shared[at] == inner) & (live[at + inner] > live[at])
        at, hashes = at[maybe], hashes[maybe]
        ids = docs.column("doc_id").to_numpy()
        text = words.text_of[at]
        waits = np.zeros(len(ids), bool)
        waits[text] = True
        order = np.lexsort((ids[text], hashes))
        hashes, own = hashes[order], ids[text][order]
        first = groups(hashes)
        last = np.append(first[1:], len(hashes)) - 1
        keys, least, many = hashes[first], own[first], own[first] != own[last] if len(first) else first.astype(bool)
        raw = texts.cast(pa.binary())
        for k, (d, wait) in enumerate(zip(ids.tolist(), waits.tolist())):
            value = raw[k].as_py() or b""
            row = {"kind": "wait" if wait else "done", "chunk": name, "doc_id": d, "n_words": int(words.counts[k])}
            row |= {"text": value.decode()} if wait else {"kept_sha256": _digest(value)}
            for c in out:
                out[c].append(row.get(c))
        for b, s in buckets(keys, 64 - n_bits):
            row = {"kind": "ask", "chunk": name, "bucket": b, "keys": pack(keys[s], 8), "ids": least[s].astype("<i8").tobytes(), "many": bits(many[s])}
            for c in out:
                out[c].append(row.get(c))

    def look(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _LOOKED_ARROW}
        for piece, rows in answered_pieces(docs, answers):
            look_at(piece, rows, out)
        return pa.table({c: pa.array(v, _LOOKED_ARROW[c]) for c, v in out.items()})

    return look


def _answer_runs(table: pa.Table) -> pa.Table:
    """For each chunk, its runs that also start in a text with a smaller doc_id than one of the chunk's that has them, and that doc_id."""
    rows = table.to_pylist()
    keys = [unpack(r["keys"], 8) for r in rows]
    flat, ids = np.concatenate(keys), np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    many = np.concatenate([unbits(r["many"], len(k)) for r, k in zip(rows, keys)])
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    order = np.lexsort((ids, flat))
    first = groups(flat[order])
    least = np.empty(len(flat), np.int64)
    least[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(flat))))
    told = (least < ids) | many
    out = {"chunk": [], "keys": [], "least": []}
    for r, mine, own, low in zip(rows, np.split(told, cuts), keys, np.split(least, cuts)):
        if mine.any():
            for c, v in zip(out, (r["chunk"], pack(own[mine], 8), low[mine].astype("<i8").tobytes())):
                out[c].append(v)
    return pa.table({c: pa.array(v, pa.int64() if c == "chunk" else pa.binary()) for c, v in out.items()})


def _cut(window: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = docs.column("text").combine_chunks(), docs.column("doc_id").to_numpy()
        words = split_words(texts)
        keys = np.concatenate([unpack(x.as_py(), 8) for x in answers.column("keys")] or [np.zeros(0, np.uint64)])
        least = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in answers.column("least")] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, least = keys[order], least[order]
        at, hashes = runs(words, window)
        where = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        gone = np.zeros(len(at), bool)
        if len(keys):
            gone = (keys[where] == hashes) & (least[where] < ids[words.text_of[at]])
        steps = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(steps, at[gone], 1)
        np.add.at(steps, at[gone] + window, -1)
        removed = np.cumsum(steps)[:-1] > 0
        raw, out = texts.cast(pa.binary()), {"doc_id": ids, "n_words": words.counts, "removed": [], "kept_sha256": []}
        for k in range(len(ids)):
            mine = removed[words.first[k] : words.first[k + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            out["removed"].append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            kept = compress((raw[k].as_py() or b"").split(), (~mine).tolist())
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["removed"], span), pa.array(out["kept_sha256"], pa.string())], names=list(out))

    return cut


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, removed (word spans, end exclusive) and kept_sha256 of every row of `docs`.

    A word is removed if a run of `window` words around it also starts in a row with a smaller doc_id.
    A null text has no words. Rows without doc_id neither lose words nor make others lose any; rows
    that share a doc_id don't either to each other. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    block = window // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    n_bits = bucket_bits(known, BUCKET_BYTES)
    texts = written(known.mapInArrow(number_chunks, "chunk long, row long, doc_id long, text string"), "substring-chunks")
    asked = texts.mapInArrow(_ask_anchors(block, n_bits), "chunk long, start long, stop long, bucket int, keys binary, many binary, indexed binary")
    anchors = written(asked.groupBy("bucket").applyInArrow(_answer_anchors, "chunk long, start long, stop long, bucket int, n int, shared binary, live binary"), "anchor-bits")
    looked = written(texts.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_look_around(window, block, n_bits), _LOOKED), "passage-runs", ("kind",))
    discard(texts, anchors)
    asks = looked.filter("kind = 'ask'").select("chunk", "bucket", "keys", "ids", "many")
    answers = asks.groupBy("bucket").applyInArrow(_answer_runs, "chunk long, keys binary, least binary")
    span = "array<struct<start:long,end:long>>"
    cut = (looked.filter("kind = 'wait'").select("chunk", "doc_id", "text").groupBy("chunk").cogroup(answers.groupBy("chunk"))
           .applyInArrow(_cut(window), f"doc_id long, n_words long, removed {span}, kept_sha256 string"))
    done = looked.filter("kind = 'done'").select("doc_id", "n_words", F.array().cast(span).alias("removed"), "kept_sha256")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    other = docs.filter("doc_id is null").select("doc_id", F.size(words).cast("long").alias("n_words"), F.array().cast(span).alias("removed"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))
    return cut.unionByName(done).unionByName(other)


def remove_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs` with the repeated words gone and the kept words joined by one space; doc_id must be a key."""
    found = repeated_passages(docs, window).filter(F.size("removed") > 0).select(F.col("doc_id").alias("_id"), "removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))  # whatever the names of other columns
    words = F.array_remove(F.split("_row.text", r"[\x20\x09-\x0D]+"), "")
    kept = F.filter(words, lambda w, i: ~F.exists("removed", lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.when(F.col("removed").isNotNull(), F.col("_row").withField("text", F.array_join(kept, " "))).otherwise(F.col("_row"))
    return rows.join(found.hint("merge"), "_id", "left").select(cut.alias("_row")).select("_row.*")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n.alias("n_removed"), "kept_sha256")
