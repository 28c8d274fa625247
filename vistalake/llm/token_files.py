"""Operator 5: token ids in files, by canonical length-limited Huffman coding.

Ids are counted over all texts; code lengths (at most LIMIT bits) come from those counts by package
merge, and codes follow from the lengths alone. A file is a Parquet table of blocks in ascending
doc_id order. A block holds whole texts and can be decoded by itself: the bit stream, the bit offset of
every STEP-th id as checkpoints, and its texts' ids and lengths. Decoding looks LIMIT bits up in a
table, for all checkpoints of a block in step. The lengths of the code stand in a table beside it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.bpe import default_vocabulary, ship_file
from vistalake.llm.shared import documents, fresh_path, written
from vistalake.llm.words import byte_pieces, chunks, distinct, hash_runs, ranges, text_bytes

LIMIT, STEP, BLOCK_IDS = 20, 64, 1 << 16
#: Ids of a file, about: the number of files follows the input.
FILE_IDS = 1 << 22
#: Words in a generation of a worker's table, and the longest word (bytes) that goes there.
CACHE, CACHED_LENGTH = 500_000, 64
#: Words of letters that the tokenizer sees in one text.
RUN = 100
#: Kinds of bytes: what joins both ways, white space, letters, digits, others.
_JOINS, _WHITE = 0, 1
_KIND = np.array([_JOINS if b > 127 or b == 39 else _WHITE if b in b" \t\n\r\f\v" else 2 if chr(b).isalpha() else 3 if chr(b).isdigit() else 4 for b in range(256)], np.uint8)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits for symbols 0.. with these counts (0: no code), by package merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        order = np.argsort(items, kind="stable")
        levels.append(order < len(leaves))
        items = items[order]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            codes[s], last = code, int(lengths[s])
            code += 1
    return codes


def pack_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, most significant bit first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(at[-1]) // 32 + 2, np.uint64)
    if len(ids):
        where, value = at[:-1] >> 5, codes[ids] << (64 - size - (at[:-1] & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        words[where[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[where[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (int(at[-1]) + 7) // 8], at[:-1][::STEP]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (LIMIT - lengths[used].astype(np.int64)))
        fill = (1 << LIMIT) - int(spans.sum())
        self.symbols = np.concatenate([np.repeat(used, spans), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.sizes = np.concatenate([np.repeat(lengths[used], spans), np.zeros(fill, np.uint8)]).astype(np.int64)

    def unpack(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
        peek = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
        for k in range(STEP):
            bits = (peek[np.minimum(at >> 3, len(peek) - 1)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[:, k] = self.symbols[bits]
            at = at + self.sizes[bits]
        return out.reshape(-1)[:n]


def _cut_words(data: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`data` with A-Z lower-cased, and the starts and ends of runs of bytes that no token crosses.

    Tokens end at white space, and between ASCII letters, digits and other ASCII characters but the
    apostrophe. A capital before a byte above 0x7F stays: it may be one with a mark, which the tokenizer
    composes before it lower-cases (J and a caron have no composed capital but a composed small
    letter). Texts in `apart` are cut at white space only and stay as they are.
    """
    kind = _KIND[data]
    high = np.append(data[1:] >= 0x80, False)
    fold = np.zeros(256, np.uint8)
    fold[65:91] = 32
    low = data + np.where(high, 0, fold[data]).astype(np.uint8)
    begins = kind != _WHITE
    inside = (kind[1:] == kind[:-1]) | (kind[1:] == _JOINS) | (kind[:-1] == _JOINS)
    begins[1:] &= ~inside | (kind[:-1] == _WHITE)
    begins[at[:-1][at[:-1] < at[1:]]] = kind[at[:-1][at[:-1] < at[1:]]] != _WHITE
    for k in apart.tolist():
        a, b = int(at[k]), int(at[k + 1])
        low[a:b] = data[a:b]
        white = kind[a:b] == _WHITE
        begins[a:b] = ~white & np.append(True, white[:-1])
    stops = np.append(begins[1:] | (kind[1:] == _WHITE), True) & (kind != _WHITE)
    stops[at[1:][at[1:] > at[:-1]] - 1] = kind[at[1:][at[1:] > at[:-1]] - 1] != _WHITE
    return low, np.flatnonzero(begins), np.flatnonzero(stops) + 1


class Known:
    """Words by hash, and their ids end to end."""

    def __init__(self, keys=None, where=None, counts=None, ids=None, kind=np.uint16):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.where, self.counts = (np.zeros(0, np.int64) if x is None else x for x in (where, counts))
        self.ids = np.zeros(0, kind) if ids is None else ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keys that are known, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, at[hit]

    def take(self, places: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.where[places], self.counts[places])]

    def plus(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Known:
        keys, where = np.concatenate([self.keys, keys]), np.concatenate([self.where, len(self.ids) + np.cumsum(counts) - counts])
        order = np.argsort(keys)
        return Known(keys[order], where[order], np.concatenate([self.counts, counts])[order], np.concatenate([self.ids, ids]))


class WordIds:
    """Texts to ids by the tokenizers library, which sees each distinct word once for as long as it is known.

    Two generations of words are kept: what is asked for again moves to the young one, and a full young
    one takes the old one's place.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young, self.old = Known(kind=self.kind), Known(kind=self.kind)

    def _look_up_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """_look_up of words of letters a-z, RUN of them in one text: each is one word to the tokenizer, and ends with an id that ends words. None where these don't tell."""
        texts = [" ".join(words[low : low + RUN]) for low in range(0, len(words), RUN)]
        ids = [np.zeros(0, self.kind)]
        for low in range(0, len(texts), 10_000 // RUN):
            found = self.tokenizer.encode_batch_fast(texts[low : low + 10_000 // RUN], add_special_tokens=False)
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in found), self.kind))
        ids = np.concatenate(ids)
        counts = np.diff(np.append(-1, np.flatnonzero(self.ends_word[ids])))
        return (ids, counts) if len(counts) == len(words) and counts.sum() == len(ids) else None

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library, end to end, and how many each word has."""
        plain = np.array([w.isascii() and w.isalpha() and w.islower() for w in words], bool)
        if self.ends_word.any() and plain.any():
            runs = self._look_up_runs([words[k] for k in np.flatnonzero(plain).tolist()])
            if runs:
                ids, counts = self._look_up_each([words[k] for k in np.flatnonzero(~plain).tolist()])
                place = np.empty(len(words), np.int64)
                place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
                all_counts = np.concatenate([runs[1], counts])
                starts = np.cumsum(all_counts) - all_counts
                return np.concatenate([runs[0], ids])[ranges(starts[place], all_counts[place])], all_counts[place]
        return self._look_up_each(words)

    def _look_up_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, ids = np.zeros(len(words), np.int64), [np.zeros(0, self.kind)]
        for low in range(0, len(words), 10_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[low : low + 10_000], add_special_tokens=False)]
            counts[low : low + len(found)] = [len(x) for x in found]
            ids.append(np.fromiter(chain.from_iterable(found), self.kind))
        return np.concatenate(ids), counts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with `end_id` at its end, and where each text's begin; one more at the end."""
        data, at = text_bytes(texts)
        raw, n = data.tobytes(), len(at) - 1
        # A special token's name in upper case is no special token.
        apart = np.unique(np.searchsorted(at, [m.start() for m in re.finditer(rb"<\|", raw)], "right") - 1)
        low, starts, ends = _cut_words(data, at, apart) if len(data) else (data, np.zeros(0, np.int64), np.zeros(0, np.int64))
        hashes = hash_runs(low, starts, ends)
        first, number = distinct(hashes)
        keys = hashes[first]
        hit, place = self.young.find(keys)
        unseen = np.ones(len(keys), bool)
        unseen[hit] = False
        rest = np.flatnonzero(unseen)
        again, old_place = self.old.find(keys[rest])
        moved = rest[again]
        unseen[moved] = False
        new = np.flatnonzero(unseen)
        spelled, raw = low.tobytes(), None
        ids, counts = self._look_up([spelled[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        all_keys, all_counts = np.concatenate([keys[hit], keys[moved], keys[new]]), np.concatenate([self.young.counts[place], self.old.counts[old_place], counts])
        old_ids = self.old.take(old_place)
        all_ids = np.concatenate([self.young.take(place), old_ids, ids])
        short = (ends - starts)[first[new]] <= CACHED_LENGTH
        self.young = self.young.plus(np.concatenate([keys[moved], keys[new][short]]), np.concatenate([self.old.counts[old_place], counts[short]]), np.concatenate([old_ids, ids[np.repeat(short, counts)]]))
        if len(self.young.keys) > CACHE:
            self.young, self.old = Known(kind=self.kind), self.young
        # Every text has one word more, its end.
        where = np.empty(len(keys) + 1, np.int64)
        size = np.ones(len(keys) + 1, np.int64)
        rank = np.concatenate([hit, moved, new])
        where[rank], size[rank] = np.cumsum(all_counts) - all_counts, all_counts
        where[-1] = len(all_ids)
        all_ids = np.append(all_ids, np.array([end_id], self.kind))
        of_text = np.searchsorted(starts, at)
        words = np.insert(number.astype(np.int64), of_text[1:], len(keys))
        sizes = size[words]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return all_ids[ranges(where[words], sizes)], sums[of_text + np.arange(n + 1)]


_loaded: dict[str, WordIds] = {}


def _encode(name: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = WordIds(SparkFiles.get(name))
        table = _loaded[name]
        for batch in chunks(batches):
            ids, first = table.encode(batch.column("text"), end_id)
            blobs = map(bytes, byte_pieces(ids, first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary()), pa.array([table.kind.itemsize] * batch.num_rows, pa.int32())], names=["doc_id", "ids", "width"])

    return encode


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        width = batch.column("width")[0].as_py() if batch.num_rows else 2
        more = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}"))
        if len(more) > len(total):
            total, more = more, total
        total[: len(more)] += more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


_BLOCKS = "part int, at long, n long, doc_ids binary, known binary, sizes binary, stream binary, checkpoints binary"


def _write_blocks(lengths: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        size = np.frombuffer(lengths, np.uint8)
        codes = canonical_codes(size)
        docs: list = []
        held: list = []

        def block() -> pa.RecordBatch:
            nonlocal at
            ids = np.concatenate(held)
            stream, checkpoints = pack_ids(ids, codes, size)
            row = (part, at, len(ids), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs], np.uint8).tobytes(),
                   np.array([len(x) for x in held], "<i8").tobytes(), stream, checkpoints.astype("<i8").tobytes())
            at += len(ids)
            docs.clear()
            held.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        n = 0
        for batch in batches:
            for d, ids, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width"))):
                docs.append(d)
                held.append(np.frombuffer(ids, f"<u{width}"))
                n += len(held[-1])
                if n >= BLOCK_IDS:
                    yield block()
                    n = 0
        if docs:
            yield block()

    return write


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, file_ids: int = FILE_IDS) -> None:
    """Ids of all rows of `docs`, ascending by doc_id (null first; rows that share one by their ids), in files under `path`.

    Every text gets `end_id` at its end; a null text has only that. Repeated rows are written each, an
    empty table gives files without blocks. Columns other than doc_id and text are ignored, whatever
    their names. `path` must not exist.
    """
    spark = docs.sparkSession
    name = ship_file(spark, vocabulary)
    encoded = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(name, end_id), "doc_id long, ids binary, width int"), "token-ids")
    counted = encoded.mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    n_files = max(1, -(-int(counts.sum()) // file_ids))
    ordered = encoded.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_write_blocks(lengths), _BLOCKS).write.parquet(f"{path}/blocks")


def _read_blocks(lengths: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for r in batch.to_pylist():
                ids = decoder.unpack(r["stream"], np.frombuffer(r["checkpoints"], "<i8"), r["n"]).astype("<u4")
                sizes = np.frombuffer(r["sizes"], "<i8")
                ends = np.cumsum(sizes)
                known = np.frombuffer(r["known"], np.uint8).astype(bool)
                out = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(out), pa.int32()), pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=~known), pa.array(r["at"] + ends - sizes, pa.int64()), pa.array(out, pa.binary())],
                    names=["part", "doc_id", "at", "ids"])

    return read


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all texts before it in the files' order) and ids (binary: little-endian unsigned 32-bit)."""
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    before = Window.orderBy("part")  # a row for each file
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    texts = blocks.mapInArrow(_read_blocks(lengths), "part int, doc_id long, at long, ids binary")
    return texts.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, default_vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
