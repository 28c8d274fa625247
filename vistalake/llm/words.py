"""Words of a column of texts and their hashes, in NumPy over Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is a run of characters other
than these. Hashes are 64-bit polynomials taken from prefix sums, so a word or a run of words hashes
alike wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Odd multipliers of the polynomials for bytes and for words, and the constants of the splitmix64 finalizer.
BYTE_BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Texts are handled in chunks of about so many bytes (one text is never cut), and hashed in blocks that fit the CPU's cache.
CHUNK_BYTES, BLOCK_BYTES = 6 << 20, 1 << 20
#: Bits of a hash that are sent beside its bucket's number, and the number of keys from which on they are packed by cells.
REST_BITS, MANY_KEYS = 34, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but letters, digits and bytes above 0x7F.
_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        table = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        table[0] = 1
        _tables[base] = np.multiply.accumulate(table)
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts, end to end, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    data: np.ndarray  #: bytes, end to end
    starts: np.ndarray  #: of each word in data
    ends: np.ndarray
    first: np.ndarray  #: number of each text's first word; one more at the end
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """lower: A-Z become a-z. letters: punctuation also ends words."""
    between = _NO_LETTER if letters else _SPACE
    data, at = text_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, hashes, low = [], [], [], 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + BLOCK_BYTES, "right")) - 1)
        block, edges = data[at[low] : at[high]], at[low : high + 1] - at[low]
        if len(block):
            space = between[block]
            before = np.empty(len(block), bool)
            before[0], before[1:] = True, space[:-1]
            before[edges[:-1][edges[:-1] < len(block)]] = True
            after = np.empty(len(block), bool)
            after[-1], after[:-1] = True, space[1:]
            after[edges[1:][edges[1:] > 0] - 1] = True
            s, e = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block + np.uint64(1)) * powers(BYTE_BASE, len(block)), out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * powers(pow(BYTE_BASE, -1, 1 << 64), len(block) + 1)[s]))
            starts.append(s + at[low])
            ends.append(e + at[low])
        low = high
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return Words(data, starts, join(ends, np.int64), np.searchsorted(starts, at), join(hashes, np.uint64))


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (numbers of words) where runs of k words of one text start, and the runs' hashes."""
    n = len(words.hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * powers(WORD_BASE, n), out=sums[1:])
    left = np.repeat(words.first[1:], words.counts) - np.arange(n)
    at = np.flatnonzero(left >= k)
    return at, mix((sums[at + k] - sums[at]) * powers(pow(WORD_BASE, -1, 1 << 64), n + 1)[at] + np.uint64(k))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text each; the same batches give the same slices."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, low = np.cumsum(sizes), 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (lengths[k] of them) for every k, end to end."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint runs of bytes; alike wherever a run stands."""
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK_BYTES, "right")))
        base, n = starts[low], int(ends[high - 1] - starts[low])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n] + np.uint64(1)) * powers(BYTE_BASE, n), out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((sums[e] - sums[s]) * powers(pow(BYTE_BASE, -1, 1 << 64), n + 1)[s])
        low = high
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash stands first, and each hash's number among them."""
    number = pa.array(hashes).dictionary_encode().indices.to_numpy()
    first = np.empty(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first, number


def byte_pieces(data: np.ndarray, first: np.ndarray) -> Iterator[memoryview]:
    """What lies between neighbours of `first`, in bytes."""
    view, width = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    for a, b in zip((first[:-1] * width).tolist(), (first[1:] * width).tolist()):
        yield view[a:b]


def number_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, row (in the chunk), doc_id, text of slices of about CHUNK_BYTES. Numbers hold for one run only: write the rows before they are read twice."""
    part = TaskContext.get().partitionId()
    for k, c in enumerate(chunks(batches)):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(c.num_rows, part << 32 | k)), pa.array(np.arange(c.num_rows)), c.column("doc_id"), c.column("text")], names=["chunk", "row", "doc_id", "text"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """Runs of rows of one chunk as a reader meets them: chunk, first row, row after the last, rows. A chunk is one piece unless its rows are split."""
    for batch in batches:
        chunk, row = batch.column("chunk").to_numpy(), batch.column("row").to_numpy()
        new = np.flatnonzero((chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1] + 1)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(chunk)]):
            if b > a:
                yield int(chunk[a]), int(row[a]), int(row[b - 1]) + 1, batch.slice(a, b - a)


def answered_pieces(docs: pa.Table, answers: pa.Table) -> Iterator[tuple[pa.Table, list[dict]]]:
    """Each piece of a chunk that asked, with its answers by bucket; rows between these, which had nothing to ask, without."""
    docs = docs.take(pc.sort_indices(docs.column("row"))) if docs.num_rows else docs
    by: dict[tuple[int, int], list[dict]] = {}
    for r in answers.to_pylist():
        by.setdefault((r["start"], r["stop"]), []).append(r)
    at = 0
    for (start, stop), rows in sorted(by.items()):
        if start > at:
            yield docs.slice(at, start - at), []
        yield docs.slice(start, stop - start), sorted(rows, key=lambda r: r["bucket"])
        at = stop
    if docs.num_rows > at:
        yield docs.slice(at), []


def groups(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def bucket_keys(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The top bits of hashes that are sent: a bucket's number and REST_BITS more, so that chance matches are as rare at any size."""
    return hashes >> np.uint64(64 - n_bits - REST_BITS)


def buckets(keys: np.ndarray, rest_bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (all but the lowest rest_bits) of sorted keys, and where their keys stand."""
    top = keys >> np.uint64(rest_bits)
    cuts = np.append(groups(top), len(keys))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(top[a]), slice(a, b)


def pack_keys(keys: np.ndarray) -> bytes:
    """The lowest REST_BITS of sorted keys of one bucket. Many keys: how many stand in each cell of 2^24, and three bytes of each; few: five bytes of each."""
    rest = keys & np.uint64((1 << REST_BITS) - 1)
    if len(rest) < MANY_KEYS:
        return b"\0" + pack(rest, 5)
    return b"\1" + np.bincount((rest >> np.uint64(24)).astype(np.int64), minlength=1 << REST_BITS - 24).astype("<u4").tobytes() + pack(rest, 3)


def unpack_keys(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return unpack(blob[1:], 5)
    cells = 4 << REST_BITS - 24
    high = np.repeat(np.arange(1 << REST_BITS - 24, dtype=np.uint64), np.frombuffer(blob[1 : 1 + cells], "<u4"))
    return high << np.uint64(24) | unpack(blob[1 + cells :], 3)


def bucket_bits(docs, per_bucket: int) -> int:
    """Number of top bits so that a bucket answers for about `per_bucket` bytes of text; grows with the input."""
    from pyspark.sql import functions as F

    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2, int(np.ceil(np.log2(max(1.0, total / per_bucket)))))
