"""Operator 3: byte-level BPE by a tokenization automaton.

The automaton reads tokens; its state is the last token read, and an arc leads to the token that it is
labelled with. It starts as one state with an arc for every byte. Each merge (a, b) -> c adds its
gadget, in order: after a, the arc b goes away; c gets an arc wherever a has one, and its state has the
arcs that b's state has at that time. A state's row is thus a copy of an earlier row, a label's column
one of an earlier column. The tables hold of each token what it is copied from and when, and of each
gadget the arc that it takes; from these, an entry of the transition table follows by one walk back
through both copies. Entries that have been read are kept in a table of fixed size. A merge whose own
arc is gone by then can never happen; it adds nothing.

The automaton is deterministic: only one sequence of tokens spells a word. It is read from left to
right, for all distinct words of a chunk at once. A table of spellings gives the tokens that end at a
byte; the longest whose arc is open is the last token there, whatever follows. Decoding emits labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import documents
from vistalake.llm.words import byte_pieces, chunks, distinct, hash_runs, ranges, text_bytes

#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies. `split_pieces` cuts as it does.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the table of transitions already read; bytes of distinct words that are encoded together; longest word (bytes) among these, longer ones go one by one.
KEPT_BITS, TOGETHER, LONG = 18, 1 << 19, 64
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
_NEVER = 1 << 60
_kinds: list[np.ndarray] = []


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_labels(spec: dict) -> list[bytes]:
    """What each token spells."""
    chars = byte_characters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"] | special
    labels = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        labels[k] = token.encode() if token in special else bytes(chars[c] for c in token)
    return labels


class Labels:
    """The spellings of all tokens, end to end."""

    def __init__(self, labels: list[bytes]):
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(labels), np.uint8)

    def emit(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.sizes[ids])]


def character_kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER, WHITE or SPACE (the character 0x20) for every code point."""
    if not _kinds:
        every = "".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))
        kinds = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                kinds[m.start() : m.end()] = kind
        kinds[32] = SPACE
        _kinds.append(kinds)
    return _kinds[0]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and kind of every character of UTF-8."""
    table = character_kinds()
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kinds = table[lead]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        first, place = lead[wide].astype(np.int64), at[wide]
        more = lambda k: data[np.minimum(place + k, len(data) - 1)].astype(np.int64) & 0x3F
        two, three = (first & 0x1F) << 6 | more(1), (first & 0x0F) << 12 | more(1) << 6 | more(2)
        four = (first & 0x07) << 18 | more(1) << 12 | more(2) << 6 | more(3)
        kinds[wide] = table[np.where(first < 0xE0, two, np.where(first < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    return at, kinds


def split_pieces(data: np.ndarray, edges: np.ndarray, whole: list[tuple[int, int]] = ()) -> np.ndarray:
    """First byte of each piece that PATTERN cuts from the stretches of `data` that begin at `edges`; the `whole` spans are stretches that stay one piece."""
    at, kind = _characters(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    for a, b in whole:
        cut[[a, b]] = True
    edge = cut[at]
    now, before = kind[1:], kind[:-1]
    # The last of several white characters stands apart where something else follows in the stretch; a space goes with what follows.
    ends = np.ones(len(at), bool)
    ends[:-1] = edge[1:]
    follows = np.zeros(len(at), bool)
    follows[:-1] = (now < WHITE) & ~ends[:-1]
    begins = edge.copy()
    begins[1:] |= np.where(now < WHITE, ((before < WHITE) & (before != now)) | (before == WHITE), (before < WHITE) | follows[1:])
    mark = np.flatnonzero(begins & (data[at] == 39) & ~ends)
    if len(mark):
        room = lambda k: np.where(mark + k < len(at), data[at[np.minimum(mark + k, len(at) - 1)]], 0)
        one, two = room(1), np.where(ends[np.minimum(mark + 1, len(at) - 1)], 0, room(2))
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(one * np.int64(256) + two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        begins[(mark + size + 1)[mark + size + 1 < len(at)]] = True
    starts = at[begins]
    for a, b in whole:
        starts = starts[(starts <= a) | (starts >= b)]
    return starts


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_characters(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.split = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        spelled = read_labels(spec)
        self.labels, self.n = Labels(spelled), len(spelled)
        self.in_use = [vocab[c] for c in chars]
        # Of each token: the gadget that made it (0: a byte), the token whose column it copies and the one whose row; one more for the start.
        made, column, row = [0] * (self.n + 1), list(range(self.n + 1)), list(range(self.n + 1))
        taken: dict[int, int] = {}  # state * n + label: gadget that took the arc
        known = set(self.in_use)
        for number, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if a in known and b in known and self._has_arc(a, b, made, column, row, taken):
                if c in known:
                    raise ValueError(f"two merges make token {c}")
                taken[a * self.n + b] = number
                made[c], column[c], row[c] = number, a, b
                known.add(c)
                self.in_use.append(c)
        self._plain: tuple | None = None  # the same tables as Python numbers, made when a long word is met
        self.made, self.column, self.row = (np.array(x, np.int64) for x in (made, column, row))
        self.taken = np.array(sorted(taken), np.int64)
        self.taker = np.array([taken[k] for k in self.taken.tolist()], np.int64)
        self.maybe_taken = np.zeros(1 << 20, bool)
        self.maybe_taken[self._place(self.taken, 20)] = True
        self.kept = np.full(1 << KEPT_BITS, -1, np.int64)
        self.kept_open = np.zeros(1 << KEPT_BITS, bool)
        self._add_spellings(spelled)

    def _has_arc(self, state: int, label: int, made: list, column: list, row: list, taken: dict) -> bool:
        """By the gadgets added so far; `_read_arcs` walks alike for many arcs at once."""
        state_until, label_until = _NEVER, _NEVER
        while True:
            by = taken.get(state * self.n + label, _NEVER)
            # A gadget of a token with itself takes the new token's arc from that token's state too.
            if by < state_until and by <= label_until:
                return False
            if not (made[state] or made[label]):
                return True
            if made[label] >= made[state]:
                label_until, label = made[label], column[label]
            else:
                state_until, state = made[state], row[state]

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _add_spellings(self, spelled: list[bytes]) -> None:
        """A tree of bytes: `ends` has the token that a node spells. Nodes with several ways on have a row of 256, the others one byte and node."""
        step: dict[int, int] = {}
        ends = [-1]
        for label in self.in_use:
            node = 0
            for byte in spelled[label]:
                node = step.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = label
        self.ends = np.array(ends, np.int32)
        keys, to = np.array(list(step), np.int64), np.array(list(step.values()), np.int32)
        node, byte = keys >> 8, keys & 255
        ways = np.bincount(node, minlength=len(ends))
        self.way = np.zeros(len(ends), np.int32)  # row of a node with several ways on
        many = np.flatnonzero(ways > 1)
        self.way[many] = np.arange(1, len(many) + 1)
        self.ways = np.full((len(many) + 1, 256), -1, np.int32)
        some = ways[node] > 1
        self.ways[self.way[node[some]], byte[some]] = to[some]
        self.only = np.full(len(ends), -1, np.int16)
        self.only_to = np.full(len(ends), -1, np.int32)
        self.only[node[~some]], self.only_to[node[~some]] = byte[~some], to[~some]

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return np.where(self.only[node] == byte, self.only_to[node], self.ways[self.way[node], byte])

    def _read_arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Entries of the transition table: has each state an arc with the label?"""
        out, live = np.ones(len(state), bool), np.arange(len(state))
        state_until, label_until = np.full(len(state), _NEVER), np.full(len(state), _NEVER)
        while len(live):
            key = state * self.n + label
            some = np.flatnonzero(self.maybe_taken[self._place(key, 20)])
            where = np.minimum(np.searchsorted(self.taken, key[some]), len(self.taken) - 1)
            by = np.full(len(live), _NEVER)
            by[some] = np.where(self.taken[where] == key[some], self.taker[where], _NEVER) if len(self.taken) else _NEVER
            gone = (by < state_until) & (by <= label_until)
            out[live[gone]] = False
            of_state, of_label = self.made[state], self.made[label]
            on = np.flatnonzero(~gone & ((of_state > 0) | (of_label > 0)))
            live, state, label, of_state, of_label = live[on], state[on], label[on], of_state[on], of_label[on]
            back = of_label >= of_state
            state_until, label_until = np.where(back, state_until[on], of_state), np.where(back, of_label, label_until[on])
            state, label = np.where(back, state, self.row[state]), np.where(back, self.column[label], label)
        return out

    def arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        key = state * self.n + label
        place = self._place(key, KEPT_BITS)
        out = self.kept_open[place]
        new = np.flatnonzero(self.kept[place] != key)
        if len(new):
            out[new] = self._read_arcs(state[new], label[new])
            self.kept[place[new]] = key[new]
            # Two keys may want one place: the key that got it decides what stands there.
            won = self.kept[place[new]] == key[new]
            self.kept_open[place[new[won]]] = out[new[won]]
        return out

    def _candidates(self, flat: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end at each byte, longest first: where a byte's begin, lengths, labels. limit: bytes from each to its word's end."""
        live, found = np.arange(len(flat)), []
        node = self._step(np.zeros(len(flat), np.int32), flat)
        depth = 1
        while len(live):
            label = self.ends[node]
            some = np.flatnonzero(label >= 0)
            found.append((live[some] + depth - 1, label[some]))
            some = np.flatnonzero(limit[live] > depth)
            live, node = live[some], node[some]
            node = self._step(node, flat[live + depth])
            some = np.flatnonzero(node >= 0)
            live, node = live[some], node[some]
            depth += 1
        first = np.zeros(len(flat) + 1, np.int64)
        for at, _ in found:
            first[at + 1] += 1
        np.cumsum(first, out=first)
        free, sizes, labels = first[:-1].copy(), np.empty(first[-1], np.int32), np.empty(first[-1], np.int64)
        for size, (at, label) in reversed(list(enumerate(found, 1))):
            sizes[free[at]], labels[free[at]] = size, label
            free[at] += 1
        return first, sizes, labels

    def _last_tokens(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each byte the last token of what its word spells up to there. Longest words first."""
        first, sizes, labels = self._candidates(flat, np.repeat(starts + lengths, lengths) - np.arange(len(flat)))
        last = np.full(len(flat), self.n, np.int64)
        if len(starts) == 1 and lengths[0] > LONG:
            return self._last_of_one(first.tolist(), sizes.tolist(), labels.tolist(), len(flat))
        for k in range(int(lengths[0]) if len(lengths) else 0):
            at = starts[: int(np.searchsorted(-lengths, -k, "left"))] + k
            turn = first[at]
            while len(at):
                size, label = sizes[turn], labels[turn]
                state = np.where(size > k, self.n, last[at - np.minimum(size, k)])
                open_ = (size > k) | self.arcs(state, label)
                last[at[open_]] = label[open_]
                at, turn = at[~open_], turn[~open_] + 1
        return last

    def _reader_of_one(self):
        """_read_arcs for one entry, on plain numbers: a long word asks for one entry after another."""
        if self._plain is None:
            self._plain = dict(zip(self.taken.tolist(), self.taker.tolist())), self.made.tolist(), self.row.tolist(), self.column.tolist()
        (taker, made, row, column), n, never = self._plain, self.n, int(_NEVER)

        def read(state: int, label: int) -> bool:
            state_until = label_until = never
            while True:
                by = taker.get(state * n + label, never)
                if by < state_until and by <= label_until:
                    return False
                of_state, of_label = made[state], made[label]
                if of_label >= of_state:
                    if of_label <= 0:
                        return True
                    label_until, label = of_label, column[label]
                else:
                    state_until, state = of_state, row[state]

        return read

    def _last_of_one(self, first: list, sizes: list, labels: list, n: int) -> np.ndarray:
        last, known, read = [], {}, self._reader_of_one()
        for k in range(n):
            for turn in range(first[k], first[k + 1]):
                size, label = sizes[turn], labels[turn]
                if size > k:
                    break
                key = (last[k - size], label)
                if (open_ := known.get(key)) is None:
                    open_ = known[key] = read(*key)
                if open_:
                    break
            last.append(label)
        return np.array(last, np.int64)

    def _encode_block(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        flat, begin = data[ranges(starts[order], size)], np.cumsum(size) - size
        last = self._last_tokens(flat, begin, size)
        back, live, at = [], np.arange(len(order)), begin + size
        count = np.zeros(len(order), np.int64)
        while len(live):
            token = last[at - 1]
            back.append((live, token))
            count[live] += 1
            at = at - self.labels.sizes[token]
            more = at > begin[live]
            live, at = live[more], at[more]
        out_count = np.empty(len(order), np.int64)
        out_count[order] = count
        end = np.cumsum(out_count)[order]
        out = np.empty(int(count.sum()), np.int64)
        for k, (words, token) in enumerate(back, 1):
            out[end[words] - k] = token
        return out, out_count

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of runs of bytes, end to end, and how many each run has."""
        ids, counts, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(lengths)
        long = np.append(np.flatnonzero(lengths > LONG), len(lengths))
        while low < len(lengths):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + TOGETHER)))
            next_long = int(long[np.searchsorted(long, low)])
            high = low + 1 if next_long == low else min(high, next_long)
            some, n = self._encode_block(data, starts[low:high], lengths[low:high])
            ids.append(some)
            counts.append(n)
            low = high
        return np.concatenate(ids), np.concatenate(counts)

    def _special_spans(self, data: np.ndarray, at: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        """Special tokens in texts that begin at `at`."""
        spans, ids, raw = [], [], data.tobytes() if self.split else b""
        if self.split and self.split.search(raw):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                for m in self.split.finditer(raw[a:b]):
                    spans.append((a + m.start(), a + m.end()))
                    ids.append(self.special[m.group()])
        return spans, ids

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, end to end, and where each text's begin; one more at the end."""
        data, at = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        spans, special = self._special_spans(data, at)
        starts = split_pieces(data, at[:-1], spans)
        ends = np.append(starts[1:], len(data))
        first, number = distinct(hash_runs(data, starts, ends))
        ids, counts = self.encode(data, starts[first], (ends - starts)[first])
        where = np.cumsum(counts) - counts
        if spans:  # a special token is a word of one token at the end of the list
            number = number.astype(np.int64)
            number[np.searchsorted(starts, [a for a, _ in spans])] = len(counts) + np.arange(len(spans))
            where, counts = np.append(where, len(ids) + np.arange(len(spans))), np.append(counts, np.ones(len(spans), np.int64))
            ids = np.append(ids, special)
        size = counts[number]
        sums = np.concatenate([[0], np.cumsum(size)])
        return ids[ranges(where[number], size)], sums[np.searchsorted(starts, at)]


_loaded: dict[str, Automaton] = {}
_labels: dict[str, Labels] = {}


def _automaton(name: str) -> Automaton:
    if name not in _loaded:
        _loaded[name] = Automaton(SparkFiles.get(name))
    return _loaded[name]


def ship_file(spark: SparkSession, path: str) -> str:
    """Every executor gets the vocabulary file; returns the name to ask SparkFiles for."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _emit(labels: Labels, ids: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """Each text that the ids spell, in UTF-8; bytes that are no UTF-8 become U+FFFD."""
    size = labels.sizes[ids]
    sums = np.concatenate([[0], np.cumsum(size)])
    for text in byte_pieces(labels.emit(ids), sums[first]):
        yield str(text, "utf-8", "replace").encode()


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every row of `docs`.

    A null text is empty and has no ids. Repeated rows are encoded each, an empty table gives no rows,
    a text of any length is encoded whole. Other columns, whatever their names, are ignored.
    """
    name = ship_file(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name)
        for batch in chunks(batches):
            ids, first = automaton.encode_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(bytes, byte_pieces(ids.astype("<u4"), first)), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """`encoded` (doc_id, ids) plus text; bytes that are no UTF-8 become U+FFFD, null ids an empty text. Other columns are ignored."""
    name = ship_file(encoded.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _labels:
            with open(SparkFiles.get(name), encoding="utf-8") as f:
                _labels[name] = Labels(read_labels(json.load(f)))
        for batch in chunks(batches, "ids"):
            blobs = [x or b"" for x in batch.column("ids").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int64)
            texts = [t.decode() for t in _emit(_labels[name], np.frombuffer(b"".join(blobs), "<u4").astype(np.int64), first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, text string")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each row of `docs` encoded and decoded again, in one pass. Odd rows are treated as `bpe_encode` does."""
    name = ship_file(docs.sparkSession, vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name)
        for batch in chunks(batches):
            ids, first = automaton.encode_texts(batch.column("text"))
            sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), sha(byte_pieces(ids.astype("<u4"), first)), sha(_emit(automaton.labels, ids, first))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), default_vocabulary())
