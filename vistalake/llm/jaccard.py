"""Operator 7: n-gram Jaccard join by vertical partitioning.

Every text is the set of its distinct 5-word shingles. One global order of all shingles, rarest
first, is cut into fragments:

1. Document frequencies. Texts are cut into chunks once and written with their numbers. A chunk sends
   its distinct shingles, packed by range of the hash, and gets back a logarithmic frequency for each.
   The order is by frequency, then hash. A text with fewer shared shingles than the threshold asks for
   links with nothing and is done.
2. Equal sets become one class. Classes meet in the lists of the shingles at the front of their
   order (two sets that link share one there).
3. Candidate pairs are counted by fragment: a fragment is a range of the global order that holds an
   even share of all shingles; partial overlaps are counted in each fragment apart, and summed per pair.

Only components are wanted, so a list is not paired out: its leader is compared with the members that
are not yet in the leader's component. Lists that still hold several components after these rounds
form clusters by the members they share. A cluster is dealt in blocks by hash and by size; tasks count
the overlaps of two blocks, fragment after fragment, as products of matrices summed per pair, and return
for each member the least member that it reaches there, never the pairs.

What this costs: lists are linear in the fronts. A cluster of m members that are still in several
components takes at most 3 (m / BLOCK)^2 tasks of two blocks each, and sends each set to 3 m / BLOCK of
them; only clusters whose members share shingles but mostly don't link with their lists' leaders stay large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistalake.llm.shared import discard, documents, sized, written
from vistalake.llm.words import REST_BITS, answered_pieces, bucket_bits, bucket_keys, buckets, groups, mix, number_chunks, pack_keys, pieces, runs, split_words, unpack_keys

BUCKET_BYTES = 12 << 20
#: Fragments of the global order, parts that a leader's members are dealt over, and rounds of leaders before clusters are compared whole.
FRAGMENTS, PARTS, ROUNDS = 4, 16, 1
#: Members of a block of a cluster, shingles of a fragment inside a task, and the number of a block's members from which on a shingle counts as common there.
BLOCK, SLICE, COMMON = 1024, 2048, 8


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, end to end; and where each text's begin. A text of 1 to k-1 words has one: all its words."""
    words = split_words(texts, lower=True)
    counts, n = words.counts, len(words.first) - 1
    at, hashes = runs(words, k)
    owner = words.text_of[at]
    short = [runs(words, j) for j in range(1, k)]
    for j, (place, h) in enumerate(short, 1):
        whole = counts[words.text_of[place]] == j
        owner, hashes = np.concatenate([owner, words.text_of[place][whole]]), np.concatenate([hashes, h[whole]])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(n + 1))


def _distinct(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sent keys, sorted; each hash's number among them; the times each occurs."""
    return np.unique(bucket_keys(hashes, n_bits), return_inverse=True, return_counts=True)


_SENT = {"chunk": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "bucket": pa.int32(), "keys": pa.binary(), "times": pa.binary()}


def _send(k: int, n_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, start, stop, docs in pieces(batches):
            keys, _, times = _distinct(shingle_sets(docs.column("text"), k)[0], n_bits)
            out: list[list] = [[] for _ in _SENT]
            for b, s in buckets(keys, REST_BITS):
                for column, v in zip(out, (chunk, start, stop, b, pack_keys(keys[s]), np.minimum(times[s], 255).astype(np.uint8).tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SENT.values())], names=list(_SENT))

    return send


def _frequencies(table: pa.Table) -> pa.Table:
    """For each key sent: 0 if it is in one set only, else 1 + the whole part of log2 of the number of sets."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    flat, times = np.concatenate(keys), np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
    order = np.argsort(flat)
    first = groups(flat[order])
    total = np.add.reduceat(times[order].astype(np.int64), first)
    level = np.where(total > 1, np.log2(np.maximum(total, 1)).astype(np.uint8) + 1, 0).astype(np.uint8)
    back = np.empty(len(flat), np.uint8)
    back[order] = np.repeat(level, np.diff(np.append(first, len(flat))))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return table.select(["chunk", "start", "stop", "bucket"]).append_column("levels", pa.array([x.tobytes() for x in np.split(back, cuts)], pa.binary()))


_SETS = "doc_id long, tag long, n_shingles long, set_key binary, tokens binary, levels binary"


def _sets(k: int, percent: int, n_bits: int):
    """Each text's shared shingles in the global order, with their frequency levels."""

    def read_piece(docs: pa.Table, rows: list[dict]) -> pa.Table:
        hashes, first = shingle_sets(docs.column("text"), k)
        _, number, _ = _distinct(hashes, n_bits)
        level = np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8)[number]
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        shared = np.bincount(owner[level > 0], minlength=len(size))
        links = (size > 0) & (100 * shared >= percent * size)
        keep = links[owner] & (level > 0)
        order = np.lexsort((hashes[keep], level[keep], owner[keep]))
        tokens, level = hashes[keep][order], level[keep][order]
        cuts = np.searchsorted(owner[keep][order], np.arange(len(size) + 1))
        names = np.zeros((2, len(size)), np.uint64)
        if len(hashes):
            some = size > 0
            for row, salt in zip(names, (1, 2)):
                row[some] = np.add.reduceat(mix(hashes ^ mix(np.array([salt], np.uint64))), first[:-1][some])
        names = np.ascontiguousarray(names.T).tobytes()
        blobs = lambda values: pa.array([values[cuts[i] : cuts[i + 1]].tobytes() if x else None for i, x in enumerate(links)], pa.binary())
        return pa.table({
            "doc_id": docs.column("doc_id"), "tag": docs.column("tag"), "n_shingles": pa.array(size, pa.int64()),
            "set_key": pa.array([names[16 * i : 16 * i + 16] if x else None for i, x in enumerate(links)], pa.binary()), "tokens": blobs(tokens), "levels": blobs(level)})

    def read(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.concat_tables([read_piece(*piece) for piece in answered_pieces(docs, answers)])

    return read


def _front(percent: int):
    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shared shingles among the first n - ceil(n * percent / 100) + 1 of the global order, where unshared ones come first."""
        for batch in batches:
            sizes = batch.column("n_shingles").to_numpy()
            tokens = [np.frombuffer(x, "<i8") for x in batch.column("tokens").to_pylist()]
            front = [max(0, int(n + (-n * percent // 100) + 1 - (n - len(t)))) for n, t in zip(sizes, tokens)]
            taken = np.array([min(f, len(t)) for f, t in zip(front, tokens)], np.int64)
            if taken.sum():
                place = np.concatenate([np.arange(n - len(t), n - len(t) + f) for n, t, f in zip(sizes, tokens, taken)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([t[:f] for t, f in zip(tokens, taken)])), pa.array(np.repeat(batch.column("class").to_numpy(), taken)),
                    pa.array(np.repeat(sizes, taken)), pa.array(place, pa.int64())], names=["token", "class", "n", "place"])

    return front


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8), minlength=256)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["level", "n"])


def fragment_ends(counts: np.ndarray, n: int = FRAGMENTS) -> list[tuple[int, int]]:
    """(level, hash) at which the fragments but the last end: even shares of `counts`, shingles by level. Within a level hashes are spread evenly."""
    sums = np.cumsum(counts)
    goals = [int(sums[-1]) * k // n for k in range(1, n)]
    levels = [int(np.searchsorted(sums, g, "right")) for g in goals]
    return [(x, int((g - (sums[x] - counts[x])) / counts[x] * (1 << 64))) for g, x in zip(goals, levels)] if sums[-1] else []


def _cut_sets(ends: list[tuple[int, int]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets by fragment of the global order; inside a fragment by hash."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for c, n, blob, level in zip(*(batch.column(x).to_pylist() for x in ("class", "n_shingles", "tokens", "levels"))):
                tokens, level = np.frombuffer(blob, "<u8"), np.frombuffer(level, np.uint8)
                where = np.zeros(len(tokens), np.int64)
                for x, h in ends:
                    where += (level > x) | ((level == x) & (tokens >= np.uint64(h)))
                cuts = np.searchsorted(where, np.arange(len(ends) + 2))  # tokens stand in the global order
                for f, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    if b > a:
                        for column, v in zip(out, (c, n, f, np.sort(tokens[a:b]).tobytes())):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["class", "n", "fragment", "tokens"])

    return cut


def _partial_overlaps(leaders: pa.Table, members: pa.Table) -> pa.Table:
    """Shingles that each pair shares in this fragment."""
    names, number = np.unique(leaders.column("class").to_numpy(), return_inverse=True)
    left = [np.frombuffer(x, "<u8") for x in leaders.column("tokens").to_pylist()]
    right = [np.frombuffer(x, "<u8") for x in members.column("tokens").to_pylist()]
    if not left or not right:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
    tag = lambda owner, sets: np.concatenate(sets) ^ mix(np.repeat(owner, [len(x) for x in sets]).astype(np.uint64) + np.uint64(1))
    keys = np.sort(tag(number, left))
    asked = tag(np.searchsorted(names, members.column("a").to_numpy()), right)
    found = np.concatenate([[0], np.cumsum(keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked)])
    ends = np.cumsum([len(x) for x in right])
    shared = found[ends] - found[np.concatenate([[0], ends[:-1]])]
    return pa.table({"a": members.column("a"), "b": members.column("b"), "shared": pa.array(shared, pa.int64())})


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, with sizes na, nb) whose summed overlap reaches the threshold."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda part: F.pmod(F.xxhash64("a", part), F.lit(4 * n)).cast("int")
    dealt = pairs.withColumn("cell", cell(F.pmod(F.xxhash64("b"), F.lit(PARTS))))
    members = dealt.select("a", "b", "cell").join(parts.hint("merge"), F.col("b") == F.col("class")).select("cell", "fragment", "a", "b", "tokens")
    leads = dealt.select("a", "cell").distinct().join(parts.hint("merge"), F.col("a") == F.col("class")).select(*[F.col(c).alias(c) for c in ("cell", "fragment", "class", "tokens")])
    partial = leads.groupBy("cell", "fragment").cogroup(members.groupBy("cell", "fragment")).applyInArrow(_partial_overlaps, "a long, b long, shared long")
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    both = pairs.join(total.hint("merge"), ["a", "b"])
    return both.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(class, label) after links(a, b): each class gets the least label that it reaches. Labels must name classes."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = edges.join(labels.hint("merge"), F.col("b") == F.col("class")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), F.col("class") == F.col("a"), "left").select("class", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # An old label that has found a smaller one takes everybody who carries it along.
        moved = step.groupBy("old").agg(F.min("label").alias("to"))
        step = step.join(moved.hint("merge"), "old").select("class", "old", F.least("label", "to").alias("label"))
        step = written(step, "labels")
        labels = step.select("class", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def _list_pairs(lists: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs of a leader and a member of one list that are in different components and that the sizes and places in the order allow to link."""
    pairs = lists.join(leaders.hint("merge"), "token").filter((F.col("class") != F.col("other")) & (F.col("label") != F.col("other_label")))
    most = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    # The first shared shingle of the order is in both fronts; here it may be a later one, so only the sizes bound the overlap before it.
    before = F.least("place", "other_place")
    pairs = pairs.filter((100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (100 * (most + before) >= percent * F.greatest("n", "other_n")))
    swap = F.col("class") > F.col("other")
    a, b = F.struct("class", "n"), F.struct(F.col("other").alias("class"), F.col("other_n").alias("n"))
    low, high = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return pairs.select(low["class"].alias("a"), high["class"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")).distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each set on the left with each on the right, summed over fragments."""
    rows = np.repeat(np.arange(len(left)), [len(x) for x in left])
    cols = np.repeat(np.arange(len(right)), [len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    keys = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(keys):
        return out
    sides = []
    for tokens, owner in ((a, rows), (b, cols)):
        at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
        hit = keys[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], owner[hit][order]))
    sizes = [np.bincount(at, minlength=len(keys)) for at, _ in sides]
    common = (sizes[0] >= COMMON) & (sizes[1] >= COMMON)
    # Common shingles: one fragment of their order after the other, as products of 0/1 matrices.
    place = np.cumsum(common) - 1
    for low in range(0, int(common.sum()), SLICE):
        blocks = []
        for (at, owner), n in zip(sides, (len(left), len(right))):
            mine = common[at] & (place[at] >= low) & (place[at] < low + SLICE)
            m = np.zeros((n, SLICE), np.float32)
            m[owner[mine], place[at[mine]] - low] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    # The others: every pair of holders of a shingle; few on one side at least.
    first = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
    flat = out.reshape(-1)
    for k in range(COMMON):
        for one, other in ((0, 1), (1, 0)):
            # The k-th holder on the short side with all holders on the other.
            ids = np.flatnonzero(~common & (sizes[one] > k) & ((sizes[one] < sizes[other]) | ((sizes[one] == sizes[other]) & (one == 0))))
            n = sizes[other][ids]
            if not len(ids):
                continue
            x = np.repeat(sides[one][1][first[one][ids] + k], n)
            start = np.repeat(first[other][ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            y = sides[other][1][start + np.arange(len(start))]
            index = x * len(right) + y if one == 0 else y * len(right) + x
            flat += np.bincount(index, minlength=len(flat)).astype(np.float32)
    return out


def _reach(percent: int):
    def reach(table: pa.Table) -> pa.Table:
        """(a, b): b is the least member that a reaches by links between this task's two blocks."""
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        own, names, n = table.column("block").to_pylist(), table.column("class").to_numpy(), table.column("n").to_numpy()
        label = table.column("label").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        x, y = (np.array([k for k, b in enumerate(own) if b == side], np.int64) for side in (left, right))
        out = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        if len(x) and len(y):
            shared = _overlaps([sets[k] for k in x], [sets[k] for k in y])
            linked = 100 * shared.astype(np.float64) >= percent * (n[x][:, None] + n[y][None, :] - shared)
            best = label.copy()
            far = np.iinfo(np.int64).max
            while True:
                before = best.copy()
                best[x] = np.minimum(best[x], np.where(linked, best[y][None, :], far).min(axis=1))
                best[y] = np.minimum(best[y], np.where(linked, best[x][:, None], far).min(axis=0))
                if (best == before).all():
                    break
            moved = best != label
            out = {"a": label[moved], "b": best[moved]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return reach


def _cluster_links(lists: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between labels, from all members of open lists compared with all others of their cluster that the sizes allow."""
    leader = lists.groupBy("token").agg(F.min("class").alias("a"))
    edges = written(lists.select("token", "class").join(leader.hint("merge"), "token").filter("class <> a").select("a", F.col("class").alias("b")).distinct(), "cluster-edges")
    members = written(lists.select("class").distinct(), "cluster-members")
    cluster = components(members.select("class", F.col("class").alias("label")), edges).select("class", F.col("label").alias("cluster"))
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    rows = cluster.join(sizes.hint("merge"), "cluster").join(labels.hint("merge"), "class").join(classes.select("class", F.col("n_shingles").alias("n"), "tokens").hint("merge"), "class")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    # Sizes that may link differ by less than one band (a hundredth wider than need be), so they are in one band or in neighbours.
    band = F.floor(F.log("n") / F.log(F.lit(100 / (percent - 1)))).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("band", band).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    name = lambda b, p: F.struct(b.cast("int").alias("band"), p.cast("int").alias("part"))
    own = name(F.col("band"), F.col("part"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = lambda one, two: F.struct(F.least(one, two).alias("left"), F.greatest(one, two).alias("right"))
    beside = lambda d: F.transform(others, lambda p: pair(own, name(F.col("band") + d, p)))
    pairs = F.flatten(F.array(beside(-1), beside(0), beside(1)))
    dealt = rows.withColumn("block", own).withColumn("pair", F.explode(pairs)).select("cluster", "pair", F.to_json("block").alias("block"), F.to_json("pair.left").alias("left"), F.to_json("pair.right").alias("right"), "class", "label", "n", "tokens")
    return dealt.drop("pair").groupBy("cluster", "left", "right").applyInArrow(_reach(percent), "a long, b long").distinct()


def _tag() -> Column:
    """What tells rows of one doc_id apart: their text."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Two rows link if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles (A-Z
    lower-cased); component_id is the least doc_id that links reach. A null, empty or wordless text has
    an empty set and links with nothing. Rows without doc_id link with nothing and have no component.
    Repeated rows link with each other like any equal texts. An empty table gives no rows. Other columns
    are ignored.
    """
    return _classified(docs, k, percent).drop("tag")


def _classified(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bits = bucket_bits(docs, BUCKET_BYTES)
    texts = written(docs.mapInArrow(number_chunks, "chunk long, row long, doc_id long, text string"), "jaccard-chunks")
    sent = texts.mapInArrow(_send(k, n_bits), "chunk long, start long, stop long, bucket int, keys binary, times binary")
    levels = written(sent.groupBy("bucket").applyInArrow(_frequencies, "chunk long, start long, stop long, bucket int, levels binary"), "shingle-levels")
    tags = texts.select("chunk", "row", "doc_id", "text", _tag().alias("tag"))
    sets = written(tags.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_sets(k, percent, n_bits), _SETS), "shingle-sets")
    discard(texts, levels)
    linked = sets.filter("set_key is not null and doc_id is not null")
    classes = linked.groupBy("set_key").agg(F.min("doc_id").alias("class"), *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "levels")])
    classes = written(classes, "shingle-classes")
    fronts = written(classes.select("class", "n_shingles", "tokens").mapInArrow(_front(percent), "token long, class long, n long, place long"), "shingle-fronts")
    posts = fronts.join(fronts.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token").hint("merge"), "token")
    counts = np.zeros(256, np.int64)
    for r in classes.select("levels").mapInArrow(_levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # 64 rows at most
        counts[r["level"]] = r["n"]
    parts = written(classes.select("class", "n_shingles", "tokens", "levels").mapInArrow(_cut_sets(fragment_ends(counts)), "class long, n long, fragment int, tokens binary"), "shingle-fragments")

    labels = classes.select("class", F.col("class").alias("label"))
    found = None
    for turn in range(ROUNDS + 1):
        lists = posts.join(labels.hint("merge"), "class")
        # Lists whose members are all in one component are through.
        open_lists = lists.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
        lists = written(lists.join(open_lists.hint("merge"), "token"), "shingle-lists")
        if lists.isEmpty():
            break
        if turn < ROUNDS:
            as_other = [F.col(c).alias(f"other_{c}" if c != "class" else "other") for c in ("class", "label", "n", "place")]
            rank = F.xxhash64(F.col("class"), F.lit(turn)) if turn else F.col("class")
            leaders = lists.groupBy("token").agg(F.min_by(F.struct("class", "label", "n", "place"), rank).alias("l")).select("token", "l.*").select("token", *as_other)
            pairs = written(_list_pairs(lists, leaders, percent), "shingle-pairs")
            new = written(_links(pairs, parts, percent), "shingle-links")
        else:
            new = written(_cluster_links(lists, classes, labels, percent), "shingle-links")
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            labels = components(labels, found)
    discard(fronts, parts)
    named_sets = linked.select("doc_id", "tag", "set_key", "n_shingles").join(classes.select("set_key", "class").hint("merge"), "set_key")
    out = named_sets.join(labels.hint("merge"), "class").select("doc_id", "tag", "n_shingles", F.col("label").alias("component_id"))
    rest = sets.filter("set_key is null or doc_id is null").select("doc_id", "tag", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose component has a smaller doc_id.

    Rows that share a doc_id are judged each by its own text; of those in one component one stays, and
    so does one of equal rows without words. Rows without doc_id stay.
    """
    found = written(_classified(docs, 5, 80).filter("doc_id is not null"), "jaccard-found")
    gone = written(found.filter("component_id < doc_id").select("doc_id", "tag").distinct(), "jaccard-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text").withColumn("_tag", _tag()).select("_row", "doc_id", "_tag")  # whatever the names of other columns
    key = [F.col("doc_id").cast("long") == F.col("_gone_id"), F.col("_tag") == F.col("_gone_tag")]
    without = lambda rows, gone, how="left_anti": rows.join(gone.select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).hint("merge"), key, how)
    many = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id")
    if many.isEmpty():
        return rows.join(sized(gone.select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag"))), key, "left_anti").select("_row.*")
    # Of namesakes in one component the one with the least tag stays, of equal rows any.
    named = found.filter("component_id = doc_id and n_shingles > 0")
    least = named.groupBy("doc_id").agg(F.min("tag").alias("least"))
    gone = gone.unionByName(named.join(least.hint("merge"), "doc_id").filter("tag > least").select("doc_id", "tag")).distinct()
    equal = found.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id", "tag")
    left = written(without(rows, gone), "jaccard-left")
    one = without(left, equal, "left_semi").groupBy("doc_id", "_tag").agg(F.first("_row").alias("_row"))
    return without(left, equal).select("_row").unionByName(one.select("_row")).select("_row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))
