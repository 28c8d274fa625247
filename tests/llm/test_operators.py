"""The ten operators against brute force, on texts with repeats, ties, nulls and odd characters."""
import hashlib
import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from vistalake.llm import bpe, decontamination, jaccard, licenses, lm, quality, secrets, sharding, substring, token_files, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string, `_words` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts() -> list[tuple]:
    rng = np.random.default_rng(11)
    lexicon = ["of", "the", "and"] + ["".join(rng.choice(list("abcdeirnstoué"), rng.integers(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(lexicon, n))
    long, shared = say(400), say(70)
    out = [long, long, long.replace(" the ", " and ", 1), "  " + long.upper(), say(20) + " " + shared + "\n" + say(30), shared + " " + say(80), say(60) + "\t" + shared]
    base = say(200).split()
    for _ in range(12):
        copy = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 6)):
            copy[k] = "edit" + str(k)
        out.append(" ".join(copy))
    out += ["", None, " \n ", "one", "one two three", "One two three", " nbsp wide", "日本 語 テキスト", "x" * 30000, "the " * 3000, "a\nb\n" * 40, say(12) + "\n" + say(12)]
    out += [say(n) for n in rng.integers(3, 150, 25)]
    rows = [(k, t) for k, t in enumerate(out)]
    return rows + [(3, out[3]), (None, long), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", "clash", 1) for d, t in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_words_hash_alike_everywhere(rows):
    values = [t for _, t in rows]
    got = words.split_words(pa.array(values))
    found = [got.data.tobytes()[a:b].decode() for a, b in zip(got.starts, got.ends)]
    assert found == [w for t in values for w in WORD.findall(t or "")]
    assert len(set(zip(found, got.hashes.tolist()))) == len(set(found)) == len(set(got.hashes.tolist()))
    assert got.counts.tolist() == [len(WORD.findall(t or "")) for t in values]
    sliced = words.split_words(pa.array(["zz zz"] + values)[1:])
    assert (sliced.hashes == got.hashes).all()


def test_no_words_at_all(monkeypatch):
    monkeypatch.setattr(words, "_tables", {})
    got = words.split_words(pa.array(["", None, " "]))
    assert len(got.hashes) == 0 and [len(x) for x in words.runs(got, 5)] == [0, 0] and got.counts.tolist() == [0, 0, 0]


def test_substring(spark, docs, rows, none):
    runs = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if d is not None:
                runs[tuple(w[i : i + 50])] = min(d, runs.get(tuple(w[i : i + 50]), d))
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if d is not None and runs[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()] += 1
    found = substring.repeated_passages(docs)
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    assert as_set(found, "doc_id", "n_words", n, "kept_sha256") == want
    assert sum(k[2] for k in want) > 500
    assert substring.repeated_passages(none).count() == 0


def test_remove_passages(docs, rows):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = substring.remove_passages(unique)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()}[1] == ""


def shingles(t):
    w = WORD.findall((t or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(docs, rows, none):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and a is not None and rows[j][0] is not None and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                label[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d) if d is not None else d
    want = Counter((d, len(sets[i]), low[root(i)] if sets[i] and d is not None else d) for i, (d, _) in enumerate(rows))
    assert as_set(jaccard.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.jaccard_classes(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert as_set(kept, "doc_id", "text") == Counter(set((d, t) for (d, t), s in zip(rows, sets) if d is not None and (not s or low_of(d, s, rows, sets, label, root) == d))) + Counter((d, t) for d, t in rows if d is None)
    assert jaccard.one_of_each(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).count() == len({d for d, _, c in want if d is not None and d == c})


def low_of(d, s, rows, sets, label, root):
    """Least doc_id of the component that the row with this set is in."""
    here = next(root(i) for i, (e, _) in enumerate(rows) if e == d and sets[i] == s)
    return min(rows[i][0] for i in range(len(rows)) if root(i) == here and rows[i][0] is not None)


def test_one_of_namesakes(spark):
    say = lambda k: " ".join(f"w{k}.{x}" for x in range(40))
    data = [(1, say(1)), (2, say(1)), (2, say(2)), (3, say(3)), (3, say(3)), (4, say(4)), (4, say(4) + " more"), (5, None), (5, None), (5, ""), (5, say(5)), (None, say(1)), (None, say(1))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, tag string")
    kept = jaccard.one_of_each(docs)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == docs.columns
    four = [k for k in got if k[0] == 4]
    assert len(four) == 1 and got[four[0]] == 1
    assert {k: v for k, v in got.items() if k[0] != 4} == {(1, say(1)): 1, (2, say(2)): 1, (3, say(3)): 1, (5, None): 1, (5, ""): 1, (5, say(5)): 1, (None, say(1)): 2}


def test_fragments_are_ranges_of_the_order():
    counts = np.zeros(256, np.int64)
    counts[[1, 3, 9]] = 500, 300, 200
    ends = jaccard.fragment_ends(counts)
    assert ends == sorted(ends) and [x for x, _ in ends] == [1, 3, 3] and ends[0][1] == 1 << 63
    rng = np.random.default_rng(0)
    level = np.sort(rng.choice([1, 3, 9], 400, p=[0.5, 0.3, 0.2])).astype(np.uint8)
    tokens = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    order = np.lexsort((tokens, level))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([400]), pa.array([tokens[order].tobytes()]), pa.array([level[order].tobytes()])], names=["class", "n_shingles", "tokens", "levels"])
    out = next(jaccard._cut_sets(ends)(iter([batch]))).to_pylist()
    assert [r["fragment"] for r in out] == [0, 1, 2, 3] and all(60 < len(r["tokens"]) // 8 < 140 for r in out)
    assert np.sort(np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in out])).tolist() == np.sort(tokens).tolist()


@pytest.mark.parametrize("edits, block", [(2, 1024), (4, 1024), (5, 16)])
def test_jaccard_of_a_large_group(spark, edits, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(edits)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        copy = list(base)
        for x in rng.integers(0, 300, edits):
            copy[x] = f"e{k % 7}.{x}"
        rows.append((k, " ".join(copy[: 300 - k % 30])))
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(8):
        for i in range(len(rows)):
            for j in range(len(rows)):
                n = len(sets[i] & sets[j])
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    label[i] = label[j] = min(label[i], label[j])
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(label))


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")
    copies = [
        (900, "filler words here THE QUICK, brown fox jumps over the lazy dog near the old river bank and more"),
        (901, "so the quick brown cat jumps over one lazy dog near the old muddy river bank today"),
        (902, "the river is old and the dog sleeps"), (903, " ".join(["pad"] * 5000) + " quick brown fox jumps over the lazy dog near the old river bank " + "pad " * 5000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(every, items).collect()}
    assert set(got) == {(900, 1), (901, 1), (903, 1)} and got[900, 1] == 1.0 and 0.5 <= got[901, 1] < 1
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    left = decontamination.decontaminate(every, items)
    assert left.count() == every.count() - 3 and left.columns == every.columns


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_scores():
    rng = np.random.default_rng(0)
    item = rng.integers(0, 6, 12).astype(np.uint64)
    passages = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 5, 12, 30)]
    assert decontamination.align(item, passages)[0].tolist() == [smith_waterman(item, p) for p in passages]


def test_every_edited_copy_is_found(spark):
    rng = np.random.default_rng(3)
    lexicon = ["the", "of"] + [f"w{k}" for k in range(80)]
    say = lambda n: list(rng.choice(lexicon, n))
    items = [say(n) for n in (3, 5, 15, 15, 38)] + [["lonely", "pair"], ["single"]]
    texts = []
    for item in items[2:5]:
        texts += [item] * 2
        for share in (0.1, 0.2, 0.25, 0.3):
            for _ in range(12):
                copy = [[w] if rng.random() >= share else [["edit"], [], [w, "edit"]][rng.integers(3)] for w in item]
                texts.append(say(10) + [w for part in copy for w in part] + say(10))
        texts += [[w for pair in zip(item, say(len(item))) for w in pair], item[: len(item) // 2 + 1]]
    texts += [[items[0][0], "x", items[0][2]], ["a", "pair"], ["a", "single", "word"], say(30)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(df, benchmark).collect()}
    every = {(d, i): smith_waterman(item, t) / (2 * len(item)) for d, t in enumerate(texts) for i, item in enumerate(items)}
    assert got == {k: v for k, v in every.items() if v >= decontamination.THRESHOLD}


@pytest.fixture(scope="module")
def odd_texts():
    rng = np.random.default_rng(4)
    parts = list("aabcdeors  \n\t'!?.,012") + ["\x1c", "\x85", "é", "ß", "日本", "👍🏽", "é", "'s", " the", "ing", "<|endoftext|>", "<|ENDOFTEXT|>", "\r\n", "aaaa", "----", "İ", "Σ", "THE", "    ", "ABCa."]
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(400)] + ["", None, "x" * 5000, "word. " * 500]


def test_bpe_round_trip(spark, odd_texts):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()}
    for k, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (ids, library.decode(ids, skip_special_tokens=False)), t
    assert bpe.token_digests(df.limit(0), path).count() == 0


def test_token_files(spark, odd_texts, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(odd_texts)] + [(5, "tie one"), (5, "tie two"), (None, "nobody")]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "t"), path)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    sizes = [len(r["ids"]) // 4 for r in got]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "f"), path, file_ids=50)
    several = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert several == got and spark.read.parquet(str(tmp_path / "f" / "blocks")).select("part").distinct().count() > 1
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_capitals_with_marks():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary("word_bpe_49k.json")
    library, table = Tokenizer.from_file(path), token_files.WordIds(path)
    texts = [a + word + b for word in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "E\u0301", "\u00c9") for a in ("", "A", "see ") for b in ("", "AN.", ", <|x")]
    ids, first = table.encode(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


def test_token_ids_equal_the_library_with_a_small_table(odd_texts, monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary("word_bpe_49k.json")
    library, table = Tokenizer.from_file(path), token_files.WordIds(path)
    monkeypatch.setattr(token_files, "CACHE", 500)
    monkeypatch.setattr(token_files, "CACHED_LENGTH", 6)
    rng = np.random.default_rng(17)
    parts = list("aabcd  \n'!?.,012A") + ["\x1c", "\x85", "é", "日本", "'s", "can't.", "İ", "(x)", "a1b", "=\u0338", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts_ = odd_texts + ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + pa.parquet.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    for low in range(0, len(texts_), 700):
        some = texts_[low : low + 700]
        ids, first = table.encode(pa.array(some, pa.string()), 2)
        want = [e.ids + [2] for e in library.encode_batch_fast([t or "" for t in some], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


@pytest.mark.parametrize("counts", [[5], [0, 3, 0, 1], [1] * 300, [2**k for k in range(40)]])
def test_huffman(counts):
    counts = np.array(counts, np.int64)
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= token_files.LIMIT and ((lengths > 0) == (counts > 0)).all() and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    if len(counts) == 300:  # without a limit in the way, package merge is Huffman's code
        heap = [(c, k) for k, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1]))
        assert (counts * lengths).sum() == cost
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 1000)
    stream, marks = token_files.pack_ids(ids, token_files.canonical_codes(lengths), lengths)
    assert (token_files.Decoder(lengths).unpack(stream, marks, len(ids)) == ids).all()


def test_quality_measures(docs, rows, none):
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)] += 1
    got = quality.text_measures(docs.select("doc_id", "text"))
    assert as_set(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert quality.keep_good(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {4, 5, 6} <= {r["doc_id"] for r in kept.collect()}


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["kept"] for r in got if r["quality"] == 1 and not r["base_failed"])
    bad = [r for r in got if r["quality"] == 0]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_licenses(spark, none):
    data = [(1, "some words\nReleased under the MIT License.\nmore words of text"), (2, "plain text about a licence to fish"), (3, None), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame(data, "doc_id long, text string").unionByName(spark.createDataFrame([(k, f"ordinary line number {k} of the corpus with several words") for k in range(10, 60)], "doc_id long, text string"))
    got = {r["doc_id"]: {x["family"] for x in r["notices"] if x["match"] >= licenses.CONFIRM} for r in licenses.scan_licenses(df).collect()}
    assert got[1] == {"mit"} and got[2] == set() == got[3] and got[4] == {"gpl-3.0"} and got[5] == {"cc-by-nc-4.0", "apache-2.0"}
    assert not any(v for k, v in got.items() if k >= 10)
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_wrapped_embedded_and_similar(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    gpl = "you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or"
    conditions = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code\n\n2. Redistributions in binary form\n\n"
    filler = " ".join(["plain", "words", "of", "a", "long", "line"] * 200)
    data = [(mit, {"mit"}), (f"{filler} Licensed under the Apache License, Version 2.0. {filler}", {"apache-2.0"}), (gpl.format(3), {"gpl-3.0"}), (gpl.format(2), {"gpl-2.0"}),
            (gpl.format(3).replace("General", "Lesser General"), {"lgpl-3.0"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0"}), ("Licensed under CC BY-NC-ND 4.0.", {"cc-by-nc-nd-4.0"}), ("Licensed under CC BY 4.0.", {"cc-by-4.0"}),
            ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", {"cc-by-nc-4.0"}), ("Licensed under the GPL v2.", {"gpl-2.0"}), (conditions, set()),
            (conditions + "3. Neither the name of the copyright holder", {"bsd-3-clause"}), ("MIT License or Apache License, Version 2.0", {"mit", "apache-2.0"}), (filler, set())]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(data)], "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    assert {r["doc_id"]: {x["family"] for x in r["notices"] if x["match"] >= licenses.CONFIRM} for r in rows} == {k: f for k, (_, f) in enumerate(data)}
    assert {r["doc_id"]: r["n_lines"] for r in rows} == {k: t.count("\n") + 1 for k, (t, _) in enumerate(data)}


def every_segmentation(lattice, pieces, word):
    table = {p: k for k, p in enumerate(pieces)}

    def go(rest):
        if not rest:
            return 1.0
        total = sum(np.exp(lattice.log_p[table[rest[:k]]]) * go(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in table)
        if rest[0] not in table:
            total += np.exp(lattice.log_p[lattice.byte] * len(rest[0].encode())) * go(rest[1:])
        return total

    return np.log(go(lm.SPACE + word))


def test_lattice_sums_all_segmentations():
    pieces = [lm.SPACE, lm.SPACE + "a", "a", "b", "ab", "aba", "ba"]
    lattice = lm.Lattice(pieces, lm.first_guess(len(pieces)))
    some = ["abab", "a", "abaé", "日", "bbbb", "ab"]
    assert np.allclose(lattice.log_likelihood(some), [every_segmentation(lattice, pieces, w) for w in some])
    uses = lattice.expected(some, np.ones(len(some)))
    step = 1e-5
    for k in range(len(pieces)):  # expected uses are the likelihood's slopes
        more = lattice.log_p.copy()
        more[k] += step
        slope = (lm.Lattice(pieces, more).log_likelihood(some) - lattice.log_likelihood(some)).sum() / step
        assert abs(slope - uses[k]) < 1e-3


def test_lm_scores(docs, rows, none):
    count, texts_ = Counter(), []
    for d, t in rows:
        w = WORD.findall((t or "").translate(FOLD)) + [None]
        held = zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2
        texts_.append((d, w, held))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    got = lm.lattice_scores(docs, bpe.default_vocabulary("piece_bpe_32k.model")).collect()
    key = lambda d: (d is not None, d)
    want = sorted(((d, held, len(w), sum(count[x] > 0 for x in w), n, sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)) for d, w, held in texts_), key=lambda r: (key(r[0]), r[2]))
    got = sorted(got, key=lambda r: (key(r["doc_id"]), r["n_tokens"]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r["base_score"] for r in got], [r[5] for r in want]) and all(r["score"] < 0 for r in got)
    assert lm.lattice_scores(none, bpe.default_vocabulary("piece_bpe_32k.model")).count() == 0


def test_lm_score_is_the_sum_over_all_segmentations(spark, monkeypatch):
    seen = []
    whole = lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: seen.append(whole(*a)) or seen[-1])
    monkeypatch.setattr(lm, "vocabulary_pieces", lambda path: [lm.SPACE, lm.SPACE + "a", "a", "b", "ab", "aba", "ba"])
    data = [(k, t) for k, t in enumerate(["abab a", "A ab ab", "abaé 日 ab", "", None, "bbbb ab a", "ab ba aba a", "b b b"])]
    got = {r["doc_id"]: r["score"] for r in lm.lattice_scores(spark.createDataFrame(data, "doc_id long, text string"), "unread").collect()}
    pieces = lm.vocabulary_pieces("")
    lattice = lm.Lattice(pieces, seen[-1])
    for d, t in data:
        want = sum(every_segmentation(lattice, pieces, w) for w in (t or "").lower().split()) + seen[-1][-1]
        assert np.isclose(got[d], want / lm.LN10), t


def test_secrets(spark, docs, none):
    key = "".join(np.random.default_rng(6).choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789"), 40))
    data = [(1, "é token = \"0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d\" tail"), (2, "passwd: short secret=alsoshort API-KEY: Token:'abcdefghijkl'"), (3, "AKIAABCDEFGHIJ AKIAABCDEFGHIJKLMN"),
            (4, f"key {key} and wordswordswordswordswords 123456789012345678901234"), (5, None), (6, ""), (7, "token=" * 200 + "x" * 30)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    spans = {d: [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["_all"]] for d, r in got.items()}
    assert spans[1] == [("assign", 2, 51), ("hex", 11, 51)]
    assert [k for k, *_ in spans[2]] == ["assign"] and spans[3] == [("access", 15, 33)] and spans[5] == spans[6] == []
    assert spans[4] == [("entropy", 4, 44), ("hex", 75, 99)]
    clean = secrets.redact_secrets(spark.createDataFrame([(d, t, "n") for d, t in data], "doc_id long, text string, row string"))
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[1] == "é [secret]\" tail" and out[4].startswith("key [secret] and") and out[5] is None and out[6] == ""
    assert secrets.redact_secrets(docs).columns == docs.columns and secrets.redact_secrets(none).count() == 0


def test_entropy_by_increments(spark):
    rng = np.random.default_rng(8)
    runs = ["".join(rng.choice(list("abcdef0123456789"), n)) for n in (20, 21, 60)] + ["a1" * 20]
    df = spark.createDataFrame([(r,) for r in runs], "r string")
    for r, d in df.select("r", secrets._dense(F.col("r"), F.lit(2.9)).alias("d")).collect():
        h = [-sum(c / 20 * np.log2(c / 20) for c in Counter(r[i : i + 20]).values()) for i in range(len(r) - 19)]
        ends = [i + 20 for i, x in enumerate(h) if x >= 2.9]
        assert (d["first"], d["last"]) == ((ends[0], ends[-1]) if ends else (0, 0))


def test_secrets_in_time_that_grows_with_the_text(spark):
    rng = np.random.default_rng(10)
    run = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWYZabcdefghkmnpqrstuvwyz2345689"), 300_000))
    hits = ["".join(rng.choice(list("0123456789abcdef"), 18)) for _ in range(100_000)]
    df = spark.createDataFrame([(1, "é " + run + " é"), (2, " ".join(hits))], "doc_id long, text string")
    got = {r["doc_id"]: r["_all"] for r in secrets.scan_secrets(df).collect()}
    (one,) = got[1]  # from the first to the last window that is dense enough
    assert one["kind"] == 3 and 2 <= one["start"] < 60 and 299_940 < one["end"] <= 300_002
    assert [(s["kind"], s["start"], s["end"]) for s in got[2]] == [(2, 19 * k, 19 * k + 18) for k in range(100_000)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert re.fullmatch("é .{,60}\\[secret\\].{,60} é", clean[1]) and clean[2] == " ".join(["[secret]"] * 100_000)


def test_allow_list_spares_only_what_it_names(spark):
    rng = np.random.default_rng(12)
    key = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWYZabcdefghkmnpqrstuvwyz2345689"), 40))
    letters = "qWzRtYpLkJhGfDsAxCvBnMeTrUiO"
    data = [(1, f"/example/{key}"), (2, "x" * 40), (3, "getUserNameFromTheDatabaseNow"), (4, letters), (5, "your-key-example-goes-here-soon"), (6, "12345678901234567890")]
    df = spark.createDataFrame([(d, t, "clash", 1, "c") for d, t in data], "doc_id long, text string, _more string, base int, `every` string")
    out = secrets.scan_secrets(df)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["_all"] if s["kind"] == 3] for r in out.collect()}
    assert out.columns[:5] == df.columns and {r["_more"] for r in out.collect()} == {"clash"}
    assert got == {1: [(8, 49)], 2: [], 3: [], 4: [(0, 28)], 5: [], 6: []}


def test_longest_first_is_the_heap():
    rng = np.random.default_rng(9)
    for n in (1, 3, 24):
        sizes = np.concatenate([rng.integers(1, 12, 200), [500, 500, 90]])
        heap = [(0, k) for k in range(n)]
        for s in sorted(sizes.tolist(), reverse=True):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + s, k))
        loads = Counter({k: 0 for k in range(n)})
        for size, shard, low, high in sharding.longest_first(list(Counter(sizes.tolist()).items()), n):
            loads[shard] += size * (high - low)
        assert sorted(loads.values()) == sorted(x for x, _ in heap)


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs, 4).collect()
    groups, heap, loads = Counter(), [0] * 4, Counter({k: 0 for k in range(4)})
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    for r in got:
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == sorted(heap)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert all(len({r["shard"] for r in got if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in got})
    assert sharding.shard_documents(none).count() == 0


def test_bpe_equals_the_library_on_documents():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, automaton = Tokenizer.from_file(path), bpe.Automaton(path)
    rng = np.random.default_rng(14)
    parts = list("aabcdeors  \n\t'!?.,012") + ["\x85", "é", "日本", "'s", "'re", "'ll", "'", "　", " ", "<|endoftext|>", "    ", "\r\n"]
    texts_ = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(5000)] + [" " * 300 + "a", "é" * 4000, "ab" * 5000, " 　"]
    texts_ += pa.parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()[:10_000]
    ids, first = automaton.encode_texts(pa.array(texts_, pa.string()))
    want = [e.ids for e in library.encode_batch_fast([t or "" for t in texts_], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


def test_bpe_pieces_are_those_of_the_pattern():
    import regex

    rng = np.random.default_rng(15)
    parts = list("ab 1 \n\t'") + ["é", "日", "'s", "'ve", "　", "!", "²", "\x1c", "👍"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(1, 15)))
        data = np.frombuffer(t.encode(), np.uint8)
        starts = bpe.split_pieces(data, np.zeros(1, np.int64))
        got = [data[a:b].tobytes().decode() for a, b in zip(starts, np.append(starts[1:], len(data)))]
        assert got == regex.findall(bpe.PATTERN, t), t


def test_bpe_arcs_are_the_pairs_that_stay_apart():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, automaton = Tokenizer.from_file(path), bpe.Automaton(path)
    letters = [k for k in automaton.in_use if automaton.labels.emit(np.array([k])).tobytes().isalpha()]
    rng = np.random.default_rng(16)
    a, b = rng.choice(letters, 3000), rng.choice(letters[:2000], 3000)
    for x, y, open_ in zip(a.tolist(), b.tolist(), automaton.arcs(a, b)):
        word = automaton.labels.emit(np.array([x, y])).tobytes().decode()
        assert open_ == (library.encode(word, add_special_tokens=False).ids == [x, y]), word


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 50_000])
def test_keys_are_packed_and_unpacked(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64))
    assert all((words.unpack_keys(words.pack_keys(keys[s])) == keys[s] & np.uint64((1 << words.REST_BITS) - 1)).all() for _, s in words.buckets(keys, words.REST_BITS))
    assert sum(s.stop - s.start for _, s in words.buckets(keys, words.REST_BITS)) == n


@pytest.fixture
def split_otherwise(monkeypatch):
    """Every read of a written table, and every read after the first, is split at other places, down to a few rows a batch."""
    from pyspark.sql import DataFrame

    whole = DataFrame.mapInArrow
    sizes = iter([7, 3, 11, 2, 5] * 50)

    def split(self, f, schema, **more):
        n = next(sizes)
        return whole(self, lambda batches: f(b.slice(k, n) for b in batches for k in range(0, b.num_rows, n)), schema, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", split)


def test_substring_and_jaccard_of_scans_that_are_split_otherwise(spark, docs, rows, split_otherwise):
    for test in (test_substring, test_jaccard):
        test(*((spark,) if test is test_substring else ()), docs.repartition(5), rows, docs.limit(0))
