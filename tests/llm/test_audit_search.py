"""Filter audit (12) and ranked search (13) against brute force on small tables with odd rows."""
import itertools
import math
import re

import numpy as np
import pytest

from vistalake.llm import audit, search

DOCS = "doc_id long, text string, source string, part string, mask int, key string, n int"


def documents(spark):
    plain = "one two three four five six seven eight nine ten " * 6
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "a"), (2, words, "b"), (2, words, "b"), (None, words, "a"), (3, plain, "a"), (4, plain + "$", None), (5, words.upper(), ""), (6, None, "a"), (7, "", "b"), (8, "A$", "c"),
            (9, words, "a"), (10, "x" * 200_000, "c"), (11, "ÄÖ " * 70, "a"), (0, words + " $", "b"), (12, words + " $", "b")]
    return spark.createDataFrame([(i, t, s, "clash", 3, "clash", 0) for i, t, s in rows], DOCS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 1, 0), (5, 0, 1), (7, 1, 1), (99, 1, 1), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")


def by_hand(docs, labels):
    """Each order applied to each document, one filter after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        copies = [j for j, t, *_ in docs if j is not None and (t or "") == text]
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
             "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and min(copies) < i}
        fails.append((source or "", i, {x for x, failed in f.items() if failed}))
    out = {}
    for part in {p for p, _, _ in fails}:
        rows = [(i, f) for p, i, f in fails if p == part]
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [i for i, f in rows if x in f and not f & before]
                removed[order, k + 1] = len(here)
                out[part, order, k + 1] = [sum(not f & set(order[: k + 1]) for _, f in rows), len(here), sum(x in f and bool(f & before) for _, f in rows), sum(f == {x} for _, f in rows),
                                           sum(i in good for i in here), sum(i in toxic for i in here)]
        for (order, step) in removed:
            out[part, order, step].append(sum(n for (o, s), n in removed.items() if o[s - 1] == order[step - 1]))
    return out


def test_audit_equals_every_order_by_hand(spark):
    docs, said = documents(spark), labels(spark)
    got = audit.audit_filters(audit.failure_cells(docs, said), "ABCDE")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*audit.COUNTS, "shapley")] for r in got.collect()} == by_hand(docs.collect(), said.collect())


def test_audit_of_empty_tables_and_other_filters(spark):
    docs, said = documents(spark), labels(spark)
    assert audit.audit_filters(audit.failure_cells(docs.limit(0), said), "ABCDE").count() == 0
    unlabelled = audit.audit_filters(audit.failure_cells(docs, said.limit(0)), "ABCDE")
    assert unlabelled.count() == 4 * 600 and unlabelled.filter("good_lost + toxic_lost > 0").count() == 0
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in audit.audit_filters(cells, "xy").collect()}
    assert rows == {("xy", 1): (7, 5, 0, 5), ("xy", 2): (7, 0, 5, 5), ("yx", 1): (7, 5, 0, 5), ("yx", 2): (7, 0, 5, 5)}
    with pytest.raises(ValueError):
        audit.audit_filters(cells, "xx")


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(FOLD)))
        df = {x: sum(x in t for _, t in terms) for x in asked}
        scored = []
        for i, t in terms:
            m = 100 - 90 + 90 * len(t) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in t)
            scored.append((-s, math.inf if i is None else i))
        out += [(item, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_every_score(spark, monkeypatch):
    """Small buckets, so that bounds are used; odd rows; blocks of one item each."""
    random = np.random.default_rng(5)
    word = lambda: "abcdefghijklmnopqrstuvwxyzäÖ"[min(27, int(random.zipf(1.3)))] * int(random.integers(1, 3))
    texts = [" ".join(word() for _ in range(int(random.integers(1, 60)))) for _ in range(400)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(7, texts[3]), (7, texts[3]), (500, texts[3]), (None, texts[3]), (501, None), (502, ""), (503, "--- !!"), (504, "a-b_C " * 5000)]
    items = [(1, "a B cc"), (2, texts[3]), (3, None), (4, ""), (5, "zzz not there"), (2, texts[3]), (None, "dd ee ä ÖÖ"), (6, "q" * 3 + " " + texts[10])]
    made = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs], "doc_id long, text string, n long, terms string, norm double").repartition(3)
    asked = spark.createDataFrame([(i, t, 0, 1) for i, t in items], "item_id long, text string, number int, score long")
    want = ranked_by_hand(docs, items)
    monkeypatch.setattr(search, "BUCKET", 16)
    monkeypatch.setattr(search.search_block, "__defaults__", (10, 16, 0.05))
    for block_bytes in (1 << 20, 100):
        got = search.search(made, asked, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).collect()] == ranked_by_hand([(1, "a")], [(1, "a")])


def test_buckets_are_pruned():
    """Only documents with a rare term, and with enough of it, are scored."""
    import pyarrow as pa

    lists = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    rows = [[0], [0, 1], [0], [0, 2]]
    impacts = [[500], [400, 300], [100], [100, 900]]
    w = np.array([1, 2000, 1], np.int64)
    norm = [math.sqrt(sum(w[t] * i * i for t, i in zip(r, p))) for r, p in zip(rows, impacts)]
    part = search._Bucket(pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), lists(rows), lists(impacts), pa.array(norm)], ["doc_id", "terms", "impacts", "norm"]))
    assert part.candidates(np.array([0, 1]), w[:2].astype(float), 400_000.0).tolist() == [1]
    assert part.candidates(np.array([0, 1]), w[:2].astype(float), 1.0).tolist() == [0, 1, 2, 3]
    assert part.scores(np.array([0, 1]), np.array([1, 2000, 0])).tolist() == [500, 600_400]
