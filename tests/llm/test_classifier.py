"""Quality classifier (11): held-out accuracy, features and the estimated prior against plain computations, odd rows."""
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vistalake.llm import classifier


def test_features_equal_counts_by_hand():
    texts = [None, "", "a", "The cat, the CAT!\nthe cat, the CAT!\n\nÄöü 12 " + "x" * 20, "\n\n", "b" * 5000 + " c", "%%% %%% %%% %%%", "last line", "one\ntwo\none\n"]
    rows = classifier.text_features(pa.array(texts))
    n = classifier.N_KINDS
    for text, row in zip(texts, rows):
        data = (text or "").encode()
        pairs = np.zeros(n * n)
        for a, b in zip(data, data[1:]):
            pairs[classifier._KIND[a] * n + classifier._KIND[b]] += 1
        assert np.allclose(row[: n * n], np.sqrt(pairs / max(1, len(data))), atol=1e-6)
        words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        lines = (text or "").split("\n")
        lines = lines[:-1] if not lines[-1] else lines
        triples = list(zip(words, words[1:], words[2:]))
        share = lambda a, b: a / max(1, b)
        want = [math.log1p(len(data)) / 10, math.log1p(len(words)) / 10, share(len(set(words)), len(words)), share(len(triples) - len(set(triples)), len(triples)),
                share(sum(a == b for a, b in zip(words, words[1:])), len(words)), math.log1p(share(sum(map(len, words)), len(words))), share(sum(len(w) <= 2 for w in words), len(words)),
                share(sum(len(w) >= 15 for w in words), len(words)), math.log1p(len(lines)) / 10, share(len(lines) - len({x + "\n" * (k < len(lines) - 1 or (text or "").endswith("\n")) for k, x in enumerate(lines)}), len(lines)),
                math.log1p(share(len(words), len(lines)))]
        assert np.allclose(row[n * n :], want, atol=1e-6), text


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    return classifier.op11_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id", how="left")


def test_held_out_labels_are_told(scored):
    held = scored[scored.held_out & scored.quality.notna()]
    good, rank = held.quality == 1, held.score.rank()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and (held.predicted == held.quality).mean() > 0.95
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]).all() and len(scored) == 1000


def test_held_out_and_bad_labels_are_not_learned(spark, scored):
    """Turning every held-out label, and dropping the bad ones, changes nothing."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in labels.doc_id])
    labels.loc[held, "quality"] = 1 - labels.loc[held, "quality"]
    labels = labels[held | (labels.quality == 1)]
    again = classifier.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(labels)).toPandas()
    both = scored.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y, atol=1e-9)


def test_prior_is_found(spark):
    """Positives and negatives of which 30 % are good: the estimate is near, whatever the model's own level."""
    random = np.random.default_rng(3)
    x = np.zeros((4000, classifier.N_FEATURES))
    good = np.arange(4000) % 10 < 3
    x[:, 0] = random.normal(size=4000) + np.where(good, 3, -1)
    kept = np.zeros(4000, bool)
    extra = np.zeros((600, classifier.N_FEATURES))
    extra[:, 0] = random.normal(size=600) + 3
    rows = [(v.astype("<f2").tobytes(), False, bool(k)) for v, k in zip(np.concatenate([x, extra]), np.append(kept, np.ones(600, bool)))]
    model = classifier.Model(np.zeros(classifier.N_FEATURES), np.ones(classifier.N_FEATURES))
    model.w[0] = 0.5
    found = classifier.estimate_prior(spark.createDataFrame(rows, "x binary, positive boolean, kept boolean"), model)
    share = (good.sum() + 600) / 4600
    assert abs(found - share) < 0.08


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a fine text here", 9, "x"), (1, "a fine text here", 9, "x"), (None, "no id", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (4, "y" * 300_000, 1, None)], "doc_id long, text string, score int, x string")
    labels = spark.createDataFrame([(1, 1, "l"), (1, 0, "l"), (None, 1, "l"), (2, 0, "l"), (3, 1, "l")], "doc_id long, quality int, text string")
    rows = classifier.quality_scores(docs, labels).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 1, 1, 2, 3, 4] and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (2, 3)} and len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0
