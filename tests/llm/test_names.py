"""Operators that return the columns of documents do so whatever these are called."""
from pyspark.sql import functions as F

from vistalake.llm import decontamination, jaccard, quality, secrets, substring

NAMES = ("_tag", "_gone", "removed", "_row", "_text", "_id", "_gone_id", "row", "tag", "n_words", "_words", "start", "chunk")


def test_clashing_names(spark):
    words = " ".join(f"word{k}" for k in range(120))
    texts = [(1, words), (2, words), (3, " ".join(f"other{k}" for k in range(60))), (3, " ".join(f"other{k}" for k in range(60))), (4, "secret: abcDEF123456789 " + " ".join(f"plain{k}" for k in range(40))), (5, None), (None, "a few words only")]
    docs = spark.createDataFrame([(i, t, *[f"{n} of {i}" for n in NAMES]) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    items = spark.createDataFrame([(1, " ".join(f"other{k}" for k in range(50)), "x", 1)], "item_id long, text string, _gone string, removed int")
    want = {"one_of_each": [1, 3, 4, 5, None], "decontaminate": [1, 2, 4, 5, None], "remove_passages": [1, 2, 4, 5, None], "keep_good": None, "redact": [1, 2, 3, 3, 4, 5, None]}
    unique = docs.filter("doc_id is null or doc_id <> 3")
    for name, run in {"one_of_each": lambda: jaccard.one_of_each(docs), "decontaminate": lambda: decontamination.decontaminate(docs, items), "remove_passages": lambda: substring.remove_passages(unique),
                      "keep_good": lambda: quality.keep_good(docs), "redact": lambda: secrets.redact_secrets(docs)}.items():
        out = run()
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in NAMES), name
        if want[name] is not None:
            assert sorted([r["doc_id"] for r in rows], key=str) == sorted(want[name], key=str), name
    cut = {r["doc_id"]: r["text"] for r in substring.remove_passages(unique).filter(F.col("doc_id").isNotNull()).collect()}
    assert cut[1] == words and cut[2] == ""
