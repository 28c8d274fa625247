"""License scans (6): what the classifier decides, held-out wordings by family, features and template shares against plain counts, odd rows."""
import numpy as np
import pyarrow as pa
import pytest

from vistalake.llm import licenses

SF = "/root/testdata/sf0.01"
FRAMES = ("Code is made available under {}", "Terms: {}", "(c) 2021 A. Author, {}", "You may copy this under the conditions of the {} only", "our documents use {} throughout")


@pytest.fixture(scope="module")
def lines():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    named = ("licens", "licenc", "copyright", "spdx", "permission", "redistribut")
    return [x for k, t in enumerate(texts) for x in [(t or "").split("\n")[k % len((t or "").split("\n"))]] if not any(n in x.lower() for n in named)]


@pytest.fixture(scope="module")
def model(lines):
    return licenses.train(lines)


def confirmed(texts, model):
    rows, _ = licenses.scan_texts(pa.array(texts, pa.string()), model, licenses.all_templates())
    return [{n["family"] for n in r if n["match"] >= licenses.CONFIRM} for r in rows]


def test_common_wordings(model):
    texts = {"licensed under GPLv3": {"gpl-3.0"}, "GNU GPL v3 or later": {"gpl-3.0"}, "under the MIT licence": {"mit"}, "Dual licensed under MIT or Apache-2.0": {"mit", "apache-2.0"}, "the MIT license plate": set(),
             "SPDX-License-Identifier: BSD-3-Clause-Clear": {"bsd-3-clause-clear"}, "Code is CC BY 4.0 and pictures are CC BY-NC 4.0": {"cc-by-4.0", "cc-by-nc-4.0"}, "Licensed under the GPL v7": set(), "a licence to fish": set(),
             "All advertising materials mentioning features or use of this software\nmust display the following acknowledgement\n\n4. Neither the name of the copyright holder": {"bsd-4-clause"}}
    assert dict(zip(texts, confirmed(list(texts), model))) == texts


def test_nothing_without_the_classifier(model):
    """With all weights zero no text has a licence, whatever stands in it."""
    empty = licenses.Model(model.keys, np.zeros_like(model.weights), model.bias, model.slope, model.shift, model.bars)
    texts = [f.format(n) for f in licenses.FRAMES for names in licenses.NAMES.values() for n in names]
    assert all(not f for f in confirmed(texts, empty)) and sum(map(bool, confirmed(texts, model))) > 0.95 * len(texts)


def test_wordings_that_training_does_not_hold(model, lines):
    for family, names in licenses.NAMES.items():
        found = confirmed([f.format(n) for f in FRAMES for n in names], model)
        assert np.mean([family in f for f in found]) >= 0.8, family
        assert np.mean([bool(f - {family}) for f in found]) <= 0.05, family
    assert not any(confirmed(lines, model))
    assert not any(confirmed([f.format(n) for f in FRAMES for n in [*licenses.HELD_OUT, "Sleepycat License", "Vim License", "GPL v9", "Intel License 1.0"]], model))


def test_scores_equal_sums_by_hand(model):
    text = "Released under the the MIT License, version x of the License or later"
    said = text.lower().replace(",", " ").split()
    number = {int(h): k for k, h in enumerate(model.keys)}
    one = [int(licenses.read(pa.array([w])).hashes[0]) for w in said]
    two = [int(licenses.runs(licenses.read(pa.array([f"{a} {b}"])), 2)[1][0]) for a, b in zip(said, said[1:])]
    for c in range(len(licenses.CLASSES)):
        total = sum(model.weights[c, number[h]] for grams in (one, two) for k, h in enumerate(grams) if h in number and h not in grams[max(0, k - licenses.APART + 1) : k])
        want = (total / np.sqrt(len(one) + len(two)) + model.bias[c]) * model.slope[c] + model.shift[c]
        assert np.isclose(model.of_texts([text])[0, c], want)


def test_template_shares_by_hand():
    words = licenses.read(pa.array(["x x GNU General Public License version 2 y MIT License"]))
    pairs, free = licenses.all_pairs(words), np.ones(len(words.hashes), bool)
    fit = lambda text, free=free: licenses.Template.of("f", text).fit(words.hashes, pairs, free)
    assert fit("GNU General Public License version 3") == (4 / 5, 4, 2) and fit("general public license") == (1.0, 2, 3)
    assert fit("MIT License") == (1.0, 1, 9) and fit("mit") == (1.0, 1, 9) and fit("Apache License 2.0") == (0.0, 0, 0)
    assert fit("MIT License", np.arange(len(free)) != 9)[0] == 0.0


def test_odd_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    data = [(1, notice, 9, "x"), (1, notice, 9, "x"), (None, notice, 1, "x"), (2, None, 1, None), (3, "", 1, "x"), (4, "w " * 200_000 + notice + " w" * 1000, 1, "x"), (5, "\n\n" + notice, 1, "x"), (6, "b" * 300_000, 1, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_lines int, notices string")
    rows = [(r["doc_id"], r["n_lines"], [(n["line"], n["family"]) for n in r["notices"] if n["match"] >= licenses.CONFIRM]) for r in licenses.scan_licenses(docs).collect()]
    one = [(0, "apache-2.0")]
    assert sorted(rows, key=str) == sorted([(1, 1, one), (1, 1, one), (None, 1, one), (2, 1, []), (3, 1, []), (4, 1, one), (5, 3, [(2, "apache-2.0")]), (6, 1, [])], key=str)
