"""Blocks by pivot: the same pairs and clusters as without, with fewer pairs of blocks where vectors form clusters."""
import numpy as np
import pyarrow as pa
import pytest

from vistalake.operators import clustering, duplicates, similarity


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    m = np.repeat(centres, 30, axis=0) + rng.normal(scale=0.06, size=(1200, 24))
    m[:60] = m[0] + rng.normal(scale=1e-3, size=(60, 24))  # a large group of copies
    m[60] = 0
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None)], "id long, embedding array<double>")


def pairs(df):
    return {(r["id_a"], r["id_b"]): round(r["similarity"], 9) for r in df.collect()}


@pytest.mark.parametrize("low,high", [(0.95, 0.9999), (0.995, None), (0.5, None), (-0.2, None)])
def test_same_pairs(clustered, low, high):
    assert pairs(similarity.block_pairs(clustered, low, high, rows=50, pivots=40)) == pairs(similarity.block_pairs(clustered, low, high))


def test_far_blocks_are_not_paired(clustered):
    known = clustered.filter("embedding is not null")
    blocks = similarity.Blocks(known, 0.95, 50, 40)
    made = blocks.deal(blocks.rows).select("p", "q").distinct().count()
    assert made == blocks.kept < 0.2 * blocks.n * (blocks.n + 1) / 2
    assert blocks.rows.count() == known.count() and blocks.rows.groupBy("own").count().agg({"count": "max"}).first()[0] <= 120
    every = similarity.Blocks(known, 0.95, 50)
    assert every.kept == every.n * (every.n + 1) // 2 and every.deal(every.rows).select("p", "q").distinct().count() == every.kept


def test_same_clusters(clustered):
    known = clustered.filter("embedding is not null")
    for eps, least in ((0.5, 4), (0.9, 6)):
        plain, pruned = (sorted(map(tuple, clustering.dbscan(known, eps, least, **o).collect())) for o in ({}, {"rows": 50, "pivots": 40}))
        assert plain == pruned and max(c for _, c in plain) > 5


def test_empty(clustered):
    assert similarity.block_pairs(clustered.limit(0), 0.9, rows=50, pivots=4).count() == 0
    assert clustering.dbscan(clustered.limit(0), pivots=4).count() == 0


@pytest.mark.parametrize("pivots", [None, 40])
def test_no_row_is_sent_twice(spark, clustered, pivots):
    """Blocks meet where they are read: neither vectors nor pairs are shuffled for it, with the columns of both files or without."""
    sides = clustered.selectExpr("id", "id % 5 > 0 as is_processed", *[f"cast(id % 7 as string) as {c}" for c in duplicates.SIDES])
    near = similarity.block_pairs(clustered, 0.95, 0.9999, rows=50, pivots=pivots)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    both = duplicates.similar_with_sides(clustered, sides)
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    want = duplicates.with_sides(similarity.similar_pairs(clustered), sides)
    rows = lambda df: sorted(tuple(round(r[c], 9) if c == "similarity" else r[c] for c in want.columns) for r in df.collect())
    assert rows(both) == rows(want) != []


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(2)
    x = similarity.matrix_of(pa.array((np.repeat(rng.normal(size=(700, 64)), 4, axis=0) + rng.normal(scale=0.2, size=(2800, 64))).tolist()))
    x[5] = 0
    for low in (0.95, 0.79, 0.3, -0.5):
        for a, b, same in ((x, x, True), (x[:900], x[900:], False)):
            got = {(i, j) for i, j, _ in (p for t in similarity.close_rows(a, b, same, low) for p in zip(*t))}
            assert got == {(i, j) for i, j in zip(*np.nonzero(a @ b.T > low)) if i < j or not same}


def test_approximate_pairs_come_once_without_a_shuffle_of_pairs(clustered):
    known = clustered.filter("embedding is not null")
    near = similarity.similar_pairs_approximate(known, rows=50)
    assert "keys=[id_a" not in near._jdf.queryExecution().executedPlan().toString()
    found = near.collect()
    assert len(found) == len({(r["id_a"], r["id_b"]) for r in found})
    got, want = {(r["id_a"], r["id_b"]): round(r["similarity"], 9) for r in found}, pairs(similarity.similar_pairs(known))
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want) > 0


def jittered(n, size=64, copies=4, scale=0.015, seed=3):
    """Unrelated directions with a few near copies each, and a large group of rows that are all close but stand in no one ball."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    m = np.concatenate([base + rng.normal(scale=scale * (k > 0), size=base.shape) for k in range(copies)])
    return np.concatenate([m, base[0] + rng.normal(scale=0.05, size=(n // 4, size))])


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("low", [0.95, 0.79, 0.3])
def test_balls_lose_no_pair(low):
    x = unit(jittered(300))
    x[5] = 0
    x[6] = np.nan
    (a, m), (b, n) = ((part[o], s) for part in (x[:800], x[800:]) for o, s in [similarity.balls(part, (1 + low) / 2)])
    assert sorted(map(bytes, a)) == sorted(map(bytes, x[:800])) and m.sum() == len(a) and m.max() > 1
    for y, k, same in ((a, m, True), (b, n, False)):
        got = [p for i, j, _ in similarity.close_rows(a, y, same, low, sizes=(m, k)) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(a @ y.T > low)) if i < j or not same}


def test_near_copies_are_compared_once_for_all():
    """Rows of a ball are looked at by its mean: of 4 000 rows in balls of four only means meet."""
    x = unit(np.random.default_rng(1).normal(size=(1000, 64)))
    m = unit(np.concatenate([x + np.random.default_rng(k).normal(scale=0.01 * k, size=x.shape) for k in range(4)]))
    order, sizes = similarity.balls(m, 0.9)
    assert len(sizes) < 1100 and sorted(order) == list(range(4000))


def test_whole_cells_are_put_together_where_pivots_rule_out_little(spark):
    """Far fewer blocks than cells, near copies in one block, every pair of blocks counts."""
    m = jittered(300, scale=0.004)[:1200]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    blocks = similarity.Blocks(rows, 0.79, 100, 60)
    assert blocks.partners is None and 12 <= blocks.n <= 24 and blocks.kept == blocks.n * (blocks.n + 1) // 2
    assert blocks.rows.groupBy("own").count().agg({"count": "max"}).first()[0] <= 100
    own = {r["id"]: r["own"] for r in blocks.rows.select("id", "own").collect()}
    assert sum(own[i] == own[i + 300] for i in range(300)) > 200
    assert len(blocks.pack().selectExpr("explode(sizes)").collect()) < 800


@pytest.mark.parametrize("pivots", [None, 30])
def test_blocks_meet_again_only_where_they_are_dense(spark, monkeypatch, pivots):
    """The same clusters as by definition; one meeting of all blocks, a second one of dense pairs of blocks only."""
    from tests.test_operators import reference_dbscan

    met = []
    meet = similarity.Blocks.meet
    monkeypatch.setattr(similarity.Blocks, "meet", lambda self, packed, *a: met.append("only" in packed.columns) or meet(self, packed, *a))
    sparse = jittered(80, scale=0.03)[:320]
    for m, want in ((sparse, [False]), (np.concatenate([sparse, jittered(1000)[4000:]]), [False, True])):
        m = unit(m)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
        met.clear()
        got = dict(map(tuple, clustering.dbscan(rows, 0.65, 4, 100, pivots).collect()))
        assert [got[i] for i in range(len(m))] == reference_dbscan(m, 0.65, 4).tolist()
        assert met == want and len(set(got.values())) > 20


def test_a_block_is_a_file(spark):
    """A reader holds the rows of a file at a time: one block, not all that a task has packed."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(jittered(40))], "id long, embedding array<double>")
    blocks = similarity.Blocks(rows, 0.79, 20)
    packed = blocks.pack()
    assert len(packed.inputFiles()) == packed.count() == blocks.n > 4
