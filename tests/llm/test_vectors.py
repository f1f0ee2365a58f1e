"""Whitening, SimHash groups and hard negatives against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cordon.llm import negatives, simhash
from cordon.llm.whitening import whiten

NAN = float("nan")


def test_whitening_equals_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.normal(size=(50, 6)) * [5, 4, 3, 2, 1, 0.5] + 100
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(0, x[0].tolist(), 0), (None, x[1].tolist(), 1)]
    odd = [(90, None, 1), (91, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (92, [NAN] * 6, 1), (93, [float("inf")] + [1.0] * 5, 1), (94, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, index long").repartition(5).withColumn("a.b", F.lit(1)).withColumn("_index", F.lit(2))
    out = whiten(df, components=4, block_rows=7, slab_blocks=3)
    assert out.columns == [*df.columns, "_white"]
    got = out.collect()
    y = np.array([r[1] for r in rows])
    c = y - y.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / len(y))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(rows) and all(r._white.n == len(rows) and r._white.identity_error < 1e-10 for r in got)
    assert np.allclose([r._white.explained for r in got], values[:4] / values.sum())
    one = np.array([r._white.whitened for r in got])
    two = (np.array([r.embedding for r in got]) - y.mean(0)) @ axes[:, :4] / np.sqrt(values[:4])
    assert np.allclose(one * np.sign((one * two).sum(0)), two, atol=1e-9)


def test_whitening_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r._white.whitened for r in whiten(df).collect()] == [[], []]
    assert whiten(df.limit(0)).count() == 0
    assert [len(r._white.whitened) for r in whiten(df.unionByName(df.selectExpr("vec_id + 5 as vec_id", "array(3F, 2F) as embedding"))).collect()] == [1] * 4
    with pytest.raises(ValueError, match="entries"):
        whiten(df.unionByName(df.selectExpr("vec_id", "array(3F) as embedding")))


def brute_print(text):
    words = [w for w in re.split("[ \\t-\\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"W{k}é" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 90]))) for _ in range(60)]
    for k in range(40):
        own = texts[3 + k % 2].split(" ") * 4
        own[rng.randrange(len(own))] = "edit"
        texts.append("\t".join(own))
    texts += [None, "", " \n", texts[0], texts[0].upper(), "x" * 100_000, "word " * 30_000]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(5, texts[7], 1), (5, texts[5], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print long").repartition(3)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    prints = [(k, brute_print(t)) for k, t, _ in rows]
    for k, p in prints:
        for j, q in prints:
            if None not in (k, j) and bin(p ^ q).count("1") <= 3 and find(k) != find(j):
                a, b = sorted((find(k), find(j)))
                root[b] = a
    expected = sorted((repr(k), f"{p:016x}", None if k is None else find(k)) for k, p in prints)
    assert len({x[2] for x in expected}) < len(ids) - 30
    for stripe in (simhash.STRIPE, 5):
        assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, stripe=stripe).collect()) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_tiles_and_forest():
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (12, 2)))]))
    rng.shuffle(prints)
    half = len(prints) // 2
    pair = lambda x, y: {frozenset(z) for a, b in [(x, y)] for z in zip(a.tolist(), b.tolist())}
    true = {frozenset((a, b)) for a in prints.tolist() for b in prints.tolist() if a < b and bin(a ^ b).count("1") <= 3}
    got = set().union(*(pair(x, y) for x, y in simhash.near_pairs(prints, None, 3)))
    split = set().union(*(pair(x, y) for s in ((prints[:half], None), (prints[half:], None), (prints[:half], prints[half:])) for x, y in simhash.near_pairs(*s, 3)))
    assert got == split == true and len(true) > 100
    a, b = np.arange(9, 0, -1), np.arange(8, -1, -1)
    assert dict(zip(*(x.tolist() for x in simhash.forest(a, b)))) == {k: 0 for k in range(1, 10)}


def brute_negatives(rows, anchor):
    """Scores of every anchor with every row; rows: (id, label, x)."""
    rows = sorted({(k, m, tuple(x)) for k, m, x in rows})
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        score = {r: int(np.dot(a[2], r[2])) for r in rows if r != a}
        best = lambda some, k: sorted(some, key=lambda r: (-score[r], r[0]))[:k]  # noqa: B023, E731
        for p in best([r for r in score if r[1] == a[1]], 5):
            some = [r for r in score if r[1] != a[1] and 30 * score[p] <= 100 * score[r] <= 90 * score[p]]
            out += [(a[0], p[0], k + 1, r[0], score[p], score[r]) for k, r in enumerate(best(some, 10))]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 5, 64])
def test_hard_negatives_equal_brute_force(spark, width):
    rng = np.random.Generator(np.random.PCG64(width))
    centres = rng.normal(size=(4, width))
    rows = []
    for k in range(240):
        label = int(rng.integers(0, 4))
        x = np.zeros(width, int) if k % 50 == 0 else np.floor(20 * (centres[k % 4] + 0.4 * rng.normal(size=width))).astype(int)
        rows.append((k, label, x.tolist()))
    rows += [(300 + k, 1, rows[7][2]) for k in range(12)]  # ties
    odd = [(None, 1, rows[3][2]), (400, None, rows[3][2]), (401, 1, None), (402, 1, [None] * width), rows[20], rows[9], (403, 1, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, x array<long>").repartition(4).withColumn("score", F.lit(1))
    for sizes in ({}, {"cell_rows": 37, "cell_anchors": 5}):
        got = negatives.mine(df, F.col("vec_id") % 20 == 0, **sizes).collect()
        assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda k: k % 20 == 0)
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.Generator(np.random.PCG64(9))
    steps = np.repeat(rng.integers(-200, 200, (300, 8)), 8, axis=1) + rng.integers(-3, 4, (300, 64))
    side = negatives.Side(steps, negatives.LEVELS)
    exact = steps @ steps.T
    spreads = []
    for mean, deviation in side.levels:
        middle, spread = mean @ mean.T, deviation @ deviation.T
        assert (np.abs(exact - middle) <= spread + 1e-6).all()
        spreads.append(spread.mean())
    assert spreads == sorted(spreads, reverse=True)
    one = np.full((300, 1), -(2**62))
    i, j, score = negatives.survivors(side, side, ~np.eye(300, dtype=bool), one, -one, 5)
    assert len(i) < 0.2 * 300 * 300 and (score == exact[i, j]).all()


def test_scores_past_floats():
    a = np.array([[2**28 + 1, 3]])
    assert negatives.exact_scores(a, a)[0, 0] == (2**28 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        negatives.exact_scores(a * 2**10, a)
