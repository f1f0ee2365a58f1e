"""Operators against brute force on a small fixture with nulls, blanks, copies, repeated rows, extra columns and long texts."""

import collections
import hashlib
import os
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cordon.llm import components, decontaminate, fmindex, licences, lineruns, linear, minhash, mixing, resample, scratch, substring, textkit, toxicity
from cordon.llm import language as lang
from cordon.llm import queries as q

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "ru", "sal", "vo") for b in ("ra", "ni", "do", "pel", "sti", "x", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n_words int, kept string, mark long, hub long"


def prose(rng, n):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))).capitalize() for _ in range(max(1, n // 8)))


def fixture_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 20, 80, 200])) for _ in range(60)]
    texts = list(base)
    for k in range(40):  # edited copies of one text, copies, shared passages
        words = base[3 if k < 25 else 7].split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [base[0]] * 3 + [base[5] + "\n" + base[9], base[11] * 2, "", " \n\t", None, None, "one", "ONE", "two words", "é" * 150, "a" * 400, "\n".join(["Same line here."] * 40), prose(rng, 30_000)]
    rows = [(k, t, ("en", "fr", None)[k % 3], "s", 1, "x", 0, "y", 2, 3) for k, t in enumerate(texts)]
    rows += [rows[2], rows[-1]]  # repeated rows
    rows += [(None, base[1], "en", "s", 1, "x", 0, "y", 2, 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], int("ka" in (r[1] or "")), int("vox" in (r[1] or ""))) for r in fixture_rows() if r[0] is not None]
    return spark.createDataFrame([*rows, (None, 1, 1), (10**9, None, 1)], "doc_id long, quality int, toxic int")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute_components(rows, n, percent=80):
    sets = collections.defaultdict(list)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r[1]))
        sets[r[0]].append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    parent = {k: k for k in sets if k is not None}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}, {k: {len(x) for x in v} for k, v in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    expected, sizes = brute_components(fixture_rows(), n)
    out = minhash.near_duplicates(docs, ngram=n).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.component_id == expected.get(r.doc_id) and r.n_shingles in sizes[r.doc_id]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_large_group_of_edited_copies(spark):
    rng = random.Random(2)
    base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(40))
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute_components(rows, 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, ngram=2).collect()} == expected


def test_estimate_is_close():
    rng = np.random.Generator(np.random.PCG64(1))
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    regs = minhash.registers(textkit.mix(np.concatenate([x, y])), np.array([0, 900, 1800]))
    guess, _ = minhash.estimate(regs[:1], regs[1:], np.array([900]), np.array([900]))
    assert abs(guess[0] - 0.8) < 0.1


def test_components_of_a_chain(spark):
    s = scratch.Scratch(spark, "test")
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 50), (31, 30)], "a long, b long")
    out = {r.node: r.root for r in components.components(edges, s).collect()}
    assert out == {k: 0 for k in range(21)} | {30: 30, 31: 30}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_equal_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = q.queries()[name](spark, SF).toPandas(), c.sql(q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(expected.columns)
    norm = lambda df: sorted(repr([None if v != v else round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in df[cols].values.tolist())
    assert norm(got) == norm(expected)


def test_quality_base_counts(docs):
    from cordon.llm.divergence import quality_rules

    out = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    for r in fixture_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = out[r[0], len(w)]
        assert (got.word_chars, got.n_dup_lines, got.n_repeat_words) == (sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert got.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (got.base_failed and got.kept)


def test_suffix_array_and_index():
    rng = np.random.Generator(np.random.PCG64(3))
    for size, sigma in ((1, 2), (50, 2), (400, 3), (300, 1)):
        text = rng.integers(1, sigma + 1, size)
        full = np.concatenate([text, [0]])
        assert fmindex.suffix_array(full).tolist() == sorted(range(size + 1), key=lambda k: full[k:].tolist())
        index = fmindex.FMIndex(text)
        for n in (1, 2, 5):
            patterns = rng.integers(1, sigma + 2, (20, n))
            low_, high = index.search(patterns)
            for p, a, b in zip(patterns, low_, high, strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [k for k in range(size - n + 1) if (text[k : k + n] == p).all()]


def bench_rows():
    texts = [r[1] for r in fixture_rows() if r[0] in (2, 8, 14)]
    return [(k, " ".join((t or "").split()[:40])) for k, t in enumerate(texts)] + [(7, "two words"), (8, ""), (9, None), (None, "one"), (10, "nothing of this stands anywhere")]


@pytest.mark.parametrize("block", [2 << 20, 600])
def test_decontamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "BLOCKS", 4)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = collections.defaultdict(set)
    for k, t in bench_rows():
        w = pattern.findall(low(t))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[j : j + n])] |= {str(k)} - {"None"}
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    got = collections.defaultdict(set)
    for r in decontaminate.report(docs, bench).collect():
        got[r.doc_id].add((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    for r in fixture_rows():
        w, hit, items = pattern.findall(low(r[1])), set(), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                if (p := tuple(w[j : j + n])) in phrases:
                    hit.update(range(j, j + n))
                    items |= phrases[p]
        assert (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)) in got[r[0]]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == decontaminate.report(docs, bench).where("not contaminated").count()


@pytest.mark.parametrize("flush", [1 << 20, 50])
def test_substring_dedup(docs, monkeypatch, flush):
    monkeypatch.setattr(substring, "FLUSH", flush)
    rows, first = sorted({(r[0] if r[0] is not None else substring.LAST, r[1]) for r in fixture_rows()}, key=lambda x: (x[0], x[1] or "")), {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (k, i))
            first[b[i : i + 100]] = min(first[b[i : i + 100]], (k, i))
    expected = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (k, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        expected[None if k == substring.LAST else k, len(b)] = (sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    out = substring.remove_repeats(docs, with_bytes=True).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) == expected[r.doc_id, r.n_bytes]


@pytest.mark.parametrize("least", [4, 12])
def test_line_dedup(docs, least):
    key = lambda r: r[0] if r[0] is not None else lineruns.LAST
    seqs = {(key(r), r[1]): [(i, x) for i, x in enumerate((r[1] or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for r in fixture_rows()}
    runs = collections.defaultdict(lambda: (1 << 64, 0))
    each = []
    for (k, t), s in seqs.items():
        for a in range(len(s)):
            words = 0
            for b in range(a, min(len(s), a + 45)):
                words += len(re.findall(r"[^\x20\x09-\x0D]+", s[b][1]))
                if words >= least:
                    text = "\n".join(x for _, x in s[a : b + 1])
                    runs[text] = min(runs[text], (k, a))
                    each.append(((k, t), a, b, text))
                    if words > 6 * least:
                        break
    gone = collections.defaultdict(set)
    for at, a, b, text in each:
        if runs[text] < (at[0], a):
            gone[at].update(range(a, b + 1))
    got = {(key(r), r.n_lines, r.kept_sha256): r.n_removed_lines for r in lineruns.line_report(docs, min_words=least).collect()}
    for (k, t), s in seqs.items():
        lines = (t or "").split("\n")
        assert sum(v for (i, n, _), v in got.items() if i == k and n == len(lines)) in {len(gone[k, t]), *(len(v) for (a, _), v in gone.items() if a == k)}
    kept = lineruns.drop_repeated_lines(docs, min_words=least)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 2


def test_language_by_held_out_accuracy(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 34", "en"), (10**6 + 2, "—…—", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in lang.identify(d.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert all(out[10**6 + k].lang_pred == "und" for k in range(3))
    rows = [r for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(out[r.doc_id].held_out for r in rows)
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_pools_every_letter(spark, monkeypatch):
    from cordon.llm import bigru

    monkeypatch.setattr(lang, "train", lambda data, mask, label, classes: bigru.new_weights(classes))
    rng = random.Random(3)
    texts = [prose(rng, 30), prose(rng, 200), "Été à Paris, 12 fois", "x", "é" * 100, "9 8 7", "", None, prose(rng, 3_000)]
    rows = [(k, t, ("aa", "bb", "cc")[k % 3]) for k, t in enumerate(texts)] * 2
    with pytest.warns(UserWarning, match="more than 2 languages"):
        assert {r.lang_pred for r in lang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=2).collect()} <= {"aa", "bb", "cc", "und"}
    out = lang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    w = {k: v.astype(np.float64) for k, v in bigru.new_weights(3).items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    n = bigru.HIDDEN

    def walk(d, seen):
        h, states = np.zeros(n), []
        for c in seen:
            a, b = w["x"][c + 256 * d], h @ w["u"][d]
            z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
            states.append(h)
        return states

    for r in out:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (texts[r.doc_id] or "").encode())
        pooled, letters = np.zeros(3), 0
        for at in range(0, len(raw), bigru.LENGTH):
            own = raw[at : at + bigru.LENGTH].ljust(bigru.LENGTH, b"\0")
            for c, f, back in zip(own, walk(0, own), walk(1, own[::-1])[::-1], strict=True):
                if chr(c).isascii() and chr(c).isalpha() or c >= 0x80:
                    e = np.exp(f @ w["v"][0] + back @ w["v"][1] + w["c"])
                    pooled, letters = pooled + e / e.sum(), letters + 1
        if not letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "abc"[pooled.argmax()] * 2 and abs(r.score - pooled.max() / letters) < 1e-4


def test_gradients_of_the_recurrent_network():
    from cordon.llm import bigru

    rng = np.random.Generator(np.random.PCG64(0))
    w = {k: v.astype(np.float64) for k, v in bigru.new_weights(3).items()}
    x, mask, y = rng.integers(0, 256, (6, 4)), rng.random((6, 4)) > 0.3, np.array([0, 1, 2, 1])
    _, g = bigru._gradients(w, x, mask, y)
    for k, at in (("u", (1, 2, 5)), ("v", (0, 3, 1)), ("x", (int(x[2, 1]), 20)), ("x", (256 + int(x[2, 1]), 3)), ("c", (1,))):
        moved = []
        for step in (1e-2, -1e-2):
            v = {n: a.copy() for n, a in w.items()}
            v[k][at] += step
            moved.append(bigru._gradients(v, x, mask, y)[0])
        assert abs((moved[0] - moved[1]) / 2e-2 - g[k][at]) < 2e-4


def test_toxicity(spark, docs, labels):
    if os.path.isdir(SF.replace("0.001", "0.01")):
        d, lab = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
        train = lab.where("pmod(xxhash64(doc_id), 4) > 0")
        got = toxicity.classify(d, train).join(lab.where("pmod(xxhash64(doc_id), 4) = 0").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
        assert (got.toxic == (got.y == 1)).mean() > 0.88 and got[got.y == 0].toxic.mean() < 0.05
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count() and out.where("kept = toxic or p_toxic is null").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.classify(docs, labels.limit(0)).where("toxic").count() == 0


def test_chain_equals_brute_force(spark):
    docs, labels = labelled_texts(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    texts, marks = {r.doc_id: r.text for r in docs.collect()}, sorted((r.doc_id, r.quality, r.toxic) for r in labels.collect())
    have = {k: {x for word in re.findall("[a-z0-9]+", t.lower()) for x in [("w", word)] + [(n, word[:n]) for n in (4, 5, 6, 7)]} for k, t in texts.items()}
    y = np.array([(1 - a, b, b * (1 - a)) for _, a, b in marks], float)
    counts = collections.defaultdict(lambda: np.zeros(4))
    for (k, *_), row in zip(marks, y, strict=True):
        for f in have[k]:
            counts[f] += [1, *row]
    chosen = set()
    for j, share in enumerate(y.mean(0)):
        z = {f: abs(c[j + 1] - c[0] * share) / (c[0] * share * (1 - share)) ** 0.5 for f, c in counts.items() if c[0] >= 5}
        found = {f for f, v in z.items() if v >= 4}
        assert len(found) < linear.MAX_FEATURES
        chosen |= found
    chosen = sorted(chosen, key=str)
    x_of = lambda ids, extra: np.hstack([np.array([[f in have[k] for f in chosen] for k in ids], float), extra, np.ones((len(ids), 1))])

    def newton(x, t):
        w, cost = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
        cost[-1] = 1e-3
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(cost), x.T @ (t - p) - cost * w), -2, 2)
        return w

    p_of = lambda x, w: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    squash = lambda p: (np.log(np.clip(p, 1e-4, 1 - 1e-4)) - np.log1p(-np.clip(p, 1e-4, 1 - 1e-4)))[:, None] / 4
    ids = [k for k, *_ in marks]
    fold = np.array([(k * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.FOLDS for k in ids])
    everyone, learnt, seen = sorted(texts), np.zeros((len(ids), 0)), np.zeros((len(texts), 0))
    for j, name in enumerate(("p_junk", "p_toxic", "p_toxic_junk")):
        x, unseen = x_of(ids, learnt), np.zeros(len(ids))
        for f in range(toxicity.FOLDS):
            unseen[fold == f] = p_of(x[fold == f], newton(x[fold != f], y[fold != f, j]))
        p = p_of(x_of(everyone, seen), newton(x, y[:, j]))
        assert max(abs(got[k][name] - v) for k, v in zip(everyone, p, strict=True)) < 1e-3, name
        learnt, seen = np.hstack([learnt, squash(unseen)]), np.hstack([seen, squash(p)])


def test_resampling_keeps_the_share(spark, docs, labels):
    out = resample.resample(docs, labels, share=0.25).collect()
    assert sum(r.kept for r in out) >= round(0.25 * len(out))
    assert min(r.gumbel_key for r in out if r.kept) >= max(r.gumbel_key for r in out if not r.kept)
    values = [random.Random(1).randrange(-(2**63), 2**63) for _ in range(50)] + [0, 0, -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 30, 55):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "v", 0) is None


def test_wrapped_licence_texts(spark):
    def wrap(text, width, mark=""):
        return "\n".join(mark + line for line in textwrap.wrap(text, width))

    s = licences.SENTENCES
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    warranty = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one."
    cases = []
    for width, mark in ((70, ""), (30, " * "), (45, "# "), (60, "! "), (50, ";; ")):
        w, gap = (lambda text: wrap(text, width, mark)), f"\n{mark}\n"  # noqa: B023
        cases += [
            (gap.join(["Copyright X", w(s[3] + ":"), w(s[4] + "."), w(s[5].upper() + ".")]), "MIT"),
            (gap.join([w("Copyright X. All rights reserved."), w(s[30] + ":"), w("1. " + s[31] + "."), w("2. " + s[32] + ".")]), "BSD-2-Clause,LicenseRef-all-rights-reserved"),
            (gap.join([w(s[30] + ":"), w("* " + s[31] + "."), w("* " + s[32] + "."), w("* " + s[33] + ".")]), "BSD-3-Clause"),
            (gap.join([w(gpl.format(":", ",", 3)), w(warranty)]), "GPL-3.0-or-later"),
            (gap.join([w(gpl.format(";", ";", 2)), w(warranty)]), "GPL-2.0-or-later"),
            (gap.join([w(apache), f"{mark}    http://www.apache.org/licenses/LICENSE-2.0", w(s[14] + ".")]), "Apache-2.0"),
            (w(mpl), "MPL-2.0"),
        ]
    cases += [("Some code\nReleased under the MIT License\nby someone", "MIT"), ("it is not released under the MIT License\nat all", ""), ("all rights\n\nreserved", ""), ("all rights. Reserved", "")]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "doc_id int, text string")
    out = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    assert out == {k: want for k, (_, want) in enumerate(cases)}


def test_resampling_counts_every_target_text(spark):
    n = 12_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 7, ' v', id % 11) as text").repartition(3)
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as quality", "0 as toxic")
    labels = labels.unionByName(labels.where("doc_id % 5 = 0"))
    rows = {r.doc_id: r for r in resample.resample(docs, labels).collect()}
    raw, aim = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    own = {k: resample.ngram_buckets(pa.array([f"w{k % 7} v{k % 11}"]))[0] for k in range(77)}
    for k in range(n):
        np.add.at(raw, own[k % 77], 1)
        if k % 3 == 0:
            np.add.at(aim, own[k % 77], 1)
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    assert max(abs(rows[k].log_weight - ratio[own[k % 77]].sum()) for k in range(n)) < 2e-6
    assert sum(r.kept for r in rows.values()) == n // 3


def test_licence_sequences(spark):
    s = licences.SENTENCES
    texts = [f"{s[3]}:\n\n{s[4]}.\n{s[5]}.", f"{s[4]}.\n{s[3]}.", f"{s[30]}:\n{s[31]}.\nOther.\n{s[32]}.\n{s[33]}.", "Released under the MIT License. All rights reserved.", None, "",
             f"{s[30]}:\n{s[31]}.\n{s[32]}.\nReleased under the MIT License.\n{s[30]}:\n{s[31]}.\n{s[32]}.\n{s[33]}.", f"{s[70]}.\n{s[71]}."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: (r.licences, r.n_sentences) for r in licences.scan(df).collect()}
    assert out == {0: ("MIT", 3), 1: ("", 2), 2: ("BSD-3-Clause", 4), 3: ("LicenseRef-all-rights-reserved,MIT", 2), 4: ("", 0), 5: ("", 0), 6: ("BSD-2-Clause,BSD-3-Clause,MIT", 8), 7: ("ISC", 2)}
    c = duckdb.connect()
    frame = df.toPandas()
    c.register("documents", frame)
    assert {r[0]: (r[4], r[1]) for r in c.sql(licences.oracle()).fetchall()} == out


def test_mixing_meets_its_targets(spark, docs, labels):
    rng = np.random.Generator(np.random.PCG64(4))
    p = rng.dirichlet([1, 1, 1], 200)
    table = spark.createDataFrame([(int(rng.integers(1, 50)), x.tolist()) for x in p], "tokens long, p array<double>")
    aim = np.array([0.5, 0.3, 0.2])
    steps, size, _, _ = mixing.descend(table, aim, 1e-3, 1e-6, 400)
    rows = table.collect()
    t, q_ = np.array([r.tokens for r in rows], float), np.array([r.p for r in rows])
    rate = mixing._rates(q_, steps, size, 1e-3, (0.0, 20.0))[1]
    assert np.abs((t * rate) @ q_ / t.sum() - aim).max() < 0.01 and rate.min() >= 0
    out = mixing.mix(docs, labels)
    assert out.count() == docs.count() and out.where("_rate.rate < 0 or _rate.rate is null").count() == 0


def labelled_texts(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(400):
        kind = rng.choices([(1, 0), (0, 0), (1, 1), (0, 1)], [0.76, 0.08, 0.11, 0.05])[0]
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))] + ["idiotic"] * (kind[1] and rng.randint(2, 4)) + ["buynow"] * ((not kind[0]) and rng.randint(2, 4))
        rows.append((k, " ".join(words)))
        if k % 5 < 3:
            marks.append((k, *kind))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_default_mixing_equals_brute_force(spark):
    out = [r._rate for r in mixing.mix(*labelled_texts(spark)).collect()]
    t, p, rate = np.array([r.tokens for r in out], float), np.array([r.p for r in out]), np.array([r.rate for r in out])
    aim = np.array(list(mixing.TARGETS.values()))
    assert np.abs((t * rate) @ p / t.sum() - aim).max() < 2e-3 and {r.miss for r in out} == {np.float64(out[0].miss)}
    best = np.ones(len(p))
    for _ in range(40_000):
        best = np.clip(best - 0.3 * (p @ (((t * best) @ p / t.sum() - aim) / aim) + 1e-3 * (best - 1)), 0.0, mixing.MOST)
    assert np.abs(best - rate).max() < 3e-2


def test_posteriors_are_calibrated(spark):
    texts, labels = labelled_texts(spark)
    out = {r.doc_id: r._rate.p for r in mixing.mix(texts, labels).collect()}
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    y = np.array([[m == d for d in ((1, 0), (0, 0), (1, 1), (0, 1))] for m in marks.values()], float)
    p = np.array([out[k] for k in marks])
    assert np.abs(p.mean(0) - y.mean(0)).max() < 0.03 and np.allclose(p.sum(1), 1)


def test_unreachable_mixing_targets_are_reported(spark):
    docs, labels = labelled_texts(spark)
    one = labels.where("quality = 1 and toxic = 0")
    with pytest.warns(UserWarning, match="targets are missed"):
        out = mixing.mix(docs, one)
    assert out.where("_rate.rate < 0").count() == 0 and out.where("_rate.miss < 0.04").count() == 0
    with pytest.raises(ValueError, match="targets are missed"):
        mixing.mix(docs, one, strict=True)


def test_empty_tables(spark, empty, labels):
    bench = spark.createDataFrame([], "item_id long, text string")
    none = labels.limit(0)
    assert minhash.near_duplicates(empty).count() == 0
    assert decontaminate.report(empty, bench).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert lineruns.line_report(empty).count() == 0
    assert toxicity.classify(empty, none).count() == 0
    assert licences.scan(empty).count() == 0
    assert lang.identify(empty).count() == 0
    assert resample.resample(empty, none).count() == 0
    assert mixing.report(empty, none).count() == 0
    from cordon.llm.divergence import quality_rules

    assert quality_rules(empty).count() == 0


def test_empty_benchmark_hits_nothing(spark, docs):
    assert decontaminate.report(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_pipeline_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "mixing"]
    ids = {r.doc_id for r in d.collect()}
    now = d
    s = scratch.Scratch(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        out = s.keep(stage(spark, now, SF))
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in now.collect()} <= ids
        if name != "mixing":
            assert out.columns == d.columns
        if name == "minhash":
            expected, _ = brute_components([(r.doc_id, r.text) for r in now.collect()], 5)
            assert {r.doc_id for r in rows} == {k for k, v in expected.items() if k == v}
        assert len(rows) >= 0.9 * now.count()
        if name == "mixing":  # every document stays; the total holds where the targets are met
            assert len(rows) == now.count() and all(0.05 <= r.mix_rate <= 4 for r in rows)
        now = out


def test_pipeline_mixing_of_a_tenth(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    marks = spark.read.parquet(f"{folder}/labels.parquet").dropDuplicates(["doc_id"])
    d = spark.read.parquet(f"{folder}/documents.parquet").join(marks.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    rows = corpus_pipeline.weigh(spark, d, folder).collect()
    t, r = np.array([x.mix_tokens for x in rows], float), np.array([x.mix_rate for x in rows])
    assert len(rows) == d.count() and rows[0].mix_miss < 2e-3 and abs(t @ r / t.sum() - 1) < 2e-3
    good = {x.doc_id: x.quality for x in marks.collect()}
    known = np.array([x.doc_id in good for x in rows])
    share = sum(a * b for x, a, b in zip(rows, t, r) if good.get(x.doc_id) == 1) / (t * r)[known].sum()
    assert abs(share - 0.9 / 0.95) < 0.03


def test_texts_just_below_the_threshold_meet_little(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    asked = []
    for n in (60, 120):
        rows = []
        for k in range(n):
            words = list(base)
            for i in rng.sample(range(400), 14):
                words[i] = f"e{rng.randrange(10**6)}"
            rows.append((k, " ".join(words)))
        pool = spark.createDataFrame(rows, "id long, text string")
        met = minhash._apart(pool.select("id", F.col("id").alias("root")), pool, 2, 80, scratch.Scratch(spark, "test"))
        got = {(r.a, r.b) for r in met.collect()}
        sets = [set(zip(w, w[1:])) for w in (t.split() for _, t in rows)]
        assert {(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} <= got
        asked.append(len(got))
    assert asked[1] <= 120  # of 7,140 pairs


def test_hot_buckets_lose_no_pair(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 3)
    pool = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text").dropDuplicates()
    met = minhash._apart(pool.select("id", F.col("id").alias("root")).distinct(), pool, 5, 80, scratch.Scratch(spark, "test"))
    got = {(r.a, r.b) for r in met.collect()}
    sets = {r.id: textkit_set(r.text) for r in pool.collect()}
    assert {(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])} <= got


def textkit_set(text, n=5):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_take_columns_of_any_name_and_type(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    text = " ".join(WORDS)
    df = spark.createDataFrame([(1, text, {"k": 1}, 2), (1, text, {"k": 1}, 2), (2, text, None, None), (None, None, {}, 4)], "doc_id long, text string, m map<string,int>, x int")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), "m", F.col("x").alias("a.b"), F.col("x").alias("back`tick"), F.col("x").alias("_extra3"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.columns[: len(df.columns)] == df.columns
        assert {r.asDict()["a.b"] for r in out.collect()} == ({2, 4} if name in ("line_dedup", "minhash") else {2, None, 4})


def confusing_words():
    """Two words of 2,048 letters that every power series modulo 2^64 with an odd base takes for equal."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_confusing_words_stay_apart(spark):
    one, two = confusing_words()
    rest = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(0, one), (1, two), (2, f"{one} {rest}\n{two} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, ngram=2).collect()} == {0: 0, 1: 1, 2: 2}
    bench = spark.createDataFrame([(7, two)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(df, bench).collect()} == {0: 0, 1: 1, 2: 1}
    assert all(r.n_removed_lines == 0 for r in lineruns.line_report(df).collect())
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()}
    first, expected = {}, {}
    for k, t in ((0, one), (1, two)):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first.setdefault(t[i : i + 100], (k, i)) != (k, i):
                gone[i : i + 100] = b"\1" * 100
        expected[k] = sum(gone)
    assert {k: got[k] for k in expected} == expected


def test_bands_and_estimate_find_similar_sets():
    rng = np.random.Generator(np.random.PCG64(6))
    pairs = 200
    values = [rng.integers(0, 2**63, 550, dtype=np.int64).astype(np.uint64) for _ in range(pairs)]
    sets = [x for v in values for x in (v[:500], np.concatenate([v[:450], v[500:]]))]  # 450 of 550 are shared
    regs = minhash.registers(textkit.mix(np.concatenate(sets)), np.arange(0, 500 * (2 * pairs + 1), 500))
    keys = regs.reshape(2 * pairs, minhash.GROUPS, minhash.BUCKETS)[:, : minhash.BANDS]
    met = (keys[0::2] == keys[1::2]).all(2).any(1)
    size = np.full(pairs, 500)
    guess, count = minhash.estimate(regs[0::2], regs[1::2], size, size)
    passed = guess >= 0.8 - minhash.MARGIN * np.sqrt(0.16 / count)
    assert (met & passed).mean() >= 0.99


def test_line_runs_are_maximal(spark):
    lines = [f"line {k} of some words here" for k in range(200)]
    texts = ["\n".join(lines[:120]), "\n".join(["alone", *lines[20:90], "other", *lines[50:60], *lines[100:130]]), "\n".join(lines[5:12]), "\n".join([lines[0]] * 64)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = scratch.Scratch(spark, "test")
    rows = lineruns.repeated_runs(df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text"), 30, s).collect()
    got = {(r.id, r.pos, r.length) for r in rows}
    assert {(1, 1, 70), (1, 72, 10), (1, 82, 20), (2, 0, 7)} <= got
    # the first line of text 3 stands in text 0 too, but in no stretch of 30 words
    assert {x for x in got if x[0] == 3} == {(3, 1, 63)} and not any(x[0] == 0 for x in got)


CLASHING = ["_id", "_mark", "_runs", "_chain", "_mix", "_rate", "_contamination", "_text", "hub", "root", "words"]


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    text = " ".join(WORDS) + " " + " ".join(reversed(WORDS))
    rows = [(1, text), (1, text), (1, "another text of this id"), (2, None), (3, ""), (None, text), (None, text), (None, None), (4, "x" * 200_000), (5, "word " * 30_000), (6, text)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, SF), stage(spark, df.limit(0), SF)
        assert out.columns[: len(df.columns)] == df.columns and none.count() == 0
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert set(got) <= set(rows) and all(out.where(f"`{c}` <> {k}").isEmpty() for k, c in enumerate(CLASHING))
        if name == "minhash":  # equal rows become one, and 6 is a copy of 1; null ids are linked with nothing
            assert sorted(got, key=repr) == sorted(set(rows) - {(6, text)}, key=repr)
        if name in ("decontamination", "toxicity", "mixing"):
            assert len(got) == len(rows)
