"""Whitening, exact top k and spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling as sp
from tidemark.llm import topk as tk
from tidemark.llm import whitening as wh
from tidemark.llm.spectrum import inertia, leading

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id long, embedding array<float>, label int, score string, n int"
ODD = [None, [], [1.0, None, 2.0, 0.0], [NAN, 0.0, 0.0, 0.0], [0.0, INF, 0.0, 0.0], [1.0, 2.0]]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SHAPE)


def made(n, d=4, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32) * [3, 2, 1, 0.5]
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]


def test_inertia_counts_signs():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = rng.integers(1, 12)
        a = rng.integers(-3, 4, (n, n)).astype(float)
        a = a + a.T
        w = np.linalg.eigvalsh(a)
        if np.abs(w).min() > 1e-9:
            assert inertia(a) == ((w > 0).sum(), 0, (w < 0).sum())


@pytest.mark.parametrize("kind", ["spread", "near", "equal", "low_rank", "zero", "one"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(3)
    lam = {"spread": np.geomspace(100, 0.01, 48), "near": np.r_[9 + 1e-7 * np.arange(8)[::-1], np.linspace(8, 1, 40)],
           "equal": np.r_[np.full(6, 5.0), np.full(6, 2.0)], "low_rank": np.r_[[7, 3, 1], np.zeros(9)], "zero": np.zeros(5), "one": np.array([4.0])}[kind]
    q = np.linalg.qr(rng.normal(size=(len(lam), len(lam))))[0]
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    e, x = leading(a, 32)
    want = [v for v in lam if v > 0][:32]
    assert np.allclose(e, want, rtol=1e-12, atol=1e-12) and len(e) == len(want)
    assert np.abs(x.T @ x - np.eye(len(e))).max(initial=0) < 1e-12
    assert np.abs(a @ x - x * e).max(initial=0) < 1e-12 * max(lam.max(initial=0), 1) * 10


def whitened_brute(rows, k):
    v = [(i, r) for i, r in rows if r is not None and len(r) == 4 and all(c is not None and np.isfinite(c) for c in r)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r] for _, r in v], object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    c = off.astype(float) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    return [i for i, _ in v], n, [int(d) for d in (off ** 2).sum(axis=1)], c @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_against_brute_force(spark):
    rows = made(200) + [(900 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0, 2.0, 3.0, 4.0])] + [(7, made(200)[7][1])] * 3
    ids, n, deviation, want, explained = whitened_brute(rows, 4)
    got = wh.whiten(table(spark, rows).repartition(3), 4).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 4 * len(ids) == 4 * 204 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert Counter(got.deviation) == Counter(d for d in deviation for _ in range(4))
    for k in range(4):
        mine = got[got.component == k + 1]
        assert np.allclose(mine.explained, explained[k])
        a = mine.sort_values("deviation").whitened.to_numpy()
        b = want[np.argsort(deviation, kind="stable"), k]
        order = np.argsort(np.abs(a)), np.argsort(np.abs(b))
        assert np.allclose(np.abs(a)[order[0]], np.abs(b)[order[1]], rtol=1e-8)
        assert abs(a @ b) / len(a) == pytest.approx(1, abs=0.05)
    assert got[got.vec_id.isna()].shape[0] == 4


def test_whitening_edges(spark):
    assert wh.whiten(table(spark, [])).count() == 0
    assert wh.whiten(table(spark, [(1, v) for v in ODD[:5]])).count() == 0
    assert wh.whiten(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0  # no spread, no component
    two = wh.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0])])).collect()
    assert len(two) == 2 and sorted(round(r.whitened, 9) for r in two) == [-1, 1] and {r.explained for r in two} == {1.0}
    big = wh.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 4.0])])).collect()
    assert len(big) >= 3 and all(np.isfinite(r.whitened) for r in big)
    # Products too large for doubles and longs stay exact.
    y = np.array([[1 << 40, -3], [5, 1 << 39]])
    assert (wh.exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def top_brute(rows, every, k):
    v = sorted({(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in r)) for i, r in rows
                if i is not None and r is not None and len(r) == 4 and all(c is not None and np.isfinite(c) for c in r)})
    out = []
    for i, q in v:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, z)), j) for j, z in v if j != i)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out)


def answers(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_top_k_against_brute_force(spark, monkeypatch):
    rows = made(300, seed=4) + [(1000 + i, [1.0, 0.5, 0.0, 0.0]) for i in range(120)]  # one vector of many ids
    rows += [(2000 + i, [0.0, 0.0, 1.0, float(i % 2)]) for i in range(30)] + [(3000 + i, v) for i, v in enumerate(ODD)]
    rows += [(None, [9.0, 9.0, 9.0, 9.0]), rows[10], rows[10], (20, [50.0, 0.0, 0.0, -700.0])]
    monkeypatch.setattr(tk, "TILE", 7)
    monkeypatch.setattr(tk, "ROWS", 50)
    monkeypatch.setattr(tk, "QUERIES", 16)  # several scans
    df = table(spark, rows).repartition(5)
    assert answers(tk.top_k(df, F.col("vec_id") % 10 == 0)) == top_brute(rows, 10, 5)


def test_top_k_edges(spark):
    all_ = F.col("vec_id") % 1 == 0
    assert tk.top_k(table(spark, []), all_).count() == 0
    assert tk.top_k(table(spark, [(1, None), (2, [])]), all_).count() == 0
    assert answers(tk.top_k(table(spark, [(5, [1.0])]), all_)) == []
    few = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-1.0, 0.0])]
    assert [a[1:] for a in answers(tk.top_k(table(spark, few), F.col("vec_id") == 1))] == [(1, 2, 32768), (2, 3, 32768), (3, 4, -65536)]
    assert tk.top_k(table(spark, few), F.col("vec_id") == 99).count() == 0
    # Far values: sums that doubles cannot hold.
    far = [(1, [1e11, 3.0]), (2, [-1e11, 1.0]), (3, [1e11, 5.0]), (4, [1e11, 4.0])]
    assert [a[2] for a in answers(tk.top_k(table(spark, far), F.col("vec_id") == 1))] == [3, 4, 2]


def test_cells_bound_every_entry():
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.integers(-200, 200, (500, 6)), rng.integers(-5, 5, (100, 6)) * 10_000])
    cells = tk.Cells.fit(z[:80], z.min(axis=0), z.max(axis=0), 16)
    c = cells.of(z)
    d = np.arange(6)
    assert ((cells.low[d, c] <= z) & (z <= cells.high[d, c])).all() and c.max() <= 15


def variants_brute(docs, least=6, often=5, times=5, every=199):
    n = Counter()
    for i, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{i if i is not None else ''}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= least:
                n[w] += 1
    words = sorted(w for w in n if n[w] >= often)

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    close = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-n[v], v)) for w in words}
    form = {w: close[w][0] if close[w] and n[close[w][0]] >= times * n[w] else None for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else -1) for w in words)


def test_spelling_variants_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = ["señales", "straßen", "ÀÉÎõüÿ", "banana", "banane", "bananas", "prefixes", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdefgh", "short"]
    words = base + [w[:k] + rng.choice("abñß") + w[k + rng.randrange(2):] for w in base for k in range(len(w))]
    docs = []
    for i in range(260):
        pick = [w for w in rng.choices(words, [60 if k < len(base) else 1.2 for k in range(len(words))], k=40)]
        docs.append((i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in pick)))
    docs += [(None, "banana " * 30), (3, None), (4, ""), (5, docs[5][1]), (6, "x" * 70_000 + " ")] + [(7000 + i, "y" * 70_000) for i in range(6)]
    docs.append((8000, " ".join("y" * 69_999 for _ in range(50))))
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, word string, n int")
    want = variants_brute(docs)
    for every, block in ((199, 512), (199, 8), (7, 512)):
        monkeypatch.setattr(sp, "BLOCK", block)  # many tiles
        got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n)
                     for r in sp.spelling_variants(df.repartition(4), drop_every=every).collect())
        assert got == (want if every == 199 else variants_brute(docs, every=every))
    assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1]) is not None
    assert sp.spelling_variants(df.limit(0)).count() == 0


def test_one_edit_of_all_short_words():
    import itertools

    words = {k: ["".join(p) for p in itertools.product("ab", repeat=k)] for k in (2, 3, 4)}
    for m, k in ((3, 3), (2, 3), (3, 4)):
        a, b = (sp._points(words[x], x) for x in (m, k))
        got = sp.one_edit(a, b)
        for i, x in enumerate(words[m]):
            for j, y in enumerate(words[k]):
                edits = {y[:c] + z + y[c + 1:] for c in range(k) for z in "ab"} - {y} if m == k else {y[:c] + y[c + 1:] for c in range(k)}
                assert got[i, j] == (x in edits), (x, y)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("z", "w30")], "word string, form string")
    assert {r.root for r in sp.roots(forms).collect()} == {"w37"} and sp.roots(forms.limit(0)).count() == 0
