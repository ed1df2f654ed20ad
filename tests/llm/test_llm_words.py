"""Quality rules, decontamination, near-duplicates and repeats against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import near_duplicates as nd
from tidemark.llm import quality as q
from tidemark.llm import repeats as rp
from tidemark.llm.decontaminate import contaminated, decontaminate, find_matches
from tidemark.llm.graph import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t ", "é", "x" * 3000, "a b " * 3000, "\n\n\n", "Ünï ﬁ 中文 👍 0"]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(rng, n, words=60, vocabulary=40):
    base = [f"w{i}" for i in range(vocabulary)] + ["É", "ab,", "X"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(base) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(words))))
        if rng.random() < 0.4 and len(out) > 1:
            w = rng.choice(out[:-1]).split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(base)
            out.append(" ".join(w))
    return out


def frame(spark, rows, schema="doc_id long, text string, lang string, n_words string"):
    """Documents with nulls and a column whose name an operator uses itself."""
    return spark.createDataFrame([(i, t, random.Random(i or 0).choice(["en", None]), "clash") for i, t in rows], schema)


def measured(t):
    t = t or ""
    w = SPACE.findall(t)
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(k for i in places for k in range(i, i + 8))
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(1)
    rows = list(enumerate(ODD + texts(rng, 60, 50, 3) + ["# a|b\n" * 5, "x y\nx y\n\nx y"])) + [(None, "a b c"), (3, "again")]
    got = q.measures(frame(spark, rows).drop("n_words")).collect()
    want = [(i, *measured(t)) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got)


def test_cutoffs_hold_their_risk_and_catch_bad(spark):
    good = np.zeros(q.GRID + 1, int)
    bad = np.zeros(q.GRID + 1, int)
    good[[5, 20]], bad[[6, 40]] = [9980, 20], [10, 50]
    assert q.select_cutoff(good, bad, 0.01, 1e-4) == 6  # 20 of 10,000 is surely under 1 %
    assert q.select_cutoff(good, bad, 0.002, 1e-4) == 21  # but not surely under 0.2 %
    assert q.select_cutoff(good // 100, bad, 0.01, 1e-4) is None  # too few labels to tell
    exact = sum(__import__("math").comb(30, i) * 0.2 ** i * 0.8 ** (30 - i) for i in range(4))
    assert q.binomial_tail(3, 30, 0.2) == pytest.approx(exact)


def test_quality_rules_end_to_end(spark):
    clean = [(i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(1500)]
    junk = [(2000 + i, " ".join(f"u{i}y{k} ####" for k in range(40))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in clean + junk + [(None, None), (5000, "short")]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in clean] + [(i, 0) for i, _ in junk[:150]] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.quality_rules(docs, labels, limit=0.05).collect()}
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk)
    assert got[5000].base_failed and not got[5000].kept and got[None].base_failed
    kept = q.keep_good(docs.withColumnRenamed("lang", "n_words"), labels, stratum="n_words", limit=0.05)
    assert kept.columns == ["doc_id", "text", "n_words"] and kept.count() == len(clean)
    assert q.quality_rules(docs.limit(0), labels).count() == 0
    assert q.quality_rules(docs, labels.limit(0)).where("kept").count() == len(clean) + len(junk)


def test_quality_rules_reject_with_few_labels_and_production_limits(spark):
    """500 good labels a language, four languages, limit and risk as in production."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    rows, marks = [], []
    for lang, n in [("a", 500), ("b", 500), ("c", 500), ("d", 60)]:
        for i in range(n + 40):
            junk = i >= n
            w = [word() for _ in range(rng.randrange(30, 90))]
            rows.append((len(rows), " ".join(w + ["####"] * rng.randrange(3, 8) * junk), lang))
            marks.append((len(rows) - 1, int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in q.quality_rules(docs, labels).collect()}
    good = dict(marks)
    assert all(got[i] for i, _, lang in rows if good[i])
    assert not any(got[i] for i, _, lang in rows if not good[i] and lang != "d")
    assert all(got[i] for i, _, lang in rows if lang == "d")  # too few labels


def test_union_of_rules_stays_within_the_limit():
    """The walk stops where all rules together would lose too much; its order spares the guide."""
    bad, guide = np.array([[9, 0], [5, 0], [0, 7]]), np.array([[0, 8], [0, 0]])
    steps = q.walk(bad, np.array([1, 2, 9]), guide, np.array([1, 9]))
    assert steps == [(0, 9), (0, 5), (1, 7)]
    good = np.array([[0, 0], [6, 0], [0, 8]])
    assert q.along(steps, good, np.array([2000, 4, 40])).tolist() == [2000, 40, 4, 0]
    cut = q.select_cutoff(q.along(steps, good, np.array([2000, 4, 40])), q.along(steps, bad, np.array([1, 2, 9])), 0.01, 0.05)
    assert steps[:len(steps) - cut + 1] == [(0, 9), (0, 5)]
    assert q.shares([461, 459, 1900, 305], 0.01, 0.05) == 3 and q.shares([], 0.01, 0.05) == 1


def matched(docs, items):
    out = {}
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a:a + k]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in wins}
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in wins:
                    hit.update(range(a, a + k))
                    ids |= wins[tuple(w[a:a + k])]
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(2)
    pool = texts(rng, 30, 70, 300)
    items = [(i, t) for i, t in enumerate(pool[:12])] + [(50, "w1 w2"), (51, "É"), (None, "w3 w4 w5"), (60, None), (61, "..."), (9, pool[0])]
    docs = [(i, t) for i, t in enumerate(ODD + pool + [pool[0] + pool[1], "x " + pool[2].upper(), "w1,w2;w3 w4 w5"])]
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_matches(d, b, block_chars=block).collect()}
    assert got == matched(docs, items)
    row = [r for r in find_matches(d, b, block_chars=block).collect() if r.n_hit]
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and r.longest_match >= 1 for r in row)
    kept = decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {i for i, (n, h, _) in matched(docs, items).items() if h and 20 * h >= n}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - bad
    assert find_matches(d, b.limit(0)).where("n_hit > 0").count() == 0 and find_matches(d.limit(0), b).count() == 0


def shingles(t):
    w = SPACE.findall(low(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def grouped(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(i), root(j)
                up[max(r, s)] = min(r, s)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


@pytest.mark.parametrize("tile", [4096, 7])
def test_near_duplicates_match_brute_force(spark, monkeypatch, tile):
    """Chains, copies, edits around the limit; small tiles must find the same links."""
    monkeypatch.setattr(nd, "TILE", tile)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    rows = [*ODD, "a b", "A  b", "a b c d e"]
    for g in range(4):
        w = [rng.choice(base) for _ in range(rng.choice([30, 120]))]
        for _ in range(25):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = rng.choice(base)
            w = v if rng.random() < 0.3 else w
            rows.append(" ".join(v))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == grouped(rows)


def test_near_duplicates_odd_rows(spark):
    d = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None), (9, "a b"), (9, "c d")])
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in nd.near_duplicates(d).collect()), key=str)
    assert got == [("3", 3, True), ("5", 3, False), ("5", 3, False), ("9", 9, True), ("9", 9, True), ("None", 3, False), ("None", None, True)]
    kept = nd.deduplicate(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "9", "None"]
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_pipeline_reduces_pairs_from_80_percent(spark):
    import corpus_pipeline as cp

    base = lambda g, n: " ".join(f"p{g}x{k}" for k in range(n))
    rows = [(g * 10 + i, base(g, n)) for g in range(20) for i, n in enumerate((100, 121))]  # 96 of 117 shingles: 0.82
    rows += [(1000, base("z", 100)), (1001, base("z", 126))]  # 96 of 122: below
    kept = {r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == {g * 10 for g in range(20)} | {1000, 1001}
    assert nd.deduplicate(frame(spark, rows)).count() == len(rows)  # op3's limit stays


def test_register_estimates_are_close():
    rng = np.random.default_rng(4)
    for jaccard in (0.5, 0.85):
        err = []
        for n in (20, 300, 5000):
            for _ in range(8):
                both = int(round(2 * n * jaccard / (1 + jaccard)))
                x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
                a, b = x[:n], x[n - both:]
                r = nd.sketches(np.concatenate([a, b]), np.array([0, n, n + len(b)]))
                err.append(float(nd.estimate(np.array([(r[0] == r[1]).mean()]), n)[0]) - both / len(x))
        assert abs(np.mean(err)) < 0.02 and np.max(np.abs(err)) < 0.12


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(50)] + [(2000, 2000), (1049, 1050)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(51)} == {1000} and 2000 not in got


def removed(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, raw):
        f = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                f[k:k + length] = [True] * length
        spans = sum(x and (not k or not f[k - 1]) for k, x in enumerate(f))
        kept = bytes(x for x, y in zip(b, f) if not y)
        out.append((str(i), len(b), sum(f), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("together", [rp.TOGETHER, 1])
def test_repeats_match_brute_force(spark, monkeypatch, together):
    """Shared passages, self-repeats, periodic text, copies, edits; also by the counting path."""
    monkeypatch.setattr(rp, "TOGETHER", together)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, other = word(300), word(150)
    rows = list(ODD) + [word(200) + passage + word(90) for _ in range(4)] + [passage[:140] + other + passage[20:], other + other, "ab" * 200, "z" * 500]
    for _ in range(6):
        edited = list(passage + other)
        edited[rng.randrange(len(edited))] = "#"
        rows.append("".join(edited))
    rows = list(enumerate(rows)) + [(100, passage), (100, passage), (None, other), (None, None)]
    got = rp.remove_repeats(frame(spark, rows), length=100, gram=16).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows, 100)
    assert rp.remove_repeats(frame(spark, rows).limit(0), length=100, gram=16).count() == 0


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    """All windows of a core under one hash: the bytes decide, as with good hashes."""
    rng = random.Random(11)
    core = "the core of them all".encode()
    bits = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(4)]
    parts = [rng.choice(bits) + core + rng.choice(bits) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data, at, first = np.frombuffer(b"".join(parts), np.uint8), np.full(40, 12), np.array([0, 25, 40])
    good = {tuple(map(int, x)) for x in zip(*rp.repeated_windows(data, offsets, at, first, 30))}
    made = []

    class Weak(rp.PrefixHash):
        def of(self, start, end):
            return np.zeros(len(start), np.uint64)

    plain = rp.PrefixHash
    monkeypatch.setattr(rp, "PrefixHash", lambda x: made.append(1) or (Weak if len(made) == 3 else plain)(x))
    found = {tuple(map(int, x)) for x in zip(*rp.repeated_windows(data, offsets, at, first, 30))}
    seen = {}
    for c, p in enumerate(parts):
        for i in range(len(p) - 30 + 1):
            seen.setdefault((c >= 25, p[i:i + 30]), []).append((c, i))
    twice = {x for v in seen.values() if len(v) > 1 for x in v}
    around = {(c, i) for c, i in twice if i <= 12 and i + 30 >= 12 + len(core)}  # a core's windows hold it whole
    assert found == good and around <= found <= twice and len(made) == 3


def test_suffix_mergesort_orders_like_sorting():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.sort(rng.choice(380, 90, replace=False))
    end = np.minimum(start + rng.integers(1, 60, 90), 400)
    s = rp.Suffixes(data, start, end)
    first = np.array([0, 1, 40, 40, 90])
    order = s.sorted_within(first)
    raw = [data[a:b].tobytes() for a, b in zip(start, end)]
    for a, b in zip(first, first[1:]):
        assert [raw[i] for i in order[a:b]] == sorted(raw[a:b])


def test_contaminated_is_a_twentieth():
    assert contaminated(np.array([1, 1, 0]), np.array([20, 21, 0])).tolist() == [True, False, False]
