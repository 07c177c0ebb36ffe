import random

import numpy as np

from regispark.llm import revisions as rv


def table(spark, rows):
    return spark.createDataFrame(rows, "field string, id bigint, text string")


def brute(rows, least=1):
    sets = {(f, i): set(rv._WORD.findall(t.lower())) for f, i, t in rows if t}
    out = set()
    for (f, a), x in sets.items():
        for (g, b), y in sets.items():
            if f == g and a < b and min(len(x), len(y)) >= least and 5 * len(x & y) >= 3 * len(x | y):
                out.add((f, a, b))
    return out


def corpus():
    rnd = random.Random(5)
    words = [f"sõna{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(60):
        base = rnd.sample(words, rnd.randint(10, 40))
        for _ in range(rnd.randint(1, 4)):
            edited = [w if rnd.random() > 0.12 else rnd.choice(words) for w in base]
            rnd.shuffle(edited)
            rows.append(("contents" if i % 3 else "title", i, " ".join(edited)))
            i += 1
    return rows


def test_pairs_are_brute_force(spark):
    rows = corpus() + [("title", 900, None), ("title", 901, ""), ("title", 902, "... !"), ("title", 903, "A b C"), ("title", 904, "c, a, B!"), ("title", 905, "a b c"), ("contents", 903, "a b c")]
    got = {tuple(r) for r in rv.revision_pairs(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert ("title", 903, 904) in got and ("title", 903, 903) not in got


def test_least_words(spark):
    assert rv.revision_pairs(table(spark, [("t", 1, "a b"), ("t", 2, "a b"), ("t", 3, "a b c"), ("t", 4, "a b c")]), 3).collect() == [("t", 3, 4)]


def test_groups(spark):
    rows = [("t", 1, "a b c d e f"), ("t", 2, "a b c d e g"), ("t", 3, "a b c d e g h"), ("t", 4, "x y z"), ("t", 5, "x y z"), ("t", 6, None)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in rv.revision_groups(table(spark, rows)).collect()}
    assert got[4] == got[5] == (4, 0) and got[1][0] == got[2][0] == got[3][0] == 1 and 6 not in got


def test_odd_tables(spark):
    assert rv.revision_pairs(table(spark, [])).count() == 0 and rv.revision_groups(table(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(30_000))
    clash = table(spark, [("t", 1, long), ("t", 2, long + " more"), ("t", None, long), ("t", 1, long)]).selectExpr("*", "'b' band", "1 k1", "'w' words")
    assert [tuple(r) for r in rv.revision_pairs(clash).collect()] == [("t", 1, 2)]


def templates(n=200, shared=15, own=5, levels=(0, 3, 5, 7)):
    """Pairs that agree in words half of all texts hold and differ in words of their own."""
    rnd = random.Random(7)
    pool, rows, i = [f"tavaline{k}" for k in range(40)], [], 0
    for k in range(n):
        base = rnd.sample(pool, shared)
        same = [f"ühine{k}x{j}" for j in range(levels[k % len(levels)])]
        for side in "ab":
            rows.append(("title", i, " ".join(base + same + [f"oma{side}{k}x{j}" for j in range(own)])))
            i += 1
    return rows


def test_pairs_that_share_frequent_words_only(spark):
    rows = templates()
    want = brute(rows)
    assert sum((f, 2 * k, 2 * k + 1) in want for f in ["title"] for k in range(200)) == 200
    exact = {tuple(r) for r in rv.revision_pairs(table(spark, rows), exact=True).collect()}
    assert exact == want
    got = {tuple(r) for r in rv.revision_pairs(table(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    assert sum(("title", 2 * k, 2 * k + 1) in got for k in range(0, 200, 4)) >= 49


def test_mixed_corpus_with_everything_rare_or_frequent(spark, monkeypatch):
    rows = corpus() + [(f, 5000 + i, t) for f, i, t in templates(40)]
    want = brute(rows)
    for few in (2, 64, 10**6):
        monkeypatch.setattr(rv, "FEW", few)
        got = {tuple(r) for r in rv.revision_pairs(table(spark, rows)).collect()}
        assert got <= want and len(got) >= 0.99 * len(want)
        assert {tuple(r) for r in rv.revision_pairs(table(spark, rows), exact=True).collect()} == want


def test_bags_count_repeats(spark):
    rows = [("t", 1, "a a a a b c"), ("t", 2, "a b c d"), ("t", 3, "a a a a b d"), ("t", 4, "c a b a a a")]
    assert {tuple(r)[1:] for r in rv.revision_pairs(table(spark, rows), counted=True).collect()} == {(1, 3), (1, 4), (3, 4)}
    assert (1, 2) in {tuple(r)[1:] for r in rv.revision_pairs(table(spark, rows)).collect()}


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([("t", w, 100 + w) for w in range(1000)], "field string, w bigint, df bigint")
    assert len(rv.frequent_words(counts, {"t": 2000})) == 1000
    assert 0 < len(rv.frequent_words(counts, {"t": 2000}, most=600)) <= 600


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(1)
    words = rnd.integers(1, 2**63, 80, dtype=np.uint64)
    for most in (1, 9):
        wa, wb = rnd.integers(1, most + 1, 80), rnd.integers(1, most + 1, 80)
        wa[60:], wb[:20] = 0, 0
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        n = 4000
        a, b = rv.signatures([(words[wa > 0], wa[wa > 0]), (words[wb > 0], wb[wb > 0])], n)
        assert np.isfinite(a).all() and abs(float((a == b).mean()) - true) < 4 * (true * (1 - true) / n) ** 0.5
    # A signature does not depend on its neighbours in a batch, nor on how far points were drawn.
    alone = rv.signatures([(words[:3], np.ones(3, dtype=np.int64))], 64)[0]
    assert (rv.signatures([(words, np.ones(80, dtype=np.int64)), (words[:3], np.ones(3, dtype=np.int64)), (words[:1], np.full(1, 500))], 64)[1] == alone).all()


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(-(2**62), 2**62, 90), rnd.integers(-(2**62), 2**62, 30)
    x, y = rv.sketch(a), rv.sketch(np.concatenate([a[:70], b]))
    assert sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y)) <= 50
