import random

import pytest

from regispark.llm import mixing, packing
from regispark.llm.tokens import token_count


def test_token_counts_are_those_of_the_tokenizer(spark):
    import base64

    import tiktoken

    from regispark.llm.tokens import PATTERN, TOKENIZER

    with open(TOKENIZER, "rb") as f:
        e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = ["Tere, maailm!", "", None, "проверка  kahe\n\n tühikuga", "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["n"] for r in df.select(token_count(df, "text").alias("n")).collect()] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def test_completion_is_best():
    rnd = random.Random(3)
    for _ in range(60):
        left = {s: rnd.randint(1, 3) for s in rnd.sample(range(1, 40), 6)}
        room, best = rnd.randint(5, 90), {0}
        for s, n in left.items():
            best |= {t + k * s for t in best for k in range(n + 1) if t + k * s <= room}
        got = packing.best_completion(room, sorted(left), left)
        assert sum(got) == max(best) and all(got.count(s) <= left[s] for s in got)


def test_search_is_bounded_but_not_its_depth():
    """1599 sizes and a room of 1.2 million: no recursion; and a search cut short still gives an undominated filling."""
    sizes = list(range(1, 1600))
    got = packing.best_completion(1_200_000, sizes, dict.fromkeys(sizes, 1))
    assert sum(got) == 1_200_000 and len(set(got)) == len(got)
    rnd = random.Random(8)
    left = {s: 1 for s in rnd.sample(range(100, 10_000, 7), 300)}
    for most in (1, 50, None):
        got = packing.best_completion(9_999, sorted(left), left, most)
        waste = 9_999 - sum(got)
        assert waste >= 0 and not any(s < x <= s + waste for s in got for x in left if x not in got)


def test_least_containers():
    assert packing.least_containers({6: 4}, 10) == 4 and packing.least_containers({5: 4}, 10) == 2 and packing.least_containers({}, 10) == 0
    rnd = random.Random(4)
    for _ in range(40):
        hist = {rnd.randint(1, 20): rnd.randint(1, 9) for _ in range(8)}
        assert packing.least_containers(hist, 20) <= sum(t for t, _ in packing.plan_containers(hist, 20))


def test_plan_takes_everything():
    hist = {1: 5, 3: 10, 7: 4, 8: 2, 10: 1, 11: 3}
    plan = packing.plan_containers(hist, 10)
    used = {}
    for times, items in plan:
        assert sum(items) <= 10
        for s in items:
            used[s] = used.get(s, 0) + times
    assert used == {s: n for s, n in hist.items() if s <= 10} and packing.plan_containers({}, 10) == []


def test_containers(spark):
    rnd = random.Random(1)
    docs = [(i, rnd.choice([0, 3, 9, 10, 17, 40, 120])) for i in range(500)] + [(7, 9), (7, 9), (None, 4)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id bigint, n bigint, rest string, spec_id int")
    out = packing.pack(df, "doc_id", "n", {1: 50, 2: 16, 3: None, 4: 0}).collect()
    for spec, cap in ((1, 50), (2, 16)):
        mine = [r for r in out if r["spec_id"] == spec]
        fill, size = {}, {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            size.setdefault(r["id"], []).append(r["tokens"])
        assert max(fill.values()) <= cap and sorted(fill) == list(range(1, len(fill) + 1))
        assert sum(fill.values()) == sum(n for _, n in docs)
        whole = {i: n for i, n in docs if i is not None and i != 7}
        assert all(sum(size[i]) == n and (len(size[i]) == 1 or n > cap) for i, n in whole.items() if n)
        assert len(fill) <= -(-sum(fill.values()) // cap) * 1.05 + 1
    assert {r["spec_id"] for r in out} == {1, 2}
    assert packing.pack(df.limit(0), "doc_id", "n", {1: 50}).count() == 0 and packing.pack(df, "doc_id", "n", {}).count() == 0


def test_mixture(spark):
    docs = [(i, s, 10) for i, s in enumerate(["A"] * 600 + ["b "] * 300 + ["c"] * 10 + [None] * 5 + ["other"] * 5)] + [(5000, "a", 0), (None, "a", 10)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id bigint, source string, n bigint, finish string")
    targets = mixing.targets_of(spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 2), (None, 0.5, 1), ("a", 0.2, 9), ("z", None, 1)], "source string, target_share double, max_repeats int"))
    assert set(targets) == {"a", "b", "c", "none"} and targets["a"] == (0.5, 1)
    m = mixing.mix(df, "id", "source", "n", targets)
    rows = m.collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    taken = {}
    for r in rows:
        taken[r["id"]] = taken.get(r["id"], 0) + 1
    most = {i: targets[s.strip().lower()][1] for i, s, _ in docs if s and s.strip().lower() in targets and i is not None}
    assert all(n <= most[i] for i, n in taken.items()) and 5000 not in taken
    got = {r["source"]: r["actual_share"] for r in mixing.shares(m, targets).collect()}
    assert got["none"] == 0 and abs(got["a"] / got["b"] - 5 / 3) < 0.15 and sum(got.values()) == pytest.approx(1)
    large = mixing.mix(df, "id", "source", "n", targets, budget=3000)
    assert abs(sum(r["tokens"] for r in large.collect()) - 3000) <= 30
    assert set(taken) <= {r["id"] for r in large.collect()}
    assert mixing.mix(df.limit(0), "id", "source", "n", targets).count() == 0


def test_cut_time():
    held, once, half = {"a": 100, "b": 10}, {"a": 1, "b": 1}, {"a": 0.5, "b": 0.5}
    assert mixing.full_budget(held, once, half) == 20 and mixing.cut_time(held, once, half, 20) == 20
    assert mixing.cut_time(held, once, half, 60) == 100 and mixing.cut_time(held, once, half, 10**9) == 200


def test_shares_are_met_unless_a_source_runs_dry(spark):
    rnd = random.Random(9)
    docs = [(i, s, rnd.randint(1, 60)) for i, s in enumerate(["a"] * 4000 + ["b"] * 2000 + ["c"] * 100)]
    df = spark.createDataFrame(docs, "id bigint, source string, n bigint")
    targets = {"a": (0.6, 1), "b": (0.3, 2), "c": (0.1, 3)}
    for r in mixing.shares(mixing.mix(df, "id", "source", "n", targets), targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.005
    held = sum(n for *_, n in docs)
    large = {r["source"]: r for r in mixing.shares(mixing.mix(df, "id", "source", "n", targets, held), targets).collect()}
    assert large["c"]["most_copies"] == 3 and large["c"]["actual_share"] < 0.06 and abs(large["a"]["actual_share"] / large["b"]["actual_share"] - 2) < 0.1
    assert sum(r["n_tokens"] for r in large.values()) <= held
