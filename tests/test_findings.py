"""Whole work and equal rows where a review found otherwise."""

import random
import time
from difflib import SequenceMatcher

from paperloom.operators import matching, scores, stories


def test_categories_read_whole_texts(spark):
    docs = spark.createDataFrame([(1, "", "x " * 2000 + "hospitals clinics doctors doctors"), (2, "Nothing here", "x " * 2000)], "id int, title string, text string")
    words = spark.createDataFrame([(0, "Sport", "runners"), (1, "Health", "hospitals"), (1, "Health", "clinics"), (1, "Health", "doctors")], "place int, category string, word string")
    assert [tuple(r) for r in scores.categories(docs, "id", "title", "text", words).collect()] == [(1, "Health", 2.0)]


def test_categories_send_no_texts(spark):
    docs = spark.createDataFrame([(1, "Rail tickets", "rail fares"), (2, "Clinics and clinics", "rail")], "id int, title string, text string")
    words = spark.createDataFrame([(0, "Transport", "rail tickets"), (1, "Health", "clinics")], "place int, category string, word string")
    df = scores.categories(docs, "id", "title", "text", words)
    assert sorted(map(tuple, df.collect())) == [(1, "Transport", 3.0), (2, "Health", 3.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_leader_clusters_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), [f"w{int(rng.random() ** 2 * 25)}" for _ in range(rng.randrange(8))]) for i in range(900)]
    want, leaders = {}, {"a": [], "b": []}
    for i, block, ws in rows:
        mine = set(ws)
        alike = lambda o: len(mine & o) / len(mine | o) >= 0.55 or (len(mine & o) >= 3 and len(mine & o) / min(len(mine), len(o)) >= 0.75)  # noqa: B023, E731
        want[i] = next((k for k, o in leaders[block] if mine and o and alike(o)), i)
        if want[i] == i:
            leaders[block].append((i, mine))
    assert dict(stories.leader_clusters(spark.createDataFrame(rows, "id long, block string, words array<string>"), "block", "id", "words", "id").collect()) == want


def test_leader_clusters_of_common_words(spark):
    """Headlines that share their frequent words only aren't all held against each other."""
    rows = [(i, "a", ["plan", "city", "vote", *(f"n{i}x{j}" for j in range(5))]) for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>").cache()
    df.count()
    began = time.perf_counter()
    assert all(r.id == r.leader for r in stories.leader_clusters(df, "block", "id", "words", "id").collect())
    assert time.perf_counter() - began < 30


def test_near_titles_in_many_looks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "_FIRST_LOOK", 6)
    rng = random.Random(8)
    vocabulary = [f"{c}{i}" for i in range(40) for c in ("storage", "plan", "Ostfalk", "9")]
    make = lambda: " ".join(vocabulary[int(rng.random() ** 2 * len(vocabulary))] for _ in range(rng.randrange(1, 9)))
    old, new = [(i, make()) for i in range(150)], [(i, make()) for i in range(120)]
    kw = lambda t: set(t.lower().split())

    def likeness(x, y):
        a, b = kw(x), kw(y)
        j = len(a & b) / len(a | b)
        likeness = max(j, 0.85 * (len(a & b) / min(len(a), len(b))))
        ratio = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio()
        return max(likeness, 0.9 * ratio) if j > 0.25 and likeness < 0.9 else likeness

    n, o = spark.createDataFrame(new, "k int, title string"), spark.createDataFrame(old, "o int, title string")
    for least, best in ((0.6, False), (0.25, True), (0.88, False)):
        want = {}
        for k, x in new:
            found = [(y, round(like, 9)) for y, t in old if (like := likeness(x, t)) >= least]
            if found:
                want[k] = max(found, key=lambda f: (f[1], -f[0])) if best else found[0]
        got = {r.k: (r.other, round(r.likeness, 9)) for r in matching.near_titles(n, o, "k", "title", "o", least, best).collect()}
        assert got == want and want


def test_near_titles_of_common_words(spark):
    """Headlines that share too few of their words, however frequent, aren't compared."""
    make = lambda s: [(i, "city plan vote storage " + " ".join(f"{s}{i}x{j}" for j in range(8))) for i in range(2500)]
    n, o = spark.createDataFrame(make("new"), "k int, title string").cache(), spark.createDataFrame(make("old"), "o int, title string").cache()
    n.count(), o.count()
    began = time.perf_counter()
    assert matching.near_titles(n, o, "k", "title", "o").count() == 0
    assert time.perf_counter() - began < 40


def test_best_titles_of_common_words(spark):
    """Headlines that have their like aren't held against all that share frequent words."""
    rows = [(i, "city plan vote storage " + " ".join(f"n{i}x{j}" for j in range(4))) for i in range(4000)]
    n, o = spark.createDataFrame(rows, "k int, title string").cache(), spark.createDataFrame(rows, "o int, title string").cache()
    n.count(), o.count()
    began = time.perf_counter()
    assert all(r.k == r.other for r in matching.best_match(n, o, "k", "title", "o").collect())
    assert time.perf_counter() - began < 40
