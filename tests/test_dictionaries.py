"""Dictionaries against a plain search of every entry at every token."""

import random
import time
from fnmatch import fnmatchcase

from corpusloom.operators import dictionaries


def _plain(tokens, dictionary):
    found = set()
    for k, key in enumerate(dictionary):
        for entry in dictionary[key]:
            words = entry.split()
            for i in range(len(tokens) - len(words) + 1):
                if words and all(fnmatchcase(t, w) for t, w in zip(tokens[i:], words, strict=False)):
                    found.add((i, i + len(words), k))
    return sorted(m for m in found if not any(a <= m[0] and m[1] <= b and b - a > m[1] - m[0] for a, b, _ in found))


def test_automaton_against_plain_search():
    rng = random.Random(4)
    words = ["a", "ab", "abc", "b", "ba", "not", "good", "goods", "never", "x"]
    globs = ["a*", "*b", "g??d*", "*", "n*t", "good*"]
    for _ in range(150):
        entries = {k: [" ".join(rng.choice(words + globs * (k == "two")) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(rng.randrange(1, 6))] for k in ("one", "two", "three")}
        tokens = [rng.choice(words) for _ in range(rng.randrange(0, 14))]
        assert dictionaries.Automaton(entries).scan(tokens) == _plain(tokens, entries), (entries, tokens)


def test_many_entries_cost_no_more():
    rng = random.Random(1)
    tokens = [f"w{rng.randrange(20_000)}" for _ in range(40_000)]
    few = {"k": [f"w{i} w{i + 1}" for i in range(10)]}
    many = {"k": [f"w{i} w{i + 1}" for i in range(5_000)] + [f"w{i}x*" for i in range(5_000)]}

    def seconds(dictionary):
        a, best = dictionaries.Automaton(dictionary), 9e9
        for _ in range(3):
            began = time.perf_counter()
            a.scan(tokens)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(many) < 6 * seconds(few)


def test_counts_and_tone(spark):
    rows = [(1, ["not", "good", "at", "all"]), (2, ["good", None, "bad"]), (3, []), (4, None), (5, ["never", "a", "bad", "thing"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    held = {"positive": ["good"], "negative": ["bad"], "neg_positive": ["not good"], "neg_negative": ["never * bad"]}
    got = {r.id: tuple(r.k) for r in df.select("id", dictionaries.counts(df.t, held).alias("k")).collect()}
    assert got == {1: (0, 0, 1, 0), 2: (1, 1, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 1)}
    tone = {r.id: (r.x.pos, r.x.neg, r.x.label) for r in df.select("id", dictionaries.tone(df.t, held).alias("x")).collect()}
    assert tone[1] == (0, 1, "distrust") and tone[5] == (1, 0, "trust") and tone[2][2] == "non_evaluative"


def test_plain_tokens(spark):
    text = "See https://a.b/c?d=1 or www.x.org, it's 42 well-known: 3D C++ €5 naïve!"
    df = spark.createDataFrame([(text,), (None,), ("",)], "x string")
    got = [r.t for r in df.select(dictionaries.plain_tokens(df.x).alias("t")).collect()]
    assert got == [["see", "or", "it's", "well-known", "3d", "c", "naïve"], None, []]
    assert "42" in df.select(dictionaries.plain_tokens(df.x, numbers=True).alias("t")).first().t
