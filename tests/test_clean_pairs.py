"""Pairs of near copies and of alike names against all pairs."""

import random
import re

from pyspark.sql import functions as F

from tideframe.operators import clean


def _words(text):
    return re.sub(r"[^\w\s]", " ", text.lower()).split()


def _shingles(text, n=3):
    w = _words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1)))


def test_near_duplicates_are_all_links_between_classes(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(30):  # versions of one text: they meet in buckets of many, and only some are alike
        t = list(base)
        for at in rng.sample(range(60), rng.randint(0, 4)):
            t[at] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(t))
    texts += texts[:6]
    df = spark.createDataFrame([*enumerate(texts), (100, None)], "id long, t string")
    got = {(r.a, r.b): r.jaccard for r in clean.near_duplicates(df, "id", "t", 0.8, bands=256, rows=1).collect()}
    sets = [_shingles(t) for t in texts]
    first = [sets.index(s) for s in sets]
    want = {(first[i], i): 1.0 for i in range(len(sets)) if first[i] < i}
    for b in set(first):
        for a in set(first):
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8:
                want[a, b] = j
    assert got == want and len(want) > 30


def test_bands_have_seeds_of_their_own(spark):
    df = spark.createDataFrame([(["a b c", "d e f", "g h i"], ["g h i", "a b c", "d e f"])], "s array<string>, t array<string>")
    one = df.select(*[clean.minhash_bands(F.col(c), 1, 1, seed).alias(f"{c}{seed}") for c in "st" for seed in range(8)]).first()
    assert all(one[f"s{i}"] == one[f"t{i}"] for i in range(8)) and len({one[f"s{i}"][0] for i in range(8)}) == 8


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_alike_names_are_all_pairs_of_a_block(spark):
    rng = random.Random(8)
    words = ["acme", "holding", "holdings", "group", "the", "north", "norths", "trade", "traders", "int"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    names += [n[:i] + rng.choice("abc") + n[i + 1 :] for n in names[:60] for i in [rng.randrange(len(n))]] + ["ACME  Holding!", "acme holding", None, ""]
    df = spark.createDataFrame([*enumerate(names), (None, "acme")], "id long, n string")
    norm = [None if n is None else " ".join(_words(n)) for n in names]
    for threshold in (0.7, 0.85, 1.0):
        want = {}
        first = {n: norm.index(n) for n in norm if n is not None}
        for i, n in enumerate(norm):
            if n is not None and first[n] < i:
                want[first[n], i] = 1.0
        for a, i in first.items():
            for b, j in first.items():
                if i < j and {w[:3] for w in a.split(" ")} & {w[:3] for w in b.split(" ")}:
                    x, y = set(a.split(" ")), set(b.split(" "))
                    score = max(1 - _edits(a, b) / max(len(a), len(b)), len(x & y) / len(x | y))
                    if score >= threshold:
                        want[i, j] = score
        got = {(r.a, r.b): r.score for r in clean.resolve_entities(df, "id", "n", threshold).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    canon = {r.id: r.canonical_id for r in clean.canonical_ids(df, "id", "n", 0.85).collect()}
    assert canon[names.index("ACME  Holding!")] == canon[names.index("acme holding")] and len(canon) == len(names) + 1


def test_clusters_and_splits(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6)], "a long, b long")
    got = {r.id: r.component for r in clean.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    split = spark.createDataFrame([(i, "train" if i < 5 else "test") for i in range(1, 10)], "id long, s string")
    assert sorted((r.a, r.b) for r in clean.straddling_pairs(edges, split, "id", "s").collect()) == [(5, 4)]
    components = clean.connected_components(edges)
    assert [(r.component, r.splits) for r in clean.straddling_clusters(components, split, "id", "s").collect()] == [(4, ["test", "train"])]
    text = "one two three four five six seven eight nine ten eleven twelve"
    train = spark.createDataFrame([(1, text), (2, text), (3, "quite another text than that"), (4, None)], "id long, t string")
    test = spark.createDataFrame([(1, text + " thirteen")], "id long, t string")
    assert sorted(r.id for r in clean.purge_near_duplicates(train, test, "id", "t", 0.8).collect()) == [3, 4]
    names = spark.createDataFrame([(1, "Acme, Inc"), (2, "inc acme"), (3, "inc acme"), (4, "Other")], "id long, n string")
    assert [tuple(r) for r in clean.fingerprint_clusters(names, "id", "n").orderBy("key").collect()] == [("acme inc", "inc acme", 3, 3), ("other", "Other", 1, 1)]
