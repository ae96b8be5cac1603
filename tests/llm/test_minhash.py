"""MinHash near-dedup against all pairs of whole sets, and its parts by hand."""

import random
from math import comb

import numpy as np
import pytest

from punchlist.llm import minhash

SCHEMA = "doc_id long, text string, key string, comp string, size string, keys string, rep string, agree string"
LOW = {i: i + 32 for i in range(65, 91)}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", "c", "s", "x", "r", "a") for i, t in rows], SCHEMA).repartition(3)


def shingles(text, n=2):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n=2, percent=80):
    """doc_id -> smallest reachable, by all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120, 400]))] for _ in range(30)]
    out = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 25, len(w) // 15, len(w) // 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    chain = [f"c{i}" for i in range(120)]  # each like the next, the ends unlike
    out += [(2000 - 3 * i, " ".join(chain[i * 6 : i * 6 + 80])) for i in range(7)]
    out += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "long " * 50_000), (5007, "long long"), (-5, "é É"), (-4, "É é"), (6000, "caf\N{NO-BREAK SPACE}é x"), (6001, "caf é x")]
    return out


def test_components_are_those_of_all_pairs(spark, rows):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, rows)).collect()}
    expected = components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["kept"] == (i == expected[i]) and r["n_shingles"] == len(shingles(dict(rows)[i])) for i, r in got.items())
    assert len(set(expected.values())) < len(expected) - 100


@pytest.mark.parametrize("settings", [{"rounds": 0}, {"n": 3, "percent": 60}])
def test_settings_do_not_change_what_is_linked(spark, rows, settings, monkeypatch):
    monkeypatch.setattr(minhash, "MAX_IDS", 10)
    monkeypatch.setattr(minhash, "RARE", 2)
    some = rows[::3]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, some), **settings).collect()}
    assert got == components(some, settings.get("n", 2), settings.get("percent", 80))


def test_a_group_with_members_that_are_not_quite_similar(spark, monkeypatch):
    """Copies of one text with a few to very many words changed: some are linked with none, each is nearly similar to many."""
    monkeypatch.setattr(minhash, "RARE", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(120), i % 15):
            w[at] = rng.choice(["x", "y", f"w{i}", f"v{rng.randrange(30)}"])
        rows.append((i, " ".join(w)))
    expected = components(rows)
    assert 5 < len(set(expected.values())) < 60
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()} == expected


def test_repeated_ids_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, a + " end"), (None, a), (None, None), (5, None), (6, b), (6, b), (7, "x y"), (7, "z")]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, rows)).collect() if r["doc_id"] is not None)
    assert got == sorted((i, c, i == c) for i, c in [(1, 1), (2, 1), (3, 1), (3, 1), (3, 1), (4, 1), (5, 5), (6, 1), (6, 1), (7, 7), (7, 7)])
    kept = sorted(r["doc_id"] or 0 for r in minhash.one_of_each(table(spark, rows)).collect())
    assert kept == [0, 0, 1, 5, 7, 7]
    assert minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_banding_keeps_the_miss_probability():
    for n in (10, 10**4, 10**6, 10**9):
        rows, bands = minhash.banding(n)
        assert (1 - 0.8**rows) ** bands <= minhash.MISS < (1 - 0.8**rows) ** (bands - 1)
    assert minhash.banding(10**9)[0] > minhash.banding(10**4)[0]


def test_posterior_by_integration():
    """After a uniform prior, the mass above t of the density s ** m * (1 - s) ** (n - m)."""
    s = (np.arange(200_000) + 0.5) / 200_000
    for n in (8, 64, 128):
        for miss in (1e-3, 1e-6):
            least = minhash.least_agreements(n, 80, miss)
            for m in (least - 1, least):
                density = (n + 1) * comb(n, m) * s**m * (1 - s) ** (n - m)
                assert (density[s >= 0.8].mean() * 0.2 >= miss) == (m >= least)


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for shared, own in ((80, 10), (800, 100), (50, 50), (4, 1)):
        agree = []
        for _ in range(30):
            x = rng.integers(0, 2**64, shared + 2 * own, np.uint64)
            m = minhash.minima([x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])], 320)
            agree.append((m[:, 0] == m[:, 1]).mean())
        assert np.mean(agree) == pytest.approx(shared / (shared + 2 * own), abs=0.03)
    rows, bands = minhash.banding(1000)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 100, np.uint64)
        keys = minhash.band_keys([x[:90], np.concatenate([x[:80], x[90:]])], rows, bands)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_long_sets_are_slices_of_their_own():
    sets = [np.arange(n, dtype=np.uint64) for n in (5, 70_000, 0, 50_000, 20_000, 3)]
    full = [s for s in sets if len(s)]
    assert [(p.start, p.stop) for p in minhash._slices(full)] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    assert minhash._per_set(sets, lambda some: np.array([[len(s)] for s in some]), 1, np.int64).ravel().tolist() == [5, 70_000, 0, 50_000, 20_000, 3]
