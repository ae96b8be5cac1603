"""Periodic runs against all lags tried one by one, and the query against a second version of its contract."""

import hashlib
import random
from zlib import crc32

import pytest

from punchlist.llm import periodic_runs as runs


def every_lag(w, shortest, repeats):
    n, out = len(w), {}
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s + q >= max(shortest, repeats * q):
                out.setdefault((s - q, i - s + q), q)
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def text_of(rng):
    alphabet, w, n = rng.choice([1, 2, 2, 3, 5, 50]), [], rng.randint(0, 250)
    while len(w) < n:
        unit = [b"%d" % rng.randrange(alphabet) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.4:  # units that repeat within themselves
            unit = unit[: rng.randint(1, len(unit))] * rng.randint(1, 4) + unit
        w += (unit * rng.randint(1, 6))[: rng.randint(1, 200)]
    return w


@pytest.mark.parametrize("shortest, repeats", [(24, 3), (10, 3), (4, 4), (1, 3), (30, 5)])
def test_runs_are_those_of_all_lags(shortest, repeats):
    rng, total = random.Random(shortest), 0
    for _ in range(400):
        w = text_of(rng)
        expected = every_lag(w, shortest, repeats)
        assert runs.runs_of(w, shortest, repeats) == expected
        total += len(expected)
    assert total > 100


def test_nested_units_and_edges():
    a41b = [b"a"] * 40 + [b"b"] + [b"a"] * 41 + [b"b"]
    for w in (a41b * 4, [b"x"] * 24, [b"x"] * 23, [b"x", b"y"] * 12, [b"z"] + [b"x", b"y"] * 12 + [b"x"], [b"%d" % (i % 500) for i in range(1500)], [b"%d" % (i % 500) for i in range(1499)]):
        assert runs.runs_of(w) == every_lag(w, 24, 3)
    assert runs.runs_of([b"%d" % (i % 500) for i in range(1500)]) == [(0, 1500, 500)]
    with pytest.raises(ValueError):
        runs.runs_of([b"x"] * 30, 24, 2)


def test_a_word_with_very_many_occurrences_stays_cheap():
    w = [b"x"] * 200_000 + [b"y"] + [b"x"] * 200_000
    assert runs.runs_of(w) == [(0, 200_000, 1), (200_001, 200_000, 1)]
    assert len(runs.collapsed(w, runs.runs_of(w))) == 3


SCHEMA = "doc_id long, text string, runs string, collapsed string, id string, words string, a string, p string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "c", "i", "w", "a", "p") for i, t in rows], SCHEMA)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [None, "", " \t\n", "one"][i] if i < 4 else rng.choice([" ", "\t", " \n"]).join(w.decode() for w in text_of(rng))) for i in range(250)]
    rows += [(300, "\N{NO-BREAK SPACE}x\x1fx " * 40), (301, "lang " * 30_000), (302, " ".join(str(i) for i in range(20_000))), (-7, "a b " * 20)]
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in runs.query(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows}
    edited = 0
    for i, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
            edited += 1
        if n > 5000:
            found = [(0, n, 1)] if i == 301 else runs.runs_of(w)
        else:
            found = every_lag(w, 24, 3)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {j for s, x, q in found for j in range(s + q, s + x)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3)), i
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert edited > 15


def test_awkward_rows(spark):
    assert runs.periodic_runs(table(spark, [(1, "x")]).limit(0)).count() == 0
    again = table(spark, [(1, "x " * 30), (1, "x " * 30), (None, "y " * 24), (None, None), (2, None)])
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(again).collect()))
    assert got == [(0, [], ""), (0, [(0, 24, 1)], "y"), (1, [(0, 30, 1)], "x"), (1, [(0, 30, 1)], "x"), (2, [], "")]
    named = again.selectExpr("cast(doc_id as string) as key", "text as body")
    assert dict(runs.periodic_runs(named, "key", "body").dtypes)["key"] == "string"
    assert runs.with_repeating_tails(again).count() == 5
