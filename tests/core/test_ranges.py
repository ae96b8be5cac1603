"""Windows over hot keys, taken range by range, against loops; sections a book lacks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from punchlist.operators import history, scoring
from punchlist.operators.ranges import RANGE, in_ranges
from punchlist.streaming import jobs


@pytest.fixture
def ranges(spark):
    """Small ranges are not put together, so that a key of a few hundred rows has several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranges_split_a_hot_key_and_keep_its_order(spark, ranges):
    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, i long")
    rows = in_ranges(df, ["k", "i"]).collect()
    hot = sorted((r["i"], r[RANGE]) for r in rows if r["k"] == "hot")
    assert len({x for _, x in hot}) > 3 and [x for _, x in hot] == sorted(x for _, x in hot)


def test_versions_of_a_hot_name(spark, ranges):
    rng = random.Random(3)
    digests = ["same", "same", None, *[f"d{i}" for i in range(30)]]
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice(digests)) for i in range(600)]
    got = {r["i"]: (r["duplicate"], r["version"], r["supersedes"]) for r in history.versions(spark.createDataFrame(rows, "i long, name string, digest string"), ["name"], "digest", ["i"]).collect()}
    seen, want = {}, {}
    for i, name, digest in rows:
        before = seen.setdefault(name, [])
        if digest in before:
            want[i] = (True, None, None)
        else:
            want[i] = (False, len(before) + 1, before[-1] if before else None)
            before.append(digest)
    assert got == want


def test_versions_of_nothing(spark):
    assert history.versions(spark.createDataFrame([], "i long, name string, digest string"), ["name"], "digest", ["i"]).collect() == []


def test_pitch_of_a_hot_key(spark, ranges):
    rng = random.Random(5)
    points = [("hot", float(y)) for y in rng.sample(range(2000), 400)] + [("few", 1.0), ("few", 13.0), ("few", 25.0), ("few", 30.0), ("few", None), ("one", 4.0)]
    got = {r["k"]: r["pitch"] for r in history.pitch(spark.createDataFrame(points, "k string, y double"), ["k"], "y", grain=1.0).collect()}
    ys = sorted(y for k, y in points if k == "hot")
    steps = [b - a for a, b in zip(ys, ys[1:])]
    assert got == {"hot": min(set(steps), key=lambda s: (-steps.count(s), s)), "few": 12.0}


def test_digests_list_few_folders_and_send_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACTED", 2)
    assert [jobs._blocks(i) for i in (0, 1, 2, 7)] == [[], [(0, 0)], [(1, 0)], [(2, 0), (1, 4), (0, 6)]]
    path, day = str(tmp_path / "sent"), dt.datetime(2024, 1, 1)
    people = spark.createDataFrame([("a", True)], "person string, is_active boolean")
    each = jobs.digest_batches(path, people, F.lit(day + dt.timedelta(hours=2)), 60)
    for id in range(5):
        batch = spark.createDataFrame([("a", n, day, None) for n in range(id + 1)], "person string, note long, created_at timestamp, read_at timestamp")
        each(batch, id)
        if id in (2, 4):
            each(batch, id)  # repeated, with its blocks
        assert [r["note"] for r in spark.read.parquet(f"{path}/batch={id}").collect()] == [id]
    assert sorted(r["note"] for r in jobs.sink(spark, path).collect()) == list(range(5))
    assert spark.read.parquet(f"{path}-blocks/level=2/first=0").count() == 4


def test_sections_a_book_lacks(spark):
    books = spark.createDataFrame([("x", "facility"), ("y", "flowline"), ("z", None)], "id string, book_type string")
    template = spark.createDataFrame([("1", "both"), ("2", "facility"), ("3", "flowline"), ("1", "facility")], "section_number string, applies_to string")
    sections = spark.createDataFrame([("x", "1", "na"), ("x", "3", "open"), ("y", "3", "open")], "job_book_id string, section_number string, status string")
    got = sorted(tuple(r) for r in scoring.unscaffolded(books, template, sections).collect())
    assert got == [("x", "2"), ("y", "1"), ("z", "1")]
