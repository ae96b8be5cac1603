"""The pipeline's stages, one by one and together."""

import random
import re
from zlib import crc32

import pytest


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "a line of forty or more characters that many share"
    item = text(30)
    rows = [(i, text(60)) for i in range(60)]
    rows += [(100 + i, text(40) + " slur insult curse slur") for i in range(30)]
    rows += [(200 + i, shared + "\n" + text(50)) for i in range(6)]
    copy = text(80)
    rows += [(300, copy), (301, copy), (302, copy + " more")]
    rows += [(400, text(20) + " " + item), (500, None), (501, "")]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 130)) for i, _ in rows if i < 130], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), shared


def test_pipeline(spark, folder):
    import corpus_pipeline as p

    path, rows, shared = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(rows) - set(seen["toxicity"]) == set(range(100, 130))
    lines = seen["line dedup"]
    assert set(lines) == set(seen["toxicity"]) and [i for i in range(200, 206) if shared in lines[i]["text"]] == [205]
    assert set(lines) - set(seen["near duplicates"]) == {301, 302}
    assert set(seen["near duplicates"]) - set(seen["decontamination"]) == {400}
    assert set(seen["pieces"]) == set(seen["decontamination"]) and all(r["round_trip"] for r in seen["pieces"].values())
    assert {r["doc_id"]: r["ids"] for r in p.run(spark, path).collect()} == {i: r["ids"] for i, r in seen["pieces"].items()}


# Brute force: what each stage has to keep of its own input, in plain Python. The toxic model is the operator's own; that it
# finds what it should is tested apart.


def _low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def _lines(rows):
    holders = {}
    for i, t in rows:
        for x in set((t or "").split("\n")):
            k = _low(x.strip("\x20\t\n\v\f\r"))
            if i is not None and len(k) >= 40:
                holders.setdefault(k, set()).add(i)
    shared = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    key = lambda x: _low(x.strip("\x20\t\n\v\f\r"))
    return [(i, "\n".join(x for x in (t or "").split("\n") if key(x) not in shared or shared[key(x)] == i)) for i, t in rows]


def _copies(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", _low(t)) if x]
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    ids = sorted(i for i in sets if i is not None)
    near = {i: {j for j in ids for a in sets[i] for b in sets[j] if a and b and 100 * len(a & b) >= 80 * len(a | b)} | {i} for i in ids}
    kept = set()
    for i in ids:
        reached, size = {i}, 0
        while len(reached) > size:
            size = len(reached)
            reached |= {k for j in reached for k in near[j]}
        if min(reached) == i:
            kept.add(i)
    return [(i, t) for i, t in rows if i is None or i in kept]


def _clean(rows, items):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", _low(t)) if w]
    windows = {tuple(w[i : i + 13]) for w in map(words, items) if w for i in range(max(1, len(w) - 12))}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


@pytest.fixture
def awkward(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, near = text(40), text(60)
    shared = "One Shared line of more than forty characters, in many documents"
    rows = [(i, text(rng.randint(1, 90))) for i in range(50)]
    rows += [(100 + i, (shared.upper() if i % 2 else "  " + shared) + "\n" + text(30)) for i in range(7)] + [(None, shared)]
    rows += [(200, near), (200, near), (201, near + " x"), (202, text(3)), (203, near.upper()), (None, near), (None, None), (None, None)]
    rows += [(300, text(30) + " " + item), (300, text(30)), (301, item), (302, " ".join(item.split()[:13]) + " " + text(400)), (303, None), (304, ""), (305, "\n\n"), (306, "word " * 60_000)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, size int, comp long, key string, lines string"
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "x", 1, 2, "x", "x") for i, t in rows], columns).repartition(3)
    path = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, docs, item


def _pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, awkward):
    import corpus_pipeline as p

    path, rows, docs, item = awkward
    stages = dict(p.STAGES)
    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns and _pairs(kept) == sorted(rows, key=repr)  # no toxic label: nothing is toxic
    rows = _lines(rows)
    docs = stages["line dedup"](spark, kept, path)
    assert docs.columns == kept.columns and _pairs(docs) == sorted(rows, key=repr)
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "x" for r in docs.collect())
    rows = _copies(rows)
    docs = stages["near duplicates"](spark, docs, path)
    assert docs.columns == kept.columns and _pairs(docs) == sorted(rows, key=repr)
    rows = _clean(rows, [item, None, ""])
    docs = stages["decontamination"](spark, docs, path)
    assert docs.columns == kept.columns and _pairs(docs) == sorted(rows, key=repr)
    assert (301, item) not in rows and any(i == 300 for i, _ in rows) and any(i == 302 for i, _ in rows)
    pieces = stages["pieces"](spark, docs, path).collect()
    assert len(pieces) == len(rows) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in pieces)


def test_stages_on_empty_tables(spark, awkward, tmp_path):
    import corpus_pipeline as p

    path, _, docs, _ = awkward
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0, name
        assert name == "pieces" or out.columns == docs.columns
    bare = str(tmp_path / "bare")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{bare}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{bare}/benchmark.parquet")
    stages = dict(p.STAGES)
    for name in ("toxicity", "decontamination"):
        assert stages[name](spark, docs, bare).count() == docs.count(), name


def test_toxic_rows_go_by_the_model(spark, tmp_path):
    """The stage keeps just the rows whose probability of any grade is below a half, by a model fitted apart."""
    from punchlist.llm import toxicity
    from punchlist.llm.common import crc_mod
    from punchlist.llm.features import Codes, labelled_sample, word_counts

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["calm", "warm", "walk", "river"]) for _ in range(20)) + (" slur insult curse" if i % 3 == 0 else "")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", lambda i: crc_mod(i, 5) != 0, toxicity.SAMPLE_ROWS))
    want = {i for i, t in rows if model.above(*word_counts(t, Codes()))[0] < 0.5}
    assert {r["doc_id"] for r in toxicity.reject_toxic(docs, labels).collect()} == want == {i for i, _ in rows if i % 3}
    assert any(crc32(str(i).encode()) % 5 == 0 for i in want)
