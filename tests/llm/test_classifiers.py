"""Quality and severity of whole texts against a second, plain version."""

import math
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

TEXTS = ["", None, "Plain words, plain WORDS.\nsecond line\n\n", "\t a  b c_d éÜx 12 \U0001f600!!", "x" * 3000, "one " * 700 + "\n" * 40, "slur Kind slur nice", "日本 語 a"]


def words(text):
    """Runs of letters and digits, lower-cased."""
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return Counter(out)


def statistics(text):
    n = len(text)
    if not n:
        return [0.0] * 13
    share = lambda test: sum(map(test, text)) / n
    blank = " \t\n\v\f\r"
    tokens, run = [], ""
    for c in text.strip(blank) + " ":
        if c in blank:
            tokens += [run] if run or not text.strip(blank) else []
            run = ""
        else:
            run += c
    lines, counts = text.split("\n"), Counter(tokens)
    plain = lambda c: c.isascii() and (c.isalnum() or c in blank)
    return [
        min(1, math.log(n + 1) / 12), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c.isascii() and not plain(c)), share(lambda c: c in blank), share(lambda c: ord(c) > 127),
        min(1, n / len(tokens) / 20), len(counts) / len(tokens), max(counts.values()) / len(tokens), min(1, math.log(len(lines) + 1) / 8),
        sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), sum(len(t) == 1 for t in tokens) / len(tokens),
    ]


def corpus(spark, label):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["river", "stone", "cloud", "house", "slur" if i % 3 == 0 else "kind"]) for _ in range(rng.randint(5, 40)))) for i in range(200)]
    stated = {i: (None if i % 11 == 0 else len(t)) for i, t in rows}
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)]
    stated |= {1000: 5, 1001: None, 1002: -3, 1003: 10**12}
    docs = spark.createDataFrame([(i, t, stated.get(i)) for i, t in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], f"doc_id long, {label} int")
    return rows, stated, docs, labels


def test_quality_against_all_pairs(spark):
    from punchlist.llm import quality
    from punchlist.llm.common import crc_mod
    from punchlist.llm.features import labelled_sample

    rows, stated, docs, labels = corpus(spark, "quality")
    model = quality.fit(labelled_sample(docs, labels, "quality", lambda i: crc_mod(i, 5) != 0, quality.SAMPLE_ROWS, metadata=("n_chars",)))
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels, metadata=("n_chars",)).collect()}
    for i, text in rows:
        counts = words(text or "")
        x = [(crc32(w.encode()) % quality.BUCKETS, math.sqrt(c / sum(counts.values()))) for w, c in counts.items()]
        for k, s in enumerate(statistics(text or "")):
            x.append((quality.BUCKETS + k * 17 + min(15, int(math.sqrt(max(0.0, min(1.0, s))) * 16)), 0.5))
        n = stated.get(i)
        x.append((quality.BUCKETS + 13 * 17 + (16 if n is None else min(15, int(math.sqrt(min(1.0, math.log1p(max(n, 0)) / 12)) * 16))), 0.5))
        raw = model.bias + sum(float(model.w[a]) * v for a, v in x)
        raw += sum(float(model.v[a] @ model.v[b]) * u * v for j, (a, u) in enumerate(x) for b, v in x[:j])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4), (i, text)


def test_metadata_counts_and_has_a_bound(spark):
    from punchlist.llm.quality import quality_scores

    docs = spark.createDataFrame([(i, "same text", 10 if i % 2 else None) for i in range(200)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    by = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels, metadata=("n_chars",)).collect()}
    assert len(set(by.values())) == 2 and by[1] > 0.9 > 0.1 > by[0]
    with pytest.raises(ValueError):
        quality_scores(docs, labels, metadata=("n_chars",) * 5)


def test_severity_against_plain_sums(spark):
    from punchlist.llm import toxicity
    from punchlist.llm.common import crc_mod
    from punchlist.llm.features import labelled_sample

    rows, _, docs, labels = corpus(spark, "toxic")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", lambda i: crc_mod(i, 5) != 0, toxicity.SAMPLE_ROWS))
    # Words whose share of toxic and of clean training texts differs by enough standard errors, chosen once more.
    trained = [(i % 3 == 0, set(words(t))) for i, t in rows if i < 200 and crc32(str(i).encode()) % 5]
    sides = [[w for toxic, w in trained if toxic == y] for y in (True, False)]
    chosen = []
    for w in set().union(*[w for _, w in trained]):
        a, b = (sum(w in s for s in side) for side in sides)
        p = (a + b) / len(trained)
        error = math.sqrt(max(p * (1 - p), 1e-12) * sum(1 / len(side) for side in sides))
        if abs(a / len(sides[0]) - b / len(sides[1])) >= toxicity.MIN_Z * error and a + b >= 3:
            chosen.append(crc32(w.encode()))
    assert sorted(chosen) == list(model.words) and len(chosen) >= 2
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for i, text in rows:
        s = sum(weight.get(crc32(w.encode()), 0.0) * math.log(1 + c) for w, c in words(text or "").items())
        above = [1 / (1 + math.exp(min(50, max(-50, t - s)))) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(above), abs=1e-9) and got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-9)
    assert {r["doc_id"] for r in toxicity.reject_toxic(docs, labels).select(F.col("doc_id")).collect()} == {i for i, r in got.items() if not r["toxic_pred"]}
