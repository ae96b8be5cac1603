"""Operators of punchlist.llm against brute-force versions on small tables with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, lines string, key string, score string, h string"
LOW = {i: i + 32 for i in range(65, 91)}
BLANKS = "\x20\t\n\v\f\r"


def low(text):
    return (text or "").translate(LOW)


def table(spark, rows):
    """(doc_id, text) rows, with the columns of documents and some whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "eps", "zeta", "eta", "theta", "iota", "kappa", "日本", "mu", "nu", "xi"]
    long_line = "This line is Shared by very many of the documents here"
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    out = []
    for i in range(60):
        lines = [texts[rng.randrange(40)]]
        if i % 3 == 0:
            lines.insert(0, "  " + (long_line if i % 2 else long_line.upper()) + "\t")
        if i % 7 == 0:
            lines.append("")
        out.append((i, "\n".join(lines)))
    out += [(100, None), (101, ""), (102, "\n\n"), (103, " \t "), (104, long_line + "\n" + long_line), (105, "one two"), (106, "One  TWO"), (107, "x" * 500 + " " + "very long " * 4000)]
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_dedup(spark, rows):
    from punchlist.llm.line_dedup import line_dedup, with_lines_dropped

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := low(line.strip(BLANKS))) >= 40:
                holders[k].add(i)
    shared = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    docs = table(spark, rows)
    got = by_id(line_dedup(docs))
    texts = {r["doc_id"]: r for r in with_lines_dropped(docs).collect()}
    assert shared and len(got) == len(rows)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if shared.get(low(x.strip(BLANKS)), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert texts[i]["text"] == "\n".join(kept) and texts[i]["lines"] == "x" and texts[i]["n_chars"] == len("\n".join(kept))


def test_decontamination(spark, rows):
    from punchlist.llm.decontamination import decontaminate, decontaminated, drop_contaminated

    def words(text):
        return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text)) if w]

    texts = dict(rows)
    items = [(1, " ".join((texts[3] or "").split()[:20])), (2, "one TWO"), (3, None), (4, "..."), (5, texts[3]), (None, "very long very"), (7, "one two")]
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    docs = table(spark, rows)
    for limit in (1000, 0):  # broadcast, and shuffled
        got = by_id(decontaminated(decontaminate(docs, benchmark, max_broadcast=limit)))
        for i, t in rows:
            w, hit, cited = words(t), set(), set()
            for n in {len(x) for x in windows}:
                for at in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[at : at + n])):
                        hit |= set(range(at, at + n))
                        cited |= found
            cited.discard(None)
            assert (got[i]["n_words"], got[i]["n_hit"], set(got[i]["items"])) == (len(w), len(hit), cited)
            assert got[i]["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))
    kept = {r["doc_id"] for r in drop_contaminated(docs, benchmark).collect()}
    repeated = table(spark, [(1, texts[3]), (1, "clean words only"), (1, texts[3]), (None, texts[3]), (None, "clean")])
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_contaminated(repeated, benchmark).collect()) == [("1", "clean words only"), ("None", "clean")]
    assert kept == {i for i, r in got.items() if not r["contaminated"]} and kept != set(got)
    assert decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()


def test_secret_scan(spark):
    from punchlist.llm.secret_scan import BASE_RULES, RULES, secret_spans

    rng = random.Random(3)
    parts = ["password: hunter2abc", "PASSWD='abc'", "token=token: abcdefgh12", "Api_Key = \"A1B2C3D4E5\"", "apikey:aaaabbbb", "AKIA" + "Z" * 12, "AKIAAKIA1", "0123456789abcdef" * 2, "0123456789abcdef", "日本", "secret", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "x\n", " "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "token=abcdefgh " * 3000)]
    got = by_id(secret_spans(table(spark, rows)))
    kinds = [r.kind for r in RULES]
    for i, t in rows:
        want = []
        for rule in RULES:
            # The base rules as the contract words them: match first, then drop what is too short.
            rx = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(rule.kind, rule.regex)
            least = {"access": 16, "hex": 32}.get(rule.kind, rule.least)
            want += [(m.start(), kinds.index(rule.kind), m.end(), rule.kind) for m in re.finditer(rx, t or "") if len(m.group(rule.group)) >= least]
        assert [tuple(s) for s in got[i]["spans"]] == sorted(want)
    assert len(BASE_RULES) == 3


def test_trigram_queries():
    from punchlist.llm.trigrams import ANYTHING, trigram_query

    assert trigram_query("[0-9a-f]{32,}") == ANYTHING
    assert trigram_query("abcd") == {frozenset({"abc", "bcd"})}
    assert trigram_query("(abc|xyz)+") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert trigram_query("ab?c[0-9]+(?i:KEY)") == {frozenset({"abc", "key"}), frozenset({"key"})} or trigram_query("ab?c[0-9]+(?i:KEY)") == {frozenset({"key"})}


def test_ppm(spark, rows):
    from punchlist.llm.ppm import ppm_scores

    def tokens(t):
        return re.findall("[^\x20\x09-\x0d]+", low(t)) + [" "]

    counts = Counter()
    for i, t in rows:
        if crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)

    for heavy in (1_000_000, 3):  # all words broadcast, and nearly all joined by shuffle
        got = by_id(ppm_scores(table(spark, rows), max_heavy=heavy, order=1))
        for i, t in rows:
            ts = tokens(t)
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(w in counts for w in ts), n)
            assert r["base_score"] == pytest.approx(base, abs=1e-6)
            assert r["score"] < 0


STOP = 256


def ppm_model(texts, order):
    """Counts of what follows every context of up to ``order`` bytes, and the probability of a symbol by escapes with exclusion,
    one level at a time."""
    counts = defaultdict(Counter)
    for t in texts:
        b = [*bytes(order), *(t or "").encode(), STOP]
        for j in range(order, len(b)):
            for k in range(order + 1):
                counts[tuple(b[j - k : j])][b[j]] += 1

    def probability(context, symbol):
        context, out, p = tuple(context), set(), 1.0
        while True:
            left = {s: n for s, n in counts[context].items() if s not in out}
            n, d = sum(left.values()), len(left)
            if left:
                escape = d if len(out) + d < 257 else 0
                if symbol in left:
                    return p * left[symbol] / (n + escape)
                p *= escape / (n + escape)
                out |= set(left)
            if not context:
                return p / (257 - len(out))
            context = context[1:]

    def score(t):
        b = [*bytes(order), *(t or "").encode(), STOP]
        return sum(math.log10(probability(b[j - order : j], b[j])) for j in range(order, len(b)))

    return counts, probability, score


def test_ppm_long_contexts(spark, rows):
    from punchlist.llm import ppm

    rows = [*rows, (7, dict(rows)[7]), (7, "another text of document seven"), (None, "alpha beta"), (300, "zz q"), (301, "aqqz \0 x")]
    order = 4
    counts, probability, score = ppm_model([t for i, t in rows if i is None or crc32(str(i).encode()) % 5 != 1], order)
    for context in (b"alph", b"eta ", b"\0\0\0\0", b"zzzz", b"a al"):  # every context's probabilities sum to one
        assert sum(probability(context, s) for s in range(257)) == pytest.approx(1)
    # There are contexts whose exclusion changes a shorter one's escape.
    assert any(counts[c] and len(counts[c]) < len(counts[c[1:]]) for c in list(counts) if len(c) == order)
    want = {(i, len(t or "")): score(t) for i, t in rows if len(t or "") < 300}
    assert want[101, 0] == want[100, 0] < 0
    docs = table(spark, rows)
    for sent in (1_000_000, 200, 0):  # all paths broadcast, some, none
        got = ppm.ppm_scores(docs, order=order, max_paths=sent)
        found = got.join(docs.select("doc_id", "n_chars"), "doc_id").where("doc_id <> 7").collect()
        assert len(found) > 60
        for r in found:
            if (r["doc_id"], r["n_chars"]) in want:
                assert r["score"] == pytest.approx(want[r["doc_id"], r["n_chars"]], rel=1e-4, abs=1e-4), (sent, r["doc_id"])
        repeated = sorted(r["score"] for r in got.where("doc_id = 7 or doc_id is null").collect())
        assert repeated == pytest.approx(sorted(score(t) for t in {t for i, t in rows if i in (7, None)}), rel=1e-4)
    assert ppm.ORDER >= order


def test_ppm_scores_do_not_depend_on_what_is_broadcast(spark, rows):
    from punchlist.llm import ppm

    some = table(spark, rows[:40])
    scores = [{i: r["score"] for i, r in by_id(ppm.ppm_scores(some, order=3, max_paths=most)).items()} for most in (0, 200, 10**6)]
    assert scores[0] == pytest.approx(scores[2], rel=1e-9) and scores[1] == pytest.approx(scores[2], rel=1e-9)


def test_ppm_keeps_the_type_of_ids(spark):
    from punchlist.llm.ppm import ppm_scores

    got = ppm_scores(spark.createDataFrame([("a", "one"), ("b", "two")], "doc_id string, text string"))
    assert {r["doc_id"] for r in got.collect()} == {"a", "b"}


def test_winnowing(spark, rows):
    from punchlist.llm.winnowing import fingerprints, kgram_hashes, winnow

    got = by_id(fingerprints(table(spark, rows), run=7))
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        own, following = texts[i], texts[ids[(at + 1) % len(ids)]]
        n = len(own) // 4
        edited = own[: len(own) - n] + following[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = ({x.split(":")[0] for x in f.split(",") if x} for f in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[ids[(at + 1) % len(ids)]]["fingerprint"]))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i]["near_edited"] == pytest.approx(like(a, b)) and got[i]["near_next"] == pytest.approx(like(a, c))

    rng = random.Random(1)
    for size in (0, 1, 31, 32, 40, 95, 96, 400):
        text = "".join(rng.choice("ab") for _ in range(size))
        hashes, places = winnow(text)
        if size >= 32:
            import numpy as np

            with np.errstate(over="ignore"):
                h = (kgram_hashes(np.array([ord(c) for c in text], np.uint32)) >> np.uint64(24)).tolist()
            want = set()
            for s in range(max(1, len(h) - 63)):
                window = h[s : s + 64]
                least = min(window)
                want.add(s + max(j for j, x in enumerate(window) if x == least))
            assert places.tolist() == sorted(want) and hashes.tolist() == [h[p] for p in sorted(want)]


def test_winnowing_without_ids(spark):
    from punchlist.llm.winnowing import fingerprints

    rows = [(None, f"text without an id, number {i}, and more of it") for i in range(40)] + [(i, f"text {i}") for i in range(9)] + [(8, "text 8")]
    found = fingerprints(table(spark, rows), run=5).collect()
    hashes = {r["text"]: r["h"] for r in table(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for at, (i, own) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        k = len(own) // 4
        want[i, hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == want
    with pytest.raises(TypeError):
        fingerprints(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_winnowing_blocks(monkeypatch):
    from punchlist.llm import winnowing

    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "BLOCK", 700)
    parts = winnowing.winnow(text)
    assert whole[1].tolist() == parts[1].tolist() and whole[0].tolist() == parts[0].tolist()


def test_jaccard_components(spark):
    from punchlist.llm.jaccard_join import jaccard_components, one_of_each

    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 12, 60, 120]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(own).upper() if n % 3 else " ".join(own)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(500 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 40)))) for i in range(40)]
    rows += [(700, None), (701, ""), (702, "  "), (703, "same few"), (704, "SAME few"), (705, "w1 " * 3000)]
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", low(t)) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for settings in ({}, {"frequent": 2}, {"frequent": 2, "max_sent": 1}):
        got = by_id(jaccard_components(table(spark, rows), **settings))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}, settings
    assert {r["doc_id"] for r in one_of_each(table(spark, rows)).collect()} == {i for i in sets if find(i) == i}


def test_jaccard_repeated_ids(spark):
    from punchlist.llm.jaccard_join import jaccard_components

    text = lambda k, n: [f"r{k}x{j}" for j in range(n)]
    rows = []
    for k in range(0, 80, 4):
        near, other = text(k, 60), text(k + 1, 104)
        rows += [(k, " ".join(near)), (k + 1, " ".join([*near, "more"])), (k + 1, " ".join(other))]  # a text of its own beside a near copy
        same = text(k + 2, 60)
        rows += [(k + 2, " ".join(same))] * 4 + [(k + 3, " ".join(["new", *same[1:]]))] * 5 + [(k + 3, " ".join(text(k + 3, 60)))]  # equal rows, and another text of equal size
    want = {i: i - i % 2 for i in range(80)}
    for settings in ({}, {"max_sent": 1}):
        found = jaccard_components(table(spark, rows), **settings).collect()
        got = {r["doc_id"]: r["component_id"] for r in found}
        assert len(found) == len(rows) and got == want, (settings, sum(got[i] != want[i] for i in want))


@pytest.mark.parametrize("boundary", [5, 9, 12])
def test_jaccard_light_pairs(spark, monkeypatch, boundary):
    from punchlist.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_: boundary)
    rows, want = [], {}
    for n in range(8, 17):
        for k in range(6):
            base = [f"w{n}x{k}x{j}" for j in range(n)]
            for text in (base, ["new", *base], [*base, "new"], base[1:], base[:-1]):
                rows.append((len(rows), " ".join(text)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for first in range(0, len(rows), 5):
        group = range(first, first + 5)
        for i in group:
            reached = {i}
            while more := {j for j in group for x in reached if 100 * len(sets[x] & sets[j]) >= 80 * len(sets[x] | sets[j])} - reached:
                reached |= more
            want[i] = min(reached)
    for settings in ({}, {"max_sent": 1}):
        got = {i: r["component_id"] for i, r in by_id(jaccard_join.jaccard_components(table(spark, rows), **settings)).items()}
        assert got == want, (settings, sum(got[i] != want[i] for i in want), len({x for x in want if want[x] != x}))


def test_jaccard_boundary():
    from math import comb

    from punchlist.llm.jaccard_join import choose_boundary, costs

    few = {i: 100 for i in range(1, 25)}
    assert choose_boundary({}, 5.0) == 0 and choose_boundary(few, 1000.0) > choose_boundary(few, 2.0)
    table = {b: (enumerated, scanned) for b, enumerated, scanned in costs({4: 3, 10: 7}, 6.0)}
    # Sets of 4 need all of their shingles for a partner of 4, and 4 of 5 for one of 5.
    assert table[0] == (0, 3 * 1 * 6.0 + 7 * 3 * 6.0) and table[4][0] == 3 * comb(4, 4) and table[5][0] == 3 * (1 + comb(4, 4))
    # From boundary 5 on, sets of 4 match no heavy set; sets of 10 are scanned as long as a heavy one can match them.
    assert table[5][1] == 7 * 3 * 6.0 and table[12][1] == 0 and table[12][0] > table[10][0] > table[9][0]
    assert choose_boundary({4: 3, 10: 7}, 6.0) == min(table, key=lambda b: (sum(table[b]), b))


def test_jaccard_shared_passages_make_no_pairs(spark):
    from punchlist.llm import jaccard_join

    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(rng.randint(12, 20))) + " " + passage) for i in range(90)]
    rows += [(200 + i, passage + (" z" * i)) for i in range(3)]
    near, seen = defaultdict(set), []
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                near[i].add(j)
    original = jaccard_join.possible_links
    jaccard_join.possible_links = lambda pairs, *more: (seen.append(pairs.count()), original(pairs, *more))[1]
    try:
        got = {i: r["component_id"] for i, r in by_id(jaccard_join.jaccard_components(table(spark, rows), frequent=8)).items()}
    finally:
        jaccard_join.possible_links = original
    for i in sets:
        reached, size = {i}, 0
        while len(reached) > size:
            size = len(reached)
            reached |= {k for j in reached for k in near[j]}
        assert got[i] == min(reached)
    assert sum(seen) < 20 * len(rows)


def test_components_of_a_chain(spark):
    from punchlist.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 80)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 80: 80, 90: 80}


def test_pieces(spark, rows):
    import public_tokenizers
    import sentencepiece

    from punchlist.llm.pieces import decode_documents, encode_documents

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    odd = [" ", "a  b", "a\nb\r\n", "\t", "日本 \U0001f389", "▁x ▁", "x\0y", "<s> </s> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x"]
    odd += ["".join(rng.choice("ab ▁\nétheingrondlsw  ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    encoded = encode_documents(table(spark, rows))
    got, decoded = by_id(encoded), by_id(decode_documents(encoded))
    for i, t in rows:
        assert list(got[i]["ids"]) == model.encode(t or "") and got[i]["round_trip"]
        assert decoded[i]["text"] == (t or "").replace("▁", " ")


def labelled(spark, column, positive, negative, n=240):
    rng = random.Random(9)
    words = ["river", "stone", "cloud", "green", "paper", "light", "house", "walk"]
    rows, labels = [], []
    for i in range(n):
        y = i % 3 == 0
        t = [rng.choice(words) for _ in range(rng.randint(10, 60))] + [rng.choice(positive if y else negative) for _ in range(4)]
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 4:
            labels.append((i, int(y), "x"))
    rows += [(900, None), (901, ""), (902, "word " * 50000)]
    labels += [(900, 0, "x"), (None, 1, "x"), (5, None, "x")]
    return table(spark, rows), spark.createDataFrame(labels, f"doc_id long, {column} int, text string"), n


def test_quality(spark):
    from punchlist.llm.quality import quality_scores

    docs, labels, n = labelled(spark, "quality", ["fine", "good"], ["$$$", "junk!!"])
    got = by_id(quality_scores(docs, labels))
    held = [i for i in range(n) if crc32(str(i).encode()) % 5 == 0]
    assert len(got) == n + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {i for i, r in got.items() if r["held_out"] and i < n} == set(held)
    assert sum((got[i]["score"] >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_interactions_by_sums():
    import numpy as np

    from punchlist.llm.quality import Machine

    m = Machine(np.random.default_rng(0))
    at, x = np.array([3, 9, 40]), np.array([0.5, 1.0, 2.0], np.float32)
    raw, _ = m.raw(at, x, np.array([0]))
    want = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert raw[0] == pytest.approx(want, rel=1e-4)


def test_toxicity(spark):
    from punchlist.llm.toxicity import reject_toxic, toxicity_scores

    docs, labels, n = labelled(spark, "toxic", ["slur", "insult", "curse"], ["kind", "nice", "warm"])
    got = by_id(toxicity_scores(docs, labels))
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    assert sum(got[i]["toxic_pred"] == (i % 3 == 0) for i in range(n)) >= 0.97 * n
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic_pred"]}
    assert reject_toxic(docs, labels.limit(0)).count() == n + 3


def test_samples_stay_bounded(spark):
    from punchlist.llm.features import labelled_sample

    docs = table(spark, [(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    sizes = [len(labelled_sample(docs, labels, "toxic", lambda i: F.lit(True), most).y) for most in (2, 10, 100)]
    assert sizes[0] == 2 and sizes[1] == 10 and sizes[2] == 52


def test_severity_by_hand():
    """The probabilities, the shared weights and the expected grade, written out for a small model."""
    import numpy as np

    from punchlist.llm.toxicity import Ordinal

    weights, thresholds = {3: 0.7, 8: -0.4, 20: 1.1}, [0.5, 1.5, 4.0]
    model = Ordinal(np.array(sorted(weights)), np.array([weights[k] for k in sorted(weights)]), np.array(thresholds))
    for counts in ({}, {3: 2}, {8: 1, 20: 3}, {5: 9, 20: 1}):
        score = sum(math.log1p(n) * weights.get(w, 0) for w, n in counts.items())
        above = [1 / (1 + math.exp(t - score)) for t in thresholds]
        at = np.array(sorted(counts), np.int64)
        got = model.above(at, np.array([counts[k] for k in sorted(counts)], float))
        assert got == pytest.approx(above)
        grades = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert all(g > 0 for g in grades) and sum(got) == pytest.approx(sum(k * g for k, g in enumerate(grades)))


def test_ordinal_fit_reaches_a_minimum():
    """No small step of a weight or threshold makes the grades of the sample likelier."""
    import numpy as np

    from punchlist.llm import toxicity
    from punchlist.llm.features import STATISTICS, Sample

    rng = np.random.default_rng(3)
    sample = Sample.__new__(Sample)
    n = 400
    sample.y = (np.arange(n) % 2).astype(int)
    sample.at = np.concatenate([np.unique(rng.choice([1, 2, 3, 9, 10] if y else [1, 2, 3, 4], 3)) for y in sample.y]).astype(np.int64)
    rng = np.random.default_rng(3)
    sample.sizes = np.array([len(np.unique(rng.choice([1, 2, 3, 9, 10] if y else [1, 2, 3, 4], 3))) for y in sample.y])
    sample.n, sample.stats = np.ones(len(sample.at)), np.zeros((n, len(STATISTICS)))
    sample.row = np.repeat(np.arange(n), sample.sizes)
    model = toxicity.fit(sample)
    assert np.all(np.diff(model.thresholds) > 0)
    x = np.zeros((n, len(model.words)))
    for r, w in zip(sample.row, sample.at):
        if w in model.words:
            x[r, np.searchsorted(model.words, w)] = math.log1p(1)
    # Grades as the module documents them: toxic rows by thirds of their evidence.
    evidence = x[:, [w in (9, 10) for w in model.words]].sum(axis=1)
    cuts = np.quantile(evidence[sample.y > 0], [1 / 3, 2 / 3])
    grade = np.where(sample.y > 0, 1 + np.searchsorted(cuts, evidence, side="right"), 0)

    def loss(weights, thresholds):
        above = 1 / (1 + np.exp(thresholds[None, :] - (x @ weights)[:, None]))
        bounds = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = bounds[np.arange(n), grade] - bounds[np.arange(n), grade + 1]
        return -np.log(np.maximum(p, 1e-12)).mean() + 5e-4 * (weights @ weights) / n

    best = loss(model.weights, model.thresholds)
    for i in range(len(model.weights)):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved, model.thresholds) > best - 1e-3
    for step in (-0.05, 0.05):
        moved = model.thresholds.copy()
        moved[0] += step
        assert loss(model.weights, moved) > best - 1e-3


def test_factorisation_gradient():
    """A step of the machine's fit goes down the loss: gradients by hand against differences."""
    import numpy as np

    from punchlist.llm.quality import Machine

    m = Machine(np.random.default_rng(1))
    m.v = m.v.astype(np.float64)
    m.w = m.w.astype(np.float64)
    at, x = np.array([2, 5, 7]), np.array([0.5, 1.5, 1.0])
    raw, total = m.raw(at, x, np.array([0]))
    for i, a in enumerate(at):
        for k in range(m.v.shape[1]):
            gradient = x[i] * (total[0, k] - m.v[a, k] * x[i])
            old, e = m.v[a, k], 1e-5
            m.v[a, k] = old + e
            up = m.raw(at, x, np.array([0]))[0][0]
            m.v[a, k] = old - e
            down = m.raw(at, x, np.array([0]))[0][0]
            m.v[a, k] = old
            assert (up - down) / (2 * e) == pytest.approx(gradient, abs=1e-6)


def test_language_id(spark):
    from punchlist.llm.language_id import language_ids

    rng = random.Random(8)
    words = {"en": ["the", "house", "water", "through", "thing", "with"], "de": ["der", "haus", "wasser", "durch", "nicht", "straße"], "fr": ["le", "maison", "eau", "été", "dans", "avec"]}
    rows = []
    for i in range(150):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 \u00b2\u00bd :: 34", "fr"), (503, "haus " * 30000, None), (504, "x" * 5000, "en"), (505, "wasser" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = by_id(language_ids(docs))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:150])
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 505)] == ["und", "und", "und", "de", "de"]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, *_ in rows if crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_marginal_is_the_sum_over_segmentations(monkeypatch):
    import numpy as np

    from punchlist.llm import language_id
    from punchlist.llm.language_id import START, Pieces, expected, marginals

    pieces = [START, START + "a", "a", "b", "ab", "aba", "abababab"]
    index, p = Pieces(pieces), np.arange(1, len(pieces) + 2) / 100
    value = dict(zip(pieces, p))

    def segmentations(rest):
        if not rest:
            yield []
        for size in range(1, len(rest) + 1):
            if rest[:size] in value or size == 1:
                for more in segmentations(rest[size:]):
                    yield [rest[:size], *more]

    def weight(parts):
        return np.prod([value.get(x, p[-1]) for x in parts])

    words = ["abab", "b", "aba" * 4, "axb", "\u00e9"]
    n = np.array([3.0, 1.0, 2.0, 5.0, 1.0])
    want, counts = [], np.zeros(len(pieces) + 1)
    for w, k in zip(words, n):
        ways = list(segmentations(START + w))
        total = sum(map(weight, ways))
        want.append(total)
        for parts in ways:
            for x in parts:
                counts[pieces.index(x) if x in value else len(pieces)] += k * weight(parts) / total
    for long in (64, 1):  # words side by side, and one by one in blocks
        monkeypatch.setattr(language_id, "LONG", long)
        monkeypatch.setattr(language_id, "BLOCK", 3)
        assert np.exp(marginals(words, index, np.log(p)[:, None]))[:, 0] == pytest.approx(want)
        assert expected(words, n, index, np.log(p)) == pytest.approx(counts)


def test_expectation_maximisation(spark):
    import numpy as np

    from punchlist.llm.language_id import START, Pieces, expected, learn, maximised

    pieces, rows = sorted([START, "a", "b", "ab", START + "a"]), [("x", "abab", 4), ("x", "ba", 2), ("y", "bbb", 3), ("y", "a", 1)]
    got = learn(spark.createDataFrame(rows, "lang string, word string, n long").repartition(3), ["x", "y"], pieces, rounds=3)
    for j, lang in enumerate(("x", "y")):
        logs = np.full(len(pieces) + 1, np.log(1e-3))
        for _ in range(3):
            own = [(w, n) for x, w, n in rows if x == lang]
            logs = maximised(expected([w for w, _ in own], np.array([n for _, n in own], float), Pieces(pieces), logs)[:, None])[:, 0]
        assert got[:, j] == pytest.approx(logs)


def test_words_are_runs_of_letters():
    from punchlist.llm.language_id import words_of

    assert words_of("Été_2x\u00b2y \u00bd 3 日本" + "q" * 70) == ["été", "x", "y", "日本" + "q" * 70]


def test_empty_and_repeated_rows(spark):
    from punchlist.llm import decontamination, jaccard_join, language_id, line_dedup, pieces, ppm, quality, secret_scan, toxicity, winnowing

    empty = table(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    again = table(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (None, "seven"), (None, None), (2, "one two three four five six")])
    runs = {
        "lines": lambda d: line_dedup.line_dedup(d),
        "benchmark": lambda d: decontamination.decontaminate(d, benchmark),
        "secrets": lambda d: secret_scan.secret_spans(d),
        "ppm": lambda d: ppm.ppm_scores(d),
        "winnowing": lambda d: winnowing.fingerprints(d),
        "jaccard": lambda d: jaccard_join.jaccard_components(d),
        "language": lambda d: language_id.language_ids(d),
        "pieces": lambda d: pieces.encode_documents(d),
        "quality": lambda d: quality.quality_scores(d, labels),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
    }
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        ids = Counter(r["doc_id"] for r in run(again).collect())
        assert set(ids) == {1, 2, None}, name
        merged = name in ("benchmark", "secrets", "ppm")  # rows that repeat id and text are one
        assert ids[1] == (1 if merged else 2), name
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(again).collect()}
    assert got == {(1, 1), (2, 1), (None, None)}
