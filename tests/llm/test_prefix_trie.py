"""The prefix trie against sets of prefixes, and its parentheses against plain scans."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from punchlist.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, path string, words string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "p", "w", "b") for r in rows], SCHEMA).repartition(3)


def expected(rows, rebuilt=True):
    """All columns of each node, by (smallest member, depth)."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        convs.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4 if rebuilt else 0
        base = convs.get(c - c % 20 if c >= 0 else c + -c % 20, [])
        paths[c] = tuple(base[:h] + own[h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    kids = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in nodes}
    out = {}
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if paths[c] == p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode().split()) for q in below[p] if q)
        parent = min(nodes[p[:-1]]) if p else None
        out[min(members), len(p)] = (parent, len(members), len(kids[p]), sum(not kids[q] for q in below[p]), saved, sha256(ends.encode()).hexdigest())
    return out


def by_node(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = []
    for c in range(150):
        n, words = rng.choice([1, 1, 2, 3, 5, 9]), rng.choice([1, 2, 30])
        out += [(c, t, "user" if t % 2 == 0 else None, " \n".join(rng.choice("ab") for _ in range(words))) for t in range(n)]
    long = [(t, "user", f"turn {t}") for t in range(2500)]  # of several blocks, twice and with an end of its own
    out += [(1001, *t) for t in long] + [(1002, *t) for t in long[:2400]] + [(1003, *t) for t in long] + [(1004, *t) for t in long[:1500]] + [(1004, 9000, "user", "other"), (1005, 5, "x", "y")]
    out += [(2000, None, "b", "null turn"), (2000, None, None, None), (2000, 3, "a", "x"), (2000, 3, "a", "x"), (2000, 3, "A", "x"), (2001, -4, "é", "日本"), (None, 1, "user", "nobody"), (-21, 0, "u", "v"), (-20, 0, "u", "w")]
    return out


def test_query_columns(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "HELD", 15)
    few = [r for r in rows if r[1] is None or r[1] < 40 or r[1] == 9000]
    table(spark, few).write.parquet(f"{tmp_path}/conversations.parquet")
    got, wanted = by_node(trie.query(spark, str(tmp_path))), expected(few)
    assert got == wanted
    assert any(v[5] == sha256(b"").hexdigest() for v in got.values()) and max(v[1] for v in got.values()) == len({r[0] for r in few if r[0] is not None})


def test_long_conversations_in_blocks(spark, rows):
    got = by_node(trie.prefix_trie(table(spark, [r for r in rows if r[0] is not None and r[0] > 1000])))
    assert got[1001, 2500][1:3] == (2, 0) and got[1001, 2400][1:3] == (3, 1) and got[1001, 1500][1:4] == (4, 2, 2)
    assert got[1001, 1][4] == 2 * (3 * 1500 + 2 * 900 + 100) and got[1001, 2450][4] == 2 * 51 and got[1001, 1501][4] == 2 * (2 * 900 + 100)
    assert got[1004, 1501] == (1001, 1, 0, 1, 0, sha256(b"1004").hexdigest())
    assert got[1001, 2400][5] == sha256(b"1002").hexdigest() and got[1001, 2500][5] == sha256(b"1001,1003").hexdigest()
    assert got[1001, 0][:4] == (None, 7, 4, 5)


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(i, 0, "u", "same") for i in range(-30, 60)] + [(500, 0, "u", "other")]
    got = by_node(trie.prefix_trie(table(spark, rows)))
    assert got[-30, 1] == (-30, 90, 0, 1, 89, sha256(",".join(map(str, range(-30, 60))).encode()).hexdigest())
    assert got[-30, 0][:5] == (None, 91, 2, 2, 89)


def test_awkward_tables(spark):
    assert trie.prefix_trie(table(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0
    assert by_node(trie.prefix_trie(table(spark, [(7, None, None, None)]))) == expected([(7, None, None, None)], False)
    with pytest.raises(TypeError):
        trie.prefix_trie(spark.createDataFrame([("a", 1, "u", "x")], "conv_id string, turn long, role string, text string"))


def test_parentheses():
    rng = random.Random(2)
    for size in (1, 2, 5, 40, 700):
        for block in (2, 3, 8, 256):
            opens, depth, left = [], 0, size
            while left or depth:
                if left and (depth == 0 or rng.random() < 0.55):
                    opens.append(True)
                    depth, left = depth + 1, left - 1
                else:
                    opens.append(False)
                    depth -= 1
            tree, stack, closes = trie.Parentheses(np.array(opens, bool), block), [], {}
            for i, o in enumerate(opens):
                if o:
                    stack.append(i)
                else:
                    closes[stack.pop()] = i
            assert {i: tree.findclose(i) for i in closes} == closes
            for i, close in closes.items():
                assert tree.leaves(i, close) == sum(opens[j] and not opens[j + 1] for j in range(i, close))


def test_parts_of_shards_add_up():
    """However sorted paths are cut into shards, the parts of a chain have the same sums."""
    rng, paths = random.Random(4), {(0,)}
    for _ in range(60):
        paths.add((0, *[rng.randrange(3) for _ in range(rng.randint(1, 6))]))
    chains = sorted({p[:d] for p in paths for d in range(1, len(p) + 1)})
    number = {c: i for i, c in enumerate(chains)}
    convs = {p: i for i, p in enumerate(sorted(paths, key=lambda p: rng.random()))}
    smallest = {c: min(convs[p] for p in paths if p[: len(c)] == c) for c in chains}
    leaf = {c: not any(len(d) > len(c) and d[: len(c)] == c for d in chains) for c in chains}
    rows = [([(number[p[:d]], 0, smallest[p[:d]], 10**19 + number[p[:d]], leaf[p[:d]]) for d in range(1, len(p) + 1)], convs[p]) for p in sorted(paths)]
    for cuts in ([], [1], [7, 8, 30], list(range(1, len(rows)))):
        sums = {}
        for first, end in zip([0, *cuts], [*cuts, len(rows)]):
            for k1, _, leaves, saved in trie.shard_parts(rows[first:end]):
                a, b = sums.get(k1, (0, 0))
                sums[k1] = a + leaves, b + saved
        for c in chains:
            below = [d for d in chains if d[: len(c)] == c]
            assert sums[number[c]] == (sum(leaf[d] for d in below), sum(10**19 + number[d] for d in below))
