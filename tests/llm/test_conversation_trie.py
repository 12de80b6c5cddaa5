"""The trie of conversations against a dictionary of prefixes, and its query against SQL."""

import hashlib
import random
import re
import zlib

import pytest
from flowtide.llm import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, depth int"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    below = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    out = set()
    for p, members in nodes.items():
        tree, leaves, saved = [p], 0, 0
        while tree:
            q = tree.pop()
            tree += below[q]
            leaves += not below[q]
            saved += (len(nodes[q]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), up, len(members), len(below[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    got = conversation_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, convs, turns, kinds):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rnd.randrange(1, turns + 1)):
            rows.append((c, t, rnd.choice("ab"), f"Say {rnd.randrange(kinds)}  \t again", "k", 1))
    return rows


@pytest.mark.parametrize(("turns", "kinds"), [(6, 1), (5, 2), (3, 40)])
def test_random(spark, turns, kinds):
    rows = made(kinds, range(3, 240), turns, kinds)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_copies_over_many_shards(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} of {c % 9}", "", 0) for c in range(1, 120) for t in range(1 + c % 4)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_odd_rows(spark):
    rows = [
        (None, 1, "a", "x", "", 0), (21, None, None, None, "", 0), (21, None, "a", "y", "", 0), (21, 0, "a", "z", "", 0),
        (5, 1, "", "", "", 0), (5, 1, "", "", "", 0), (-7, 3, "u", "long " * 50_000, "", 0), (40, 2, "u", "1 2", "", 0),
        (41, 2, "u", "1 2", "", 0), *[(100, t, "u", f"{t % 3}", "", 0) for t in range(1500)],
        *[(101, t, "u", f"{t % 3}", "", 0) for t in range(1500)],
    ]
    assert found(spark, [r for r in rows if r[0] not in (100, 101)]) == plain([r for r in rows if r[0] not in (100, 101)])
    deep = found(spark, rows)
    assert max(r[1] for r in deep) == 1500 and min(r[5] for r in deep) == 1
    assert found(spark, []) == set() == found(spark, rows[:1])


def test_ends_in_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rows = [r for r in conversation_trie.shard_rows([([], [], list(range(10))), ([7], [2], [11])], 4) if r["kind"] == conversation_trie.ENDS]
    assert [r["convs"] for r in rows] == ["0,1,2", "3,4,5", "6,7,8", "9", "11"] and len({r["key"] for r in rows}) == 2
    step, finish = conversation_trie._digests()
    batch = pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in ("key", "shard", "chunk", "convs")})
    got = [*step(batch), *finish()]
    assert [g["ends_sha256"][0] for g in got] == [hashlib.sha256(x.encode()).hexdigest() for x in ("0,1,2,3,4,5,6,7,8,9", "11")]


def test_ternary_tree():
    rnd = random.Random(4)
    found = sorted({tuple(rnd.randrange(5) for _ in range(rnd.randrange(7))) for _ in range(200)})
    assert sorted(conversation_trie.medians(37)) == list(range(37))
    tree = conversation_trie.TernaryTree()
    for number in conversation_trie.medians(len(found)):
        tree.insert(found[number], [1] * len(found[number]), number)
    assert all(tree.end[tree.path(s)[-1]] == k for k, s in enumerate(found))
    seen = set()
    for node in tree.walk():
        assert node == 0 or tree.above[node] in seen
        seen.add(node)
    assert len(seen) == len(tree.key) == len({s[:d] for s in found for d in range(len(s) + 1)})


def test_query_against_sql(spark, sf):
    from flowtide.llm.q_trie import SQL, op11_conversation_trie
    from harness.check import compare, connect

    assert compare(spark, connect(sf), op11_conversation_trie, SQL, sf)[0] == ""
