"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from flowtide.llm import bwt_dedup

SCHEMA = "doc_id long, text string, body int, Spans string, n_bytes string"


def plain(rows, size=50):
    first = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        for s in range(len(data) - size + 1) if doc is not None else ():
            w = data[s : s + size]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - size + 1) if doc is not None else ():
            if first[data[s : s + size]] < doc:
                gone[s : s + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    got = bwt_dedup.dedup(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "body", "Spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    rows = got.collect()
    for r in rows:
        assert r["n_bytes"] - r["n_removed"] == sum(k["b"] - k["a"] for k in r["kept"])
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)


def row(doc, text):
    return (doc, text, 1, "s", "n")


def texts_with_repeats(seed, docs, alphabet):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(20, 200))) for _ in range(8)]
    texts = []
    for _ in range(docs):
        parts = []
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            parts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))), p[rnd.randrange(10) :]]
        texts.append("".join(parts))
    texts += texts[:5] + [t[3:] + "x" for t in texts[:5]]
    return texts


@pytest.mark.parametrize(("alphabet", "hot"), [("abcdefgh", 10_000), ("aé", 10_000), ("abñ", 2)])
def test_random(spark, monkeypatch, alphabet, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    texts = texts_with_repeats(len(alphabet), 60, alphabet)
    ids = list(range(1, 5 * len(texts), 5))
    random.Random(2).shuffle(ids)
    rows = [row(k, t) for k, t in zip(ids, texts)]
    want = plain(rows)
    assert found(spark, rows) == want and sum(r[2] > 0 for r in want) > 20


def test_odd_rows(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("xyz ") for _ in range(300))
    rows = [
        row(None, long), row(3, None), row(4, ""), row(5, "short"), row(6, long[:49]), row(7, long[:50]), row(8, long), row(8, long),
        row(8, "a" * 70), row(9, "a" * 200), row(2, "a" * 49), row(-1, long[100:160]), row(10, "b" * 400 + long[20:90]), row(11, "é" * 30),
        row(12, "x" + "é" * 30),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    word = "".join(rnd.choice("abcdef") for _ in range(5000))
    long = "".join(rnd.choice("abcdefghij") for _ in range(40_000)) + word + "q" * 3000 + word
    assert found(spark, [row(1, word), row(2, long), row(3, "q" * 60)]) == plain([row(1, word), row(2, long), row(3, "q" * 60)])


@pytest.mark.parametrize("kinds", [1, 2, 5, 200])
def test_common_prefixes(kinds):
    rng = np.random.default_rng(kinds)
    symbols = rng.integers(1, kinds + 1, 400).astype(np.int16)
    symbols[::37] = 0
    order = bwt_dedup.sorted_suffixes(symbols, 9)
    around = [bytes(np.roll(symbols, -k).astype(np.uint8)) for k in order]
    assert all(a[:9] <= b[:9] for a, b in zip(around, around[1:]))
    got = bwt_dedup.common_prefixes(symbols, order, 9)
    for k in range(1, 400):
        a, b = around[k - 1], around[k]
        same = next((i for i in range(9) if a[i] != b[i]), 9)
        assert got[k] == (-1 if same == 9 else same)


def test_spots_in_blocks(monkeypatch):
    texts = [t.encode() for t in texts_with_repeats(3, 40, "abc")]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    for block in (70, 1 << 16):
        monkeypatch.setattr(bwt_dedup, "BLOCK", block)
        bwt_dedup._powers.cache_clear()
        starts, pieces = [], {}
        for text, start, n, gram, piece in (s for many in bwt_dedup.spots(data, ends) for s in zip(*many)):
            assert start + n + 49 <= ends[text] and start >= ends[text] - len(texts[text])
            starts += range(start, start + n)
            body = bytes(data[start : start + n + 49])
            assert pieces.setdefault((gram, piece), body) == body
        want = [s for e, t in zip(ends, texts) for s in range(e - len(t), e - 49)]
        assert starts == want and len(set(pieces.values())) == len(pieces)


def test_transforms_are_cut_between_grams(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 100)
    rnd = random.Random(6)
    base = ["".join(rnd.choice("ab") for _ in range(70)).encode() for _ in range(4)]
    rows = [(g, k, 20, g * 10 - k, base[g][:69]) for g in range(4) for k in (2, 1, 0)]
    rows += [(5, k, 1, k, b"z" * 50) for k in range(3, 6)]
    columns = {n: list(c) for n, c in zip(("gram", "piece", "n", "least", "body"), zip(*rows))}
    step, flush = bwt_dedup._shard()
    out = [*step(pa.RecordBatch.from_pydict(columns)), *flush()]
    assert len(out) == 5
    got = {(g, p): r for part in out for g, p, r in zip(part["gram"], part["piece"], part["runs"])}
    whole = {(g, k): [{"a": 0, "b": 20}] for g in range(4) for k in (1, 0)}
    assert got == whole | {(5, k): [{"a": 0, "b": 1}] for k in (4, 5)}


def test_least_places():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 3, 8, 31):
        got = bwt_dedup.least_places(hashes, width)
        assert len(got) == 501 - width and all(got[s] == s + int(np.argmin(hashes[s : s + width])) for s in range(len(got)))


def test_query_against_sql(spark, sf):
    from flowtide.llm.q_strings import SQL, op12_string_dedup
    from harness.check import compare, connect

    assert compare(spark, connect(sf), op12_string_dedup, SQL, sf)[0] == ""
