"""Runs of repeated strings in the pieces of a shard, by both ways to follow the intervals."""

from __future__ import annotations

import random

import pytest

from flowtide.llm import bwt_dedup as bwt


def expected(pieces, docs):
    least = {}
    for piece, doc in zip(pieces, docs):
        for k in range(len(piece) - bwt.LENGTH + 1):
            string = piece[k : k + bwt.LENGTH]
            least[string] = min(doc, least.get(string, doc))
    out = []
    for number, (piece, doc) in enumerate(zip(pieces, docs)):
        flags = [least[piece[k : k + bwt.LENGTH]] < doc for k in range(len(piece) - bwt.LENGTH + 1)]
        edges = [k for k in range(len(flags) + 1) if (k > 0 and flags[k - 1]) != (k < len(flags) and flags[k])]
        if edges:
            out.append((number, [{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2])]))
    return out


@pytest.mark.parametrize("many", [0, 1, 6, 10**9])
def test_runs_of_pieces(monkeypatch, many):
    monkeypatch.setattr(bwt, "MANY", many)  # 0: all intervals by themselves; a great number: all place by place
    rng = random.Random(7)
    source = bytes(rng.choices(b"ab\x00\xff", k=400))
    pieces = []
    for _ in range(60):
        at = rng.randrange(300)
        piece = bytearray(source[at : at + rng.randrange(50, 81)])
        if rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = 120
        pieces.append(bytes(piece))
    docs = [rng.randrange(20) for _ in pieces]
    found = list(bwt.runs_of_pieces(pieces, docs))
    assert found == expected(pieces, docs) and len(found) > 10
    assert list(bwt.runs_of_pieces(pieces[:1], docs[:1])) == []


def test_unique_ids_need_no_digest_and_no_sort(spark, monkeypatch):
    made = {}
    keep = bwt.stored
    monkeypatch.setattr(bwt, "stored", lambda df, name: made.setdefault(name, df) and keep(df, name))
    text = "".join(chr(33 + k * k % 90) for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, None)], "doc_id long, text string")
    assert [r.n_removed for r in bwt.dedup(docs).orderBy("doc_id").collect()] == [0, 200, 0]
    assert "mark" not in made["spots"].columns
    assert "SortAggregate" not in made["pieces"]._jdf.queryExecution().executedPlan().toString()
