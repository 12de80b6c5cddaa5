"""What the stages of the pipeline leave on disk and shuffle."""

from __future__ import annotations

import os
import random

import pytest
from flowtide.llm import common, line_dedup, simhash
from pyspark.sql import functions as F


def test_line_dedup_keeps_only_what_its_result_reads(spark, monkeypatch):
    made = []
    keep = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    docs = spark.createDataFrame([(1, "a b\nc d\ne f"), (2, "x\na b\nc d\ny"), (3, None)], "doc_id long, text string")
    found = line_dedup.dedup(docs)
    assert {name for name, table in made if os.path.exists(table.stored_at)} == {"rows", "removed"}
    assert [r.text for r in found.orderBy("doc_id").collect()] == ["a b\nc d\ne f", "x\ny", None]


def test_texts_of_unlike_pairs_are_not_shuffled(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda k: f"w{rnd.randrange(10**6)}"
    common = [word(0) for _ in range(60)]  # a passage that all share, of texts that are not alike
    texts = [" ".join([*common, *map(word, range(100))]) for _ in range(40)]
    texts += [texts[0] + " end", texts[1] + " end"]
    compared = []
    alike = simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.one_of_each(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert 2 <= sum(compared) <= 4


def test_parities_never_part_similar_sets():
    rnd = random.Random(8)
    for _ in range(300):
        runs = [rnd.randbytes(8) for _ in range(rnd.randrange(0, 3000))]
        other = [r for r in runs if rnd.random() > 0.1] + [rnd.randbytes(8) for _ in range(rnd.randrange(0, 20))]
        prints = []
        for some in (runs, other):
            seen = []
            simhash.votes(some, 1, seen)
            prints.append(int.from_bytes(simhash._parities(seen)))
        assert (prints[0] ^ prints[1]).bit_count() <= len(set(runs) ^ set(other))


def stored_docs(spark, folder, files=3):
    """The same texts as rows and as a table of several files."""
    common = " ".join(f"w{k}" for k in range(80))
    rows = [(k % 7, f"{common}\nline {k // 2} a\nline {k // 2} b") for k in range(40)] + [(None, None), (None, ""), (9, "x y"), (9, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


@pytest.mark.parametrize(("module", "work", "left"), [(line_dedup, line_dedup.dedup, {"removed"}), (simhash, simhash.one_of_each, {"gone"})])
def test_files_are_read_again_and_not_copied(spark, monkeypatch, tmp_path, module, work, left):
    made = []
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    docs = stored_docs(spark, tmp_path / "docs")
    found = work(docs).collect()
    assert {name for name, table in made if os.path.exists(table.stored_at)} & {"rows", "prints", "distinct", "wide", "shared", "named", "stay", *left} == left
    if module is simhash:
        return
    # An input that is no table of files gives the same rows.
    same = work(spark.createDataFrame(docs.orderBy(docs.metadataColumn("_metadata")["file_path"]).collect(), docs.schema).coalesce(1)).collect()
    assert sorted(map(str, found)) == sorted(map(str, same))


def test_numbers_follow_files_and_places(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "a b%20c"))
    table = spark.read.parquet(str(tmp_path / "a b%20c"))
    rows = common.numbered(table.where("id > 10").select("id"), "n")
    own = {r.id: r.n for r in rows.collect()}
    assert own == {r.id: r.n for r in rows.repartition(3).collect()} and len(set(own.values())) == 989
    assert {n >> 40 for n in own.values()} == set(range(5)) and rows.columns == ["id", "n"]


def test_only_plain_files_are_numbered_in_place(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert common._is_scan(table) and common._is_scan(table.where("id > 3").selectExpr("id + 1 as k"))
    for other in (table.withColumn("k", F.rand()), table.limit(5), table.union(table), table.distinct(), table.join(table, "id"), spark.range(3)):
        assert not common._is_scan(other)
        assert common.numbered(other, "n").select("n").distinct().count() == other.count()


def test_workers_let_go_of_what_later_steps_do_not_use():
    get = common.held(lambda k: [k])
    one = common.begun(lambda: get(1))
    assert common.begun(lambda: get(2)) == [2] and get(1) is one
    common.begun(lambda: None)
    assert not common._held and get(1) is not one
