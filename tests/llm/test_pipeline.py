"""The pipeline's stages on the small tables, each against a plain version of its own decision."""

import zlib

import corpus_pipeline
import pytest
from flowtide.llm import bpe, decontaminate, simhash, toxicity
from flowtide.llm import queries as llm
from flowtide.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents").cache()
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        docs.count()
        out.append((name, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages] == ["documents", "toxicity", "line_dedup", "simhash", "decontaminate", "bpe"]
    assert all(d.columns == COLUMNS for _, d in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    model = toxicity.train(stages[0][1], table(spark, sf, "labels"))
    assert set(after) == {k for k, r in before.items() if model.document(r.text or "")[0] < toxicity.THRESHOLD}
    assert all(after[k] == before[k] for k in after)


def test_repeated_lines_go(stages):
    from test_group_operators import without_repeats

    before, after = rows(stages[1][1]), rows(stages[2][1])
    keys = sorted(before)
    want = {k: t for k, (t, gone) in zip(keys, without_repeats([before[k].text for k in keys])) if not gone or t.strip()}
    assert {k: r.text for k, r in after.items()} == want
    assert all(r.n_chars == (before[k].n_chars if r.text == before[k].text else len(r.text)) for k, r in after.items())


def test_near_copies_go(stages):
    from test_group_operators import find_all

    before, after = rows(stages[2][1]), rows(stages[3][1])
    sets = {k: set(simhash.shingles(r.text or "", 5)) for k, r in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(after) == set(find_all(sets, links).values())


def test_contaminated_documents_go(spark, sf, stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    runs = set()
    for r in table(spark, sf, "benchmark").collect():
        w = decontaminate.words(r.text or "")
        runs |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    size = {len(x) for x in runs}

    def clean(text):
        w = decontaminate.words(text or "")
        return not any(tuple(w[i : i + n]) in runs for n in size for i in range(len(w) - n + 1))

    assert set(after) == {k for k, r in before.items() if clean(r.text)} and len(after) < len(before)


def test_tokens_decode(stages):
    before, after = rows(stages[4][1]), rows(stages[5][1])
    coder = bpe.load(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN)
    assert set(after) == set(before)
    for k, r in after.items():
        assert r.decoded and r.n_tokens == len(r.ids) and coder.decode(r.ids) == before[k].text.encode()


def test_run_is_the_chain_of_stages(spark, sf, stages):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(stages[-1][1].collect())


def test_stages_of_odd_documents(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b\nc d", "en", None, None)], table(spark, sf, "documents").schema)
    for part in (docs, docs.limit(0)):
        now = part
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
        assert now.count() <= part.count()


@pytest.mark.parametrize("name", sorted(llm.sql()))
def test_query_agrees_with_sql(spark, sf, name):
    from harness import check

    verdict, n = check.compare(spark, check.connect(sf), llm.queries()[name], llm.sql()[name], sf)
    assert verdict == "" and n > 0


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


def test_toxicity_never_learns_from_held_out_rows(spark, sf):
    keys = [r.k for r in toxicity.sample(
        table(spark, sf, "documents"), table(spark, sf, "labels").withColumnRenamed("toxic", "t"), "doc_id", "doc_id", "t", 10**6
    ).selectExpr("text as k").collect()]
    assert keys and all(zlib.crc32(str(k).encode()) % 3 != 1 for k in keys)
