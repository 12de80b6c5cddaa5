"""The near-copy stage against brute force where SimHash alone misses pairs: shared templates, short texts, pairs near the threshold."""

import random

from flowtide.llm import simhash
from test_group_operators import find_all, jaccard


def stays(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.one_of_each(docs).collect()}


def wanted(texts):
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    return set(find_all(range(len(texts)), links).values()), links


def test_copies_among_texts_of_one_template(spark):
    rnd = random.Random(30)
    word = lambda: f"w{rnd.randrange(10**6)}"
    template = [word() for _ in range(200)]
    texts = []
    for _ in range(100):
        body = [word() for _ in range(30)]
        other = [*body[:10], *[word() for _ in range(15)], *body[25:]]
        texts += [" ".join(template + body), " ".join(template + other)]
    want, links = wanted(texts)
    assert len(links) == len(want) == 100
    assert stays(spark, texts) == want


def test_short_texts_and_pairs_at_the_threshold(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for size in (4, 8, 40, 100, 250):  # shingles of the shorter text; the longer one has a quarter more, a similarity of 0.8
        for _ in range(20):
            body = [word() for _ in range(size // 4 + size + 4)]
            texts += [" ".join(body[: size + 4]), " ".join(body)]
    texts += ["one", "One ", "two", "a b c d e", "a b c d f", None, ""]
    want, links = wanted(texts)
    assert len(links) == 102
    assert stays(spark, texts) == want
