"""Operators that work on each text by itself, against brute force."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from flowtide.llm import bpe, brown, decontaminate, html_text, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, _text string, ids string, n_tokens long"


@pytest.fixture(scope="module")
def coder():
    return bpe.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 7) for k, t in enumerate(texts)], DOCS)


def test_bpe_equals_the_library(coder, library):
    rnd = random.Random(1)
    letters = "ab'sS \t\n\r\x1c\x1d\x85\xa0 　ßé1²½中文🙂<|endoftext|>____----'ll've\x00\x0b"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert coder.encode(text) == library.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_bpe_long_pieces(coder, library):
    rnd = random.Random(2)
    for text in ("a" * 20_000, "".join(rnd.choice("abcdefgh") for _ in range(20_000)), " " * 3000 + "x"):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_bpe_pairs_by_definition(coder):
    rnd = random.Random(3)
    for _ in range(3000):
        a, b = rnd.randrange(50_000), rnd.randrange(50_000)
        assert coder.compatible(a, b) == (coder.merges(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b])


def test_bpe_frames(spark, library):
    texts = ["Hello world", None, "", "Hello world", "ünïcode " * 2000]
    got = bpe.decode(bpe.encode(docs_of(spark, texts), PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert r.ids == library.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    rows = bpe.round_trip(docs_of(spark, texts), PATH, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        ids = library.encode_ordinary(t or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs_of(spark, []).limit(0), PATH, PATTERN).count() == 0


ITEM = "One two, three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("size", [10**9, 60])
def test_contamination(spark, size):
    texts = [f"start {ITEM.upper()}! end", "one two three", None, "", "Ünï 7 again Ünï 7", ITEM[:-7] + " other", "zwei drei"]
    bench = spark.createDataFrame(
        [(1, ITEM), (1, ITEM), (2, "ünï 7"), (3, None), (4, "..."), (None, "zwei drei"), (10, "Zwei Drei")], "item_id long, text string"
    )
    got = decontaminate.find(docs_of(spark, texts), bench, automaton_bytes=size).orderBy("doc_id").collect()
    hit = [sum(h["last"] - h["first"] + 1 for h in r.hits) for r in got]
    assert [r.n_words for r in got] == [14, 3, 0, 0, 5, 12, 2]
    # Ü is no A-Z, so it keeps its case.
    assert hit == [12, 0, 0, 0, 0, 11, 2]
    assert [r["items"] for r in got] == [["1"], [], [], [], [], ["1"], ["10"]]
    h = got[0].hits[0]
    assert texts[0][h.start : h.stop] == ITEM.upper()
    assert got[0]._text == "x" and got[0].ids == "y"


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in decontaminate.find(docs_of(spark, [ITEM]), none).collect()] == [[]]
    assert decontaminate.find(docs_of(spark, []).limit(0), none).count() == 0


PAGES = {
    "<html><body><nav><a href=a>Menu</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<p>Four</article><footer>f</footer>": "A & B\nOne two three\nFour",
    "<body><div class='cookie-notice'>We use</div><div id=main><p>Text of some length here.</p><p>More text of it.</p><form>Name</form></div>"
    "<div class=comments><p>A long comment that goes on and on and on.</p></div></body>": "Text of some length here.\nMore text of it.",
    "<article><header><h1>T</h1></header><script>var x = '<p>no</p>';</script><style>p{}</style><!-- no --><p>x&nbsp;y<br>z</p><aside>no</aside></article>": "T\nx y z",
    "plain &lt;text&gt;": "plain <text>",
    "<p>cut <b>off": "cut off",
    "<p>cut <foot": "cut",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_article(page):
    assert html_text.article(page) == PAGES[page]


def test_article_one_long_paragraph_among_links():
    links = "".join(f"<li><a href={k}>A link with many words in it {k}</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{'word ' * 80}</p><p>{'term ' * 60}</p></div></body>"
    assert html_text.article(page) == ("word " * 80).strip() + "\n" + ("term " * 60).strip()


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<a b='" * 20_000, "<" * 50_000, "<!--" * 20_000, "<b>" * 10_000 + "</i><p></p>" * 10_000])
def test_odd_pages_take_linear_time(page):
    html_text.article(page)


def test_extract_frames(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "s"), (2, None, "s"), (2, "", "s")], "page_id long, html string, _source string")
    assert [(r.page_id, r.text, r._source) for r in html_text.extract(pages).orderBy("page_id").collect()] == [(1, "a", "s"), (2, "", "s"), (2, "", "s")]


def chain_by_hand(model, grades):
    """Marginals by summing over all state sequences."""
    total, one = 0.0, [0.0] * len(grades)
    for states in range(1 << len(grades)):
        s, w, before = [states >> k & 1 for k in range(len(grades))], 0.0, 0
        for k, x in enumerate(s):
            w += {(0, 0): 0, (0, 1): model.moves[0], (1, 0): model.moves[1], (1, 1): model.moves[2]}[before, x]
            if x:
                get = lambda i: grades[i] if 0 <= i < len(grades) else 0
                w += model.own[grades[k]] + model.before[get(k - 1)] + model.after[get(k + 1)]
            before = x
        total += math.exp(w)
        for k, x in enumerate(s):
            one[k] += x * math.exp(w)
    return [o / total for o in one]


def test_marginals_by_hand():
    model = toxicity.Model({}, [-3, 0.5, 1, 2], [0, 0.3, 0.2, -0.4], [0, 0.1, 0.6, 0.2], [-1, 0.4, 0.7], [0] * 5)
    rnd = random.Random(4)
    for _ in range(60):
        grades = [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(rnd.randint(1, 10))]
        want = chain_by_hand(model, grades)
        for k, p in model.marginals(len(grades), [(k, g) for k, g in enumerate(grades) if g]):
            assert p == pytest.approx(want[k], rel=1e-9)


def test_toxicity_learns_and_leaves_out(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = [rnd.choice("alpha beta gamma delta omega kappa lambda sigma".split()) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["vilest", "grubby"])
        rows.append((k, " ".join(words), "z"))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, "z"), (9999, "", "z")], "doc_id long, text string, _text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k].score >= toxicity.THRESHOLD) == bool(truth[k]) for k in held) >= 0.98 * len(held)
    assert {got[0]["_text"], got[9999]["_text"]} == {"z"} and got[9999].spans == [] and 0 <= got[None].score <= 1
    for k in held:
        for s in got[k].spans:
            assert rows[k][1][s.start : s.stop] in ("vilest", "grubby")
    assert len(held) > 100 and not any(toxicity.score(docs.limit(0), model).collect())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.01 for r in toxicity.score(docs, toxicity.train(docs, none)).collect())


def test_language_model_base_and_norm(spark):
    rnd = random.Random(6)
    vocab = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rnd.choice(vocab[: 10 + k % 20]) for _ in range(20)) + (f" rare{k}" if k % 3 == 0 else "")) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "UNSEEN Word w1")]
    got = {r.doc_id: r for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {k: re.findall("[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"] for k, t in rows}
    count: dict[str, int] = {}
    for k, ws in tokens.items():
        if zlib.crc32(str(k).encode()) % 10:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for k, ws in tokens.items():
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[k]
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.train_tokens == n and r.n_tokens == len(ws)
        assert r.n_known == sum(w in count for w in ws) and r.held_out == (zlib.crc32(str(k).encode()) % 10 == 0) and r.score < 0


def test_language_model_sums_to_one(spark, monkeypatch):
    """After any class, all seen words, the unseen word of each class and the end have probability one in total."""
    monkeypatch.setattr(brown, "HEAD", 5)
    rows = spark.createDataFrame([(" ".join(f"w{k % m}" for k in range(25)),) for m in range(1, 12)], "text string")
    from flowtide.llm.common import stored

    counts = stored(brown.count_words(rows), "counts")
    m = brown.train(rows, counts)
    emitted = [0.0] * brown.CLASSES
    for r in counts.collect():
        c = m.of[m.units.of(bytes(r.w))]
        emitted[c] += 10 ** (math.log10(r.c) + m.seen[c])
    for before in range(brown.CLASSES):
        total = sum(10 ** m.moves[before, c] * (emitted[c] + (10 ** m.unseen[c] if c else 0)) for c in range(brown.CLASSES) if emitted[c])
        left = sum(10 ** m.moves[before, c] for c in range(brown.CLASSES) if not emitted[c])
        assert total + left == pytest.approx(1.0, abs=1e-6)


def test_exchange_finds_planted_classes(spark):
    """Two kinds of words that strictly alternate end up apart."""
    rnd = random.Random(7)
    rows = spark.createDataFrame(
        [(" ".join(rnd.choice(["a", "b", "c"] if k % 2 else ["x", "y", "z"]) for k in range(30)),) for _ in range(100)], "text string"
    )
    units = brown.Units({w: k for k, w in enumerate([brown.END, b"a", b"b", b"c", b"x", b"y", b"z"])}, 1)
    of = brown.exchange(brown.count_pairs(rows, units), units, classes=4, rounds=8)
    kinds = {frozenset(of[1:4].tolist()), frozenset(of[4:7].tolist())}
    assert not frozenset.intersection(*kinds) and of[0] == 0


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score(none).count() == 0
