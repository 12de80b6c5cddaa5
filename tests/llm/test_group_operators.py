"""Operators on groups of rows, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from flowtide.llm import compact_windows, graph, importance, lattice, line_dedup, simhash


def find_all(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)] + [(5, 5)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in find_all(nodes, [p for p in links if p[0] != p[1]]).items()}


def fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    rnd = random.Random(1)
    vocab = [f"Wörd{k}" for k in range(50)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(200)) for _ in range(30)]
    for base in texts[:6]:
        for _ in range(8):
            words = base.split()
            words[rnd.randrange(200)] = rnd.choice(vocab)
            texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "One two", texts[0]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, _text int")
    prints = simhash.fingerprints(docs)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(prints).collect()}
    want = [fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(want)) for b in range(a) if (want[a] ^ want[b]).bit_count() <= 3]
    roots = find_all(range(len(want)), links)
    assert got == {k: (want[k], roots[k]) for k in range(len(want))}
    assert len(set(roots.values())) < len(texts) - 20
    assert simhash.classes(prints.limit(0)).count() == 0


def test_simhash_links_at_each_distance(spark):
    rnd = random.Random(2)
    values = []
    for _ in range(150):
        base = rnd.getrandbits(64)
        for k in range(6):
            values.append(base ^ sum(1 << b for b in rnd.sample(range(64), k)))
    values += [0, 1, 1 << 63, 2**64 - 1]
    rows = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in enumerate(values)] + [(None, 0)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(rows).collect()}
    links = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    assert got == find_all(range(len(values)), links) | {None: len(values) - 4}


def jaccard(a, b, size=5):
    x, y = (set(simhash.shingles(t or "", size)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group(spark):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(150)) for _ in range(40)]
    for base in texts[:10]:
        for changes in (0, 1, 1, 2):
            words = base.split()
            for _ in range(changes):
                words[rnd.randrange(150)] = "new"
            texts.append(" ".join(words))
    texts += [None, "", "a b", "a b", "a c"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(k, texts[k], "s", "u") for k in order], "doc_id long, text string, _n string, t string")
    stay = simhash.one_of_each(docs)
    got = sorted(r.doc_id for r in stay.collect())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    assert stay.columns == docs.columns
    assert got == sorted(set(find_all(range(len(texts)), links).values()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def without_repeats(texts, least=2, words=50):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for i in range(len(full) - least + 1):
            run = tuple(lines[k].strip(" \t\n\r\x0b\x0c") for k in full[i : i + least])
            if run in seen:
                gone.update(full[i : i + least])
            seen.add(run)
        for k in full:
            line = lines[k].strip(" \t\n\r\x0b\x0c")
            if len(re.findall("[^\x20\x09-\x0D]+", line)) >= words:
                if (line,) in seen:
                    gone.add(k)
                seen.add((line,))
        out.append((t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), sorted(gone)))
    return out


@pytest.mark.parametrize("gram, window", [(1, 2), (2, 3), (1, 1)])
def test_line_dedup(spark, gram, window):
    rnd = random.Random(4)
    texts = ["\n".join(rnd.choice(["a", "b ", " b", "c", "d", "", " "]) + str(rnd.randrange(2)) * rnd.randrange(2) for _ in range(rnd.randrange(14))) for _ in range(60)]
    texts += [None, "", "x\nx\nx\nx\nx", "\n\n", "a", "q\nr\ns\nt", "q\nr\ns\nt", "line\n" * 300]
    docs = spark.createDataFrame([(k, t, "s", 3) for k, t in enumerate(texts)], "doc_id long, text string, _n string, removed int")
    got = line_dedup.dedup(docs.drop("removed"), gram=gram, window=window).orderBy("doc_id").collect()
    assert [(r.text, r.removed) for r in got] == without_repeats(texts, gram + window - 1)
    assert all(r["_n"] == "s" for r in got)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_single_long_lines(spark):
    long, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49))
    texts = [long, f"a\n {long}\nb", long, f"c\n{other}\nd", f"{other}\ne", f"{long} x", f"f\n{long}\n{long}", "\t" + "y " * 70 + "\ng\n" + "y " * 70]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.text, r.removed) for r in line_dedup.dedup(docs).orderBy("doc_id").collect()]
    assert got == without_repeats(texts) and [r for _, r in got] == [[], [1], [0], [], [], [], [1, 2], [2]]


def test_winnowing_keeps_the_rightmost_least(spark):
    from pyspark.sql import functions as F

    for hashes, window, want in (([3, 1, 1, 2], 2, {2, 1}), ([5, 4, 3], 2, {1, 2}), ([7], 3, {0}), ([1, 1, 1, 1], 2, {1, 2, 3})):
        row = spark.createDataFrame([(hashes,)], "h array<int>").select(line_dedup.fingerprints(F.col("h"), window).alias("f")).first()
        assert set(row.f) == want


def unit_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")


def test_lattice_links(spark):
    draw = np.random.default_rng(1)
    rows = [draw.standard_normal(64).astype("f4") for _ in range(150)]
    for base in rows[:40]:
        for cosine in (0.999, 0.98, 0.96, 0.94):
            noise = draw.standard_normal(64)
            noise -= noise @ base * base / (base @ base)
            rows.append((cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)).astype("f4") * 3)
    rows += [rows[0], 2 * rows[0], rows[5]]
    table = [(k, v.tolist(), "n") for k, v in enumerate(rows)]
    odd = [(900, None, "n"), (901, [0.0] * 64, "n"), (902, [float("nan")] + [1.0] * 63, "n"), (903, [None] + [1.0] * 63, "n"), (904, [float("inf")] * 64, "n"), (905, [], "n")]
    got = {r.vec_id: r for r in lattice.near_duplicates(unit_rows(spark, table + odd)).collect()}
    x = np.array([v.astype(float) / np.linalg.norm(v.astype(float)) for v in rows])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = list(zip(*np.nonzero(near)))
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * len(links) and all(got[k].n_links <= near[k].sum() for k in range(len(rows)))
    roots = find_all(range(len(rows)), [(int(a), int(b)) for a, b in links])
    assert sum(got[k].component_id == roots[k] for k in roots) >= 0.98 * len(roots)
    for k in range(900, 906):
        assert tuple(got[k]) == (k, 0, k, True)
    assert lattice.near_duplicates(unit_rows(spark, table).limit(0)).count() == 0


def test_lattice_decoder_against_all_points_nearby():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((300, 8)) * 1.5
    point = lattice.nearest(x)
    doubled = np.rint(2 * point).astype(int)
    assert (np.abs(2 * point - doubled) < 1e-9).all()
    assert all(len(set(d % 2)) == 1 and d.sum() % 4 == 0 for d in doubled)
    best = ((x[:, None] - point[:, None] - lattice.ROOTS[None]) ** 2).sum(-1).min(1)
    assert (((x - point) ** 2).sum(-1) <= best + 1e-9).all() and (((x - point) ** 2).sum(-1) <= 1 + 1e-9).all()
    assert len(lattice.ROOTS) == 240


def test_compact_windows_of_arrays():
    draw = np.random.default_rng(3)
    for _ in range(300):
        n, least = int(draw.integers(1, 60)), int(draw.integers(1, 12))
        v = draw.integers(1, int(draw.choice([3, 10, 1000])), n).astype(np.uint64)
        found = {c: (a, b) for a, c, b in compact_windows.compact_windows(v, least)}
        for c, (a, b) in found.items():
            assert v[a : b + 1].min() == v[c] and (a == 0 or v[a - 1] < v[c]) and (b == n - 1 or v[b + 1] < v[c])
        for i in range(n - least + 1):
            for j in range(i + least - 1, n):
                assert any(i <= c <= j and v[c] == v[i : j + 1].min() for c in found)


def test_repeated_passages(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(80)]
    changed = passage[:40] + ["other"] + passage[41:]
    texts = [" ".join([word() for _ in range(100)] + body + [word() for _ in range(100)]) for body in ([], passage, passage, changed, passage[:30], [])]
    texts += [None, "", "short", texts[0], " ".join(["spam"] * 3000), "long " * 2 + " ".join(word() for _ in range(20_000))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, r int")
    got = {(r.doc_id, r.source_doc_id): r.passages for r in compact_windows.repeated_passages(docs.coalesce(1)).collect()}
    assert set(got) == {(2, 1), (3, 1), (9, 0)}
    p = got[2, 1][0]
    assert texts[2][p.start : p.stop].split() == passage and texts[1][p.source_start : p.source_stop].split() == passage
    assert p.first_word == 100 and p.n_words == 80 and p.similarity == 1.0
    p = got[3, 1][0]
    assert p.n_words == 80 and 0.8 <= p.similarity < 1
    assert compact_windows.repeated_passages(docs.limit(0)).count() == 0


def test_importance_sample(spark):
    rnd = random.Random(6)
    good, bad = [f"good{k}" for k in range(40)], [f"bad{k}!!" for k in range(40)]
    rows = [(k, " ".join(rnd.choice(bad if k % 4 == 0 else good) for _ in range(60)), "n") for k in range(400)] + [(1000, None, "n"), (1001, "", "n")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 400, 3)] + [(None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    out = importance.resample(docs, labels, share=0.7)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "_n", "log_weight", "gumbel_key", "selected"]
    assert sum(r.selected for r in got.values()) == -(-7 * len(rows) // 10)
    assert not any(got[k].selected for k in range(0, 400, 4)) and got[1000].log_weight == 0.0
    cut = min(r.gumbel_key for r in got.values() if r.selected)
    assert all(r.selected == (r.gumbel_key >= cut) for r in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.log_weight == 0 for r in importance.resample(docs, none).collect())
    assert importance.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("values", ["spread", "equal", "two"])
def test_top_refines_and_breaks_ties(spark, values, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 5)
    monkeypatch.setattr(importance, "BINS", 4)
    rnd = random.Random(7)
    value = {"spread": lambda: rnd.gauss(0, 1), "equal": lambda: 1.0, "two": lambda: float(rnd.randrange(2))}[values]
    rows = [(k, value()) for k in range(300)]
    got = {r.n for r in importance.top(spark.createDataFrame(rows, "n long, v double"), "v", 77, "n").where("selected").collect()}
    assert got == {k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:77]}
