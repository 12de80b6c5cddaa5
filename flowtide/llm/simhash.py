"""SimHash near-duplicates by multi-index hashing (op8).

A fingerprint bit is the majority of that bit among the hashes of a text's shingles. Equal
fingerprints are one row. Two 64-bit fingerprints within three bits agree up to one bit in one half,
so each half is put into a table and looked up with all values of its Hamming ball of radius one;
matches are verified by the complete distance.

In a dense group nearly all pairs match. So pairs within two bits are joined first, without pairs: they
share a value of their balls of radius one over all 64 bits, at most 65 fingerprints share such a
value, and neighbours in that list are linked. The table look-up then skips pairs that are connected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtide.llm.common import hash_sample, numbered, scan, spare, stored, texts
from flowtide.llm.graph import components
from flowtide.session import discard, release

SEED = 42
BLOCK = 8192  # shingles whose bits are counted at once


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words, A-Z in lower case, cut at ASCII white space; a shorter text is one run."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def votes(runs: Sequence[bytes], seed: int, seen: list[np.ndarray] | None = None) -> np.ndarray:
    """For each of 64 bits: twice the number of hashes that have it, less the number of hashes. The hashes are added to ``seen``."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(runs), BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(r, seed) for r in runs[at : at + BLOCK]], "<u8")
        if seen is not None:
            seen.append(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return 2 * total - len(runs)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans, a multiple of 64 long, as signed 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all by default) and fp long. Texts without words, null too, have fingerprint zero."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c != "fp"]
    own = spare(docs, "_text")
    rows = docs.select(*kept, F.col(text).alias(own))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)

    def build():
        def step(batch):
            found = np.stack([votes(shingles(t, size), SEED) > 0 for t in texts(batch, own)])
            yield {c: batch.column(c) for c in kept} | {"fp": pa.array(packed(found)[:, 0])}

        return step

    return scan(rows, build, f"{fields}fp long")


def _ball(value: Column, bits: int, shift: int = 0) -> Column:
    """value and every value that differs from it in one of ``bits`` bits from ``shift`` on."""
    return F.array(value, *[value.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(shift, shift + bits)])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within three bits of each other.

    Every edge is such a pair, and every such pair is joined by edges; not every pair is an edge.
    """
    one = fps.select(F.col(fp).alias("a"))
    value = Window.partitionBy("z").orderBy("a")
    close = (
        one.select("a", F.explode(_ball(F.col("a"), 64)).alias("z"))
        .select("a", F.lag("a").over(value).alias("b")).where("b is not null").distinct()
    )
    close = stored(close, "close")
    known = stored(components(close), "known")
    named = one.join(known, one.a == known.node, "left").select("a", F.coalesce("root", "a").alias("c"))
    named = stored(named, "named")
    half = lambda s: F.shiftrightunsigned("a", 32 * s).bitwiseAND(F.lit((1 << 32) - 1))
    table, probes = (
        named.select("a", "c", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), keys(half(s)).alias("k")) for s in (0, 1)])).alias("h"))
        .select("a", "c", "h.s", F.explode("h.k").alias("k"))
        for keys in (lambda v: F.array(v), lambda v: _ball(v, 32))
    )
    table = table.select(F.col("a").alias("b"), F.col("c").alias("d"), "s", "k")
    far = (
        probes.join(table, ["s", "k"])
        .where((F.col("c") != F.col("d")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3))
        .select("a", "b")
    )
    return close.union(far)


def classes(docs: DataFrame, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(key, fp, component_id), one row per row of docs: the least key reachable over fingerprints within three bits.

    Rows of equal fingerprint are linked, those of empty texts like any other. Keys may repeat; a null
    key is never the least unless its component has no other.
    """
    rows = stored(docs.select(F.col(key), F.col(fp).alias("fp")), "prints")
    reps = stored(rows.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    found = stored(components(links(reps)), "components")
    least = found.join(reps, found.node == reps.fp).groupBy("root").agg(F.min("rep").alias("least"))
    least = stored(found.join(stored(least, "least"), "root").select(F.col("node").alias("fp"), "least"), "labels")
    labels = stored(
        reps.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "labels"
    )
    return rows.join(labels, "fp").select(key, "fp", "component_id")


# Near-duplicates of a given similarity. What agrees in one of SEGMENTS segments of 32 bits of a fingerprint of 256 bits (cut in
# two different ways) is linked first, which is cheap for dense groups; an exact join of the sets of shingles finds all the rest.
SEGMENTS, SHINGLE, SIMILARITY = 16, 5, 0.8
# Differing bits of 256 at a similarity of 0.8: 38 on average, with a deviation of 6. Only the first links look at this.
FARTHEST = 70
_ORDER = np.concatenate([np.arange(256), np.random.default_rng(5).permutation(256)]).reshape(SEGMENTS, 32)
# Shingles that at least OFTEN of about SAMPLE documents hold come last in the order of the exact join (at most MOST of them).
# Any order gives the same pairs; this one only keeps templates and boilerplate out of most prefixes.
SAMPLE, OFTEN, MOST = 10_000, 5, 1_000_000
# Rounds in which what shares a shingle of its prefix is linked to two others only, before all pairs left apart are compared.
STARS = 2


# Bits of the parities of a set. Every element in which two sets differ changes one at most, so sets with more differing parities than
# similar ones have differing elements need not be compared; 128 bytes tell that of nearly all unlike sets of up to 2 000 shingles.
PARITIES = 1024


def _wide_votes(runs: Sequence[bytes], seen: list[np.ndarray] | None = None) -> np.ndarray:
    return np.concatenate([votes(runs, seed, seen if seed == 1 else None) for seed in (1, 2, 3, 4)])


def _parities(hashes: list[np.ndarray]) -> bytes:
    """How many different hashes fall on each of PARITIES places, but for the last bit of these counts forgotten."""
    places = np.unique(np.concatenate(hashes or [np.zeros(0, "<u8")])) % np.uint64(PARITIES)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _words(column: str, bits: int) -> Column:
    """The 64-bit words of a binary column."""
    return F.array(*[F.conv(F.hex(F.substring(column, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(bits // 64)])


def _apart(x: str, y: str) -> Column:
    """In how many bits two arrays of words differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, d: s + d)


def _segments(prints: list[bytes]) -> np.ndarray:
    """A row for each print: its segments, each with its number."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(-1, 32), axis=1, bitorder="little")[:, _ORDER]
    base = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.int64)
    return (np.arange(SEGMENTS, dtype=np.int64) << 32)[None, :] | base


def _met(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of prints (n, fp) to compare first: those that share a segment, each with the least and the greatest n there."""

    def build():
        def step(batch):
            keys = _segments(batch.column("fp").to_pylist())
            yield {"n": np.repeat(batch.column("n").to_numpy(), keys.shape[1]), "k": keys.ravel()}

        return step

    keys = scan(prints.select("n", "fp"), build, "n long, k long")
    ends = keys.groupBy("k").agg(F.min("n").alias("x"), F.max("n").alias("y")).where("x < y")
    ends = stored(ends, "crowded")
    met = keys.join(ends.hint("merge"), "k").select("n", F.explode(F.array("x", "y")).alias("m")).where("n <> m")
    return stored(met.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct(), "met")


def _set_of(text: str, size: int) -> np.ndarray:
    """The hashes of a text's shingles, in order and each once."""
    runs = shingles(text, size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)).view(np.int64))


def _frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents (n, t) hold, by a sample, and their counts there."""

    def build():
        def step(batch):
            yield {"k": np.concatenate([_set_of(t, size) for t in texts(batch, "t")] or [np.zeros(0, np.int64)])}

        return step

    found = scan(hash_sample(rows, "n", SAMPLE, SEED), build, "k long").groupBy("k").count()
    found = found.where(F.col("count") >= OFTEN).limit(MOST).toArrow()
    k, count = (found.column(c).to_numpy() for c in ("k", "count"))
    order = np.argsort(k)
    return k[order], count[order]


def _prefixes(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(n, m, i, k, short): prefixes of the sets of shingles of (n, t) in one order for all; m: size of the set, i: place of k in it.

    If two sets are similar enough, the first shingle they share is in the prefixes of both, and in the ``short`` one of the set
    that comes first by (m, n).
    """
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows, size))  # of bounded size

    def build():
        often, count = shared.value

        def step(batch):
            out: dict[str, list] = {c: [] for c in ("n", "m", "i", "k", "short")}
            for n, t in zip(batch.column("n").to_pylist(), texts(batch, "t")):
                k = _set_of(t, size)
                if len(often) and len(k):
                    at = np.minimum(np.searchsorted(often, k), len(often) - 1)
                    k = k[np.lexsort((k, np.where(often[at] == k, count[at], 0)))]
                m = len(k)
                least = lambda share: m - math.ceil(share * m - 1e-6) + 1 if m else 0  # noqa: B023, E731
                long = min(least(similarity), m)
                for c, v in zip(out, (np.full(long, n), np.full(long, m, np.int32), np.arange(long, dtype=np.int32), k[:long], np.arange(long) < least(2 * similarity / (1 + similarity)))):
                    out[c].append(v)
            yield {c: np.concatenate(v) for c, v in out.items()} if out["n"] else {c: [] for c in out}

        return step

    keys = stored(scan(rows, build, "n long, m int, i int, k long, short boolean"), "prefixes")
    # Most shingles are in one prefix only; they go before anything is carried along.
    release(rows.sparkSession)
    often = stored(keys.groupBy("k").count().where("count > 1").select("k"), "often")  # a set holds k once
    release(rows.sparkSession)
    shared_keys = stored(keys.join(often.hint("merge"), "k"), "shared")
    discard(keys, often)
    return shared_keys


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether sets that share their shingles at places i, and none before, can be similar enough: as many as are left must be shared."""
    sizes = F.col(f"{x}.m") + F.col(f"{y}.m")
    left = F.least(F.col(f"{x}.m") - F.col(f"{x}.i"), F.col(f"{y}.m") - F.col(f"{y}.i"))
    return left * (1 + similarity) + 1e-6 >= sizes * similarity


def _alike(pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of pairs (a, b, t, u) whose texts' sets of shingles have at least the similarity."""

    def build():
        def step(batch):
            good = []
            for t, u in zip(texts(batch, "t"), texts(batch, "u")):
                x, y = set(shingles(t, size)), set(shingles(u, size))
                good.append(len(x & y) >= similarity * len(x | y))
            yield {k: batch.column(k).filter(pa.array(good, pa.bool_())) for k in ("a", "b")}

        return step

    return scan(pairs, build, "a long, b long")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near copies of others: of each group the row of least (key, place in reading order) stays.

    Groups are connected by pairs whose sets of ``size``-word shingles have at least ``similarity`` (Jaccard); all such pairs count.
    Equal sets, those of texts without words and null among them, are one. What is connected already is not compared again: links
    to the ends of equal segments and of shared prefix shingles come first, then all pairs of different components that share a
    prefix shingle at possible places are compared, however many hold it.
    """
    n, k = spare(docs, "_n"), spare(docs, "_k")
    rows = numbered(docs, n, stored)

    def build():
        def step(batch):
            out: dict[str, list] = {c: [] for c in ("fp", "e", "m", "odd")}
            for t in texts(batch, 1):
                runs, seen = shingles(t, size), []
                fp, each = packed(_wide_votes(runs, seen) > 0).tobytes(), set(runs)
                for c, v in zip(out.values(), (fp, xxhash.xxh3_128_digest(b"\n".join(sorted(each))), len(each), _parities(seen))):
                    c.append(v)
            yield {"n": batch.column(0)} | out

        return step

    prints = stored(scan(rows.select(n, text), build, "n long, fp binary, e binary, m int, odd binary"), "prints")
    one = stored(prints.groupBy("e").agg(F.min(F.struct("n", "fp", "m", "odd")).alias("o")).select("e", "o.*"), "distinct")

    wide = stored(one.select("n", "m", _words("fp", 256).alias("f"), _words("odd", PARITIES).alias("p")), "wide")
    all_prints, firsts = prints, one
    prints, one = stored(prints.select("n", "e"), "prints"), stored(one.select("n", "e"), "distinct")

    def verified(met: DataFrame) -> DataFrame:
        """Those of the pairs that are similar enough. Only texts that their parities don't part are read and shuffled."""
        met = met.join(wide.select(F.col("n").alias("a"), F.col("m").alias("x"), F.col("p").alias("p")), "a")
        met = met.join(wide.select(F.col("n").alias("b"), F.col("m").alias("y"), F.col("p").alias("q")), "b")
        possible = _apart("p", "q") * (1 + similarity) <= (F.col("x") + F.col("y")) * (1 - similarity) + 1e-6
        met = stored(met.where(possible).select("a", "b"), "possible")
        part = stored(met.select("a").union(met.select("b")).distinct().withColumnRenamed("a", n), "part")
        some = stored(rows.select(n, text).join(part, n), "texts")
        sides = met.join(some.select(F.col(n).alias("a"), F.col(text).alias("t")), "a")
        sides = sides.join(some.select(F.col(n).alias("b"), F.col(text).alias("u")), "b")
        good = stored(_alike(sides.select("a", "b", "t", "u"), size, similarity), "alike")
        discard(met, part, some)
        return good

    def closest(met: DataFrame) -> DataFrame:
        met = met.join(wide.select(F.col("n").alias("a"), F.col("f").alias("f")), "a")
        met = met.join(wide.select(F.col("n").alias("b"), F.col("f").alias("g")), "b")
        return stored(met.where(_apart("f", "g") <= FARTHEST).select("a", "b"), "near")

    links = verified(closest(_met(firsts)))
    discard(all_prints, firsts)
    found = stored(components(links), "components")
    # The exact join. A few rounds of stars link what is left of dense groups, so that their pairs need not be listed.
    sets = one.select("n").join(rows.select(F.col(n).alias("n"), F.col(text).alias("t")), "n")
    release(docs.sparkSession)
    keys = _prefixes(sets, size, similarity)
    told = met = None
    for turn in range(STARS + 1):
        named = keys.join(found.withColumnRenamed("node", "n"), "n", "left").withColumn("c", F.coalesce("root", "n")).drop("root")
        # A place where all are connected has nothing left to compare.
        apart = named.groupBy("k").agg(F.min(F.struct("c", "m", "n", "i")).alias("x"), F.max(F.struct("c", "m", "n", "i")).alias("y"))
        apart = stored(apart.where("x.c < y.c"), "apart")
        named = stored(named.join(apart.select("k").hint("merge"), "k"), "named")
        if turn < STARS:
            met = named.alias("p").join(apart.select("k", F.explode(F.array("x", "y")).alias("q")).hint("merge"), "k")
            met = met.where((F.col("p.c") != F.col("q.c")) & _possible("p", "q", similarity))
            met = met.select(F.least("p.n", "q.n").alias("a"), F.greatest("p.n", "q.n").alias("b"))
        else:
            p, q = named.where("short").alias("p"), named.alias("q")
            after = F.struct("p.m", "p.n") < F.struct("q.m", "q.n")
            met = p.join(q, (F.col("p.k") == F.col("q.k")) & (F.col("p.c") != F.col("q.c")) & after & _possible("p", "q", similarity))
            met = met.select(F.least("p.n", "q.n").alias("a"), F.greatest("p.n", "q.n").alias("b"))
        met = stored(met.distinct(), "met")
        discard(named, apart)
        # Pairs that a round found unlike are not compared once more.
        new = met if told is None else stored(met.join(told.hint("merge"), ["a", "b"], "left_anti"), "new")
        told = met if told is None else told.union(new)
        links = links.union(verified(new))
        found = stored(components(links), "components")
    named = one.join(found, one.n == found.node, "left").select("e", F.coalesce("root", "n").alias("root"))
    named = stored(named, "named")
    member = prints.join(named, "e").select(F.col("n").alias(n), "root")
    least = stored(
        member.join(rows.select(n, F.col(key).alias(k)), n).groupBy("root")
        .agg(F.count("*").alias("m"), F.min(F.struct(F.col(k).isNull(), F.col(k), F.col(n).alias("n"))).alias("o")).where("m > 1").select("root", F.col("o.n").alias("s")), "stay",
    )
    gone = stored(member.join(least, "root").where(F.col(n) != F.col("s")).select(n), "gone")
    discard(wide, keys, prints, one, named, least)  # the result reads docs and this only
    return rows.join(gone.hint("merge"), n, "left_anti").select(*docs.columns)
