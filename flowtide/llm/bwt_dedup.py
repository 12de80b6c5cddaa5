"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms (op12).

A string of LENGTH bytes goes if it also starts in a document with a smaller id. Strings that are equal have the same least
gram (by hash, the leftmost of equal ones) at the same place, so the starts of a text fall into *spots*: runs of starts with one
least gram, a piece of text each. Only pieces with equal grams can hold equal strings, and grams of one document only need no
look. Equal pieces count once, for their least document; the others of that piece lose it whole.

Pieces that share a gram meet on a shard. There their suffixes are sorted by a few more than LENGTH bytes, and the transform is
searched backwards from the empty string, breadth first: every interval found sets the common prefix at its right end if that
is still unknown, to values that rise with the level, and is followed only then. After LENGTH levels, places that are still
unknown have common prefixes of LENGTH or more: between the others lie the groups of equal strings.

Grams with more than HOT different pieces would overload a shard; their strings are grouped one by one as rows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, spare, stored
from flowtide.session import discard, release

LENGTH = 50
GRAM = 20
HOT = 10_000
BLOCK = 1 << 16  # starts looked at together: what the caches hold
SHARD_BYTES = 1 << 18  # text of a transform, up to the end of its last gram
MANY = 6  # intervals that hold more than this part of all places are followed place by place, others by themselves

_PLACES = 24  # bits of a place in a block
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_random = np.random.default_rng(50)
_TABLE, _TABLE_2 = (_random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _folded(values: np.ndarray, size: int, join) -> np.ndarray:
    """Runs of ``size`` neighbours joined into one, by doubling; join(left, right, length of right)."""
    out, have, power, width = None, 0, values, 1
    while True:
        if size & width:
            if out is None:
                out, have = power, width
            else:
                most = len(power) - have
                out, have = join(out[:most], power[have : have + len(out)], width), have + width
        if 2 * width > size:
            return out
        power, width = join(power[:-width], power[width:], width), 2 * width


def _hash_join(base: int):
    return lambda left, right, width: left * np.uint64(pow(base, width, 1 << 64)) + right


def grams(data: np.ndarray, size: int) -> np.ndarray:
    return _mixed(_folded(_TABLE[data], size, _hash_join(_BASE)))


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of the least one (by its upper bits), the leftmost of equals."""
    low = np.uint64((1 << _PLACES) - 1)
    keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    while width > 1:
        half = 1 << (width.bit_length() - 1)
        if half == width:
            half //= 2
        step = 1
        while step < half:  # least of ``half`` neighbours
            keyed = np.minimum(keyed[:-step], keyed[step:])
            step *= 2
        if half < width:
            keyed = np.minimum(keyed[: len(keyed) - (width - half)], keyed[width - half :])
        break
    return (keyed & low).astype(np.int64)


def spots(data: np.ndarray, ends: np.ndarray, pieces: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start in data, number of starts, gram, piece) arrays for texts that lie one behind the other in ``data``.

    ends: where each text ends. A piece is LENGTH - 1 bytes longer than its number of starts; it is left out without ``pieces``.
    """
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        hashes = grams(part, GRAM)
        place = least_places(hashes, LENGTH - GRAM + 1)
        inside = np.ones(len(place), bool)
        for end in ends[np.searchsorted(ends, at) :] - at:
            if end - LENGTH + 1 >= len(place):
                break
            inside[max(0, end - LENGTH + 1) : end] = False  # strings that would run on into the next text
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        place = place[start]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] - start[:-1] != 1)])
        count = np.diff(first, append=len(start))
        begin = start[first]
        text = np.searchsorted(ends, begin + at, side="right")
        piece = (_pieces(part, begin, count + LENGTH - 1),) if pieces else ()
        yield text, begin + at, count, hashes[place[first]].view(np.int64), *piece


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of pieces, and of its inverse, for all places of a block."""
    size = BLOCK + LENGTH
    both = (np.full(size, b, np.uint64) for b in (_OTHER, pow(_OTHER, -1, 1 << 64)))
    return tuple(np.cumprod(np.r_[np.ones(1, np.uint64), b[1:]], dtype=np.uint64) for b in both)


def _pieces(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of pieces of any length, from prefix sums over powers of an odd base."""
    power, back = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE_2[data] * power[: len(data)], out=sums[1:])
    return _mixed((sums[begin + size] - sums[begin]) * back[begin] + size.astype(np.uint64)).view(np.int64)


def _bytes_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one text behind the other, and where each ends."""
    values = batch.column(column)
    ends = np.cumsum([len(v.as_buffer()) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(v.as_buffer() for v in values), np.uint8), ends


def _all_spots():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        data, ends = _bytes_of(batch, "body")
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        doc, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
        for text, start, n, gram, piece in spots(data, ends):
            yield {"doc_id": doc[text], "mark": mark[text], "start": start - begins[text], "n": n, "gram": gram, "piece": piece}

    return step


def _all_grams():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        data, ends = _bytes_of(batch, "body")
        for text, _, _, gram in spots(data, ends, pieces=False):
            order = np.lexsort((gram, text))  # a gram counts once for each text
            text, gram = text[order], gram[order]
            yield {"gram": gram[np.r_[True, (np.diff(text) != 0) | (np.diff(gram) != 0)]]}

    return step


def _cut_pieces():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        data, ends = _bytes_of(batch, "body")
        wanted = batch.column("found")
        found = {f.name: c for f, c in zip(wanted.type.value_type, wanted.flatten().flatten())}
        text = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
        begin = found["start"].to_numpy() + np.r_[0, ends[:-1]][text] if len(text) else np.zeros(0, np.int64)
        end = begin + found["n"].to_numpy() + LENGTH - 1
        whole = data.tobytes()
        yield {c: found[c] for c in ("gram", "piece", "n", "least", "hot")} | {"body": [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]}

    return step


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text of symbols below 512, sorted by at least ``depth`` symbols from each place."""
    n, width = len(symbols), 7
    around = np.resize(symbols, n + width).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << 9) | around[k : k + n]
    bits = n.bit_length()
    order = np.argsort(key)
    key = key[order]
    while width < depth:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        key = (rank << bits) | np.roll(rank, -width)
        if 3 * bits < 64:  # room for the place beside the key: plain sorts are several times faster than those of places
            key = np.sort((key << bits) | np.arange(n))
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key)
            key = key[order]
        width *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the suffix order, the common prefix with the one before, or -1 if it is ``least`` or more.

    Breadth-first backward extension: level by level the intervals of longer strings, from the transform alone.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    by_symbol = np.argsort(transform, kind="stable")  # the first column's places, in the transform
    to_first = np.empty(n, np.int64)
    to_first[by_symbol] = np.arange(n)
    first = transform[by_symbol]
    borders = np.flatnonzero(first[1:] != first[:-1]) + 1
    known = np.full(n + 1, -1, np.int16)
    known[0] = known[n] = 0
    owner, fresh = np.ones(n, np.int32), np.ones(n, bool)
    low, high = np.array([0]), np.array([n])
    for level in range(1, least + 1):
        if MANY * (high - low).sum() > n:
            # Most places are in intervals: all take the owner (0: none) of their place in the transform, in order as they are.
            owner = owner.take(by_symbol)
            np.not_equal(owner[1:], owner[:-1], out=fresh[1:])
            fresh[borders] = True
            low = np.flatnonzero(fresh)
            high = np.append(low[1:], n)
            unset = (owner.take(low) > 0) & (known.take(high) < 0)
            owner = np.repeat(np.cumsum(unset, dtype=np.int32) * unset, high - low)
        else:
            size = high - low
            whose = np.repeat(np.arange(len(low)), size)
            inside = np.arange(len(whose)) + np.repeat(low - (np.cumsum(size) - size), size)
            # One symbol of an interval goes to neighbouring places of the first column.
            moved = np.sort((to_first[inside] << 31) | whose)
            place, whose = moved >> 31, moved & ((1 << 31) - 1)
            symbol = first[place]
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (whose[1:] != whose[:-1]) | (symbol[1:] != symbol[:-1])])
            low, high = place[new], place[np.r_[new[1:], len(place)] - 1] + 1
            unset = known[high] < 0
        low, high = low[unset], high[unset]
        known[high] = level - 1
        if not len(low):
            break
    return known[:n]


def least_of_strings(pieces: Sequence[bytes], docs: Sequence[int]) -> list[np.ndarray]:
    """For each piece and each start of LENGTH bytes in it, the least document of all pieces that hold that string."""
    least, _, starts = _least_of_starts(pieces, docs)
    return np.split(least, np.cumsum(starts)[:-1])


def _least_of_starts(pieces: Sequence[bytes], docs: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the starts of all pieces, one piece behind the other: least document, own document; and the starts of each piece."""
    raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size + 1) - size - 1
    symbols = raw.astype(np.int16) + 1
    symbols[begin + size] = 0  # a mark behind each piece, so that no string runs on into the next
    order = sorted_suffixes(symbols, LENGTH)
    group_at = np.empty(len(symbols), np.int64)
    group_at[order] = np.cumsum(common_prefixes(symbols, order, LENGTH) >= 0)
    starts = size - LENGTH + 1
    which = np.repeat(np.arange(len(pieces)), starts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[which]
    group, doc = group_at[place], np.asarray(docs, np.int64)[which]
    least = np.full(int(group_at.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    return least[group], doc, starts


def runs_of_pieces(pieces: Sequence[bytes], docs: Sequence[int]) -> Iterator[tuple[int, list[dict]]]:
    """(piece, runs) for pieces with starts whose string has a smaller document in another piece: where they begin and end."""
    least, doc, starts = _least_of_starts(pieces, docs)
    begin = np.cumsum(starts) - starts
    flags = np.zeros(len(least) + len(starts) + 1, np.int8)  # a place without a flag before each piece, so that runs end with it
    which = np.repeat(np.arange(len(starts)), starts)
    flags[np.arange(len(least)) + which + 1] = least < doc
    a, b = (np.flatnonzero(np.diff(flags)) + 1).reshape(-1, 2).T
    piece = np.searchsorted(begin + np.arange(len(starts)), a, side="right") - 1
    shift = begin[piece] + piece + 1
    runs: dict[int, list[dict]] = {}
    for p, x, y in zip(piece.tolist(), (a - shift).tolist(), (b - shift).tolist()):
        runs.setdefault(p, []).append({"a": x, "b": y})
    return iter(runs.items())


def _shard():
    """Pieces come by gram; those of one gram stay together, several grams share a transform."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = [0]

    def flush() -> Iterator[dict]:
        if held:
            out = [(*held[k][:3], runs) for k, runs in runs_of_pieces([r[4] for r in held], [r[3] for r in held])]
            held.clear()
            size[0] = 0
            if out:
                gram, piece, n, runs = zip(*out)
                yield {"gram": gram, "piece": piece, "n": n, "runs": runs}

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "piece", "n", "least", "body"))):
            if size[0] >= SHARD_BYTES and row[0] != held[-1][0]:
                yield from flush()
            held.append(row)
            size[0] += len(row[4])

    return step, flush


_PIECE = "gram long, piece long, n int, least long, body binary"
_RUNS = "gram long, piece long, n int, runs array<struct<a:int,b:int>>"


def earlier_strings(pieces: DataFrame, hot: DataFrame) -> DataFrame:
    """(gram, piece, n, runs): the starts in each piece whose string stands in a piece with a smaller document.

    pieces: (gram, piece, n, least, body) of grams that few pieces share; hot: the same of the others.
    """
    met = scan(pieces.repartition("gram").sortWithinPartitions("gram"), _shard, _RUNS)
    one = hot.select("gram", "piece", "n", "least", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    one = one.select("gram", "piece", "n", "least", "a", F.expr(f"substring(body, a + 1, {LENGTH})").alias("string"))
    first = one.groupBy("string").agg(F.min("least").alias("before"))
    again = one.join(first, "string").where("before < least").select("gram", "piece", "n", F.struct("a", (F.col("a") + 1).alias("b")).alias("r"))
    return met.unionByName(again.groupBy("gram", "piece", "n").agg(F.collect_list("r").alias("runs")))


_KEPT = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "kept": "array<struct<a:bigint,b:bigint>>"}


def _kept(rest: Sequence[str]):
    """What stays of each text; the last two columns are the bytes and the spans that go."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {c: [] for c in _KEPT}
        for body, spans in zip(batch.column(len(rest)), batch.column(len(rest) + 1).to_pylist()):
            body, state, kept = memoryview(body.as_buffer()), hashlib.sha256(), []
            at = removed = count = 0  # at: how far the text is dealt with
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > at or not count:
                    kept.append((at, a))
                    count += 1
                    removed += b - a
                    at = b
                elif b > at:
                    removed += b - at
                    at = b
            kept.append((at, len(body)))
            for a, b in kept:
                state.update(body[a:b])
            row = (len(body), removed, count, state.hexdigest(), [{"a": a, "b": b} for a, b in kept if a < b])
            for c, value in zip(out, row):
                out[c].append(value)
        yield {c: batch.column(c) for c in rest} | out

    return lambda: step


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, more columns of any name), with n_bytes, n_removed, n_spans, kept_sha256 and kept.

    kept lists the byte ranges (a, b) that stay. A null text is empty. A row without doc_id keeps its text and takes none from
    others. Rows with equal doc_id take nothing from each other, whether their texts are equal or not. Strings are judged on the
    input. An empty table gives an empty result; columns of docs named like one of the five are replaced.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != "text" and c not in _KEPT]
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    unique = again.isEmpty()
    mark = F.lit(0).cast("long") if unique else F.xxhash64(body)  # rows that share an id are told apart by their texts
    thin = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), body.alias("body"))

    seen = scan(thin.select("body"), _all_grams, "gram long").groupBy("gram").count().where("count > 1")
    seen = stored(seen.select("gram"), "grams")
    release(spark)
    found = scan(thin, _all_spots, "doc_id long, mark long, start long, n int, gram long, piece long")
    ids = ["doc_id"] if unique else ["doc_id", "mark"]  # the columns that tell a row
    found = found.select(*ids, "start", "n", "gram", "piece")
    found = stored(found.join(seen.hint("shuffle_hash"), "gram", "left_semi"), "spots")
    discard(seen)

    different = found.groupBy("gram", "piece", "n")
    if unique:  # wherever the least document holds a piece; least values of plain columns need no sort
        different = different.agg(F.min("doc_id").alias("least"), F.min_by("start", "doc_id").alias("start"))
    else:
        different = different.agg(F.min(F.struct("doc_id", "mark", "start")).alias("lead"))
        different = different.select("gram", "piece", "n", F.col("lead.doc_id").alias("least"), "lead.mark", "lead.start")
    different = stored(different, "pieces")
    release(spark)
    shared = different.groupBy("gram").count().where("count > 1")
    wanted = different.join(shared, "gram").select(
        F.col("least").alias("doc_id"), *ids[1:],
        F.struct("gram", "piece", "n", "least", "start", (F.col("count") > HOT).alias("hot")).alias("f"),
    )
    wanted = wanted.groupBy(*ids).agg(F.collect_list("f").alias("found"))
    wanted = thin.join(wanted, ids)
    if not unique:
        wanted = wanted.dropDuplicates(["doc_id", "mark"])
    pieces = stored(scan(wanted.select("body", "found"), _cut_pieces, f"{_PIECE}, hot boolean"), "shared")
    release(spark)
    runs = stored(earlier_strings(pieces.where("not hot"), pieces.where("hot")), "runs")
    discard(pieces)

    # A table of its own, so that the join with the spots has two plain sides and a common piece can be split.
    known = stored(different.select("gram", "piece", "n", "least").join(runs, ["gram", "piece", "n"], "left"), "known")
    discard(different, runs)
    tail = LENGTH - 1
    spans = F.when(F.col("doc_id") > F.col("least"), F.expr(f"array(named_struct('a', start, 'b', start + n + {tail}))")).otherwise(
        F.expr(f"transform(runs, r -> named_struct('a', start + r.a, 'b', start + r.b + {tail}))")
    )
    removed = found.join(known, ["gram", "piece", "n"]).select(*ids, spans.alias("s")).where("size(s) > 0")
    removed = stored(removed.groupBy(*ids).agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
    discard(found, known)

    key, other, data, spans = (spare(docs, c) for c in ("key", "mark", "body", "spans"))
    own = [c.alias(name) for c, name in ((F.col("doc_id").cast("long"), key), (mark, other))][: len(ids)]
    sides = removed.select(*[F.col(c).alias(name) for c, name in zip(ids, (key, other))], F.col("spans").alias(spans))
    whole = docs.select(*rest, body.alias(data), *own)
    whole = whole.join(sides, [key, other][: len(ids)], "left").select(*rest, data, spans)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema[: len(rest)]]
    return scan(whole, _kept(rest), ", ".join([*fields, *(f"{n} {t}" for n, t in _KEPT.items())]))
