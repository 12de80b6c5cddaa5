"""Benchmark decontamination (op5): one Aho-Corasick automaton over all windows of the benchmark's texts.

Both sides are normalised alike: A-Z in lower case, words of letters, digits and everything beyond
ASCII, one blank between and around words. The automaton holds every window as bytes read as Latin-1
and runs once over a document; matches are mapped back to words and to places in the original text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, spare, stored, texts

WINDOW = 10
# Bytes of windows in one automaton (some 250 MB in a worker). A larger benchmark is cut into several, scanned in turn.
AUTOMATON_BYTES = 3_000_000

_BLANKS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_HITS = "array<struct<first:int,last:int,start:int,stop:int>>"


def words(text: str) -> list[bytes]:
    """The words of a text, as bytes. bytes.lower() touches A-Z only."""
    return text.encode("utf-8").lower().translate(_BLANKS).split()


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window binary, items array<string>): each distinct run of ``size`` words with the items that hold it.

    A shorter item is one window; one without words (null or empty) has none. An item without an id
    still contributes windows, but is in no list of items.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))

    def build():
        def step(batch):
            for k, t in enumerate(texts(batch, 1)):
                w = words(t)
                runs = {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else ()
                if runs:
                    yield {"item": [batch.column(0)[k].as_py()] * len(runs), "window": list(runs)}

        return step

    found = scan(rows, build, "item string, window binary")
    return found.groupBy("window").agg(F.collect_set("item").alias("items"))


class Matcher:
    """The automaton of some windows."""

    def __init__(self, found: Sequence[tuple[bytes, Sequence[str]]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in found:
            self.automaton.add_word(bytes(window).decode("latin-1"), (len(window), tuple(items)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (first, last) covered by windows, apart and in order, and the items of those windows."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not w:
            return ranges, items
        line = b" " + b" ".join(w) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if found:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            ends = np.array([end for end, _ in found])
            starts = ends - np.array([size for _, (size, _) in found]) + 1
            for _, (_, named) in found:
                items.update(named)
            first, last = np.searchsorted(blanks, starts), np.searchsorted(blanks, ends) - 1
            ranges = merge(zip(first.tolist(), last.tolist()))
        return ranges, items


def merge(ranges) -> list[tuple[int, int]]:
    """Ranges of words joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def places(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges with their character offsets in the original text."""
    data = text.encode("utf-8")
    spans = [m.span() for m in _WORD.finditer(data.lower())]
    at = lambda n: len(data[:n].decode("utf-8"))
    return [{"first": a, "last": b, "start": at(spans[a][0]), "stop": at(spans[b][1])} for a, b in ranges]


_MATCHERS: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    """One automaton per worker process and block of windows."""
    if shared.key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.key] = Matcher(shared.value)
    return _MATCHERS[shared.key]


class _Shared:
    """A broadcast with an id by which a worker process can keep what it builds from it."""

    def __init__(self, broadcast):
        self._broadcast, self.key = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "key": self.key}

    @property
    def value(self):
        return self._broadcast.value


def _pass(docs: DataFrame, text: str, kept: Sequence[str], shared: _Shared) -> DataFrame:
    own = spare(docs, "_text")
    rest = docs.select(*kept, F.col(text).alias(own), *[c for c in ("n_words", "hits", "items") if c in docs.columns and c not in kept])
    again = "hits" in rest.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*kept).schema)

    def build():
        matcher = _matcher(shared)

        def step(batch):
            counts, hits, items = [], [], []
            for k, t in enumerate(texts(batch, own)):
                w = words(t)
                ranges, named = matcher.hits(w)
                if again:
                    before = batch.column("hits")[k].as_py()
                    ranges = merge([*ranges, *((h["first"], h["last"]) for h in before)])
                    named |= set(batch.column("items")[k].as_py())
                counts.append(len(w))
                hits.append(places(t, ranges) if ranges else [])
                items.append(sorted(named))
            yield {c: batch.column(c) for c in kept} | {"n_words": counts, "hits": pa.array(hits, pa.list_(_SPAN)), "items": items}

        return step

    return scan(rest, build, f"{fields + ', ' if fields else ''}n_words long, hits {_HITS}, items array<string>")


def find(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", keep: Sequence[str] | None = None,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with n_words, hits and items, one row per row of docs.

    hits: ranges of words inside windows, joined where they touch, with character offsets; items: the
    ids with windows in the text, sorted as strings. Columns of these names are replaced. Null and
    empty texts have no words; an empty benchmark gives no hits. Repeated rows are treated alike.
    """
    spark = docs.sparkSession
    found = stored(windows(benchmark, size), "windows")
    total = found.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    blocks = max(1, math.ceil(total / automaton_bytes))
    new = ("n_words", "hits", "items")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    rows = docs.drop(*new)
    for block in range(blocks):
        # A block holds about automaton_bytes, whatever the benchmark's size.
        part = found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        shared = _Shared(spark.sparkContext.broadcast([(bytes(r.window), r["items"]) for r in part]))
        if block == blocks - 1:
            return _pass(rows, text, kept, shared)
        rows = stored(_pass(rows, text, list(dict.fromkeys([*kept, text])), shared), "scanned")
