"""Line dedup by winnowing (op4). DataFrame functions only.

A document is its sequence of lines that hold more than white space. Runs of ``gram`` lines are
hashed; in every window of ``window`` such hashes the least one (the rightmost of equals) is a
fingerprint. So two places that agree over ``gram + window - 1`` lines have a fingerprint in common, at
the same distance from their start. Fingerprints that occur once are dropped. Around every other one the match is
extended both ways: the runs of guaranteed length that hold it are looked up, and a run that has
occurred before is a repetition. Overlapping runs make up the whole repeated stretch, all of which is deleted.
A line of LONG words or more is a passage in itself: it goes if it has occurred before, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import numbered, spare, stored
from flowtide.session import discard

GRAM, WINDOW = 1, 2
LONG = 50
# White space that doesn't count at both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def _digest(lines: Column) -> Column:
    """128 bits of an array of lines."""
    return F.unhex(F.md5(F.to_json(lines)))


def fingerprints(hashes: Column, window: int) -> Column:
    """Places (0-based) of the least hash of each window, the rightmost of equals; one window if there are fewer."""
    last = F.greatest(F.size(hashes) - window, F.lit(0))
    placed = F.transform(hashes, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("i"), -i))
    chosen = F.transform(F.sequence(F.lit(0), last), lambda i: -F.array_min(F.slice(placed, i + 1, window))["i"])
    return F.when(F.size(hashes) > 0, F.array_distinct(chosen)).otherwise(F.array().cast("array<int>"))


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has that many words; short ones are not looked at."""
    return F.when(F.char_length(line) >= 2 * words - 1, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= words).otherwise(False)


def repeats(docs: DataFrame, key: str, lines: str, gram: int = GRAM, window: int = WINDOW, words: int = LONG) -> DataFrame:
    """(key, gone array<int>) of documents with repeated runs; gone: places in ``lines`` to delete, in order.

    ``key`` is unique and gives the order in which runs count as earlier. A place is gone if it lies in
    a run of at least ``gram + window - 1`` lines, or is a line of ``words`` words or more, that also occurs at an earlier place,
    of this document or of one with a smaller key.
    """
    least = gram + window - 1
    size = F.size(lines)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(size - gram, F.lit(0))), lambda i: _digest(F.slice(F.col(lines), i + 1, gram))
    )
    long = docs.where(size >= least).select(F.col(key).alias("k"), F.col(lines).alias("l"), grams.alias("g"))
    # The candidate runs of a fingerprint at p are those that start at p - window + 1 .. p. They go along with it, so
    # that lines need not be fetched again.
    long = long.withColumn("n", F.size("l"))

    def around(p: Column) -> Column:
        starts = F.sequence(F.greatest(p - (window - 1), F.lit(0)), F.least(p, F.col("n") - least))
        return F.transform(starts, lambda i: F.named_struct(F.lit("s"), i, F.lit("r"), _digest(F.slice("l", i + 1, least))))

    chosen = F.transform(
        fingerprints(F.col("g"), window), lambda p: F.named_struct(F.lit("h"), F.element_at("g", p + 1), F.lit("x"), around(p))
    )
    chosen = stored(long.select("k", F.explode(chosen).alias("f")).select("k", "f.*"), "fingerprints")
    shared = stored(chosen.groupBy("h").count().where("count > 1").select("h"), "shared")
    runs = chosen.join(shared.hint("merge"), "h").select("k", F.explode("x").alias("x")).select("k", "x.*", F.lit(least).alias("m"))
    single = F.filter(
        F.transform(lines, lambda x, i: F.when(_is_long(x, words), F.named_struct(F.lit("s"), i, F.lit("r"), _digest(F.array(x))))), lambda x: x.isNotNull()
    )
    singles = docs.select(F.col(key).alias("k"), F.explode(single).alias("x")).select("k", "x.*", F.lit(1).alias("m"))
    runs = stored(runs.unionByName(singles), "runs")
    discard(chosen, shared)
    first = stored(
        runs.groupBy("r").agg(F.min(F.struct("k", "s")).alias("first"), F.max(F.struct("k", "s")).alias("last")).where("first < last"), "first"
    )
    later = runs.join(first.drop("last"), "r").where(F.struct("k", "s") > F.col("first"))
    gone = F.flatten(F.collect_list(F.sequence(F.col("s"), F.col("s") + F.col("m") - 1)))
    found = stored(later.groupBy("k").agg(F.array_sort(F.array_distinct(gone)).alias("gone")).withColumnRenamed("k", key), "gone")
    discard(runs, first)
    return found


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW,
    keep: Sequence[str] | None = None, words: int = LONG,
) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with text without repeated runs, n_lines, n_removed and removed.

    A run has ``gram + window - 1`` lines or more, or is one line of ``words`` words or more; shorter single lines stay.

    Runs count as earlier by (key, place); rows of equal or null key (null comes first) follow the order in
    which they are read. Lines end at \\n. Lines are compared as
    they are but for white space at both ends; blank lines belong to no run and stay. removed: the
    0-based numbers of deleted lines in the original text. Null and empty texts stay as they are, with
    no lines. Columns of these names are replaced.
    """
    new = ("n_lines", "n_removed", "removed")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    carried = list(dict.fromkeys([*kept, key, text]))
    n = spare(docs, "_n")
    rows = numbered(docs.select(*carried), n, stored)
    lines = F.split(F.col(text), "\n", -1)
    full = F.filter(F.transform(lines, lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), F.btrim(x, F.lit(BLANKS)))), lambda p: p["x"] != "")
    parts = rows.select(F.struct(F.col(key).alias("a"), F.col(n).alias("b")).alias("k"), F.col(n).alias("_n"), full.alias("f"))
    parts = parts.select("k", "_n", F.transform("f", lambda p: p["x"]).alias("l"), F.transform("f", lambda p: p["i"]).alias("i"))
    gone = repeats(parts, "k", "l", gram, window, words)
    places = parts.select("_n", "i").join(gone.select(F.col("k.b").alias("_n"), "gone"), "_n").select(
        "_n", F.transform("gone", lambda g: F.element_at("i", g + 1)).alias("removed")
    )
    places = stored(places, "removed")
    discard(gone)
    gone_at = spare(docs, "_gone")
    none = F.array().cast("array<int>")
    removed = F.coalesce(gone_at, none)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    left = F.transform(left, lambda i: F.element_at(lines, i + 1))
    out = rows.join(places.withColumnRenamed("_n", n).withColumnRenamed("removed", gone_at).hint("merge"), n, "left")
    return out.select(
        *[F.when(F.size(removed) > 0, F.array_join(left, "\n")).otherwise(F.col(text)).alias(c) if c == text else c for c in kept],
        F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
    )
