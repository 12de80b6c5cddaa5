"""Prefix trie of conversations by ternary search trees on range shards (op11).

Distinct turns get ids from a dictionary, conversations become sequences of ids, and the sequences are range-partitioned by
(sequence, conv_id): a shard is a stretch of the sorted sequences, and copies of one conversation may fill several shards. Each
shard builds a ternary search tree, medians first, and walks it without recursion. A node that lies neither on the path of the
shard's first nor of its last sequence is complete; the others are parts, which are added up by the digest of their prefix.

All figures add up if what neighbours share is taken off once: the common prefix of a shard's last and the next one's first
sequence. That takes the two border sequences of each shard, nothing else.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import scan, stored, texts

HEAD = 3  # turns that the rebuilding can take from another conversation at most
EVERY = 20
CHUNK = 1 << 16  # conversation ids in one text on their way to a digest

COMPLETE, PART, ENDS, BORDER = range(4)
_NODE = {"key": "binary", "parent_key": "binary", "depth": "int", "conv_id": "long", "parent_conv_id": "long", "n_convs": "long",
         "n_children": "long", "n_leaves": "long", "saved_tokens": "long"}
_SHARD = {"kind": "int", **_NODE, "ends_sha256": "string", "shard": "int", "chunk": "int", "convs": "string",
          "first": "array<bigint>", "words": "array<bigint>", "last": "array<bigint>"}
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): the turns of each conversation as dictionary ids, with their numbers of words.

    Turns go by turn, null first, and turns of equal number by a digest of role and text. Null role or text is empty; a row
    without conv_id belongs to no conversation. Repeated rows are repeated turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(digest), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    turns = stored(turns, "turns")
    distinct = turns.groupBy("digest").agg(F.min("w").alias("w"))
    dictionary = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = turns.select("conv_id", "turn", "digest").join(dictionary, "digest")
    in_order = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "w")))
    return coded.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.w").alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % EVERY in place of its own; h = crc32(c) % 4."""
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    heads = own.where(F.col("conv_id") % EVERY == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, HEAD).alias("head"), F.slice("words", 1, HEAD).alias("head_words")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")

    def joined(head: str, rest: str):
        none = F.array().cast("array<bigint>")
        return F.concat(F.slice(F.coalesce(F.col(head), none), F.lit(1), h), F.slice(rest, h + 1, F.greatest(F.size(rest) - h, F.lit(0))))

    both = own.withColumn("base", base).join(heads, "base", "left")
    return both.select("conv_id", joined("head", "ids").alias("ids"), joined("head_words", "words").alias("words"))


class TernaryTree:
    """A ternary search tree over integer sequences; every node but the root stands for a prefix."""

    def __init__(self):
        self.key, self.low, self.equal, self.high = [None], [-1], [-1], [-1]
        self.above, self.depth, self.words, self.end = [-1], [0], [0], [-1]

    def insert(self, ids: Sequence[int], words: Sequence[int], number: int) -> None:
        node = 0
        for key, w in zip(ids, words):
            links, at = self.equal, node
            while (child := links[at]) != -1 and self.key[child] != key:
                links, at = (self.low, child) if key < self.key[child] else (self.high, child)
            if child == -1:
                child = links[at] = len(self.key)
                for column, value in ((self.key, key), (self.low, -1), (self.equal, -1), (self.high, -1), (self.above, node),
                                      (self.depth, self.depth[node] + 1), (self.words, w), (self.end, -1)):
                    column.append(value)
            node = child
        self.end[node] = number

    def path(self, ids: Sequence[int]) -> list[int]:
        """The nodes of the prefixes of a sequence in the tree, root first."""
        nodes = [0]
        for key in ids:
            child = self.equal[nodes[-1]]
            while self.key[child] != key:
                child = self.low[child] if key < self.key[child] else self.high[child]
            nodes.append(child)
        return nodes

    def walk(self) -> list[int]:
        """All nodes, each after the node above it."""
        order, stack = [0], [self.equal[0]]
        while stack:
            node = stack.pop()
            if node != -1:
                order.append(node)
                stack += (self.low[node], self.high[node], self.equal[node])
        return order


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the median first, then those of both halves, and so on."""
    halves = deque([(0, n)])
    while halves:
        low, high = halves.popleft()
        if low < high:
            middle = (low + high) // 2
            yield middle
            halves += ((low, middle), (middle + 1, high))


def prefix_keys(ids: Sequence[int]) -> list[bytes]:
    """Digests of all prefixes of a sequence, the empty one first."""
    state, keys = hashlib.sha256(), []
    for i in [None, *ids]:
        if i is not None:
            state.update(int(i).to_bytes(8, "little", signed=True))
        keys.append(state.digest()[:16])
    return keys


def _hash_of(convs: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def shard_rows(found: list[tuple[list[int], list[int], list[int]]], shard: int) -> Iterator[dict]:
    """The rows of a shard: nodes, parts of nodes, ends of parts, and its borders.

    ``found`` holds its distinct sequences in order: ids, words, conversations.
    """
    tree = TernaryTree()
    for number in medians(len(found)):
        tree.insert(*found[number][:2], number)
    size = len(tree.key)
    members, leaves, children, saved = ([0] * size for _ in range(4))
    least: list[int | None] = [None] * size
    order = tree.walk()
    for node in reversed(order):
        if tree.end[node] >= 0:
            convs = found[tree.end[node]][2]
            members[node] += len(convs)
            least[node] = convs[0] if least[node] is None else min(least[node], convs[0])
        leaves[node] = leaves[node] or 1  # a node that no child has added to is a leaf
        saved[node] += (members[node] - 1) * tree.words[node] if node else 0
        if node:
            up = tree.above[node]
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]

    first, last = found[0], found[-1]
    keys = {}
    for ids in (first[0], last[0]):
        keys.update(zip(tree.path(ids), prefix_keys(ids)))
    for node in order:
        up, own = tree.above[node], keys.get(node)
        convs = found[tree.end[node]][2] if tree.end[node] >= 0 else []
        yield {
            "kind": COMPLETE if own is None else PART, "key": own, "parent_key": keys.get(up), "depth": tree.depth[node],
            "conv_id": least[node], "parent_conv_id": least[up] if node and own is None and up not in keys else None,
            "n_convs": members[node], "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node],
            "ends_sha256": _hash_of(convs) if own is None else None,
        }
        if own is not None:
            for at in range(0, len(convs), CHUNK):
                yield {"kind": ENDS, "key": own, "shard": shard, "chunk": at // CHUNK, "convs": ",".join(map(str, convs[at : at + CHUNK]))}
    yield {"kind": BORDER, "shard": shard, "first": first[0], "words": first[1], "last": last[0]}


def _batches(rows: Iterator[dict], names: Sequence[str], most: int = 4096) -> Iterator[dict]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield {n: [r.get(n) for r in held] for n in names}
            held = []
    if held:
        yield {n: [r.get(n) for r in held] for n in names}


def _shard():
    found: list[tuple[list[int], list[int], list[int]]] = []

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for conv, ids, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "words"))):
            if found and found[-1][0] == ids:
                found[-1][2].append(conv)
            else:
                found.append((ids, words, [conv]))
        yield from ()

    def finish() -> Iterator[dict]:
        if found:
            yield from _batches(shard_rows(found, TaskContext.get().partitionId()), list(_SHARD))

    return step, finish


def shared_rows(last: Sequence[int], first: Sequence[int], words: Sequence[int]) -> Iterator[dict]:
    """What two neighbouring shards have both counted, for each node of the common prefix of their border sequences."""
    common = 0
    while common < min(len(last), len(first)) and last[common] == first[common]:
        common += 1
    keys = prefix_keys(first[:common])
    leaf = common == len(last)  # a leaf of the first shard that goes on, or is met again, in the second
    twice = 0
    for depth in range(common, -1, -1):
        twice += words[depth - 1] if depth else 0
        yield {
            "key": keys[depth], "depth": depth, "n_convs": 0, "n_children": -1 if depth < common else 0,
            "n_leaves": -1 if leaf else 0, "saved_tokens": twice,
        }


def _shared():
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for pair in zip(*(batch.column(c).to_pylist() for c in ("last", "first", "words"))):
            yield from _batches(shared_rows(*pair), list(_NODE))

    return step


def _digests():
    """Digest of the conversation ids of each key; the rows come by key and in order, and one key is held at a time."""
    now: list = [None, None]

    def row() -> Iterator[dict]:
        if now[0] is not None:
            yield {"key": [now[0]], "ends_sha256": [now[1].hexdigest()]}

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for key, convs in zip(batch.column("key").to_pylist(), texts(batch, "convs")):
            if key != now[0]:
                yield from row()
                now[:] = key, hashlib.sha256()
            else:
                now[1].update(b",")
            now[1].update(convs.encode())

    return step, row


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the empty one included.

    conversations: (conv_id, turn, role, text), more columns don't matter. Columns: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Order, nulls and repeated rows as in
    ``sequences``; an empty table has no nodes. A conversation is one row on its way, so its ids must fit into a task.
    """
    whole = stored(rebuilt(stored(sequences(conversations), "sequences")), "rebuilt")
    sharded = whole.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = stored(scan(sharded, _shard, _ddl(_SHARD)), "shards")

    borders = nodes.where(F.col("kind") == BORDER)
    shards = sorted(r["shard"] for r in borders.select("shard").collect())  # one number for each partition
    parts = nodes.where(F.col("kind") == PART).select(*_NODE)
    if len(shards) > 1:
        follows = conversations.sparkSession.createDataFrame(list(zip(shards, shards[1:])), "shard int, after int")
        pairs = borders.select("shard", "last").join(follows, "shard").join(
            borders.select(F.col("shard").alias("after"), "first", "words"), "after"
        )
        parts = parts.unionByName(scan(pairs.select("last", "first", "words"), _shared, _ddl(_NODE)))
    merged = stored(
        parts.groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in _SUMS],
        ), "merged",
    )
    ends = nodes.where(F.col("kind") == ENDS).select("key", "shard", "chunk", "convs")
    ends = scan(ends.repartition("key").sortWithinPartitions("key", "shard", "chunk"), _digests, "key binary, ends_sha256 string")

    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    out = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    complete = nodes.where(F.col("kind") == COMPLETE)
    inside = complete.where("parent_key is null")
    below = complete.where("parent_key is not null").drop("parent_conv_id").join(up, "parent_key").withColumnRenamed("up", "parent_conv_id")
    whole = merged.join(ends, "key", "left").join(up, "parent_key", "left").withColumnRenamed("up", "parent_conv_id")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    rows = inside.select(*out).unionByName(below.select(*out)).unionByName(whole.select(*out))
    return rows.withColumn("depth", F.col("depth").cast("long"))
