"""What the workers of the pipeline's last stage hold in memory, and what an encoder does for a piece."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from flowtide.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def held(code) -> int:
    """Bytes that an encoder comes to hold for 20 000 chunks."""
    tracemalloc.start()
    for k in range(20_000):
        code(f" w{k}x{k * 7919}")
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return size


def test_packed_ids_take_less_memory():
    plain, packed = bpe.load(PATH, PATTERN), bpe.load(PATH, PATTERN, bpe.PackedBPE)
    words = ["", "a b", "Grüße, 12345 \n\n  x", "漢字\x85 und so weiter" * 50]
    assert [packed.encode(w) for w in words] == [plain.encode(w) for w in words]
    for encoder in (plain, packed):  # pieces and pairs of both are known before
        held(encoder.encode)
        encoder.chunks, encoder.older = {}, {}
    assert held(packed.encode) < 0.6 * held(plain.encode)


def test_decoding_needs_the_bytes_only(spark):
    known = bpe.load_bytes(PATH)
    assert known == bpe.load(PATH, PATTERN).bytes_of
    rows = spark.createDataFrame([(1, "Grüße, 12345 \n\n  x"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe.decode(bpe.encode(rows, PATH, PATTERN), PATH, PATTERN)
    assert back.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert [len(r.ids) > 0 for r in back.orderBy("doc_id").collect()] == [True, False, False]


class LongestOnly:
    """An automaton that does not list all matches."""

    def __init__(self, automaton):
        self.iter_long = automaton.iter_long


def test_pieces_need_the_longest_matches_only():
    coder = bpe.ByteBPE(bpe.load(PATH, PATTERN).ranks, PATTERN)
    coder.automaton = LongestOnly(coder.automaton)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rnd = random.Random(4)
    for size in [*range(1, 12)] * 200 + [100, 2_000]:  # words of syllables; the longest go beyond what is looked at together
        word = "".join(rnd.choice(("er", "in", "tion", "ö", "the", "and", "a", "th", "ing", "schl", "\u00e9", "-", "=" * 40)) for _ in range(size))
        assert coder.encode(word) == library.encode_ordinary(word)
