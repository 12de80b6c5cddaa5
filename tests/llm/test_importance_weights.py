"""log_weight of the importance resampling, counted again without Spark or numpy."""

import math
import random
import zlib
from collections import Counter

import pytest

from flowtide.llm import importance


def _features(text):
    """Buckets of the words, runs of signs and pairs of neighbours, by walking over the bytes."""
    parts, kind = [], None
    for b in (text or "").encode("utf-8"):
        b = b + 32 if 65 <= b <= 90 else b
        new = "space" if b in b" \t\n\r\x0b\x0c" else "word" if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b == 95 or b >= 128 else "sign"
        if new != "space":
            if new == kind:
                parts[-1].append(b)
            else:
                parts.append(bytearray([b]))
        kind = new
    hashes = [zlib.crc32(bytes(p)) for p in parts]
    pairs = [(a * 0x9E3779B1 + b) % 2**64 % 4_294_967_291 for a, b in zip(hashes, hashes[1:])]
    return [h % importance.BUCKETS for h in hashes + pairs]


def _log_shares(texts):
    counts = Counter(b for t in texts for b in _features(t))
    total = sum(counts.values()) + importance.SMOOTH * importance.BUCKETS
    return lambda b: math.log((counts[b] + importance.SMOOTH) / total)


def test_log_weights_against_a_plain_count(spark):
    rnd = random.Random(12)
    words = ["Good", "bad", "ÄRGER", "x_1", "42", "don't", "!!", "...", "naïve", "end.", "日本"]
    docs = [(k, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 80)))) for k in range(90)]
    docs += [(90, None), (91, ""), (92, " \n"), (93, " ".join(rnd.choice(words) for _ in range(60_000))), (94, docs[0][1])]
    # Contradicting labels count as 0; labels out of range, of no document or without key don't count.
    labels = [(k, int(k % 3 == 0)) for k in range(0, 95, 2)] + [(6, 0), (8, 5), (None, 1), (5000, 1), (93, 1)]
    good = {k for k in range(0, 95, 2) if k % 3 == 0} - {6} | {93}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    weighed, share = importance.weights(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    target, raw = _log_shares([t for k, t in docs if k in good]), _log_shares([t for _, t in docs])
    got = {r.doc_id: r.log_weight for r in weighed.collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        assert got[k] == pytest.approx(sum(target(b) - raw(b) for b in _features(t)), rel=1e-9, abs=1e-9)
    known = set(range(0, 95, 2)) | {93, 5000}
    assert share == pytest.approx(len(good | {5000}) / len(known))
