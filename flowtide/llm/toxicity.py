"""Toxic spans and document scores by a linear-chain conditional random field (op7).

Labels mark documents, not words. In a sample of labelled documents the evidence of words and word
beginnings for the toxic class is measured (log-likelihood ratio of document counts) and put into
grades; words of strong grades in toxic documents are the labelled tokens. The field has two states and
knows the grade of a word and of its neighbours, and which states follow each other. A document is
scored from the marginals of its words, found by forward-backward; words with marginals above one half are its
offending spans. Stretches of words without any evidence have equal factors, so their transfer matrix is a power.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import crc_of, hash_sample, scan, spare, stored, texts

# Bounds of the sample the model is fitted on, and of what a worker remembers about words.
MAX_TRAIN = 20_000
KEPT_WORDS = 300_000
# Least log-likelihood ratio of the grades 1, 2, ...; words from grade TAGGED on are labelled tokens in toxic documents.
GRADES, TAGGED = (15.0, 30.0, 120.0), 2
LEAST_DOCS, LEAST_ODDS = 3, 1.5
PREFIXES = (4, 5, 6)
SEGMENT = 64
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_SPANS = "array<struct<start:int,stop:int,p:double>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) > n]


def held_out(key: str) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 when divided by 3."""
    return F.pmod(crc_of(key), F.lit(3)) == 1


@dataclass
class Model:
    """Grades of words and word beginnings, the field's weights, and the weights of the document score."""

    grades: dict[str, int]
    own: list[float]
    before: list[float]
    after: list[float]
    moves: list[float]  # log factors of 0-1, 1-0 and 1-1; 0-0 is zero
    score: list[float]
    known: dict[str, int] = field(default_factory=dict)
    powers: dict[int, tuple] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "powers": {}}

    def grade(self, word: str) -> int:
        found = max((self.grades.get(x, 0) for x in (word, *beginnings(word))), default=0)
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = found
        return found

    def graded(self, ws: Sequence[str]) -> list[tuple[int, int]]:
        """(place, grade) of words with evidence."""
        get, out = self.known.get, []
        for k, g in enumerate(map(get, ws)):
            if g is None:
                g = self.grade(ws[k])
            if g:
                out.append((k, g))
        return out

    def _quiet(self, n: int) -> tuple:
        """The transfer matrix of n words without evidence, scaled."""
        found = self.powers.get(n)
        if found is None:
            if n == 1:
                a, b, c = (math.exp(m) for m in self.moves)
                e = math.exp(self.own[0])
                found = _scaled((1.0, a * e, b, c * e))
            else:
                half = self._quiet(n // 2)
                found = _times(half, half)
                if n % 2:
                    found = _times(found, self._quiet(1))
            self.powers[n] = found
        return found

    def marginals(self, n: int, graded: Sequence[tuple[int, int]]) -> list[tuple[int, float]]:
        """(place, probability of state 1) of words that have evidence or stand beside one that has."""
        if not graded:
            return []
        grade = dict(graded)
        places = sorted({p for k in grade for p in (k - 1, k, k + 1) if 0 <= p < n})
        a, b, c = (math.exp(m) for m in self.moves)
        steps, forward, x, at = [], [], (1.0, 0.0), 0
        for p in places:
            e = math.exp(self.own[grade.get(p, 0)] + self.before[grade.get(p - 1, 0)] + self.after[grade.get(p + 1, 0)])
            m = _scaled((1.0, a * e, b, c * e))
            if p > at:
                m = _times(self._quiet(p - at), m)
            x = (x[0] * m[0] + x[1] * m[2], x[0] * m[1] + x[1] * m[3])
            s = x[0] + x[1]
            x = (x[0] / s, x[1] / s)
            steps.append(m)
            forward.append(x)
            at = p + 1
        y = (1.0, 1.0)
        if n > at:
            m = self._quiet(n - at)
            y = (m[0] + m[1], m[2] + m[3])
        out = []
        for p, m, x in zip(reversed(places), reversed(steps), reversed(forward)):
            zero, one = x[0] * y[0], x[1] * y[1]
            out.append((p, one / (zero + one)))
            y = (m[0] * y[0] + m[1] * y[1], m[2] * y[0] + m[3] * y[1])
            s = y[0] + y[1]
            y = (y[0] / s, y[1] / s)
        return out[::-1]

    def features(self, n: int, marginals: Sequence[tuple[int, float]]) -> list[float]:
        """What a document's score is made of: the marginals' total, their two greatest, and their share."""
        ps = sorted((p for _, p in marginals), reverse=True) + [0.0, 0.0]
        total = sum(ps)
        return [1.0, math.log1p(total), ps[0], ps[1], total / math.sqrt(n + 1)]

    def document(self, text: str) -> tuple[float, list[dict], list[float]]:
        """(score, spans, features) of a text."""
        ws = words(text)
        marginals = self.marginals(len(ws), self.graded(ws))
        values = self.features(len(ws), marginals)
        score = _logistic(sum(w * v for w, v in zip(self.score, values)))
        spans: list[dict] = []
        tagged = {k: p for k, p in marginals if p > 0.5}
        if tagged:
            # Lower case may change the length of a text; then places are found word by word in the original.
            low = text if len(text.lower()) == len(text) else None
            source = low.lower() if low is not None else text
            for k, m in enumerate(_WORD.finditer(source)):
                if k in tagged:
                    spans.append({"start": m.start(), "stop": m.end(), "p": tagged[k]})
        return score, spans, values


def _scaled(m: tuple) -> tuple:
    s = max(m)
    return tuple(v / s for v in m)


def _times(m: tuple, o: tuple) -> tuple:
    return _scaled((m[0] * o[0] + m[1] * o[2], m[0] * o[1] + m[1] * o[3], m[2] * o[0] + m[3] * o[2], m[2] * o[1] + m[3] * o[3]))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(text, toxic, part) of at most ``most`` labelled documents that are not held out; part 0 to 2 by hash.

    Of labels that contradict each other the toxic one counts; others than 0 and 1 are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    usable = usable.groupBy(F.col(key).alias("k")).agg(F.max(label).alias("toxic"))
    chosen = hash_sample(stored(usable, "labels"), "k", most, 7)  # bounded, so it can be broadcast
    part = F.pmod(F.xxhash64("k", F.lit(3)), F.lit(3)).cast("int")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "k").select("text", F.col("toxic").cast("int").alias("toxic"), part.alias("part"))


def _evidence(train: DataFrame) -> dict[str, int]:
    """Grades of words and beginnings. Equal texts count once."""
    def build():
        def step(batch):
            for k, t in enumerate(texts(batch, 0)):
                ws = set(words(t))
                found = [*ws, *{b for w in ws for b in beginnings(w)}]
                yield {"x": found, "toxic": [batch.column(1)[k].as_py()] * len(found)}

        return step

    train = train.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sizes = train.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = sizes[0] or 0, (sizes[1] or 0) - (sizes[0] or 0)
    if not bad or not good:
        return {}
    counts = scan(train, build, "x string, toxic int").groupBy("x").agg(
        F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n")
    )
    share = lambda n, d: F.when(n > 0, n * F.log(n / d)).otherwise(0.0)
    a, b = F.col("a"), F.col("n") - F.col("a")
    p = F.col("n") / (bad + good)
    ratio = 2 * (share(a, p * bad) + share(b, p * good) + share(bad - a, (1 - p) * bad) + share(good - b, (1 - p) * good))
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
    grade = sum(((ratio >= g).cast("int") for g in GRADES), F.lit(0))
    # A word needs LEAST_DOCS documents of the bounded sample, which bounds this list.
    strong = counts.where((a >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("x", grade.alias("g")).where("g > 0")
    return {r.x: r.g for r in strong.collect()}


def _segments(train: DataFrame, model: Model) -> list[tuple[bytes, bytes, int]]:
    """Distinct runs of up to SEGMENT words with evidence around: (grades, tags, how many)."""

    def build():
        def step(batch):
            xs, ys = [], []
            for k, t in enumerate(texts(batch, 0)):
                ws = words(t)
                grades = bytearray(len(ws))
                for p, g in model.graded(ws):
                    grades[p] = g
                toxic = batch.column(1)[k].as_py()
                tags = bytes(int(toxic and g >= TAGGED) for g in grades)
                for at in range(0, len(ws), SEGMENT):
                    xs.append(bytes(grades[at : at + SEGMENT]))
                    ys.append(tags[at : at + SEGMENT])
            yield {"x": xs, "y": ys}

        return step

    found = scan(train.select("text", "toxic"), build, "x binary, y binary").groupBy("x", "y").count()
    return [(bytes(r.x), bytes(r.y), r["count"]) for r in found.collect()]


def _fit_field(rows: Sequence[tuple[bytes, bytes, int]], grades: int, rounds: int = 200) -> np.ndarray:
    """Weights of the field by gradient ascent with sign-based steps on the penalised likelihood."""
    rows = sorted(rows)
    size, length = len(rows), max(len(x) for x, _, _ in rows)
    x, y, live = (np.zeros((size, length), np.int64) for _ in range(3))
    for k, (a, b, _) in enumerate(rows):
        x[k, : len(a)], y[k, : len(b)], live[k, : len(a)] = list(a), list(b), 1
    weight = np.array([c for _, _, c in rows], float)
    weight /= weight.sum()
    before = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
    after = np.pad(x, ((0, 0), (0, 1)))[:, 1:]
    w = np.zeros(3 * grades + 3)
    w[0] = -3.0
    step, last = np.full(len(w), 0.1), np.zeros(len(w))

    def collect(one, moves):
        """Expected counts of all features: state 1 by grade, and the moves 0-1, 1-0, 1-1."""
        one = one * live * weight[:, None]
        parts = [np.bincount(f.ravel(), one.ravel(), grades) for f in (x, before, after)]
        parts[1][0] = parts[2][0] = 0
        return np.concatenate([*parts, [(m * weight).sum() for m in moves]])

    prev = np.pad(y, ((0, 0), (1, 0)))[:, :-1]
    seen = collect(y, [((prev == i) & (y == j) & (live == 1)).sum(1) for i, j in ((0, 1), (1, 0), (1, 1))])
    for _ in range(rounds):
        u, v, z, m = w[:grades], w[grades : 2 * grades], w[2 * grades : 3 * grades], np.exp(w[3 * grades :])
        e = np.exp(np.clip(u[x] + v[before] + z[after], -30, 30))
        fwd, scale = np.zeros((size, length, 2)), np.ones((size, length))
        a0, a1 = np.ones(size), np.zeros(size)
        for t in range(length):
            on = live[:, t] == 1
            n0, n1 = a0 + a1 * m[1], (a0 * m[0] + a1 * m[2]) * e[:, t]
            s = n0 + n1
            a0, a1 = np.where(on, n0 / s, a0), np.where(on, n1 / s, a1)
            fwd[:, t, 0], fwd[:, t, 1] = a0, a1
            scale[:, t] = np.where(on, s, 1)
        b0, b1 = np.ones(size), np.ones(size)
        one, moves = np.zeros((size, length)), np.zeros((3, size))
        for t in range(length - 1, -1, -1):
            on = live[:, t] == 1
            one[:, t] = fwd[:, t, 1] * b1
            p0, p1 = (fwd[:, t - 1, 0], fwd[:, t - 1, 1]) if t else (np.ones(size), np.zeros(size))
            moves += np.where(on, np.stack([p0 * m[0] * e[:, t] * b1, p1 * m[1] * b0, p1 * m[2] * e[:, t] * b1]) / scale[:, t], 0)
            b0, b1 = (
                np.where(on, (b0 + m[0] * e[:, t] * b1) / scale[:, t], b0),
                np.where(on, (m[1] * b0 + m[2] * e[:, t] * b1) / scale[:, t], b1),
            )
        slope = seen - collect(one, moves) - 1e-5 * w
        same = slope * last
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        last = np.where(same < 0, 0, slope)
        w = w + np.sign(last) * step
    return w


def _fit_score(values: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton's method."""
    w = np.zeros(values.shape[1])
    penalty = np.full(len(w), 0.05)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(values @ w, -30, 30)))
        slope = values.T @ (toxic - p) - penalty * w
        bend = (values * (p * (1 - p))[:, None]).T @ values + np.diag(penalty)
        w = w + np.linalg.solve(bend, slope)
    return w


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN
) -> Model:
    """The model of at most ``most`` labelled documents outside the held-out third.

    Two thirds of them give the evidence and the field, the rest the document score. Without documents of both
    classes every score is the share of toxic ones among the labelled (0 if nothing is labelled).
    """
    rows = stored(sample(docs, labels, key, text, label, most), "labelled")
    grades = len(GRADES) + 1
    first, second = rows.where("part > 0"), rows.where("part = 0")
    words_of = _evidence(first)
    model = Model(words_of, [0.0] * grades, [0.0] * grades, [0.0] * grades, [0.0] * 3, [0.0] * 5)
    segments = _segments(first, model) if words_of else []
    if segments:
        w = _fit_field(segments, grades).tolist()
        model.own, model.before, model.after = w[:grades], w[grades : 2 * grades], w[2 * grades : 3 * grades]
        model.moves = w[3 * grades :]

    def build():
        def step(batch):
            yield {"x": [model.document(t)[2] for t in texts(batch, 0)], "y": batch.column(1)}

        return step

    # At most ``most`` rows of five numbers. All of them if the held-back part has one class only.
    for part in (second, rows):
        got = scan(part.select("text", "toxic"), build, "x array<double>, y int").collect()
        if len({r.y for r in got}) == 2:
            model.score = _fit_score(np.array([r.x for r in got]), np.array([r.y for r in got], float)).tolist()
            return model
    share = min(max(sum(r.y for r in got) / len(got), 1e-6), 1 - 1e-6) if got else 1e-6
    model.score = [math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0]
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with score and spans (offsets and marginals of toxic words).

    Only the text decides. A null or empty text has the score of a text without evidence and no spans. Columns
    of these names are replaced.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "spans")]
    own = spare(docs, "_text")
    rows = docs.select(*kept, F.col(text).alias(own))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def build():
        model = shared.value

        def step(batch):
            found = [model.document(t) for t in texts(batch, own)]
            yield {c: batch.column(c) for c in kept} | {
                "score": [f[0] for f in found], "spans": pa.array([f[1] for f in found], pa.list_(_SPAN))
            }

        return step

    return scan(rows, build, f"{fields}score double, spans {_SPANS}")
