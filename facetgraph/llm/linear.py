"""Text classifiers over hashed features, trained in one task on a bounded sample of labelled rows.

FTRL-proximal logistic regression scores toxicity from word n-grams and skip-grams; ordinal cumulative-link
regression grades quality from words and their shapes. A labelled sample of at most ``MAX_TRAIN`` documents (those
whose ids hash lowest) trains a model; scoring covers every row and whole texts. Models are bounded by the hash
space and, for FTRL, made sparse by L1; they go to tasks in the closure.

Defined results: null text counts as empty and scores as the intercept says; several labels of a document count as
their maximum, null ones not at all; without any label a score is 0.5 (toxicity) or the middle grade; rows that
repeat are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, mapped, mixed, shingles, sliced, small_batches, texts_of

MAX_TRAIN = 12_000
BITS = 20
# Each byte to its lower case; ASCII marks and white space to a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def sample(df: DataFrame, labels: DataFrame, label: Column, id_col: str, text: str, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` labelled documents (h, text, y), by the hash of the id; ``label`` is over labels' columns."""
    y = labels.select(F.col(id_col).alias("_i"), label.alias("y")).where("y is not null and _i is not null").groupBy("_i").agg(F.max("y").cast("int").alias("y"))
    y = y.withColumn("h", F.xxhash64("_i")).orderBy("h").limit(most)
    return df.select(F.col(id_col).alias("_i"), F.col(text).alias("text")).join(F.broadcast(y), "_i").select("h", "text", "y")


def fitted(rows: DataFrame, features, fit) -> dict:
    """fit(list of (features, y)) in a task of its own, over sample()'s rows in the order of h; without rows, fit([])."""

    def hashed(batches):
        import pyarrow as pa

        make = features()
        for b in sliced(batches):
            x = [make(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_pydict({"h": b.column(0), "y": b.column(2), "i": pa.array([a.astype("<u4").tobytes() for a, _ in x], pa.binary()), "v": pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())})

    def run(batches):
        import pyarrow as pa

        data = []
        for b in batches:
            data += [(np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4"), y) for i, v, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(1).to_pylist(), strict=True)]
        index, weight, extra = fit(data)
        yield pa.RecordBatch.from_pydict({"i": pa.array([index.astype("<u4").tobytes()], pa.binary()), "w": pa.array([weight.astype("<f8").tobytes()], pa.binary()), "x": pa.array([np.asarray(extra, "<f8").tobytes()], pa.binary())})

    # texts are hashed where they are read; only the bounded sample's features go to the one task
    some = mapped(rows, hashed, "h long, y int, i binary, v binary").repartition(1).sortWithinPartitions("h", "i")
    with small_batches(rows.sparkSession):
        got = mapped(some, run, "i binary, w binary, x binary").collect()  # one row, bounded by the hash space
    if not got:  # no labelled row, so no task
        return dict(zip("iwx", map(np.asarray, fit([])), strict=True))
    return {"i": np.frombuffer(got[0].i, "<u4"), "w": np.frombuffer(got[0].w, "<f8"), "x": np.frombuffer(got[0].x, "<f8")}


def scored(df: DataFrame, id_cols: list[str], text: str, model: dict, features, score, schema: str) -> DataFrame:
    """df's id_cols and what ``score(weights, extra, index, value)`` returns (a tuple, as in schema)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        make, w = features(), np.zeros(1 << BITS)
        w[model["i"]] = model["w"]
        for b in sliced(batches):
            out = [score(w, model["x"], *make(t, w)) for t in texts_of(b.column(b.num_columns - 1))]
            cols = [b.column(i) for i in range(len(id_cols))] + [pa.array(c, pa.float64()) for c in zip(*out, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(id_cols))] + names)

    kept = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(id_cols)], F.col(text).alias("_t"))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(id_cols))
    return mapped(kept, run, f"{kinds}, {schema}").withColumnsRenamed({f"c{i}": c for i, c in enumerate(id_cols)})


# Toxicity: FTRL-proximal


class NGrams:
    """Distinct hashed unigrams, bigrams and skip-grams (one word left out) of a text, each 1; unigrams also as stems,
    the word's first bytes, since inflected words are each too rare to learn from."""

    STEMS = (5, 7)

    def __init__(self):
        self.hash = WordHash()
        self.stems: dict[bytes, list[int]] = {}

    def _stems(self, word: bytes) -> list[int]:
        x = [self.hash[b"\x02%d" % n + word[:n]] if len(word) > n else 0 for n in self.STEMS]
        if len(self.stems) < WordHash.LIMIT:
            self.stems[word] = x
        return x

    def __call__(self, text: bytes, w: np.ndarray | None = None):
        words = text.translate(PLAIN).split()
        h, known = self.hash.of(words), self.stems
        stems = np.array([known.get(x) or self._stems(x) for x in set(words)], dtype=np.uint64).reshape(-1)
        skip = mixed(h[:-2] * np.uint64(3) + h[2:] * np.uint64(5) + np.uint64(7)) if len(h) > 2 else h[:0]
        i = (np.concatenate([mixed(h), mixed(stems[stems != 0]), shingles(h, 2) if len(h) > 1 else h[:0], skip]) >> np.uint64(64 - BITS)).astype(np.int64)
        if w is not None:
            i = i[w[i] != 0]
        i = np.unique(i)
        return i, np.ones(len(i))


def ftrl(data: list, alpha: float = 5.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 8):
    """(index, weight) of the coordinates L1 leaves, and the intercept."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            i, _, y = data[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            root = np.sqrt(ni + g * g)
            z[i] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    i = np.flatnonzero(w)
    return i, w[i], [bias]


def _toxic(w, extra, i, v):
    return (float(1 / (1 + np.exp(-np.clip(w[i].sum() + extra[0], -35, 35)))),)


def toxicity_model(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> dict:
    """A model of labels.toxic, from labels' rows for which ``train`` holds."""
    return fitted(sample(df, labels.where(train), F.col("toxic"), id_col, text, most), NGrams, ftrl)


def toxicity(df: DataFrame, model: dict, id_cols: list[str], text: str = "text") -> DataFrame:
    return scored(df, id_cols, text, model, NGrams, _toxic, "score double")


# Quality: ordinal cumulative-link regression

GRADES = 3


class Shapes:
    """Words and word shapes by their share of the text, and the text's own traits, hashed."""

    #: Words that a worker keeps.
    REMEMBER = 1 << 16

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.hash = WordHash()
        self.hash.LIMIT = self.REMEMBER

    def _of(self, word: bytes) -> tuple[int, int]:
        tail = word[len(word.rstrip(b".,!?%&#$*|;:\"'")) :]
        core = word[: len(word) - len(tail)]
        shape = b"\x00" + (b"U" if core.isupper() and len(core) > 1 else b"T" if core[:1].isupper() else b"d" if core[:1].isdigit() else b"l") + tail[:3]
        x = (self.hash[core.lower()], self.hash[shape])
        if len(self.known) < self.REMEMBER:
            self.known[word] = x
        return x

    def _trait(self, name: str, x: float) -> int:
        return self.hash[f"\x01{name}:{int(x)}".encode()]

    def __call__(self, text: bytes, w: np.ndarray | None = None):
        words = text.split()
        known, n = self.known, len(words)
        pairs = np.array([known.get(x) or self._of(x) for x in words], dtype=np.uint64).reshape(-1, 2)
        lines = [x for x in text.split(b"\n") if x]
        traits = np.array([self._trait("length", np.log2(n + 1)), self._trait("repeat", 10 * len(set(words)) / max(1, n)), self._trait("lines", 10 * len(set(lines)) / max(1, len(lines)))], dtype=np.uint64)
        parts = []
        for h, scale in ((pairs[:, 0], 1.0), (pairs[:, 1], 1.0), (traits, 0.3)):
            i, c = np.unique((mixed(h) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
            c = np.sqrt(c)
            parts.append((i, scale * c / max(1e-9, np.sqrt((c * c).sum()))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def ordinal(data: list, rate: float = 0.5, l2: float = 1e-6, epochs: int = 5):
    """Shared weights and ordered thresholds t1 < t2 < ..: P(grade >= k) = s(w x - t_k). AdaGrad; the thresholds are
    a first and logarithms of steps, so that they stay ordered."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.bincount(np.array([y for *_, y in data], dtype=np.int64), minlength=GRADES)[::-1].cumsum()[::-1][1:] / max(1, len(data))
    start = -np.log((share + 0.01) / (1.01 - share))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))]) if len(data) else np.zeros(GRADES - 1)
    tg = np.full(GRADES - 1, 1.0)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            i, v, y = data[k]
            cuts = t[0] + np.concatenate([[0], np.exp(t[1:])]).cumsum()
            s = 1 / (1 + np.exp(np.clip(cuts - w[i] @ v, -35, 35)))  # P(grade >= 1), ...
            # P(y) = s[y-1] - s[y]; its log's slope in w x is 1 - s[y-1] - s[y], with s[-1] = 1 and s[last] = 0
            lo, hi = (1.0 if y == 0 else s[y - 1]), (0.0 if y == GRADES - 1 else s[y])
            slope = 1 - lo - hi
            g = -slope * v + l2 * w[i]
            np.add.at(g2, i, g * g)
            np.add.at(w, i, -rate * g / np.sqrt(g2[i]))
            p = max(lo - hi, 1e-9)
            dc = np.zeros(GRADES - 1)  # d log P / d cut
            if y > 0:
                dc[y - 1] -= lo * (1 - lo) / p
            if y < GRADES - 1:
                dc[y] += hi * (1 - hi) / p
            dt = np.concatenate([[dc.sum()], np.exp(t[1:]) * dc[::-1].cumsum()[::-1][1:]])
            tg += dt * dt
            t += 0.2 * dt / np.sqrt(tg)
    i = np.flatnonzero(w)
    return i, w[i], t[0] + np.concatenate([[0], np.exp(t[1:])]).cumsum()


def _graded(w, cuts, i, v):
    s = 1 / (1 + np.exp(np.clip(cuts - w[i] @ v, -35, 35)))
    return (float(s.sum()), *map(float, s))


def grade(labels: DataFrame) -> Column:
    """Ratings from labels: 0 poor, 1 good but toxic, 2 good; null where quality is."""
    del labels
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)


def quality_model(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> dict:
    return fitted(sample(df, labels, grade(labels), id_col, text, most), Shapes, ordinal)


def quality(df: DataFrame, model: dict, id_cols: list[str], text: str = "text") -> DataFrame:
    """expected grade (0 to 2) and the tail probabilities of grades 1 and 2."""
    return scored(df, id_cols, text, model, Shapes, _graded, "expected double, p1 double, p2 double")
