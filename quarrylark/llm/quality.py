"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), and the pairs cost linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ].

Features of one row: words hashed to a fixed range with log-damped counts of unit length, their shapes (letters,
digits, signs) hashed likewise, statistics of structure (shares of letters, signs, upper case, repeated lines and
words, lengths), and as metadata the text's length. Source, language, labels and keys are not inputs. Training reads
at most SAMPLE labelled rows (by hash of the key) to the driver, a documented bound, balances the classes by weight
and runs AdaGrad with a fixed seed. Every row is scored from its whole text.

Defined results: null text is empty; an empty text is scored from its statistics; with labels of one class only, or
none, the score is the share of label 1 (0.5 with none). A row repeated is a row, with the score of its text; a key
labelled twice teaches twice; a null key is scored and never teaches; an empty table gives none; other columns of the
documents aren't read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, learns, texts_of, trimmed

#: Labelled rows that are read for training, at most.
SAMPLE = 6_000
#: Hash range of words and of shapes.
WORDS, SHAPES, STATS = 1 << 15, 1 << 10, 16
SIZE = WORDS + SHAPES + STATS
RANK, EPOCHS, STEP, L2 = 8, 12, 0.05, 1e-5
SHAPE = bytes(ord("a") if chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else ord("w") if c >= 128 else c for c in range(256))
RUNS = re.compile(rb"([aA0w])\1+")


class Features:
    """Sparse features of texts; memos of words and shapes are bounded."""

    LIMIT = 100_000

    def __init__(self) -> None:
        self.memo: dict[bytes, tuple[int, int]] = {}

    def slot(self, word: bytes) -> tuple[int, int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.LIMIT:
                self.memo.clear()
            shape = RUNS.sub(rb"\1", word.translate(SHAPE))
            got = self.memo[word] = (xxhash.xxh3_64_intdigest(word.lower()) % WORDS, WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES)
        return got

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values."""
        words = text.split()
        counts = Counter(words)
        slots = np.array([self.slot(w) for w in counts], np.int64).reshape(-1, 2)
        n = np.fromiter(counts.values(), float, len(counts))
        index, value = [], []
        for c in range(2):
            i, back = np.unique(slots[:, c], return_inverse=True)
            v = np.log1p(np.bincount(back, n, len(i)))
            index.append(i)
            value.append(v / max(1e-9, np.sqrt((v * v).sum())))
        index.append(np.arange(WORDS + SHAPES, SIZE))
        value.append(self.stats(text, words, counts, slots, n))
        return np.concatenate(index), np.concatenate(value)

    @staticmethod
    def stats(text: bytes, words: list[bytes], counts: Counter, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        b = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
        size, k = max(1, len(text)), max(1, len(words))
        lower, upper, digits = b[97:123].sum(), b[65:91].sum(), b[48:58].sum()
        signs = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum() - b[44] - b[46]
        lines = text.split(b"\n")
        full = [x for x in lines if x.strip()]
        top = max(counts.values(), default=0)
        same = sum(x == y for x, y in zip(words, words[1:], strict=False))
        return np.array([
            1.0, np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, lower / size, upper / size, digits / size, 4 * signs / size, b[128:].sum() / size,
            len(text) / k / 20, len(counts) / k, 1 - len(set(full)) / max(1, len(full)), top / k, 2 * same / k, np.log1p(len(lines)) / 10, 10 * b[124] / size, float(not words),
        ])


@functools.lru_cache(1)
def features() -> Features:
    """One for each worker: tasks that follow one another share its memo."""
    return Features()


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows as runs of index and value from starts."""
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + pairs

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    ones = labels.mean() if len(labels) else 0.5
    if ones in (0.0, 1.0) or not len(labels):
        p = np.clip(ones, 1e-6, 1 - 1e-6)
        return Machine(float(np.log(p / (1 - p))), w, np.zeros_like(v))
    w0, g0, gw, gv = 0.0, 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 64):
            part = order[s : s + 64]
            index = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            vx = v[index] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(w[index] * x, starts) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)
            each = np.repeat(g, sizes)
            u, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, each * x, len(u)) + L2 * w[u]
            inner = (np.repeat(sums, sizes, 0) - vx) * (each * x)[:, None]
            dv = np.stack([np.bincount(back, inner[:, f], len(u)) for f in range(RANK)], 1) + L2 * v[u]
            g0 += g.sum() ** 2
            w0 -= STEP * g.sum() / np.sqrt(g0)
            gw[u] += dw * dw
            w[u] -= STEP * dw / np.sqrt(gw[u])
            gv[u] += dv * dv
            v[u] -= STEP * dv / np.sqrt(gv[u])
    return Machine(w0, w, v)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """labelled: rows to learn from; those with a null label are passed over."""
    configure(labelled.sparkSession)

    def run(batches):
        f = features()
        for b in batches:
            rows = [f.of(x) for x in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype("<u4").tobytes() for i, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary()), b.column("label"), b.column("key")], ["i", "x", "label", "key"])

    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key), F.lit(11)).alias("key"))
    n = rows.select("key").count()
    if n > sample:  # the key's hash decides, so a retried task draws the same rows
        cut = int(-(2**63) + 2**64 * min(1.0, 1.02 * sample / n))
        rows = rows.filter(F.col("key") < cut)
    got = rows.mapInArrow(run, "i binary, x binary, label int, key long").toArrow().sort_by("key").slice(0, sample)
    taught = [(np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for i, x in zip(got.column("i").to_pylist(), got.column("x").to_pylist(), strict=True)]
    return fit(taught, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))  # of fixed size

    @trimmed
    def run(batches):
        f, m = features(), Machine(*shared.value)
        for b in batches:
            t = texts_of(b, "text")
            scores = np.concatenate([m.score([f.of(x) for x in t[s : s + 64]]) for s in range(0, len(t), 64)]) if t else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(scores.astype(float), pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def labelled_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with labels, of the keys that may teach."""
    teach = labels.filter(learns(key, 3, 1)).select(key, "quality")
    return docs.select(key, "text").join(teach, key)


def op4_fm_quality(spark, sf_dir):
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, machine)
    return out.select("doc_id", (~learns("doc_id", 3, 1)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
