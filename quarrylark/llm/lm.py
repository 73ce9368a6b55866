"""N-gram language model: interpolated modified Kneser-Ney, counted in Spark, scored from mapped hash arrays.

Counting is a chain of exchanges. Map tasks sort and combine the n-grams of a bounded run of tokens and send one
packed block to each owner (a range of the n-gram's hash); an owner merges its blocks, writes its sorted arrays as one
file in the shared folder, and passes on what the next lower order needs: one continuation per distinct n-gram to its
suffix, and totals with counts-of-counts to its context. Nothing but a few sums for each order comes to the driver.

Workers map those files and compute probabilities from counts at lookup, so no join attaches probabilities to n-grams.
A lookup is a bounded binary search for the n-gram's 32-bit remainder inside the bucket that its high bits name.

Defined results: null text is empty; an empty text is one end token; words never seen share the uniform share of the
lowest order; with no training text at all every token has probability 1. Repeated rows count as often as they occur and
are scored each; a null key is scored and stays null; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, configure, input_bytes, learns, mix, posix, shared_folder, texts_of, trimmed, word_hashes, words_of, write_atomic

#: Words are 48-bit hashes; the two marks can't be made by a word's hash, which is made odd.
WORD_BITS = np.uint64((1 << 48) - 1)
BEGIN, END = np.uint64(2), np.uint64(4)
#: Tokens that a map task combines before it sends blocks.
RUN_TOKENS = 700_000
#: Input bytes for each owner.
OWNER_BYTES = 6 << 20
#: Receivers that a task sends to at once. More owners than these are reached in two steps, by way of groups of them.
WIDE = 4096
#: Files that a worker maps at once; Linux allows about 65,000 maps a process.
MAPS = 8_192
#: n-grams in a bucket of an array, about.
BUCKET = 48
VALUES = ("a", "raw", "total", "n1", "n2", "n3")


def ngram_hash(keys: np.ndarray) -> np.ndarray:
    """keys: (rows, n) word hashes."""
    h = np.full(len(keys), keys.shape[1], np.uint64)
    for k in range(keys.shape[1]):
        h = mix(h * MIX + keys[:, k])
    return h


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def combined(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum the values of equal keys; sorted by hash."""
    h = ngram_hash(keys)
    order = np.argsort(h)
    h = h[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[starts], keys[order[starts]], np.add.reduceat(values[order], starts, axis=0) if len(h) else values


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A block: 6 bytes a word, values as small integers by column, compressed."""
    out = [struct.pack("<IHH", len(keys), keys.shape[1], values.shape[1])]
    words = np.ascontiguousarray(keys.T).view(np.uint8).reshape(keys.shape[1], -1, 8)[:, :, :6]
    out.append(np.ascontiguousarray(words).tobytes())
    for c in range(values.shape[1]):
        out.append(small(values[:, c]))
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack("<Q", blob[:8])[0], codec="zstd", asbytes=True)
    rows, n, columns = struct.unpack("<IHH", raw[:8])
    keys = np.zeros((n, rows, 8), np.uint8)
    keys[:, :, :6] = np.frombuffer(raw, np.uint8, n * rows * 6, 8).reshape(n, rows, 6)
    values, at = np.empty((rows, columns), np.int64), 8 + n * rows * 6
    for c in range(columns):
        values[:, c], at = unsmall(raw, at, rows)
    return keys.view(np.uint64)[:, :, 0].T, values


def small(x: np.ndarray) -> bytes:
    """A byte a value; 255 stands for the next value of the list that follows."""
    big = x[x >= 255]
    return np.minimum(x, 255).astype(np.uint8).tobytes() + struct.pack("<I", len(big)) + big.astype("<i8").tobytes()


def unsmall(raw: bytes, at: int, rows: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(raw, np.uint8, rows, at).astype(np.int64)
    (n,) = struct.unpack_from("<I", raw, at + rows)
    x[x == 255] = np.frombuffer(raw, "<i8", n, at + rows + 4)
    return x, at + rows + 4 + 8 * n


def token_hashes(text: bytes) -> np.ndarray:
    h = word_hashes(words_of(text)) & WORD_BITS | np.uint64(1)
    return np.append(h, END)


def windows(tokens: list[np.ndarray], order: int) -> np.ndarray:
    """Every token with the order - 1 before it, over all texts: (tokens, order)."""
    ends = np.cumsum([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    keys = np.empty((len(flat), order), np.uint64)
    place = np.arange(len(flat)) - np.repeat(ends - [len(t) for t in tokens], [len(t) for t in tokens])
    for back in range(order):
        keys[back:, order - 1 - back] = flat[: len(flat) - back]
        keys[place < back, order - 1 - back] = BEGIN
    return keys


def blocks_of(keys: np.ndarray, values: np.ndarray, owners: int) -> Iterator[tuple[int, bytes]]:
    h, keys, values = combined(keys, values)
    whose = owner_of(h, owners)
    cut = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1], [True]))) if len(h) else []
    for i in range(len(cut) - 1):
        yield int(whose[cut[i]]), packed(keys[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]])


def batch_of(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.binary())], ["owner", "block"])


def counting(order: int, owners: int):
    @trimmed
    def run(batches):
        held, n = [], 0

        def flush():
            keys = windows(held, order)
            return batch_of(list(blocks_of(keys, np.ones((len(keys), 1), np.int64), owners)))

        for b in batches:
            for text in texts_of(b, "text"):
                held.append(token_hashes(text))
                n += len(held[-1])
                if n >= RUN_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def regrouping(owners: int):
    """Blocks of groups of owners, combined again and cut for the owners themselves."""

    @trimmed
    def run(batches):
        held, n = [], 0

        def flush():
            keys, values = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            return batch_of(list(blocks_of(keys, values, owners)))

        for b in batches:
            for blob in b.column("block").to_pylist():
                held.append(unpacked(blob))
                n += len(held[-1][0])
                if n >= RUN_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


# ---------------------------------------------------------------- arrays in files


def write_shard(path: str, h: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """Sorted arrays of one owner: bucket starts, 32-bit remainders, a byte a value with the large ones apart."""
    bits = max(1, math.ceil(math.log2(max(2, len(h) / BUCKET))))
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    # the owner is a range of the hash's high half; buckets are of the middle, remainders of the low half
    middle = (mix(h) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((low, middle))
    parts = {"starts": np.searchsorted(middle[order], np.arange((1 << bits) + 1)).astype(np.uint32), "low": low[order]}
    for name, x in columns.items():
        x = x[order]
        at = np.flatnonzero(x >= 255).astype(np.uint32)
        parts |= {name: np.minimum(x, 255).astype(np.uint8), f"{name}_at": at, f"{name}_big": x[at].astype(np.int64)}
    layout, at = {"bits": bits, "parts": {}}, 0
    for name, x in parts.items():
        layout["parts"][name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(layout).encode()
    head += b" " * (-(len(head) + 8) % 8)
    body = b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts.values())
    write_atomic(path, struct.pack("<Q", len(head)) + head + body)


class Shard:
    """A mapped file of write_shard()."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = struct.unpack("<Q", raw[:8].tobytes())[0]
        layout = json.loads(raw[8 : 8 + n].tobytes())
        self.bits = layout["bits"]
        self.part = {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in layout["parts"].items()}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        low, starts = self.part["low"], self.part["starts"]
        want = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        b = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        lo, end = starts[b].astype(np.int64), starts[b + 1].astype(np.int64)
        hi = end.copy()
        for _ in range(int(hi.max(initial=0) and (hi - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (low[np.minimum(mid, len(low) - 1)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        hit = lo < end
        hit[hit] = low[lo[hit]] == want[hit]
        return np.where(hit, lo, -1)

    def value(self, name: str, row: np.ndarray) -> np.ndarray:
        x = np.zeros(len(row), np.int64)
        there = row >= 0
        x[there] = self.part[name][row[there]]
        if len(at := self.part[f"{name}_at"]):
            big = np.flatnonzero(x == 255)
            x[big] = self.part[f"{name}_big"][np.searchsorted(at, row[big])]
        return x


def merging(n: int, order: int, groups: int, folder: str):
    """Owner of order n: write its arrays, give the sums of its order and, to groups of owners, the blocks for order n - 1."""

    def run(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        got = [unpacked(x) for x in table.column("block").to_pylist()]
        keys, values = np.concatenate([k for k, _ in got]), np.concatenate([v for _, v in got])
        del got, table
        h, keys, values = combined(keys, values)
        a = values[:, 0]
        raw = values[:, 1] if n < order else a
        entry = a > 0
        columns = {"a": a} | ({"total": values[:, 2], "n1": values[:, 3], "n2": values[:, 4], "n3": values[:, 5]} if n < order else {}) | ({"raw": raw} if n == 1 else {})
        write_shard(f"{folder}/{n}/{owner:08d}", h, columns)
        sums = {"types": int(entry.sum()), "a": int(a.sum()), "raw": int(raw[entry].sum()), **{f"c{k}": int((a == k).sum()) for k in (1, 2, 3, 4)}, "c3up": int((a >= 3).sum())}
        out = [(-1, json.dumps(sums).encode())]
        if n > 1:
            k, a, raw = keys[entry], a[entry], raw[entry]
            zero = np.zeros(len(k), np.int64)
            whole = (k[:, 1] == BEGIN) if n > 2 else np.zeros(len(k), bool)  # nothing precedes a begin mark: raw counts stand for continuations
            down = np.stack([np.where(whole, raw, 1), raw, zero, zero, zero, zero], 1)
            up = np.stack([zero, zero, a, a == 1, a == 2, a >= 3], 1).astype(np.int64)
            out += blocks_of(np.concatenate([k[:, 1:], k[:, :-1]]), np.concatenate([down, up]), groups)
        return pa.Table.from_batches([batch_of(out)])

    return run


def discounts(s: dict) -> list[float]:
    """D1, D2, D3+ from the counts of counts; 0.5, 1, 1.5 where a corpus is too small to give them."""
    c = [s["c1"], s["c2"], s["c3"], s["c4"]]
    if min(c) == 0:
        return [0.5, 1.0, 1.5]
    y = c[0] / (c[0] + 2 * c[1])
    return [min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


@dataclass
class Model:
    """What workers need: the folder of the arrays, owners, and for each order its sums and discounts."""

    folder: str
    order: int
    owners: int
    sums: list[dict]

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.m, self.d, self.shards = model, [discounts(s) for s in model.sums], {}

    def shard(self, n: int, owner: int) -> Shard | None:
        """The mapped file; that which was used the longest time ago is closed for it."""
        got = self.shards.pop((n, owner), self)
        if got is self:
            path = f"{self.m.folder}/{n}/{owner:08d}"
            got = Shard(path) if os.path.exists(path) else None
            if len(self.shards) >= MAPS:
                del self.shards[next(iter(self.shards))]
        self.shards[n, owner] = got
        return got

    def rows(self, n: int, keys: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        """Values of n-grams, each distinct one looked up once, owner by owner."""
        h, back = np.unique(ngram_hash(keys), return_inverse=True)
        out = np.zeros((len(h), len(names)), np.int64)
        whose = owner_of(h, self.m.owners).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1], [True]))) if len(h) else []
        for i in range(len(cut) - 1):
            part, o = slice(cut[i], cut[i + 1]), int(whose[cut[i]])
            if shard := self.shard(n, o):
                row = shard.find(h[part])
                for c, name in enumerate(names):
                    out[part, c] = shard.value(name, row)
        return out[back]

    def probabilities(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the last word of each window, and its raw count."""
        s1 = self.m.sums[0]
        p, raw, context = np.full(len(keys), 1 / (s1["types"] + 1)), None, None
        for n in range(1, self.m.order + 1):
            names = ("a",) + (("raw",) if n == 1 else ())
            got = self.rows(n, keys[:, -n:], names)
            a = got[:, 0]
            if n == 1:
                raw = got[:, 1]
                context = np.tile([s1["a"], s1["c1"], s1["c2"], s1["c3up"]], (len(keys), 1))
            else:
                context = self.rows(n - 1, keys[:, -n:-1], VALUES[2:])
            d = self.d[n - 1]
            total = context[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.maximum(a - np.array([0.0, *d])[np.minimum(a, 3)], 0) / total + (context[:, 1:] @ np.array(d)) / total * p
            p = np.where(total > 0, q, p)
        return p, raw


def train(docs: DataFrame, order: int = 2, text: str = "text") -> Model:
    """Count the model over all of docs' texts."""
    spark = docs.sparkSession
    configure(spark)
    folder = shared_folder(spark, "lm")
    size = input_bytes(docs)
    if size >= 1 << 50:  # no statistics
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES))
    groups = min(owners, WIDE)
    schema = "owner int, block binary"
    blocks = docs.select(F.col(text).alias("text")).mapInArrow(counting(order, groups), schema)
    sums: list[dict] = []
    for n in range(order, 0, -1):
        path = f"{folder}/blocks-{n}"
        if groups < owners:  # a group is a range of owners, so its blocks go on to those alone
            blocks = blocks.repartition("owner").mapInArrow(regrouping(owners), schema)
        blocks.groupBy("owner").applyInArrow(merging(n, order, groups, posix(folder)), schema).write.parquet(path)
        blocks = spark.read.schema(schema).parquet(path)
        parts = blocks.filter("owner = -1").select(F.from_json(F.decode("block", "UTF-8"), "map<string,bigint>").alias("m"))
        names = ("types", "a", "raw", "c1", "c2", "c3", "c4", "c3up")
        got = parts.agg(*[F.coalesce(F.sum(F.col("m")[k]), F.lit(0)).alias(k) for k in names]).first()
        sums.insert(0, got.asDict())
        blocks = blocks.filter("owner >= 0")
    return Model(posix(folder), order, owners, sums)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's log10 probability, its tokens, those known, and the smoothed unigram score."""

    @trimmed
    def run(batches):
        scorer, s1 = model.open(), model.sums[0]
        for b in batches:
            tokens = [token_hashes(x) for x in texts_of(b, "text")]
            if not tokens:
                continue
            starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])[:-1]))
            p, c = scorer.probabilities(windows(tokens, model.order))
            base = np.log10((c + 0.5) / (s1["raw"] + 0.5 * (s1["types"] + 1)))
            columns = [b.column("key"), pa.array([len(t) for t in tokens], pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("key", key)


def op1_lm_score(spark, sf_dir):
    """Contract query: the model of the documents that learn, over all documents. See README for the order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(learns()).select("text"))
    out = score(docs, model)
    return out.select("doc_id", (~learns()).alias("held_out"), "n_tokens", "n_known", F.lit(model.sums[0]["raw"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
