"""Document fingerprints by order MinHash, and how like a document is to its edited text and to the next document.

A text's k-mers are K code points long and numbered by occurrence: the pair of a k-mer and how often it came before is
one element, so repetitions count. Each of M permutations picks the L minimal elements; they are put back into text
order and hashed as a tuple. Two texts agree in a permutation only if they share the minimal elements and have them in
one order, so the share of equal tuples follows edit distance, not only the sets of k-mers (Marcais, DeBlasio, Pandey,
Kingsford 2019).

In numpy, for one text at a time: rolling hashes by doubling, occurrence numbers from one sort of (hash, position),
permutations as odd multipliers of a 32-bit element hash, each read from both ends. Only elements below a bound that
about LOOK of them pass in each permutation are looked at; where fewer than L do, the bound is lifted for that text, so the
minimal elements are the true ones.

Neighbours meet without a join: rows are range-partitioned and sorted by (key, hash of the text, place), and a task
compares each row with the one after it in one pass, so texts are shuffled once. The first and the last row of each
partition are written with their texts, two rows a partition, and paired over the borders afterwards.

Defined results: null text is empty; a text shorter than K code points is one k-mer, filled up, so that two empty texts
are alike and no other is like them; rows are ordered by key, null first, rows of one key by the hash of their text
and repeated rows by place, so a repetition's next is the repetition; a single row's next is itself; an empty table gives
none. Other columns, whatever their names, aren't read and don't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, located, materialise, mix, trimmed

#: Code points of a k-mer (a power of two), elements of a tuple, permutations.
K, L, M = 8, 2, 32
#: Elements that are looked at in each permutation, about, and elements that are multiplied at once.
LOOK, BLOCK = 12, 4096
#: Stands where a short text has no code point: no code point is as large.
FILL = 0x110000

STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Low bits of the sort that hold a position: as many code points as a text can have. The k-mer's hash keeps the others.
PLACE = np.uint64((1 << 31) - 1)
LOW = np.uint64(32)
FULL = (1 << 32) - 1
#: An odd multiplier for each two permutations, from one rule: products in rising and in falling order.
FACTORS = (mix(np.arange(1, M // 2 + 1, dtype=np.uint64) * STEPS[0]) >> LOW).astype(np.uint32)[:, None] | np.uint32(1)


def code_points(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return c if len(c) >= K else np.concatenate([c, np.full(K - len(c), FILL, np.uint64)])


def spread(h: np.ndarray) -> np.ndarray:
    """Bits of an own array, mixed in place."""
    h ^= h >> LOW
    h *= STEPS[4]
    h ^= h >> np.uint64(29)
    h *= STEPS[3]
    return h


def kmers(c: np.ndarray) -> np.ndarray:
    """Hash of the K code points from each place on; each step joins hashes of neighbours of half its width."""
    h, width, step = c, 1, 0
    while width < K:
        h = h[: len(h) - width] * STEPS[step] + h[width:]
        width, step = width * 2, step + 1
    return spread(h)


def elements(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of k-mer and occurrence number, and where each stands."""
    h = kmers(c)
    n = len(h)
    h &= ~PLACE
    h |= np.arange(n, dtype=np.uint64)
    h.sort()
    at = (h & PLACE).astype(np.int64)
    h &= ~PLACE
    same = h[1:] == h[:-1]
    if same.any():
        begin = np.flatnonzero(np.append(True, ~same))
        occurrence = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        h += occurrence.astype(np.uint64) * STEPS[1]
    return (spread(h) >> LOW).astype(np.uint32), at


def looked(x: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permutation, index and value of the elements that a permutation puts at the bound or below."""
    who, index, value = [], [], []
    both = 2 * bound >= FULL
    for s in range(0, len(x), BLOCK):
        part = x[s : s + BLOCK]
        y = FACTORS * part
        flat = np.arange(y.size) if both else np.flatnonzero(y + np.uint32(bound) <= np.uint32(2 * bound))
        i = flat // len(part)
        j, v = flat - i * len(part) + s, y.ravel()[flat]
        up = v > FULL >> 1
        if both:
            i, j, v, up = np.concatenate([i, i]), np.concatenate([j, j]), np.concatenate([v, v]), np.arange(2 * len(v)) >= len(v)
        who.append(2 * i + up)
        index.append(j)
        value.append(np.where(up, ~v, v))
    return np.concatenate(who), np.concatenate(index), np.concatenate(value)


def fingerprint(text: str) -> np.ndarray:
    """M hashes of 32 bits."""
    x, at = elements(code_points(text))
    n = len(x)
    take, bound = min(L, n), min(FULL, LOOK * FULL // n)
    i, index, y = looked(x, bound)
    while bound < FULL and np.bincount(i, minlength=M).min() < take:
        bound = min(FULL, bound * 8)
        i, index, y = looked(x, bound)
    # by permutation, value and index, so that equal values have one order too
    by = np.lexsort((y, i)) if len(i) >> 27 else (np.sort((i.astype(np.uint64) << np.uint64(59)) | (y.astype(np.uint64) << np.uint64(27)) | np.arange(len(i), dtype=np.uint64)) & np.uint64((1 << 27) - 1)).astype(np.int64)
    rows = by[np.searchsorted(i[by], np.arange(M))[:, None] + np.arange(take)]
    chosen = index[rows]
    chosen = np.take_along_axis(chosen, np.argsort(at[chosen], 1), 1)
    out = np.full(M, STEPS[1] + np.uint64(take))
    for t in range(take):
        out = spread(out * STEPS[2] + x[chosen[:, t]])
    return (out >> LOW).astype(np.uint32)


def spelled(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of permutations whose tuples are equal."""
    return float((a == b).mean())


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in batch.column(column).cast(pa.binary()).to_pylist()]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint (hexadecimal) of each row, without any shuffle."""
    configure(docs.sparkSession)
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    @trimmed
    def run(batches):
        for b in batches:
            t = strings(b)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(map(len, t), pa.int64()), pa.array([spelled(fingerprint(x)) for x in t], pa.string())], ["key", "n_chars", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of text, rounded down, gives way to as many first code points of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    e = edited(text, following)
    f = own if e == text else fingerprint(e)
    return len(text), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), spelled(own), spelled(f), likeness(own, f), likeness(own, other)


FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def edited_and_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and compared() of each row with the one after it in order of key, after the last the first."""
    spark = docs.sparkSession
    configure(spark)
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rows = located(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    order = [F.asc_nulls_first("key"), F.xxhash64("text"), F.col("cell"), F.col("place")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    @trimmed
    def run(batches):
        """Rows compared with the next of their partition; its first (head) and last (tail) row with their texts."""
        part, held = TaskContext.get().partitionId(), None

        def batch(keys, found, heads, tails, texts):
            arrays = [pa.array([part] * len(found), pa.int32()), keys, *[pa.array([f and f[i] for f in found], t) for i, t in enumerate(KINDS)]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(heads), pa.array(tails), pa.array(texts, pa.string())], ["part", "key", *NAMES, "head", "tail", "text"])

        for b in batches:
            t, keys = strings(b), b.column("key")
            begin = held is None
            if not t:
                continue
            now = [(x, fingerprint(x)) for x in t]
            if begin:
                yield batch(keys[:1], [None], [True], [False], t[:1])
            else:
                yield batch(held[0], [compared(*held[1], *now[0])], [False], [False], [None])
            if len(now) > 1:
                found = [compared(*x, *y) for x, y in zip(now, now[1:], strict=False)]
                yield batch(keys[: len(found)], found, [False] * len(found), [False] * len(found), [None] * len(found))
            held = keys[len(t) - 1 :], now[-1]
        if held is not None:
            yield batch(held[0], [None], [False], [True], [held[1][0]])

    made = materialise(sorted_.mapInArrow(run, f"part int, key {kind}, {FOUND}, head boolean, tail boolean, text string"), "neighbours")
    parts = sorted(r.part for r in made.filter("head").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, other int")
    heads = made.filter("head").select(F.col("part").alias("other"), F.col("text").alias("following"))
    borders = made.filter("tail").select("part", "key", "text").join(F.broadcast(after), "part").join(heads.hint("shuffle_merge"), "other").select("key", "text", "following")

    @trimmed
    def over(batches):
        for b in batches:
            found = [compared(x, fingerprint(x), y, fingerprint(y)) for x, y in zip(strings(b), strings(b, "following"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array([f[i] for f in found], t) for i, t in enumerate(KINDS)]], ["key", *NAMES])

    return made.filter("NOT head AND NOT tail").select("key", *NAMES).unionByName(borders.mapInArrow(over, f"key {kind}, {FOUND}"))


def op11_order_minhash(spark, sf_dir):
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_and_next(docs).withColumnRenamed("key", "doc_id")
