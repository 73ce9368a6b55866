"""Exact Jaccard join of word-shingle sets with index-level and answer-level skipping.

Index. Shingles are put in one global order, the rare first: by how often the shingles of their hash bucket occur in
all rows (an array of fixed size), then by hash. Two sets that link share a shingle within the
first n - ceil(t n) + 1 of each, so only those become postings (shingle, set, size, position). A list is kept sorted
by size and then position; for a probing set every size is a block, and the largest position that still allows the
needed overlap cuts the block, so the rest of it is skipped without being read.

Answers. Equal sets are one set. In each list the set with the fewest rare shingles leads; sets are verified against their
leaders first, and those that link are one component at once, never paired with each other. Long lists are led in pieces
by many tasks and the pieces' leaders by one; those that end in one component go no further. A set then derives its
answers from its leader's. Under one leader l, |x & z| <= min(|x & l|, |z & l|) + what x and z share beyond l: where
that minimum is too small, lists of l's own shingles give no pair, and the lists of what followers have beyond l give
the rest. Under two, |x & z| <= |lx & lz| + |x - lx| + |z - lz|, so one verified pair of leaders settles all pairs of
their followers whose bound stays below the needed overlap. Only pairs of different components that the bounds leave
open are verified themselves.

Components come from star contraction of the links. Nothing of the corpus comes to the driver but sums and the array of
bucket counts. Any order is correct: frequencies only decide how short the lists are. Of equal sets one row posts, and
texts are scanned in place: bitmaps of rows say whose text is wanted, so that no text is shuffled.

Defined results: null text is empty; a text without words has an empty set and links with nothing; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows are equal sets; rows of one key with different texts
are nodes of their own (they get numbers for the work, where a key would stand for two sets); a row without a key has
its set's size and no component, and links with nothing. Other columns of docs aren't read and don't clash; an empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, connected, located, mark, marked, materialise, mix, release, texts_of, trimmed, word_hashes, words_of

#: Shingles are counted by bucket of their hash, in slices that tasks send: 16 MB whatever the corpus.
BUCKET_BITS, SLICE_BITS = 22, 6
SLICES = 1 << SLICE_BITS
#: Bytes of text that one pass of array operations takes, about.
CHUNK = 1_000_000
#: Odd multiplier of a window's word, by its place.
FACTOR = 0x9E3779B97F4A7C15
#: Rows of postings that are looked at together, about.
ROWS = 60_000
#: Postings of a list that one task leads; longer lists are led in pieces, whose leaders meet in a second step.
LIST = 8192
#: Pairs that one pass of array operations expands.
PAIRS = 500_000


def factor(i: int) -> np.uint64:
    return np.uint64(pow(FACTOR, 2 * i + 1, 1 << 64) | 1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (sorted within each) and how many each text has."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = word_hashes([x for w in words for x in w])
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - k + 1, 0)
    h = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for i in range(k):
        h += flat[i : len(flat) - k + 1 + i] * factor(i)
    h = mix(h) >> np.uint64(1)
    whole = np.ones(len(flat), bool)  # starts of windows that stay in their text
    for i in range(1, k):
        at = ends - i
        whole[at[at >= 0]] = False
    h = h[whole[: len(h)]]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):  # the whole sequence is the one shingle
        before = (np.cumsum(n) - n)[short]
        n[short] = 1
        own = [np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words[i])) >> 1) for i in short]
        h = np.insert(h, before, own)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[(ends - n)[n > 0]] = True
    counts = np.add.reduceat(first, (ends - n)[n > 0]) if len(h) else np.zeros(0, np.int64)
    n[n > 0] = counts
    return h[first], n


def set_prints(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two longs."""
    some = np.flatnonzero(n)
    hi, lo = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        starts, x = (np.cumsum(n) - n)[some], mix(h)
        lo[some] = np.add.reduceat(x, starts)
        hi[some] = np.add.reduceat((x ^ (x >> np.uint64(29))) * factor(0), starts)
    return hi.view(np.int64), lo.view(np.int64)


def slices(batches):
    """Batches cut into runs of rows with about CHUNK bytes."""
    for b in batches:
        n = max(1, b.num_rows * CHUNK // max(CHUNK, b.nbytes))
        for s in range(0, b.num_rows, n):
            yield b.slice(s, n)


def summarising(k: int):
    """Rows of kind 0: key, place, size and print of a text's set; of kind 1: a slice of the task's counts of shingles by bucket."""

    @trimmed
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        for b in slices(batches):
            h, n = shingle_sets(texts_of(b, "text"), k)
            hi, lo = set_prints(h, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column("key"), b.column("cell"), b.column("place"), pa.array(n), pa.array(hi), pa.array(lo), pa.nulls(len(n), pa.binary())], NAMES)
            at, c = np.unique(bucket_of(h), return_counts=True)
            counts[at] += c.astype(np.uint32)
        parts = counts.reshape(SLICES, -1)
        some = np.flatnonzero(parts.any(1))
        z = np.zeros(len(some), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(some.astype(np.int64)), pa.array(z), pa.array(z.astype(np.int32)), pa.array(z), pa.array(z), pa.array(z), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in parts[some]], pa.binary())], NAMES)

    return run


NAMES = ["kind", "key", "cell", "place", "n", "hi", "lo", "block"]
PRINTS = "kind int, key long, cell long, place int, n long, hi long, lo long, block binary"


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(63 - BUCKET_BITS)).astype(np.int64)


def adding(batches):
    """Sums of the slices that meet in a partition, as they come."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for key, block in zip(b.column("key").to_pylist(), b.column("block").to_pylist(), strict=True):
            x = np.frombuffer(pa.decompress(block, 4 << BUCKET_BITS >> SLICE_BITS, codec="zstd", asbytes=True), np.uint32)
            sums[key] = sums[key] + x if key in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["key", "block"])


def frequencies(blocks: DataFrame) -> np.ndarray:
    """Occurrences of the shingles of each bucket over all rows: an array of fixed size."""
    got = blocks.repartition(SLICES, "key").mapInArrow(adding, "key long, block binary").toArrow()
    out = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), np.uint32)
    for key, block in zip(got.column("key").to_pylist(), got.column("block").to_pylist(), strict=True):
        out[key] = np.frombuffer(block, np.uint32)
    return out.ravel()


def prefix(n: np.ndarray, share: int) -> np.ndarray:
    return n - -(-n * share // 100) + 1


def needed(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Overlap from which 100 * intersection >= share * union."""
    return -(-share * (a + b) // (100 + share))


def shared_least(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Shingles that two sets must share in their prefixes: more of them in longer ones, as far as postings reach."""
    need = needed(a, b, share)
    return np.minimum(1 + need // 32, need - -(-np.maximum(a, b) * share // 100) + 1)


def posting(k: int, share: int, frequent):
    """Postings of each text's prefix."""

    @trimmed
    def run(batches):
        counts = frequent.value
        for b in slices(batches):
            h, n = shingle_sets(texts_of(b, "text"), k)
            _, lo = set_prints(h, n)
            key = b.column("key").to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            often = np.minimum(counts[bucket_of(h)], (1 << 23) - 1).astype(np.uint64)
            h = often << np.uint64(40) | h & np.uint64((1 << 40) - 1)
            begin = np.cumsum(n) - n
            for i in np.flatnonzero(n).tolist():
                h[begin[i] : begin[i] + n[i]].sort()
            pos = np.arange(len(h)) - np.repeat(begin, n)
            near = pos < prefix(n, share)[doc]
            h, doc, pos = h[near], doc[near], pos[near]
            for s in range(0, len(h), 200_000):
                e = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[e].view(np.int64)), pa.array(key[doc[e]]), pa.array(lo[doc[e]]), pa.array(n[doc[e]] << 32 | pos[e])], ["token", "id", "lo", "at"])

    return run


def lists_of(batches, columns: list[str]):
    """Whole lists (runs of one token) of a partition sorted by token, as many at a time as the batches hold."""
    rest: list[dict] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            rest.append({c: b.column(c).to_numpy() for c in columns})
            rows += b.num_rows
        if rows < ROWS or not rest:
            continue
        now = {c: np.concatenate([x[c] for x in rest]) for c in columns}
        cut = int(np.searchsorted(now["token"], now["token"][-1]))
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        rest = [{c: x[cut:] for c, x in now.items()}]
        rows = min(ROWS // 2, rows - cut)  # a list longer than ROWS is looked at again with half as many more
    if rest:
        yield {c: np.concatenate([x[c] for x in rest]) for c in columns}


def pieces_of(token: str):
    """Pieces in which a token's list is led: by how often its bucket occurs, which its first bits say; 1,024 at most."""
    return F.greatest(F.lit(1), F.floor(F.shiftrightunsigned(token, 40) / LIST)).cast("long")


def led(postings: DataFrame, share: int) -> DataFrame:
    """token (that of `own`), id, at, leader of postings that meet under `token`."""
    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(leading(share), "token long, id long, at long, leader long")


def leading(share: int):
    """Lists of two sets or more as rows (token, id, at, leader).

    The leader has the token at the smallest position, so the fewest rare shingles of its own: of near copies, the one
    that the others were most likely made from. Sets out of its size range have another leader.
    """

    @trimmed
    def run(batches):
        for x in lists_of(batches, ["token", "own", "id", "lo", "at"]):
            order = np.lexsort((x["id"], x["lo"], x["at"], x["token"]))
            t, own, i, lo, at = (x[c][order] for c in ("token", "own", "id", "lo", "at"))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1]) | (lo[1:] != lo[:-1])
            t, own, i, at = t[new], own[new], i[new], at[new]  # copies of one set share token and place; the smallest id stays
            start = np.ones(len(t), bool)
            start[1:] = t[1:] != t[:-1]
            runs = np.diff(np.append(np.flatnonzero(start), len(t)))
            many = np.repeat(runs > 1, runs) | (own != t)  # a piece's only row may have company in other pieces
            t, own, i, at = t[many], own[many], i[many], at[many]
            if not len(t):
                continue
            size, pos = at >> 32, at & 0xFFFFFFFF
            lead = np.empty(len(t), np.int64)
            left = np.lexsort((i, size, pos, t))
            while len(left):
                head = np.ones(len(left), bool)
                head[1:] = t[left][1:] != t[left][:-1]
                whose = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
                near = (size[left] * 100 >= size[whose] * share) & (size[left] * share <= size[whose] * 100)
                lead[left[near]] = i[whose[near]]
                left = left[~near]
            for s in range(0, len(t), 200_000):
                e = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(own[e]), pa.array(i[e]), pa.array(at[e]), pa.array(lead[e])], ["token", "id", "at", "leader"])

    return run


def crossing(share: int, more: tuple[str, ...] = ()):
    """Candidate pairs (a, b) of different components, with their sizes and the lists they share.

    Sets of n and m shingles that share o or more share at least l of their first n - o + l and m - o + l. A list is
    read in blocks of one size; for a probing set the needed o and the chosen l say at which position a block ends for
    it, and the rest of the block is skipped. Of a pair all its lists within these positions count.
    """

    def open_still(x, i, j):
        """Not settled by the answers of a common leader l: without a shingle outside l, |i & j| <= |i & l|, |j & l|."""
        met = np.minimum(x["met"][i], x["met"][j])
        return (x["leader"][i] != x["leader"][j]) | (met >= needed(x["at"][i] >> 32, x["at"][j] >> 32, share))

    def expand(x: dict):
        """x: one list, sorted by size and position; (row, row) of pairs."""
        comp = x["comp"]
        if "probe" in x:  # a piece of a list of which all pairs are wanted
            probing = x["probe"] > 0
        else:
            names, back, counts = np.unique(comp, return_inverse=True, return_counts=True)
            probing = back != np.argmax(counts)  # any pair of two components has one side here
        size, pos = x["at"] >> 32, x["at"] & 0xFFFFFFFF
        sizes, block = np.unique(size, return_index=True)
        probes = np.flatnonzero(probing)
        lo = np.searchsorted(sizes, -(-size[probes] * share // 100))
        hi = np.searchsorted(sizes, size[probes] * 100 // share, side="right")
        for s in range(0, len(probes), 4096):
            p, l, h = probes[s : s + 4096], lo[s : s + 4096], hi[s : s + 4096]
            who = np.repeat(p, h - l)
            b = np.arange(len(who)) - np.repeat(np.cumsum(h - l) - (h - l), h - l) + np.repeat(l, h - l)
            slack = shared_least(size[who], sizes[b], share) - needed(size[who], sizes[b], share) - 1
            ok = pos[who] <= size[who] + slack
            who, b, slack = who[ok], b[ok], slack[ok]
            first = block[b]
            last = np.searchsorted(x["at"], (sizes[b] << 32) + np.maximum(sizes[b] + slack, -1), side="right")
            n = np.maximum(last - first, 0)
            ends, at = np.cumsum(n), 0
            while at < len(n):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                c = n[at:stop]
                i = np.repeat(who[at:stop], c)
                j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:stop], c)
                keep = (comp[i] != comp[j]) & ((i < j) if "probe" in x else ~probing[j] | (i < j))
                keep[keep] = open_still(x, i[keep], j[keep])
                yield i[keep], j[keep]
                at = stop

    def summed(parts: list):
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        na, nb = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        c = np.diff(np.append(np.flatnonzero(new), len(a)))
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a[new], b[new], na[new], nb[new], c)], ["a", "b", "na", "nb", "c"])

    @trimmed
    def run(batches):
        parts, held = [], 0
        for x in lists_of(batches, ["token", "id", "at", "comp", "leader", "met", *more]):
            order = np.lexsort((x["id"], x["at"], x["token"]))
            x = {c: v[order] for c, v in x.items()}
            cut = np.flatnonzero(np.concatenate(([True], x["token"][1:] != x["token"][:-1], [True])))
            # lists of one component have nothing to add
            many = np.minimum.reduceat(x["comp"], cut[:-1]) != np.maximum.reduceat(x["comp"], cut[:-1])
            two = np.diff(cut) == 2
            k = cut[:-1][many & two]  # most lists: a single pair
            if len(k):
                n, m = x["at"][k] >> 32, x["at"][k + 1] >> 32
                i, j = x["at"][k] & 0xFFFFFFFF, x["at"][k + 1] & 0xFFFFFFFF
                slack = shared_least(n, m, share) - needed(n, m, share) - 1
                ok = (i <= n + slack) & (j <= m + slack) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * share)
                ok[ok] = open_still(x, k[ok], k[ok] + 1)
                ok &= (x["probe"][k] > 0) if "probe" in x else True
                pairs = [(k[ok], k[ok] + 1)]
            else:
                pairs = []
            for at in np.flatnonzero(many & ~two):
                base = cut[at]
                pairs += [(i + base, j + base) for i, j in expand({c: v[base : cut[at + 1]] for c, v in x.items()})]
                if sum(len(i) for i, _ in pairs) > PAIRS:
                    parts += [sides(x, i, j) for i, j in pairs]
                    yield summed(parts)
                    parts, pairs, held = [], [], 0
            parts += [sides(x, i, j) for i, j in pairs]
            held += sum(len(i) for i, _ in pairs)
            if held > PAIRS:
                yield summed(parts)
                parts, held = [], 0
        if held:
            yield summed(parts)

    def sides(x, i, j):
        swap = x["id"][i] > x["id"][j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        return x["id"][a], x["id"][b], x["at"][a] >> 32, x["at"][b] >> 32

    return run


def verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, added: bool = False) -> DataFrame:
    """Exact sizes and overlap of pairs (a, b), and on demand what b has beyond a; only the texts of their sets are read."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = mark(reps.join(ids, "key", "left_semi").select("cell", "place"), "involved")

    @trimmed
    def run(batches):
        for b in slices(batches):
            h, n = shingle_sets(texts_of(b, "text"), k)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("key"), lists], ["key", "tokens"])

    sets = rows.filter(marked(wanted)).select("key", "text").mapInArrow(run, "key long, tokens array<bigint>")
    sets = materialise(sets, "sets")
    one = pairs.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    two = one.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    two = two.withColumns({"na": F.size("ta"), "nb": F.size("tb"), "overlap": F.size(F.array_intersect("ta", "tb"))})
    return (two.withColumn("added", F.array_except("tb", "ta")) if added else two).drop("ta", "tb")


def linked(share: int):
    return F.expr(f"100 * overlap >= {share} * (na + nb - overlap)")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, share: int = 85) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) of each row; keys are longs."""
    configure(docs.sparkSession)
    rows = located(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    return components(rows, k, share).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, share: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links between different sets (a, b, na, nb, overlap; a < b are the smallest keys of equal sets), and the sets' members (key, rep).

    As many rows as there are links: a group of m near copies has up to m * (m - 1) / 2, while equal sets are one. Long lists are
    probed in pieces, each by a task of its own. Keys must be unique; rows without a key or a word have no rep.
    """
    configure(docs.sparkSession)
    rows = located(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    slim, reps, lists = indexed(rows, k, share)
    members = slim.join(reps.select("hi", "lo", "n", F.col("key").alias("rep")), ["hi", "lo", "n"], "left").select("key", F.when(F.col("key").isNotNull(), F.col("rep")).alias("rep"))
    pieces = F.sequence(F.lit(0), pieces_of("token") - 1)
    own = F.pmod(F.xxhash64("id"), pieces_of("token"))
    each = lists.select("token", "id", "at", own.alias("own"), F.explode(pieces).alias("piece"))
    whole = each.select(F.when(pieces_of("token") > 1, F.xxhash64("token", "piece")).otherwise(F.col("token")).alias("token"), "id", "at", F.col("id").alias("comp"), F.col("id").alias("leader"), F.lit(0).cast("long").alias("met"), (F.col("own") == F.col("piece")).cast("long").alias("probe"))
    pairs = whole.repartition("token").sortWithinPartitions("token").mapInArrow(crossing(share, ("probe",)), "a long, b long, na long, nb long, c long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    need = F.ceil(F.lit(share) * (F.col("na") + F.col("nb")) / F.lit(100 + share)).cast("long")
    least = F.least(F.floor(F.col("need") / 32) + 1, F.col("need") - F.ceil(F.greatest("na", "nb") * share / 100) + 1)
    open_ = materialise(pairs.withColumn("need", need).filter(F.col("c") >= least).select("a", "b"), "candidates")
    return verified(rows, reps, open_, k).filter(linked(share)).select("a", "b", "na", "nb", "overlap"), members


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, share: int = 85) -> DataFrame:
    """key, n_links: how many other rows each row links with, equal sets included. Counted by sets: no link is expanded into rows."""
    found, members = links(docs, key, text, k, share)
    members = materialise(members, "members")
    sizes = members.filter("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    found = materialise(found.select("a", "b"), "links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(sizes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("far")).withColumnRenamed("a", "rep")
    counts = sizes.join(far, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(counts, "rep", "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, share: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest key, of repetitions the first in place."""
    configure(docs.sparkSession)
    names = docs.columns
    rows = located(docs.toDF(*[f"c{i}" for i in range(len(names))]))  # no name clashes with cell and place
    own = rows.select(F.col(f"c{names.index(key)}").cast("long").alias("key"), F.col(f"c{names.index(text)}").alias("text"), "cell", "place")
    found = materialise(components(own, k, share).filter("n > 0 AND comp IS NOT NULL"), "components")
    keep = found.groupBy("comp").agg(F.min(F.struct("key", "cell", "place")).alias("keep"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    away = found.join(keep, "comp").filter("cell <> keep.cell OR place <> keep.place")
    return rows.filter(~marked(mark(away.select("cell", "place"), "near-away"))).drop("cell", "place").toDF(*names)


def numbered(rows: DataFrame, k: int, share: int) -> DataFrame:
    """components() where a key would stand for two sets: rows are numbered, and components get their smallest key."""
    number = F.when(F.col("key").isNotNull(), F.monotonically_increasing_id())
    named = located(materialise(rows.select(F.col("key").alias("own"), F.struct("cell", "place").alias("was"), "text", number.alias("key")), "numbered"))
    found = components(named.select("key", "text", "cell", "place"), k, share).drop("component_id")
    found = materialise(found.join(named.select("cell", "place", "own", "was"), ["cell", "place"]), "numbered-components")
    least = found.groupBy("comp").agg(F.min("own").alias("component_id"))
    return found.join(least, "comp", "left").select(F.col("own").alias("key"), "was.cell", "was.place", "n", "comp", "component_id")


def summaries(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """key, cell, place, n, hi, lo of each row; one row of each set that has a key; the counts of shingles by bucket."""
    both = materialise(rows.mapInArrow(summarising(k), PRINTS), "prints")
    slim = both.filter("kind = 0").select("key", "cell", "place", "n", "hi", "lo")
    reps = slim.filter("n > 0 AND key IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min(F.struct("key", "cell", "place")).alias("r"))
    reps = materialise(reps.select("hi", "lo", "n", "r.key", "r.cell", "r.place"), "representatives")
    return slim, reps, both.filter("kind = 1").select("key", "block")


def led_lists(rows: DataFrame, reps: DataFrame, counts: DataFrame, k: int, share: int) -> DataFrame:
    """Postings (token, id, at, leader) of the sets' representatives, in lists of two and more."""
    docs = rows.filter(marked(mark(reps.select("cell", "place"), "posting"))).select("key", "text")
    frequent = rows.sparkSession.sparkContext.broadcast(frequencies(counts))  # of fixed size
    postings = docs.mapInArrow(posting(k, share, frequent), "token long, id long, lo long, at long")
    piece = F.when(pieces_of("token") > 1, F.xxhash64("token", F.pmod(F.xxhash64("id"), pieces_of("token")))).otherwise(F.col("token"))
    return materialise(led(postings.select(piece.alias("token"), F.col("token").alias("own"), "id", "lo", "at"), share), "lists")


def indexed(rows: DataFrame, k: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows' summaries, sets and lists for links(); an error where a key stands for two sets."""
    slim, reps, counts = summaries(rows, k)
    if reps.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("a key stands for two different texts")
    return slim, reps, led_lists(rows, reps, counts, k, share)


def components(rows: DataFrame, k: int, share: int) -> DataFrame:
    """rows: key, text and where they are. Gives key, cell, place, n, comp (a number of the component) and component_id."""
    spark = rows.sparkSession
    slim, reps, counts = summaries(rows, k)
    if reps.groupBy("key").count().filter("count > 1").limit(1).count():
        return numbered(rows, k, share)
    lists = led_lists(rows, reps, counts, k, share)
    release(spark)
    long = pieces_of("token") > 1
    split = lists.filter(long).limit(1).count() > 0
    heads = lists.filter(long & (F.col("id") == F.col("leader"))).select("token", F.col("token").alias("own"), "id", F.col("id").alias("lo"), "at")
    followers = lists.unionByName(led(heads, share)) if split else lists

    # leaders first: of each set the one that shares most of its lists, if enough to promise a link
    star = followers.filter("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("at"))
    star = star.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "leader"))).filter("r = 1")
    star = star.filter(F.col("c") * 400 >= F.shiftright("at", 32) * (100 - share))  # a quarter of the prefix
    star = materialise(star.select(F.col("leader").alias("a"), F.col("id").alias("b")), "star")
    star = materialise(verified(rows, reps, star, k, added=True), "answers")
    links = star.filter(linked(share)).drop("added")
    release(spark)
    comps = connected(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    # the leader of each set that has one, and how much of the set it lacks, linked or not
    best = star.select(F.col("b").alias("id"), F.col("a").alias("leader"), (F.col("nb") - F.col("overlap")).cast("long").alias("miss"), F.col("overlap").cast("long").alias("met"))
    known = lists.select("token", "id", "at").join(comps, "id", "left").join(best, "id", "left")

    def crossed(rows):
        rows = rows.select("token", "id", "at", F.coalesce("comp", "id").alias("comp"), F.coalesce("leader", "id").alias("leader"), F.coalesce("met", F.lit(0)).cast("long").alias("met"))
        rows = rows.repartition("token").sortWithinPartitions("token").mapInArrow(crossing(share), "a long, b long, na long, nb long, c long")
        return rows.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))

    if split:  # long lists of one component have nothing to add
        one = known.select("token", F.coalesce("comp", "id").alias("comp")).filter(long)
        mixed = one.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
        known = known.filter(~long).unionByName(known.filter(long).join(mixed, "token", "left_semi"))
    cross = crossed(known)
    # followers of one leader that its answers leave open must share what they have beyond it; all of that is a list
    beyond = star.select("a", F.col("b").alias("id"), F.col("nb"), F.explode("added").alias("t"))
    beyond = beyond.select(F.xxhash64("a", "t").alias("token"), "id", F.shiftleft(F.col("nb").cast("long"), 32).alias("at")).join(comps, "id", "left")
    beyond = crossed(beyond.withColumn("leader", F.col("id")).withColumn("met", F.lit(0)))
    for side in ("a", "b"):
        beyond = beyond.join(best.select(F.col("id").alias(side), F.col("met").alias(f"m{side}")), side)
    need = F.ceil(F.lit(share) * (F.col("na") + F.col("nb")) / F.lit(100 + share)).cast("long")
    least = F.least(F.floor(F.col("need") / 32) + 1, F.col("need") - F.ceil(F.greatest("na", "nb") * share / 100) + 1)
    cross = cross.withColumn("need", need).filter(F.col("c") >= least).select("a", "b", "need")
    beyond = beyond.withColumn("need", need).filter(F.col("c") + F.least("ma", "mb") >= F.col("need")).select("a", "b", "need")
    cross = cross.unionByName(beyond).distinct()
    for side in ("a", "b"):
        cross = cross.join(best.select(F.col("id").alias(side), F.col("leader").alias(f"l{side}"), F.col("miss").alias(f"m{side}")), side, "left")
    cross = cross.select("a", "b", "need", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), (F.coalesce("ma", F.lit(0)) + F.coalesce("mb", F.lit(0))).alias("miss"))
    cross = materialise(cross.select("a", "b", "need", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"), "miss"), "candidates")
    two = cross.filter("la <> lb")
    settled = materialise(verified(rows, reps, two.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), k), "settled")
    links = links.select("a", "b").unionByName(settled.filter(linked(share)).select("a", "b"))
    # followers take the answer of their leaders where it settles theirs; followers of one leader were bounded before
    left = two.filter("NOT (la = a AND lb = b)").join(settled.select(F.col("a").alias("la"), F.col("b").alias("lb"), "overlap"), ["la", "lb"])
    left = left.filter("overlap + miss >= need").select("a", "b").unionByName(cross.filter("la = lb").select("a", "b"))
    left = materialise(left.distinct(), "pairs")
    release(spark)
    if left.limit(1).count():
        links = links.unionByName(materialise(verified(rows, reps, left, k).filter(linked(share)).select("a", "b"), "late"))
    comps = connected(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "comp")
    named = reps.withColumnRenamed("key", "rep").join(comps, "rep", "left").select("hi", "lo", "n", F.coalesce("comp", "rep").alias("comp"))
    out = slim.join(named, ["hi", "lo", "n"], "left").withColumn("comp", F.when(F.col("key").isNotNull(), F.coalesce("comp", "key")))
    return out.select("key", "cell", "place", "n", "comp", F.col("comp").alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir):
    """Contract query over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES = {
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.k + y.k - o)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT w.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.k"""
}
