"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns; its name is its depth and the smallest conversation that begins with it.
Turns travel as 128-bit digests of role and text, never as texts.

1. Turns are ordered within conversations by a range-partitioned running number (`ordering.running_within`), so that a
   conversation with any share of the rows spreads over tasks; the running total of words comes with it.
2. Conversations of equal turns throughout become one class: its smallest conv_id stands for it, with the class's size.
3. Per depth, the live classes are grouped by (parent node, next turn); the minimum conv_id names the child. The grouping is
   partially aggregated and joined back, so a turn that a third of all conversations begin with is one row for each task.
   A class that is alone in its node leaves the loop: what follows is a chain, whose every value is known from running
   totals. Where a level neither splits a node nor ends a class, one aggregate finds the next depth that does, and the
   levels between are such chains too, so the loop runs for as many levels as differ, not as many as there are turns.
4. In reverse, level by level, the children's leaves and savings are summed by parent and joined to the parents.
5. A class's conv_ids are sorted by a range partitioning, joined to pieces of bounded length, and the pieces of a class are
   hashed as a stream in order: one task reads them, in bounded memory, as a digest of a whole needs.

Each level is written to the shared folder; the driver sees counts and one depth a level.

Defined results: turns of one number are ordered by the digest of role and text; null turns come first; null role or
text is empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation; an empty table gives
none. Other columns, whatever their names, aren't read and don't clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.operators.ordering import running_within

from .common import configure, materialise, trimmed

#: conv_ids in one piece of a class's list.
PIECE = 1 << 14
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), token (digest of role and text), words, cum (words up to here) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")
    slim = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", token.alias("token"), words.alias("words"))
    found = running_within(slim, ["conv"], [F.asc_nulls_first("turn"), F.col("token")], "n", {"cum": F.col("words")})
    return found.select("conv", (F.col("n") - 1).alias("pos"), "token", "words", "cum")


def sizes(turns: DataFrame) -> DataFrame:
    """conv, len, total (words) of conversations that have turns."""
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len"), F.max("cum").alias("total"))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes where each conversation c begins with the first h turns of c - c % block, then goes on after its own first h.

    h = crc32(c as decimal) % heads. A block's first conversation gives at most heads - 1 turns to at most block others.
    """
    most = heads - 1
    cums = [F.max(F.when(F.col("pos") == i, F.col("cum"))).alias(f"w{i}") for i in range(most)]
    own = materialise(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"), F.max("cum").alias("total"), *cums), "conversations")
    base = own.select(F.col("conv").alias("base"), F.least("own", F.lit(most)).alias("b_own"), *[F.col(f"w{i}").alias(f"b_w{i}") for i in range(most)])
    upto = lambda n, prefix: F.coalesce(*[F.when(F.col(n) == i + 1, F.col(f"{prefix}{i}")) for i in range(most)], F.lit(0))
    plan = own.withColumns({"base": F.col("conv") - F.col("conv") % block, "h": F.crc32(F.col("conv").cast("string")) % heads})
    plan = plan.join(base, "base", "left").withColumns({"taken": F.least("h", F.coalesce("b_own", F.lit(0))), "skip": F.least("h", "own")})
    plan = plan.withColumns({"taken_words": upto("taken", "b_w"), "skip_words": upto("skip", "w")})
    plan = materialise(plan.select("conv", "base", "taken", "skip", (F.col("taken_words") - F.col("skip_words")).alias("shift"), (F.col("taken") + F.col("own") - F.col("skip")).alias("len"), (F.col("total") + F.col("taken_words") - F.col("skip_words")).alias("total")), "rebuilding")
    given = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    front = plan.filter("taken > 0").select("conv", "base", "taken").join(given, "base").filter("pos < taken").select("conv", "pos", "token", "words", "cum")
    rest = turns.join(plan.select("conv", "taken", "skip", "shift"), "conv").filter("pos >= skip")
    rest = rest.select("conv", (F.col("pos") - F.col("skip") + F.col("taken")).alias("pos"), "token", "words", (F.col("cum") + F.col("shift")).alias("cum"))
    return materialise(front.unionByName(rest), "rebuilt"), plan.select("conv", "len", "total")


def classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their class's marks (conv, len, f, g), and classes (rep, weight, len, total, f, g) of equal turns throughout."""
    marks = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("pos", "token")).alias("f"), F.bit_xor(F.xxhash64(F.lit(1), "token", "pos")).alias("g"))
    marked = convs.join(marks, "conv", "left").withColumns({"f": F.coalesce("f", F.lit(0)), "g": F.coalesce("g", F.lit(0))})
    marked = materialise(marked, "marked")
    return marked, materialise(marked.groupBy("len", "f", "g").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")), "classes")


@trimmed
def _pieces(batches):
    """Sorted (rep, conv) to pieces of a class's decimal ids: rep, first, ids."""
    rep, ids = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["rep", "first", "ids"])

    for b in batches:
        for r, c in zip(b.column("rep").to_pylist(), b.column("conv").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == PIECE):
                yield out()
                ids = []
            rep = r
            ids.append(c)
    if ids:
        yield out()


@trimmed
def _digests(batches):
    """Pieces sorted by rep and first to rep, sha."""
    rep, h = None, None
    reps, shas = [], []
    for b in batches:
        for r, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if r != rep:
                if h:
                    reps.append(rep)
                    shas.append(h.hexdigest())
                rep, h = r, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], ["rep", "sha"])
        reps, shas = [], []
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["rep", "sha"])


def members(marked: DataFrame, found: DataFrame) -> DataFrame:
    """rep, sha: SHA-256 of the class's conv_ids in ascending order, joined by commas."""
    one = found.filter("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("sha"))
    rows = marked.join(found.filter("weight > 1").select("len", "f", "g", "rep"), ["len", "f", "g"]).select("rep", "conv")
    pieces = rows.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(_pieces, "rep long, first long, ids string")
    return one.unionByName(pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_digests, "rep long, sha string"))


def _quiet_until(live: DataFrame, paths: DataFrame, depth: int) -> int:
    """The first depth, from this on, at which a live node's classes go different ways or one of them ends."""
    ahead = live.join(paths.filter(F.col("pos") >= depth).select(F.col("conv").alias("rep"), "pos", "token"), "rep")
    seen = ahead.groupBy("node", "pos").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    ends = live.agg(F.min("len")).first()[0]  # a node all of whose classes have ended has no row there
    found = seen.filter("a <> b OR n < k").agg(F.min("pos")).first()[0]
    return min(x for x in (found, ends) if x is not None)


def descend(found: DataFrame, paths: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """Levels from the root: depth, the depth up to which its live nodes stay as they are, and rows (rep, weight, len, total, parent,
    node, n, k, words, cum), one for each class that reaches the depth in a node that was live above it."""
    every = found.agg(F.min("rep"), F.sum("weight"), F.count(F.lit(1))).first()
    if not every[2]:
        return []
    null = F.lit(None).cast("long")
    root = found.select("rep", "weight", "len", "total", null.alias("parent"), F.lit(every[0]).alias("node"), F.lit(every[1]).alias("n"), F.lit(every[2]).alias("k"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("cum"))
    levels, depth, live, n_live, n_nodes = [(0, 0, root)], 0, root, every[2], 1
    while True:
        at = paths.filter(F.col("pos") == depth).select(F.col("conv").alias("rep"), "token", "words", "cum")
        going = live.filter(F.col("len") > depth).select("rep", "weight", "len", "total", F.col("node").alias("parent"))
        going = materialise(going.join(at, "rep"), "going")
        groups = going.groupBy("parent", "token").agg(F.min("rep").alias("node"), F.sum("weight").alias("n"), F.count(F.lit(1)).alias("k"))
        step = materialise(going.join(groups, ["parent", "token"]).select("rep", "weight", "len", "total", "parent", "node", "n", "k", "words", "cum"), "level")
        n, n_groups, more, nodes = step.agg(F.count(F.lit(1)), F.count_if(F.col("rep") == F.col("node")), F.count_if(F.col("k") > 1), F.count_if((F.col("k") > 1) & (F.col("rep") == F.col("node")))).first()
        if not n:
            return levels
        depth += 1
        live = step.filter("k > 1")
        same = more == n == n_live and n_groups == n_nodes
        until = _quiet_until(live, paths, depth) if more and same else depth
        levels.append((depth, until, step))
        depth, n_live, n_nodes = until, more, nodes
        if not more:
            return levels


def ascend(levels: list[tuple[int, int, DataFrame]], paths: DataFrame) -> list[DataFrame]:
    """Live nodes of all levels with what their subtrees sum up to: NODE and rep, the class that ends there."""
    out, below = [], None
    for depth, until, step in reversed(levels):
        alive = F.lit(True) if depth == 0 else F.col("k") > 1
        nodes = step.filter(alive & (F.col("rep") == F.col("node"))).select("node", "parent", "n", "words", "cum")
        ended = step.filter(alive & (F.col("len") == until)).select("node", F.col("rep").alias("ended"))
        if below is None:
            nodes = nodes.withColumns({"children": F.lit(0).cast("long"), "leaves": F.lit(1).cast("long"), "kids_saved": F.lit(0).cast("long")})
        else:
            sums = below.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("kids_saved")).withColumnRenamed("parent", "node")
            nodes = nodes.join(sums, "node", "left").withColumns({"children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "kids_saved": F.coalesce("kids_saved", F.lit(0))})
        nodes = nodes.join(ended, "node", "left")
        if until > depth:  # the node's words down to the last of the equal levels
            far = paths.filter(F.col("pos") == until - 1).select(F.col("conv").alias("node"), F.col("cum").alias("far"))
            nodes = nodes.join(far, "node")
        else:
            nodes = nodes.withColumn("far", F.col("cum"))
        nodes = materialise(nodes.withColumn("saved", (F.col("n") - 1) * (F.col("far") - F.col("cum") + F.col("words")) + F.col("kids_saved")), "nodes")
        if until > depth:
            chain = nodes.select(F.col("node").alias("conv"), "parent", "n", "children", "leaves", "kids_saved", "far", "ended").join(paths.filter(F.col("pos").between(depth - 1, until - 1)), "conv")
            last, top = F.col("pos") == until - 1, F.col("pos") == depth - 1
            saved = (F.col("n") - 1) * (F.col("far") - F.col("cum") + F.col("words")) + F.col("kids_saved")
            rows = _node(F.col("conv"), F.col("pos") + 1, F.when(top, F.col("parent")).otherwise(F.col("conv")), F.col("n"), F.when(last, F.col("children")).otherwise(1), F.col("leaves"), saved, F.when(last, F.col("ended")))
            out.append(chain.select(rows))
        else:
            out.append(nodes.select(_node(F.col("node"), F.lit(depth), F.col("parent"), F.col("n"), F.col("children"), F.col("leaves"), F.col("saved"), F.col("ended"))))
        alone = step.filter("k = 1").select("parent", F.lit(1).cast("long").alias("leaves"), ((F.col("weight") - 1) * (F.col("total") - F.col("cum") + F.col("words"))).alias("saved"))
        below = nodes.select("parent", "leaves", "saved").unionByName(alone)
    return out


def _node(*columns: Column) -> list[Column]:
    return [c.cast("long").alias(n) for c, n in zip(columns, [*NODE, "ended"], strict=True)]


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: NODE and ends_sha256. turns as of ordered(), convs (conv, len, total) also with those that have no turn."""
    spark = turns.sparkSession
    configure(spark)
    marked, found = classes(turns, convs)
    digests = materialise(members(marked, found), "members")
    paths = turns.join(found.select(F.col("rep").alias("conv")), "conv", "left_semi")
    paths = materialise(paths.repartitionByRange("pos", "conv").sortWithinPartitions("pos", "conv"), "paths")  # a level reads its part alone
    levels = descend(found, paths)
    if not levels:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")
    alone = None
    for depth, _, step in levels[1:]:
        own = step.filter("k = 1").select(F.col("rep").alias("conv"), "weight", "len", "total", "parent", F.lit(depth).cast("long").alias("start"))
        alone = own if alone is None else alone.unionByName(own)
    rows = ascend(levels, paths)
    if alone is not None:
        tail = alone.join(paths, "conv").filter("pos >= start - 1")
        depth = F.col("pos") + 1
        last = depth == F.col("len")
        saved = (F.col("weight") - 1) * (F.col("total") - F.col("cum") + F.col("words"))
        rows.append(tail.select(_node(F.col("conv"), depth, F.when(depth == F.col("start"), F.col("parent")).otherwise(F.col("conv")), F.col("weight"), F.when(last, 0).otherwise(1), F.lit(1), saved, F.when(last, F.col("conv")))))
    nodes = rows[0]
    for r in rows[1:]:
        nodes = nodes.unionByName(r)
    nodes = materialise(nodes, "trie")
    inner = nodes.filter("ended IS NULL").select(*NODE, F.lit(EMPTY).alias("ends_sha256"))
    return inner.unionByName(nodes.filter("ended IS NOT NULL").join(digests.withColumnRenamed("rep", "ended"), "ended").select(*NODE, F.col("sha").alias("ends_sha256")))


def op13_prefix_trie(spark, sf_dir):
    """Contract query over all conversations."""
    configure(spark)
    turns = ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return prefix_trie(*rebuilt(materialise(turns, "turns")))


ORACLES = {
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT c FROM t),
        bits AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, CASE WHEN p % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS r FROM ids),
        h AS (SELECT c, c - c % 20 AS base, xor(r, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits),
        own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        k AS (SELECT h.*, least(h, coalesce(n, 0)) AS taken FROM h LEFT JOIN own ON own.c = base),
        r AS (SELECT k.c, t.i, role, text FROM k JOIN t ON t.c = base AND i <= h UNION ALL SELECT k.c, i - h + taken, role, text FROM k JOIN t USING (c) WHERE i > h),
        d AS (SELECT c, i AS depth, md5(role || chr(1) || text) AS m, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
        p AS (SELECT c, depth, words, string_agg(m, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM d
              UNION ALL SELECT c, 0, 0, '' FROM ids),
        node AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, path),
        places AS (SELECT p.c, p.depth, node.conv_id, node.n_convs, node.words FROM p JOIN node USING (depth, path)),
        up AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS parent FROM places a JOIN places b ON a.c = b.c AND a.depth = b.depth + 1),
        kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY 1, 2),
        below AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS low, b.depth AS low_depth, b.n_convs, b.words FROM places a JOIN places b ON a.c = b.c AND a.depth <= b.depth),
        sums AS (SELECT b.conv_id, b.depth, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved
                 FROM below b LEFT JOIN kids ON kids.conv_id = low AND kids.depth = low_depth GROUP BY 1, 2),
        last AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
        ends AS (SELECT conv_id, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM places JOIN last USING (c, depth) GROUP BY 1, 2)
        SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node LEFT JOIN up USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""
}
