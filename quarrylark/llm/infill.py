"""Fill-in-middle transformation by bit-parallel work on big integers.

A text is UTF-8 bytes; `bytes.translate` turns it into masks of one bit a byte, letters (A-Z, a-z) and continuation
bytes, and each mask is one big integer, bit i for byte i. A token is a run of letters or one other code point, so its
first byte is any that neither continues a code point nor is a letter after a letter: shifted boolean operations mark all
of them at once, `bit_count` gives n, and the byte where the r-th token starts is found by halving: the half that holds
the r-th set bit is kept, until one bit is left. No token is ever listed.

Every text is one map-side row; nothing is shuffled, and a task holds one Arrow batch and the masks of one text. Defined
results: null text is empty, and an empty text is plain, with n = 0; a null key is drawn as an empty one; repeated rows
are transformed each, and equal rows alike; a text that holds a mark is plain; an empty table gives none. Other columns,
whatever their names, aren't read and don't clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, texts_of, trimmed

#: Marks of the parts, in the order prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many are transformed, and so many of those have the suffix first.
RATE, SUFFIX_FIRST = 90, 20

LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
FOLLOWING = bytes(49 if 0x80 <= b < 0xC0 else 48 for b in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """Bit i is set where byte i is of the class; data is reversed, as the first digit of a number is its highest."""
    return int(data.translate(classes), 2)


def starts(data: bytes) -> tuple[int, int]:
    """Masks of the bytes that begin a token and of those that begin a code point."""
    if not data:
        return 0, 0
    back = data[::-1]
    letters, points = mask(back, LETTERS), ((1 << len(data)) - 1) ^ mask(back, FOLLOWING)
    return points ^ (letters & (letters << 1)), points


def select(bits: int, rank: int) -> int:
    """Place of the set bit that has rank set bits below it."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def cut(data: bytes, draws: tuple[int, int]) -> tuple[int, int, int, int]:
    """n, bytes of the prefix, bytes of prefix and middle; each draw is taken modulo n + 1. Last the mask of code points."""
    tokens, points = starts(data)
    n = tokens.bit_count()
    a, b = sorted(d % (n + 1) for d in draws)
    place = lambda r: len(data) if r == n else select(tokens, r)
    return n, place(a), place(b), points


def below(points: int, end: int) -> int:
    """Code points that begin in the first end bytes."""
    return (points & ((1 << end) - 1)).bit_count()


def transform(data: bytes, h: tuple[int, int, int, int], marks: tuple[bytes, bytes, bytes], rate: int, suffix_first: int) -> tuple:
    """n, form, code points of prefix and of middle (None if plain), output."""
    n, i, j, points = cut(data, h[:2])
    if not data or any(m in data for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, data
    p, s, m = marks
    before = below(points, i)
    if h[3] % 100 < suffix_first:
        return n, "spm", before, below(points, j) - before, b"".join((s, data[j:], p, data[:i], m, data[i:j]))
    return n, "psm", before, below(points, j) - before, b"".join((p, data[:i], s, data[j:], m, data[i:j]))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """key, n (tokens), form, prefix_chars, middle_chars, output of each row.

    The draws are the first four groups of eight digits of the SHA-256 of `seed:key`, so a document is cut alike in every run.
    """
    configure(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    tags = tuple(m.encode() for m in marks)

    @trimmed
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for data, digest in zip(texts_of(b, "text"), b.column("drawn").to_pylist(), strict=True):
                h = tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
                for to, x in zip(out, transform(data, h, tags, rate, suffix_first), strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), *arrays], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), drawn.alias("drawn"))
    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was transformed. Its parts hold no mark, and none can form where a part meets a mark."""
    quoted = [rf"\Q{m}\E" for m in marks]
    parts = F.split(output, "|".join(quoted), -1)
    order = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(order)


def op12_infill(spark, sf_dir):
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fill_in_middle(docs)
    digest = lambda c: F.sha2(c, 256)
    return found.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES = {
    "op12_infill": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
                     CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
        p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m,
                     coalesce(array_to_string(w[b + 1:n], ''), '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p"""
}
