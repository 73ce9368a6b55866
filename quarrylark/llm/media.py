"""Media columns: baseline JPEG, written and read in numpy without an image library.

Reading parses the markers, builds look-up tables from the Huffman segments and decodes the entropy-coded scan of many
images in lockstep: every restart segment of every image is a lane, and one step decodes one symbol in all lanes. AC
coefficients are only stepped over; DC coefficients times their quantiser over 8 are the thumbnail at 1/8 scale, of
which dimensions and hashes are kept.

Writing stores bytes losslessly as the format's unit, DC coefficients: with the DC quantiser 8 a byte is one block's
mean luminance, so the thumbnail of the stored image is the payload. An image is 24 blocks wide; payloads beyond one
image's height continue in the next image of the same value.

Defined results: null media give nulls; media that are broken, cut short or not baseline give an error text and nulls;
null text is stored as an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, texts_of

WIDTH = 24
UNIT = 576
#: Bytes of one image: 24 x 8184 blocks, below the format's 65,535 pixels.
IMAGE_BYTES = WIDTH * 8184
#: Blocks between restart marks; each such run is a lane when read.
RESTART = 144
#: Bytes that one pass of array operations takes, about.
CHUNK = 1_500_000

# Huffman codes of what is written: 0..8 bits of difference, and an end of block that costs one bit.
DC_LENGTHS, DC_SYMBOLS = [0, 1, 3, 3, 1, 1] + [0] * 10, [5, 4, 6, 3, 2, 7, 0, 1, 8]
AC_LENGTHS, AC_SYMBOLS = [1, 1] + [0] * 14, [0, 0xF0]


def codes_of(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), canonical."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: its bits with the end of block, and how many."""
    dc, (eob, eob_bits) = codes_of(DC_LENGTHS, DC_SYMBOLS), codes_of(AC_LENGTHS, AC_SYMBOLS)[0]
    value, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        value[d + 255] = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << eob_bits) | eob
        bits[d + 255] = n + size + eob_bits
    return value, bits


VALUE, BITS = _writer_tables()


def segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


HEAD = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, bytes([0, 8] + [1] * 63))
TABLES = segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])) + segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS]))
TABLES += segment(0xDD, struct.pack(">H", RESTART)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def runs(sizes: list[int]):
    """Slices of neighbours with about CHUNK bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= CHUNK or i == len(sizes) - 1:
            yield slice(start, i + 1)
            start, total = i + 1, 0


def write_images(payloads: list[bytes]) -> list[bytes]:
    """Payloads of a multiple of 24 bytes as JPEG."""
    images = [(i, p[s : s + IMAGE_BYTES]) for i, p in enumerate(payloads) for s in range(0, len(p), IMAGE_BYTES)]
    media: list[list[bytes]] = [[] for _ in payloads]
    for part in runs([len(x) for _, x in images]):
        own = images[part]
        for (i, _), x in zip(own, encode([x for _, x in own]), strict=True):
            media[i].append(x)
    return [b"".join(x) for x in media]


def encode(images: list[bytes]) -> list[bytes]:
    """One pass of array operations for all images."""
    flat = np.frombuffer(b"".join(images), np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in images])
    begins = np.cumsum(sizes) - sizes
    lanes = -(-sizes // RESTART)
    lane_image = np.repeat(np.arange(len(images)), lanes)
    lane_no = np.arange(len(lane_image)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lane_start = begins[lane_image] + lane_no * RESTART
    previous = np.concatenate(([128], flat[:-1]))
    previous[lane_start] = 128
    d = flat - previous + 255
    value, bits = VALUE[d], BITS[d]
    upto = np.cumsum(bits)
    lane_end = np.append(lane_start[1:], len(flat))
    lane_bits = np.diff(np.concatenate(([0], upto[lane_end - 1])))
    lane_bytes = -(-lane_bits // 8)
    lane_at = np.cumsum(lane_bytes) - lane_bytes
    place = upto - bits + np.repeat(lane_at * 8 - (np.cumsum(lane_bits) - lane_bits), lane_end - lane_start)
    # the pad of ones at each lane's end is one more value
    pad = lane_bytes * 8 - lane_bits
    value = np.insert(value, lane_end, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))
    bits = np.insert(bits, lane_end, pad)
    place = np.insert(place, lane_end, lane_at * 8 + lane_bits)
    total = int(lane_bytes.sum())
    words = np.zeros(total // 4 + 2, np.uint64)
    shifted = value << ((64 - bits - (place & 31)) & 63).astype(np.uint64)  # an empty pad has value 0
    w = place >> 5
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    words[w[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    words[w[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    stream = words.astype(">u4").view(np.uint8)[:total]
    # stuffing zeros and restart marks
    ff = stream == 255
    lane_of = np.repeat(np.arange(len(lane_bytes)), lane_bytes)
    marked = np.concatenate((lane_image[1:] == lane_image[:-1], [False]))  # no mark after an image's last lane
    before = np.cumsum(marked) - marked
    to = np.arange(total) + np.cumsum(ff) - ff + 2 * before[lane_of]
    out = np.zeros(total + int(ff.sum()) + 2 * int(marked.sum()), np.uint8)
    out[to] = stream
    last = lane_at + lane_bytes - 1
    ends = to[last] + 1 + ff[last]
    out[ends[marked]] = 255
    out[ends[marked] + 1] = 0xD0 + lane_no[marked] % 8
    cut = np.concatenate(([0], ends[~marked]))
    made = []
    for k, x in enumerate(images):
        frame = segment(0xC0, struct.pack(">BHHB", 8, len(x) // WIDTH * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0]))
        made.append(b"".join((HEAD, frame, TABLES, out[cut[k] : cut[k + 1]].tobytes(), b"\xff\xd9")))
    return made


# ---------------------------------------------------------------- reading


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # id, h, v, quantiser table
    quantisers: dict = field(default_factory=dict)  # table -> DC step
    huffman: dict = field(default_factory=dict)  # class and table -> segment bytes
    restart: int = 0
    scan: list = field(default_factory=list)  # component, DC table, AC table
    at: int = 0
    end: int = 0


def parse(media: bytes, at: int = 0) -> Image:
    """Markers of one image from at: its tables, the scan that has the first component, and where it ends."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    im, at = Image(), at + 2
    while True:
        while media[at : at + 1] == b"\xff" and media[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("markers are cut short")
        mark, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        if mark == 0xD9:
            raise ValueError("no scan of the first component")
        body = media[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if mark in (0xC0, 0xC1):
            bits, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not im.height or not im.width:
                raise ValueError("not 8-bit samples of known size")
            im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                im.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif mark == 0xDD:
            im.restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            if not im.components:
                raise ValueError("a scan before the frame")
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            stop = at
            while True:  # the next mark that is neither stuffing nor a restart
                stop = media.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(media):
                    raise ValueError("the scan is cut short")
                if media[stop + 1] != 0 and not 0xD0 <= media[stop + 1] <= 0xD7:
                    break
                stop += 2
            if any(c == im.components[0][0] for c, _, _ in scan):
                im.scan, im.at, im.end = scan, at, stop
                tail = media.find(b"\xff\xd9", stop)
                if tail < 0:
                    raise ValueError("no end of image")
                return Image(**{**im.__dict__, "end": tail + 2, "at": (at, stop)})
            at = stop


def lookup(segment: bytes) -> np.ndarray:
    """16 bits ahead -> bits of the code << 8 | symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, bits) in codes_of(list(segment[:16]), list(segment[16:])).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return table


def thumbnails(found: list[tuple[bytes, Image]]) -> list[np.ndarray | ValueError]:
    """DC-only luminance of images, each (rows of blocks, blocks a row)."""
    out: list = [None] * len(found)
    groups: dict = {}
    for i, (_, im) in enumerate(found):
        alone = len(im.scan) == 1
        shape = {c: (h, v) for c, h, v, _ in im.components}
        order = [(c == im.components[0][0], d, a) for c, d, a in im.scan for _ in range(1 if alone else shape[c][0] * shape[c][1])]
        comps = [k for k, (c, _, _) in enumerate(im.scan) for _ in range(1 if alone else shape[c][0] * shape[c][1])]
        try:
            tables = tuple((im.huffman[d], im.huffman[16 | a]) for _, d, a in order)
        except KeyError:
            out[i] = ValueError("a Huffman table is missing")
            continue
        groups.setdefault((tuple(order), tuple(comps), tables), []).append(i)
    for (order, comps, tables), members in groups.items():
        for part in runs([found[i][1].at[1] - found[i][1].at[0] for i in members]):
            _decode(found, members[part], order, comps, tables, out)
    return out


def _decode(found, members, order, comps, tables, out) -> None:
    distinct = list(dict.fromkeys(x for t in tables for x in t))
    look = np.concatenate([lookup(x) for x in distinct])
    dc_table = np.array([distinct.index(d) << 16 for d, _ in tables])
    ac_table = np.array([distinct.index(a) << 16 for _, a in tables])
    luma = np.array([c for c, _, _ in order])
    comp = np.array(comps)
    per, m_luma = len(order), int(sum(luma))
    rank = np.cumsum(luma) - luma
    # one buffer of unstuffed bytes; lanes are split at restart marks
    raw = np.frombuffer(b"".join(found[i][0][slice(*found[i][1].at)] + b"\xff\xd0" for i in members) + b"\0" * 8, np.uint8)
    sizes = np.array([found[i][1].at[1] - found[i][1].at[0] + 2 for i in members])
    after = np.concatenate(([False], raw[:-1] == 255))
    mark = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = (after & (raw == 0)) | mark
    drop[:-1] |= mark[1:]
    kept = np.cumsum(~drop) - ~drop
    data = np.concatenate((raw[~drop], np.zeros(8, np.uint8))).astype(np.uint32)
    ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    stops = np.flatnonzero(mark)
    image_of = np.searchsorted(np.cumsum(sizes), stops, side="right")
    starts = np.concatenate(([0], stops[:-1] + 1))
    lane_lo, lane_hi = kept[starts] * 8, kept[stops - 1] * 8
    first = np.searchsorted(image_of, np.arange(len(members)))
    no = np.arange(len(stops)) - first[image_of]
    ims = [found[i][1] for i in members]
    wide = np.array([_mcus(im)[0] for im in ims])
    tall = np.array([_mcus(im)[1] for im in ims])
    total = wide * tall
    restart = np.array([im.restart or w * t for im, w, t in zip(ims, wide, tall, strict=True)])
    left = np.minimum(restart[image_of], total[image_of] - no * restart[image_of])
    base = np.cumsum(total) - total
    dc = np.zeros(int(total.sum()) * m_luma, np.int64)
    bad = np.zeros(len(members), bool)
    lanes_wanted = -(-total // restart)
    bad |= np.bincount(image_of, minlength=len(members)) < lanes_wanted
    use = np.flatnonzero(left > 0)
    pos, end, left, img = lane_lo[use].copy(), lane_hi[use], left[use].copy(), image_of[use]
    put = (base[img] + no[use] * restart[img]) * m_luma
    pred = np.zeros((len(use), len(comps) and max(comps) + 1), np.int64)
    blk, k = np.zeros(len(use), np.int64), np.zeros(len(use), np.int64)
    row = np.arange(len(use))
    while len(pos):
        is_dc = k == 0
        p = ahead[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)
        hit = look[np.where(is_dc, dc_table[blk], ac_table[blk]) + (p & 0xFFFF)]
        bits, s = hit >> 8, hit & 255
        size = np.where(is_dc, s, s & 15)
        pos = pos + bits
        d = np.flatnonzero(is_dc)
        if len(d):
            q = pos[d]
            n = size[d]
            extra = ((ahead[q >> 3] >> (16 - (q & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64) >> (16 - n)
            diff = np.where((n > 0) & (extra < (1 << np.maximum(n - 1, 0))), extra - (1 << n) + 1, extra)
            c = comp[blk[d]]
            pred[d, c] += np.where(n > 0, diff, 0)
            y = luma[blk[d]]
            dc[put[d][y] + rank[blk[d][y]]] = pred[d, c][y]
        pos = pos + size
        k = np.where(is_dc, 1, np.where(s == 0, 64, k + (s >> 4) + 1))
        wrong = (bits == 0) | (pos > end) | (is_dc & (size > 11))
        done = k >= 64
        blk = blk + done
        k = np.where(done, 0, k)
        mcu = blk == per
        blk = np.where(mcu, 0, blk)
        put = put + np.where(mcu, m_luma, 0)
        left = left - mcu
        over = wrong | (left == 0)
        if over.any():
            bad[img[wrong]] = True
            keep = ~over
            pos, end, left, img, put, blk, k, pred = (x[keep] for x in (pos, end, left, img, put, blk, k, pred))
    for j, i in enumerate(members):
        im = ims[j]
        if bad[j]:
            out[i] = ValueError("the scan is broken")
            continue
        x = dc[base[j] * m_luma : (base[j] + total[j]) * m_luma]
        h, v = (1, 1) if len(im.scan) == 1 else im.components[0][1:3]
        x = x.reshape(tall[j], wide[j], v, h).transpose(0, 2, 1, 3).reshape(tall[j] * v, wide[j] * h)
        hs, vs = max(c[1] for c in im.components), max(c[2] for c in im.components)
        rows = -(-(-(-im.height * im.components[0][2] // vs)) // 8)
        cols = -(-(-(-im.width * im.components[0][1] // hs)) // 8)
        step = im.quantisers.get(im.components[0][3], 1)
        out[i] = np.clip(np.floor_divide(x[:rows, :cols] * step + 4, 8) + 128, 0, 255).astype(np.uint8)


def _mcus(im: Image) -> tuple[int, int]:
    """MCUs across and down of the scan."""
    hs, vs = max(c[1] for c in im.components), max(c[2] for c in im.components)
    if len(im.scan) == 1:
        c = next(x for x in im.components if x[0] == im.scan[0][0])
        return -(-(-(-im.width * c[1] // hs)) // 8), -(-(-(-im.height * c[2] // vs)) // 8)
    return -(-im.width // (8 * hs)), -(-im.height // (8 * vs))


def read_media(media: list[bytes | None]) -> list[tuple[int, int, np.ndarray] | ValueError | None]:
    """Width, height and thumbnail of each value; images that follow each other in one value are stacked."""
    images, whose, out = [], [], [None] * len(media)
    for i, m in enumerate(media):
        if m is None:
            continue
        try:
            at, own = 0, []
            while at < len(m) or not own:
                im = parse(m, at)
                own.append((m, im))
                at = im.end
            images += own
            whose += [i] * len(own)
        except (ValueError, IndexError, struct.error) as e:
            out[i] = ValueError(str(e) or "broken")
    for i, (_, im), t in zip(whose, images, thumbnails(images), strict=True):
        if isinstance(t, ValueError) or isinstance(out[i], ValueError):
            out[i] = t if isinstance(t, ValueError) else out[i]
        elif out[i] is None:
            out[i] = (im.width, im.height, t)
        elif t.shape[1] == out[i][2].shape[1]:
            out[i] = (im.width, out[i][1] + im.height, np.concatenate((out[i][2], t)))
        else:
            out[i] = ValueError("images of one value differ in width")
    return out


def hashes(t: np.ndarray) -> tuple[int, int]:
    """Average hash of 8 x 8 means and difference hash of 8 x 9 means."""

    def means(rows: int, cols: int) -> np.ndarray:
        sums = np.zeros((t.shape[0] + 1, t.shape[1] + 1), np.int64)
        sums[1:, 1:] = t.cumsum(0, dtype=np.int64).cumsum(1)
        y, x = np.arange(rows) * t.shape[0] // rows, np.arange(cols) * t.shape[1] // cols
        y2, x2 = np.maximum(y + 1, np.arange(1, rows + 1) * t.shape[0] // rows), np.maximum(x + 1, np.arange(1, cols + 1) * t.shape[1] // cols)
        s = sums[np.ix_(y2, x2)] - sums[np.ix_(y, x2)] - sums[np.ix_(y2, x)] + sums[np.ix_(y, x)]
        return s / np.outer(y2 - y, x2 - x)

    a, d = means(8, 8), means(8, 9)
    word = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return word(a > a.mean()), word(d[:, 1:] > d[:, :-1])


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text's padded bytes as JPEG."""

    def run(batches):
        for b in batches:
            t = texts_of(b, "text")
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x) for x in t], pa.int64()), pa.array(write_images([padded(x) for x in t]), pa.binary())], ["key", "n_bytes", "media"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, media binary")


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds to any table with a media column: width, height, ahash, dhash, thumbnail, error.

    A column that has such a name already is passed on with _in after it. Null media give nulls without an error.
    """
    from pyspark.sql import types as T

    extra = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("ahash", T.StringType()), T.StructField("dhash", T.StringType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("error", T.StringType())]
    ours, names = {f.name for f in extra}, []
    for c in df.columns:
        while c in ours or c in names:
            c += "_in"
        names.append(c)
    media = names[df.columns.index(media)]
    df = df.toDF(*names)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in extra]
            for x in read_media(b.column(media).to_pylist()):
                if x is None or isinstance(x, ValueError):
                    row = (None, None, None, None, None, str(x) if x is not None else None)
                else:
                    a, d = hashes(x[2])
                    row = (x[0], x[1], f"{a:016x}", f"{d:016x}", x[2].tobytes(), None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*b.schema.names, *[f.name for f in extra]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def digest(stored: DataFrame) -> DataFrame:
    """Read stored media back and give the contract's digests."""

    def run(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for m, x in zip(media, read_media(media), strict=True):
                if isinstance(x, ValueError):
                    raise x
                p, (a, d) = x[2].tobytes(), hashes(x[2])
                row = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{x[0]}x{x[1]}:{a:016x}:{d:016x}")
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["key"].dataType.simpleString()
    return stored.mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_jpeg_media(spark, sf_dir):
    """Contract query over all documents: store as JPEG, read the stored bytes back, describe."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(store_texts(docs)).withColumnRenamed("key", "doc_id")
