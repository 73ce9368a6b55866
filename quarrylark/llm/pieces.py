"""Encoding and decoding with the pieces of a SentencePiece model by streaming Viterbi.

The best segmentation maximises the sum of piece scores. Characters arrive one after another, in slices of any length.
Only the last max-piece characters can begin a piece that is still to come, so only paths to boundaries in that window go
on. After every slice these are followed back, the farthest first, until all of them meet in one boundary: the ids before it
are final and are given out. Memory is a slice, the window and what has not met yet; when that is long, it is followed back
again once it has doubled.

No piece of the vocabulary goes on over a boundary before a space mark that follows another character, so all paths meet
there, and what lies between two such boundaries, a word, has one answer. Each word of a batch of texts is encoded once, and
answers are remembered in a bounded memo; words that it doesn't know go through the window one behind the other, and their
ids are told apart at these boundaries.

Characters that are no piece become their bytes' pieces. The model's own scores are used as they are, whatever way
they were trained; ties go to the longer last piece. Defined results: null text is empty and has no ids; decode
inverts encode, but for the space mark U+2581 itself, which comes back as a space; a null id list decodes to null.
Repeated rows and keys are rows of their own, a null key stays null, an empty table gives none, other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO = 250_000
#: Characters that are taken from a text at a time.
SLICE = 1 << 16
#: Words that are looked up at a time.
WORDS = 1 << 19
#: An open part above this is followed back again when it has doubled.
OFTEN = 4096
NEVER = float("-inf")


def fields(buf: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            at += 8
            yield tag >> 3, buf[at - 8 : at]
        elif kind == 5:
            at += 4
            yield tag >> 3, struct.unpack("<f", buf[at - 4 : at])[0]
        else:
            n = varint()
            at += n
            yield tag >> 3, buf[at - n : at]


class Pieces:
    """Vocabulary of a model file: pieces, scores, kinds, and the prefix rule."""

    def __init__(self, path: str):
        import ahocorasick

        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.prefix = True
        with open(path, "rb") as f:
            model = f.read()
        for k, v in fields(model):
            if k == 1:
                got = dict(fields(v))
                self.text.append(got.get(1, b"").decode())
                self.score.append(float(got.get(2, 0.0)))
                self.kind.append(int(got.get(3, NORMAL)))
            elif k == 3:
                spec = dict(fields(v))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2):
                    raise ValueError("models with a character map aren't supported")
        self.use = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (NORMAL, USER)}
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.longest = max(map(len, self.use))
        self.worst = min(self.score[i] for i in self.use.values()) - 10.0
        self.singles = frozenset(t for t in self.use if len(t) == 1)
        letters = self.singles.union(*self.use)
        #: Stands for every character that is in no piece.
        self.blank = next(c for c in map(chr, range(0x110000)) if c not in letters)
        self.foreign = re.compile(f"[^{re.escape(''.join(letters))}]")
        self.unlike = re.compile(f"[^{re.escape(''.join(self.singles))}]" if self.singles else "(?s:.)")
        self.found = ahocorasick.Automaton()
        for c in {self.blank} | letters - self.singles:  # no pieces themselves, they become their bytes'
            self.found.add_word(c, (1, self.worst, -1))
        for t, i in self.use.items():
            self.found.add_word(t, (len(t), self.score[i], i))
        self.found.make_automaton()
        #: No piece goes on over a mark that follows another character.
        self.cuts = MARK in self.singles and not any(MARK in t.lstrip(MARK) for t in self.use)
        #: Packed answers by word, the later and the earlier half.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: By id: it begins with a mark, isn't marks alone, stands for nothing; its bytes in a text.
        self.marked = np.array([t.startswith(MARK) for t in self.text])
        self.solid = np.array([t.strip(MARK) != "" for t in self.text])
        self.silent = np.array([k == CONTROL for k in self.kind])
        self.raw = pa.array([self._bytes(t, k) for t, k in zip(self.text, self.kind, strict=True)], pa.binary())

    @staticmethod
    def _bytes(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return (" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else text.replace(MARK, " ")).encode()

    def ids_of(self, id_: int, char: str) -> tuple[int, ...]:
        return (id_,) if id_ >= 0 else tuple(self.byte.get(b, self.unknown) for b in char.encode()) if self.byte else (self.unknown,)

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of one text that comes in parts, given out as soon as they are final."""
        s, lead = Stream(self), " " if self.prefix else ""
        for part in parts:
            if part:
                yield s.feed((lead + part).replace(" ", MARK))
                lead = ""
        yield s.finish()

    def encode(self, text: str) -> list[int]:
        return [i for part in self.stream(text[a : a + SLICE] for a in range(0, len(text), SLICE)) for i in part]

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as lists of int32 without nulls."""
        lead = " " if self.prefix else ""
        if not self.cuts:
            return pa.array([self.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))
        raw = [(lead + t).replace(MARK, " ").encode() if t else b"" for t in texts.to_pylist()]
        data = b"".join(raw)
        ends = np.cumsum([0, *map(len, raw)])
        space = np.frombuffer(data, np.uint8) == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[ends[:-1][np.diff(ends) > 0]] = True
        at = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
        blocks = [pa.array([], pa.list_(pa.int32()))]
        for a in range(0, len(words), WORDS):
            block = words.slice(a, WORDS).dictionary_encode()
            answers = self._answers(block.dictionary.to_numpy(zero_copy_only=False).tolist())
            starts = np.cumsum([0, *map(len, answers)]) // 4
            blocks.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(answers), "<i4"))).take(block.indices))
        ids = pa.concat_arrays(blocks)
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.searchsorted(at, ends))), ids.values)

    def _answers(self, words: list[str]) -> list[bytes | None]:
        """Packed ids of words that all differ."""
        got = [self.memo.get(w) or self.older.get(w) for w in words]
        new = [i for i, ids in enumerate(got) if ids is None]
        run = [i for i in new if words[i][0] == " " != words[i][-1]]  # the next one begins with a mark, so all paths meet before it
        s = Stream(self)
        if run:
            text = "".join([words[i] for i in run]).replace(" ", MARK)
            parts = [np.array(s.feed(text[a : a + SLICE]), "<u4") for a in range(0, len(text), SLICE)]
            flat = np.concatenate([*parts, np.array(s.finish(), "<u4")])
            cuts = (np.flatnonzero(self.solid[flat[:-1]] & self.marked[flat[1:]]) + 1) * 4
            flat, cuts = flat.tobytes(), [0, *cuts.tolist(), 4 * len(flat)]
            for i, a, b in zip(run, cuts[:-1], cuts[1:], strict=True):
                got[i] = flat[a:b]
        for i in new:
            if got[i] is None:  # marks alone, or none before it
                ids = s.feed(words[i].replace(" ", MARK)) + s.finish()
                got[i] = struct.pack(f"<{len(ids)}I", *ids)
        self.memo.update((words[i], got[i]) for i in new if len(words[i]) <= 2 * self.longest)  # others hardly come again
        if len(self.memo) >= MEMO // 2:
            self.older, self.memo = self.memo, {}
        return got

    def decode(self, ids: list[int]) -> str:
        out, at = [], np.asarray(ids, np.int64)
        for part in np.split(at, np.flatnonzero(self.silent[at])):
            out.append(b"".join(self.raw.take(pa.array(part)).to_pylist()).decode(errors="replace"))
        return self._text("".join(out))

    def decode_all(self, ids: pa.Array) -> list[str]:
        """The text of each list of ids, without nulls."""
        if self.silent[ids.values.to_numpy()].any():
            return [self.decode(x) for x in ids.to_pylist()]
        raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.raw.take(ids.values)), b"")
        return [self._text(x.decode(errors="replace")) for x in raw.to_pylist()]

    def _text(self, text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Stream:
    """Viterbi whose memory is the window of the longest piece and what has not met yet.

    Lists are by boundary, from the oldest that is kept: its best score, the size and id of the last piece before it.
    """

    def __init__(self, p: Pieces):
        self.p = p
        self._fresh()

    def _fresh(self) -> None:
        self.tail = ""  # the last characters, short of the longest piece
        self.low = self.root = self.end = 0  # of the lists, the oldest boundary not given out, the last one
        self.again = 0  # the end at which paths are followed back again
        self.best, self.size, self.id = [0.0], [0], [0]
        self.odd: dict[int, str] = {}  # characters that are no piece, by the boundary after them

    @property
    def open(self) -> bool:
        return self.end > 0

    def feed(self, text: str) -> list[int]:
        """Take the next characters; the ids that they make final."""
        p, tail, start = self.p, self.tail, self.end
        best, size, ids, low = self.best, self.size, self.id, self.low
        if not p.singles.issuperset(text):
            self.odd.update((start + m.end(), m[0]) for m in p.unlike.finditer(text))
            text = p.foreign.sub(lambda _: p.blank, text)
        n = len(text)
        best += [NEVER] * n
        size += [1] * n
        ids += [-1] * n
        text = tail + text  # pieces may begin in what came before
        shift, first = start - len(tail) + 1 - low, start - low
        for end, (m, x, j) in p.found.iter(text):  # in order of their ends, the longer before the shorter
            end += shift
            if end > first:
                x += best[end - m]
                if x > best[end]:
                    best[end] = x
                    size[end] = m
                    ids[end] = j
        self.end = start + n
        self.tail = text[1 - p.longest :] if p.longest > 1 else ""
        return self._commit() if self.end >= self.again else []

    def _commit(self) -> list[int]:
        """The ids before the boundary where all paths that may go on meet."""
        at, low, root, size = self.end, self.low, self.root, self.size
        alive = set(range(max(root, at + 1 - self.p.longest), at + 1))
        while len(alive) > 1:
            if at in alive:
                alive.remove(at)
                alive.add(at - size[at - low])
            at -= 1
        (at,) = alive
        out = self._ids(at)
        if self.odd and at > root:
            self.odd = {e: c for e, c in self.odd.items() if e > at}
        if at - low > 4096:  # forget what has been given out
            cut, best = at - low, self.best
            zero = best[cut]
            for x in (size, self.id):
                del x[:cut]
            best[:] = [x - zero for x in best[cut:]]
            self.low = at
        self.root = at
        still = self.end - at
        self.again = self.end + still if still > OFTEN else 0
        return out

    def _ids(self, end: int) -> list[int]:
        """Along the best path to a boundary, from the last that was given out."""
        out, e, root, size, ids = [], end - self.low, self.root - self.low, self.size, self.id
        while e > root:
            i = ids[e]
            if i >= 0:
                out.append(i)
            else:
                out += self.p.ids_of(i, self.odd[e + self.low])[::-1]
            e -= size[e]
        out.reverse()
        return out

    def finish(self) -> list[int]:
        """Nothing goes on over the last boundary: all that is open becomes final."""
        out = self._ids(self.end)
        self._fresh()
        return out


@functools.lru_cache(2)
def vocabulary(path: str) -> Pieces:
    """One for each worker: tasks that follow one another share its memo."""
    return Pieces(path)


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids of each text."""

    def run(batches):
        p = vocabulary(model_path(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), p.encode_all(b.column("text"))], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key and text of each id list."""

    def run(batches):
        p = vocabulary(model_path(path))
        for b in batches:
            texts = [None if x is None else p.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op6_piece_codec(spark, sf_dir):
    """All documents encoded, and decoded again from the ids alone: counts, digests and whether the text came back."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        p = vocabulary(model_path(None))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = p.encode_all(b.column("text"))
            back = p.decode_all(ids)
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_pylist()
            cols = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                ids.value_lengths().cast(pa.int64()),
                pa.array([zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
