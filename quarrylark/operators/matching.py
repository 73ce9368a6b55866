"""Many names in one pass over each text: which occur, where first, and how often.

A vocabulary maps names to patterns. A form stands alone: neither a word character nor a hyphen touches it. So a form of
nothing but these is a whole word of the text, and is looked up: a text is cut into words once, however many names there
are. Forms with other characters are found by an automaton that reads the text once; patterns that are no words between
bars are searched for one after another. A form tells cases apart unless its pattern starts with (?i).

The vocabulary is configuration: it is handed to the tasks with the function, in slices of SLICE names, and a slice is a
pass; the automaton of a slice is built once in a worker. Texts stay where they are scanned, without any shuffle.

Defined results: null and empty texts hold no name; a name's occurrences don't overlap, the leftmost counts, of two
forms at one place the first in the pattern; places are code points from 0; an empty vocabulary finds nothing; a name with
an empty pattern is an error.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S

#: Names of one pass.
SLICE = 200_000
FOUND = "array<struct<name:string,place:int,n:int>>"
#: Texts that are Python strings at once.
ROWS = 256
#: Words whose names a worker remembers.
KEPT = 1 << 17
WORD, BETWEEN = re.compile(r"[\w-]+"), re.compile(r"([\w-]+)")
SYNTAX = set("\\.^$*+?{}[]()")


def literal_forms(pattern: str) -> list[str] | None:
    """The words of a pattern that is no more than words between bars; None of any other."""
    out, now, escaped = [], [], False
    for ch in pattern:
        if escaped:
            if ch.isalnum():
                return None  # a class, a border or a back reference
            now.append(ch)
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == "|":
            out.append("".join(now))
            now = []
        elif ch in SYNTAX:
            return None
        else:
            now.append(ch)
    out.append("".join(now))
    return None if escaped or "" in out else out


def lowered(s: str) -> str:
    """Lower case of as many characters, each by itself (a sigma is no final one)."""
    low = s.lower()
    return low if len(low) == len(s) and "Σ" not in s else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


class Uses(dict):
    """Names that a word is a form of, by word; remembered."""

    def __init__(self):
        self.exact: dict[str, list[int]] = {}
        self.loose: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = tuple(dict.fromkeys(self.exact.get(word, []) + self.loose.get(lowered(word), [])))
        return found


class Matcher:
    """Occurrences of a vocabulary's names; of whole words, or with alone=False of any characters."""

    def __init__(self, vocabulary: Iterable[tuple[str, str]], alone: bool = True):
        self.names, self.alone, self.uses = [], alone, Uses()
        self.patterns: list[tuple[int, re.Pattern]] = []
        forms: dict[str, list] = {}
        for i, (name, pattern) in enumerate(vocabulary):
            if not pattern.removeprefix("(?i)"):
                raise ValueError(f"no pattern for {name!r}")
            self.names.append(name)
            loose, body = pattern.startswith("(?i)"), pattern.removeprefix("(?i)")
            words = literal_forms(body)
            if words is None:
                try:
                    self.patterns.append((i, re.compile(rf"(?<![\w-])(?:{body})(?![\w-])" if alone else body, re.I if loose else 0)))
                except re.error as e:
                    raise ValueError(f"bad pattern {pattern!r}: {e}") from None
            elif alone and all(map(WORD.fullmatch, words)):  # words don't overlap, so that which form it is doesn't matter
                for w in words:
                    (self.uses.loose if loose else self.uses.exact).setdefault(lowered(w) if loose else w, []).append(i)
            else:
                for rank, w in enumerate(words):
                    forms.setdefault(lowered(w), []).append((i, rank, None if loose else w))
        self.has_words = bool(self.uses.exact or self.uses.loose)
        self.automaton = ahocorasick.Automaton()
        for form, uses in forms.items():
            self.automaton.add_word(form, (len(form), uses))
        if forms:
            self.automaton.make_automaton()
        self.has_forms = bool(forms)

    def _touched(self, text: str, start: int, end: int) -> bool:
        inner = lambda c: c.isalnum() or c in "_-"
        return start > 0 and inner(text[start - 1]) or end < len(text) and inner(text[end])

    def _words(self, text: str) -> dict[int, tuple[int, int]]:
        """First place and occurrences by number of the names that are words."""
        pieces = BETWEEN.split(text)  # what is no word and words in turn
        words, starts = pieces[1::2], list(accumulate(map(len, pieces)))[:-1:2]
        first = dict(zip(reversed(words), reversed(starts), strict=True))
        out: dict[int, tuple[int, int]] = {}
        for w, n in Counter(words).items():
            for i in self.uses[w]:
                place, before = out.get(i, (first[w], 0))
                out[i] = min(place, first[w]), before + n
        return out

    def _others(self, text: str) -> dict[int, tuple[int, int]]:
        """The same of all other names."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        if self.has_forms:
            for last, (n, uses) in self.automaton.iter(lowered(text)):
                start = last + 1 - n
                if self.alone and self._touched(text, start, last + 1):
                    continue
                for i, rank, exact in uses:
                    if exact is None or text.startswith(exact, start):
                        hits.setdefault(i, []).append((start, rank, last + 1))
        out = {}
        for i, places in hits.items():
            n, end = 0, 0
            for start, _, stop in sorted(places):
                if start >= end:
                    n, end = n + 1, stop
            out[i] = min(places)[0], n
        for i, pattern in self.patterns:
            starts = [m.start() for m in pattern.finditer(text) if m.group()]
            if starts:
                out[i] = starts[0], len(starts)
        return out

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(name, first place, occurrences) in the order of the vocabulary."""
        out = (self._words(text) if self.has_words else {}) | self._others(text)
        return [(self.names[i], *out[i]) for i in sorted(out)]

    def count(self, texts: Iterable[str | None], held: Counter, all_: Counter) -> None:
        """Adds to held the texts that hold a name and to all_ its occurrences, by the name's number."""
        seen: Counter = Counter()
        for text in filter(None, texts):
            words = WORD.findall(text) if self.has_words else []
            seen.update(words)
            found = {i for w in set(words) for i in self.uses[w]}
            for i, (_, n) in self._others(text).items():
                found.add(i)
                all_[i] += n
            held.update(found)
        for w, n in seen.items():
            for i in self.uses[w]:
                all_[i] += n


@functools.lru_cache(8)
def _matcher(vocabulary: tuple[tuple[str, str], ...], alone: bool) -> Matcher:
    return Matcher(vocabulary, alone)


def texts(x: pa.Array) -> Iterator[str | None]:
    """The values, some rows at a time."""
    return (s for i in range(0, len(x), ROWS) for s in x.slice(i, ROWS).to_pylist())


def occurrences(c: Column, vocabulary: dict[str, str], alone: bool = True) -> Column:
    """array of (name, place, n) of a text, in the order of the vocabulary."""
    items = tuple(vocabulary.items())
    Matcher(items[:SLICE], alone)  # mistakes show here, not in a task
    kind = pa.list_(pa.struct([("name", pa.string()), ("place", pa.int32()), ("n", pa.int32())]))

    def of(part: tuple) -> Column:
        def run(x: pa.Array) -> pa.Array:
            m, ends, rows = _matcher(part, alone), [0], []
            for s in texts(x):
                rows += m.find(s) if s else ()
                ends.append(len(rows))
            columns = [pa.array([r[i] for r in rows], kind.value_type[i].type) for i in range(3)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["name", "place", "n"]))

        run.__annotations__ = {"x": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, FOUND)(c)

    parts = [of(items[i : i + SLICE]) for i in range(0, len(items), SLICE)]
    return F.concat(*parts) if parts else F.array().cast(FOUND)


def vocabulary_of(names: DataFrame, most: int = 1_000_000) -> dict[str, str]:
    """A vocabulary from a table (name, pattern) of configuration, by name; a table of more rows than `most` is no configuration, and an error."""
    rows = names.select("name", "pattern").filter("name IS NOT NULL AND pattern IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return dict(sorted(map(tuple, rows)))


def labels(c: Column, vocabulary: dict[str, str]) -> Column:
    """Names that occur, in the order of the vocabulary."""
    return F.transform(occurrences(c, vocabulary), lambda x: x["name"])


def mentions(df: DataFrame, key: str, text: str, vocabulary: dict[str, str]) -> DataFrame:
    """key, name, place, n: a row for each name of each text."""
    return df.select(key, F.explode(occurrences(F.col(text), vocabulary)).alias("_m")).select(key, "_m.name", "_m.place", "_m.n")


def mention_counts(df: DataFrame, key: str, text: str, vocabulary: dict[str, str]) -> DataFrame:
    """name, texts (that hold it), n (occurrences) of every name that occurs at all.

    A row is a text, with whatever key. A task counts its own texts, so that a row a name and task is shuffled.
    """
    items = tuple(vocabulary.items())
    Matcher(items[:SLICE])  # mistakes show here, not in a task

    def run(batches):
        parts = [items[i : i + SLICE] for i in range(0, len(items), SLICE)]
        held, all_ = [Counter() for _ in parts], [Counter() for _ in parts]
        for b in batches:
            for part, h, a in zip(parts, held, all_, strict=True):
                _matcher(part, True).count(texts(b.column(0)), h, a)
        for part, h, a in zip(parts, held, all_, strict=True):
            numbers = list(h)
            yield pa.RecordBatch.from_arrays([pa.array([part[i][0] for i in numbers], pa.string()), pa.array([h[i] for i in numbers], pa.int64()), pa.array([a[i] for i in numbers], pa.int64())], ["name", "texts", "n"])

    counted = df.select(F.col(text)).mapInArrow(run, "name string, texts long, n long")
    return counted.groupBy("name").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"))


def first_appearance(catalogue: DataFrame, vocabulary: dict[str, str], key: str = "uid") -> DataFrame:
    """name, date, key, papers: the earliest paper whose title names it, the undated last and of one date the smallest key; how
    many papers' entities hold the name, also as a part of another name. Names of no title are left out."""
    late = F.when(S.text(F.col("date")) == "", "9999").otherwise(F.col("date"))
    first = mentions(catalogue.select(key, late.alias("_late"), "title"), key, "title", vocabulary).select("name", key).distinct()
    dated = catalogue.select(key, late.alias("_late"), S.text(F.col("date")).alias("date"))
    first = first.join(dated, key).groupBy("name").agg(F.min(F.struct("_late", key, "date")).alias("_f")).select("name", "_f.date", F.col("_f")[key].alias(key))
    # a name counts where it is a part of another: which names hold which is settled on the vocabulary, not on rows
    held = Matcher([(n, re.escape(n)) for n in vocabulary], alone=False)
    parts = catalogue.sparkSession.createDataFrame([(n, p) for n in vocabulary for p, *_ in held.find(n)], "_entity string, name string")
    named = catalogue.select(key, F.explode(S.list_items(F.col("entities"))).alias("_entity")).join(parts, "_entity").select(key, "name").distinct()
    return first.join(named.groupBy("name").agg(F.count(F.lit(1)).alias("papers")), "name", "left").na.fill(0, ["papers"])
