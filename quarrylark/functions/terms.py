"""Topic strings: alternatives of terms, each a conjunction of words or phrases, compiled to filters and source syntaxes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"([^"]*)"|([,;])|(&)|([^\s,;&"]+)')


def parse_topic(text: str) -> list[tuple[str, ...]]:
    """Alternatives (by comma, semicolon or OR) of parts that must all occur; duplicates once."""
    out: list[tuple[str, ...]] = []
    now: list[str] = []

    def end() -> None:
        term = tuple(dict.fromkeys(now))
        if term and term not in out:
            out.append(term)
        now.clear()

    for m in TOKEN.finditer(text or ""):
        phrase, stop, _, word = m.groups()
        if stop or word == "OR":
            end()
        elif phrase is not None and phrase.strip():
            now.append(" ".join(phrase.split()))
        elif word:
            now.append(word)
    end()
    return out


#: Where a part begins and ends: at a border of a word, unless its own first or last character is of no word.
BEGINS, ENDS = r"(?:(?<!\w)|(?!\w))", r"(?:(?!\w)|(?<!\w))"
#: A plural s or es, after a letter.
PLURAL = r"(?:(?<=\p{L})e?s)?"


def part_regex(part: str, loose: bool = True, borders: tuple[str, str] = (r"(?<!\w)", r"(?!\w)"), plural: str = "(?:e?s)?") -> str:
    """loose: hyphens separate words, blanks and hyphens are one, a plural s or es is allowed; strict: a hyphen is part of a word."""
    if loose:
        body = r"[\s-]+".join(re.escape(w) for w in re.split(r"[\s-]+", part) if w)
        return rf"(?iU){borders[0]}{body}{plural}{borders[1]}"
    return rf"(?iU)(?<![\w-]){re.escape(part)}(?![\w-])"


def singular(part: str) -> str:
    """Without the plural s of a part of four characters or more; ss is no plural."""
    return re.sub(r"(?s)(?<=..[^sS])[sS]\Z", "", part)


def one_regex(terms: list[tuple[str, ...]]) -> str:
    """One pattern for a text that holds any term; the parts of a term may stand in any order. No terms match nothing.

    Parts have the borders of loose parts, and a part that is a plural also finds its singular.
    """
    every = [[part_regex(singular(p), True, (BEGINS, ENDS), PLURAL).removeprefix("(?iU)") for p in t] for t in terms]
    ahead = ["".join(rf"(?=[\s\S]*{p})" for p in t) if len(t) > 1 else t[0] for t in every if t]
    return "(?iU)" + "|".join(rf"(?:{'^' * (len(t) > 1)}{x})" for t, x in zip(filter(None, every), ahead, strict=True)) if ahead else "(?!)"


def matches(column: Column, terms: list[tuple[str, ...]], loose: bool = True) -> Column:
    """Any term all of whose parts occur; no terms match nothing."""
    every = [reduce(lambda a, b: a & b, [column.rlike(part_regex(p, loose)) for p in t]) for t in terms]
    return reduce(lambda a, b: a | b, every) if every else F.lit(False)


def group_filter(column: Column, terms, require_any, date: Column | None = None, lo: str = "", hi: str = "") -> Column:
    """any(terms) and any(require_any) and the window."""
    out = matches(column, terms)
    if require_any:
        out &= matches(column, require_any)
    if date is not None and lo:
        out &= date >= lo
    if date is not None and hi:
        out &= date <= hi
    return out


#: How a source writes one part of a term, and what stands between parts. Fixed values.
SYNTAX = {
    "pubmed": ('"{}"[tiab]', " AND "),
    "europepmc": ('TITLE_ABS:"{}"', " AND "),
    "arxiv": ('(ti:"{0}" OR abs:"{0}")', " AND "),
    "openalex": ('"{}"', " AND "),
    "github": ('"{}"', " "),
}


def compiled(term: tuple[str, ...], source: str) -> str:
    """The term in a source's query syntax; of several parts in brackets, where the source has them."""
    if source not in SYNTAX:
        raise ValueError(f"no such source: {source}")
    form, between = SYNTAX[source]
    parts = [p.replace('"', "") for p in term]
    if source == "openalex":  # a single word isn't quoted there, so that it is stemmed; commas and bars end a value
        parts = [" ".join(re.sub("[,|]", " ", p).split()) for p in parts]
        out = [form.format(p) if " " in p else p for p in parts]
    else:
        out = [form.format(p) for p in parts]
    if source == "arxiv" and len(out) == 1:
        return out[0][1:-1]
    return between.join(out) if len(out) == 1 or source == "github" else f"({between.join(out)})"


def group_query(terms: list[tuple[str, ...]], require_any: list[tuple[str, ...]], source: str) -> str:
    """any(terms) and any(require_any) in a source's syntax."""
    sides = [" OR ".join(compiled(t, source) for t in side) for side in (terms, require_any) if side]
    return " AND ".join(f"({s})" for s in sides)
