"""References as text and as exchange records, all in column expressions.

A reference is a row with uid, resource_type, date, year, authors, title, venue, volume, issue, pages, doi, pmid, url; a
column that isn't there counts as empty. Authors are one comma-separated string, 'Family AB' or 'Given Other Family'.
"""

from __future__ import annotations

import functools
import json
import re
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions.scalars import text
from quarrylark.operators.ordering import running_number, running_within
from quarrylark.sources.onefile import write_file

FIELDS = ["uid", "resource_type", "date", "year", "authors", "title", "venue", "volume", "issue", "pages", "doi", "pmid", "url"]

# Codes, their other names, and the words that mark a collective author.
CODES = ["APA", "AMA", "MLA", "CHI", "HAR", "VAN", "IEE", "NAT", "BIB", "RIS", "ENW", "CSL"]
ALIASES = {"IEEE": "IEE", "VANCOUVER": "VAN", "BIBTEX": "BIB", "ENDNOTE": "ENW", "CSL-JSON": "CSL", "JSON": "CSL", "CHICAGO": "CHI", "HARVARD": "HAR", "NATURE": "NAT"}
COLLECTIVE = ["consortium", "group", "study", "investigators", "collaboration", "network", "initiative", "team", "committee", "society", "project", "cohort", "alliance", "working"]
# Class of a resource type, then the class's name in RIS, EndNote and CSL.
CLASSES = {
    "article": ["article", "review"],
    "preprint": ["preprint"],
    "software": ["repository", "software package", "software"],
    "web": ["website", "database", "web calculator"],
    "data": ["dataset", "archive"],
}
RIS_TYPES = {"article": "JOUR", "preprint": "UNPB", "software": "COMP", "web": "ELEC", "data": "DATA", "other": "GEN"}
ENW_TYPES = {"article": "Journal Article", "preprint": "Unpublished Work", "software": "Computer Program", "web": "Web Page", "data": "Dataset", "other": "Generic"}
CSL_TYPES = {"article": "article-journal", "preprint": "article", "software": "software", "web": "webpage", "data": "dataset", "other": "document"}


def codes(spec: str) -> list[str]:
    """Format codes of a comma list, aliases resolved, each once, in order."""
    asked = [ALIASES.get(t, t) for t in (x.strip().upper() for x in spec.split(",")) if t]
    for t in asked:
        if t not in CODES:
            raise ValueError(f"unknown format {t!r}; use {', '.join(CODES)}")
    return list(dict.fromkeys(asked))


# ---------------------------------------------------------------- parts


def given(c: Column, before: str = "", after: str = "") -> Column:
    """The text with its surroundings, or nothing at all."""
    return F.when(text(c) == "", "").otherwise(F.concat(F.lit(before), text(c), F.lit(after)))


def joined(*parts: Column, sep: str = " ") -> Column:
    """Parts that aren't empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def stopped(c: Column) -> Column:
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def bare(c: Column) -> Column:
    return F.regexp_replace(squeezed(c), r"\.$", "")


def sentence(c: Column) -> Column:
    x = squeezed(c)
    return F.when(x.rlike(r"[.?!]$") | (x == ""), x).otherwise(F.concat(x, F.lit(".")))


def year_of(c: Column) -> Column:
    return F.when(text(c) == "", "n.d.").otherwise(text(c))


def kind_of(resource_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, types in CLASSES.items():
        out = out.when(text(resource_type).isin(types), name)
    return out.otherwise("other")


def named(kind: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), kind)


# ---------------------------------------------------------------- authors


COLLECTIVE_NAME = rf"(?i)\b(?:{'|'.join(COLLECTIVE)})\b"


def author_line(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.trim(text(c)), r"\.+$", ""))


#: Family, initials, and whether the name stands as it is.
PEOPLE = "array<struct<family:string,initials:array<string>,literal:boolean>>"
ET_AL = ("et al", "et al.")
_collective, _written = re.compile(COLLECTIVE_NAME), re.compile("[A-Z]{1,4}")


@functools.lru_cache(1 << 16)
def parsed(name: str) -> tuple[str, tuple[str, ...], bool]:
    """Family, initials and literal flag of one name: 'Family AB', or 'Given Other Family'; collective names and single words are literal."""
    rest, _, last = name.rpartition(" ")
    written = bool(rest) and _written.fullmatch(last)
    words = name.split(" ")
    if _collective.search(name) or (len(words) == 1 and not written):
        return name, (), True
    if written:
        return rest, tuple(last), False
    given_names = (p.strip(".") for w in words[:-1] for p in w.split("-"))
    return last, tuple(p[0].upper() for p in given_names if p), False


def names_of(line: str | None) -> list[str]:
    names = (x.strip(" ") for x in (line or "").split(","))
    return [x for x in names if x and x.lower() not in ET_AL]


def batched(of: Callable[[str], object], kind: pa.DataType, name: str) -> Callable[[Column], Column]:
    """A function of one author line as a column function over Arrow batches."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([of(s) for s in x.to_pylist()], kind)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, name)


def authors(c: Column) -> Column:
    """array of (family, initials, literal). Names are read once in a batch function: as column expressions they were interpreted one by one."""
    kind = pa.list_(pa.struct([("family", pa.string()), ("initials", pa.list_(pa.string())), ("literal", pa.bool_())]))
    as_rows = lambda s: [{"family": f, "initials": list(i), "literal": b} for f, i, b in map(parsed, names_of(s))]
    return batched(as_rows, kind, PEOPLE)(author_line(c))


def author_list(c: Column, code: str) -> Column:
    """The authors as a style lists them."""
    return batched(lambda s: LISTS[code].of([_shown(code, not i, x) for i, x in enumerate(names_of(s))]), pa.string(), "string")(author_line(c))


@functools.lru_cache(1 << 17)
def _shown(code: str, first: bool, name: str) -> str:
    """A name as a style writes it; names come again and again."""
    style = LISTS[code]
    return (style.first if first else style.others)(parsed(name))


def dots(a: Column, sep: str) -> Column:
    return F.array_join(F.transform(a["initials"], lambda i: F.concat(i, F.lit("."))), sep)


def inverted(a: Column) -> Column:
    """Family, then initials, of an author in a column."""
    return F.when(F.size(a["initials"]) == 0, a["family"]).otherwise(F.concat(a["family"], F.lit(", "), dots(a, " ")))


def form(pattern: str, between: str = " ", dot: str = ".") -> Callable[[tuple], str]:
    """How a name is written: the pattern of family (f) and initials (i), a dot after each initial, and what stands between them."""
    return lambda a: pattern.format(f=a[0], i=between.join(x + dot for x in a[1])) if a[1] else a[0]


LAST_FIRST, LAST_FIRST_TIGHT, LAST_BARE, FIRST_LAST = form("{f}, {i}"), form("{f}, {i}", ""), form("{f} {i}", "", ""), form("{i} {f}")


@dataclass(frozen=True)
class AuthorList:
    """How a style lists authors: forms of the first and the others, what stands before the last of two and of more, how
    many are listed whole, and what a longer list shows: its first `cut` names and a tail."""

    first: Callable[[tuple], str]
    others: Callable[[tuple], str]
    two: str
    more: str
    whole: int
    cut: int
    tail: str
    last_after_tail: bool = False

    def of(self, names: list[str]) -> str:
        if len(names) < 2:
            return "".join(names)
        if len(names) > self.whole:
            return ", ".join(names[: self.cut]) + self.tail + (names[-1] if self.last_after_tail else "")
        return ", ".join(names[:-1]) + (self.two if len(names) == 2 else self.more) + names[-1]


# How many names a list shows.
LISTS = {
    "APA": AuthorList(LAST_FIRST, LAST_FIRST, ", & ", ", & ", 20, 19, ", . . . ", True),
    "AMA": AuthorList(LAST_BARE, LAST_BARE, ", ", ", ", 6, 3, ", et al"),
    "VAN": AuthorList(LAST_BARE, LAST_BARE, ", ", ", ", 6, 6, ", et al."),
    "MLA": AuthorList(LAST_FIRST, FIRST_LAST, ", and ", ", and ", 2, 1, ", et al."),
    "HAR": AuthorList(LAST_FIRST_TIGHT, LAST_FIRST_TIGHT, " and ", " and ", 3, 1, " et al."),
    "CHI": AuthorList(LAST_FIRST, FIRST_LAST, ", and ", ", and ", 10, 7, ", et al."),
    "IEE": AuthorList(FIRST_LAST, FIRST_LAST, " and ", ", and ", 6, 1, " et al."),
    "NAT": AuthorList(LAST_FIRST, LAST_FIRST, " & ", " & ", 5, 1, " et al."),
}


# ---------------------------------------------------------------- text styles


class Reference:
    """Columns of a reference by name."""

    def __init__(self, df: DataFrame):
        for f in FIELDS:
            setattr(self, f, text(F.col(f)) if f in df.columns else F.lit(""))
        self.people = F.col("_people") if "_people" in df.columns else authors(self.authors)
        self.when = year_of(self.year)
        self.kind = kind_of(self.resource_type)
        self.link = F.when(self.doi != "", F.concat(F.lit("https://doi.org/"), self.doi)).otherwise(self.url)

    def source(self, volume: tuple[str, str], issue: tuple[str, str] | None, pages: tuple[str, str]) -> Column:
        """Venue, volume, issue and pages with what each style puts around them."""
        return F.concat(self.venue, given(self.volume, *volume), given(self.issue, *issue) if issue else F.lit(""), given(self.pages, *pages))


def _unled(c: Column) -> Column:
    return F.regexp_replace(c, "^[, ]+", "")


def _apa(r: Reference, a: Column) -> Column:
    date = F.concat(F.lit("("), r.when, F.lit(")."))
    src = r.source((", ", ""), ("(", ")"), (", ", ""))
    head = F.when(a != "", joined(F.concat(a, F.lit(" "), date), sentence(r.title))).otherwise(joined(sentence(r.title), date))
    return joined(head, F.when(src == "", "").otherwise(stopped(_unled(src))), r.link)


def _medical(r: Reference, a: Column) -> Column:
    issued = F.concat(r.when, given(r.volume, ";"), given(r.issue, "(", ")"), given(r.pages, ":"), F.lit("."))
    return joined(F.when(a == "", "").otherwise(stopped(a)), sentence(r.title), sentence(r.venue), issued, F.when(r.doi != "", F.concat(F.lit("doi:"), r.doi)).otherwise(r.url))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _mla(r: Reference, a: Column) -> Column:
    src = F.concat(r.venue, given(r.volume, ", vol. "), given(r.issue, ", no. "))
    issued = F.concat(given(src, "", ", "), r.when, given(r.pages, ", pp. "), F.lit("."))
    return joined(F.when(a == "", "").otherwise(stopped(a)), _quoted(sentence(r.title)), issued, given(r.link, "", "."))


def _harvard(r: Reference, a: Column) -> Column:
    t, date = bare(r.title), F.concat(F.lit(" ("), r.when, F.lit(")"))
    head = F.when(a == "", F.concat(t, date)).otherwise(F.concat(a, date, F.lit(" '"), t, F.lit("'")))
    src = r.source((", ", ""), ("(", ")"), (", pp. ", ""))
    where = F.when(r.doi != "", given(r.doi, " doi:", ".")).otherwise(given(r.url, " Available at: ", "."))
    return F.concat(head, F.when(src == "", "").otherwise(F.concat(F.lit(", "), _unled(src))), F.lit("."), where)


def _chicago(r: Reference, a: Column) -> Column:
    src = F.trim(r.source((" ", ""), (" (", ")"), (": ", "")))
    return joined(F.when(a == "", "").otherwise(stopped(a)), F.concat(r.when, F.lit(".")), _quoted(sentence(r.title)), given(src, "", "."), given(r.link, "", "."))


def _ieee(r: Reference, a: Column) -> Column:
    src = joined(r.venue, given(r.volume, "vol. "), given(r.issue, "no. "), given(r.pages, "pp. "), r.when, sep=", ")
    where = F.when(r.doi != "", given(r.doi, ", doi: ")).otherwise(given(r.url, ". [Online]. Available: "))
    return F.concat(given(a, "", ", "), F.lit('"'), bare(r.title), F.lit('," '), src, where, F.lit("."))


def _nature(r: Reference, a: Column) -> Column:
    src = F.trim(r.source((" ", ""), None, (", ", "")))
    return F.concat(given(a, "", " "), sentence(r.title), F.lit(" "), given(src, "", " "), F.lit("("), r.when, F.lit(")."), given(r.link, " "))


STYLES = {"APA": _apa, "AMA": _medical, "VAN": _medical, "MLA": _mla, "HAR": _harvard, "CHI": _chicago, "IEE": _ieee, "NAT": _nature}
#: What stands before the running number and after it; the other styles aren't numbered.
NUMBERS = {"AMA": ("", ". "), "VAN": ("", ". "), "NAT": ("", ". "), "IEE": ("[", "] ")}


# ---------------------------------------------------------------- exchange formats


def _word(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), "[^A-Za-z0-9]", ""))


def bibtex_keys(df: DataFrame, order: list) -> DataFrame:
    """df with cite_key: family, year and first word of the title; of n equal keys in order the second gets a, and so on to z."""
    r = Reference(df)
    lead = F.try_element_at(r.people, F.lit(1))
    family = F.coalesce(_word(F.when(lead["literal"], F.split(lead["family"], " ")[0]).otherwise(lead["family"])), F.lit(""))
    words = F.filter(F.transform(F.split(squeezed(r.title), " "), _word), lambda w: w != "")
    base = F.concat(F.when(family == "", "ref").otherwise(family), F.when(r.year == "", "nd").otherwise(r.year), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))
    n = F.col("_place")
    suffix = F.when(n == 1, "").otherwise(F.char(F.lit(97) + F.least(n - 2, F.lit(25))))
    # a base may hold any share of the references, so its places aren't one window's
    placed = running_within(df.withColumn("_base", base), ["_base"], order, "_place")
    return placed.withColumn("cite_key", F.concat("_base", suffix)).drop("_base", "_place")


def latex(c: Column) -> Column:
    return F.regexp_replace(text(c), "([&%#_])", r"\\$1")


def bibtex(r: Reference, key: Column) -> Column:
    article = r.kind == "article"
    people = F.array_join(F.transform(r.people, lambda a: F.when(a["literal"], F.concat(F.lit("{"), a["family"], F.lit("}"))).otherwise(inverted(a))), " and ")
    fields = [
        ("author", people), ("title", F.concat(F.lit("{"), latex(bare(r.title)), F.lit("}"))), ("journal", F.when(article, latex(r.venue))), ("howpublished", F.when(~article, latex(r.venue))),
        ("year", r.year), ("volume", r.volume), ("number", r.issue), ("pages", F.replace(r.pages, F.lit("-"), F.lit("--"))), ("doi", r.doi), ("url", r.link), ("pmid", r.pmid), ("note", F.when(~article, r.resource_type)),
    ]
    body = joined(*[given(v, f"  {n} = {{", "}") for n, v in fields], sep=",\n")
    return F.concat(F.lit("@"), F.when(article, "article").otherwise("misc"), F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}"))


def _lines(people: Column, mark: str) -> Column:
    return F.array_join(F.transform(people, lambda a: F.concat(F.lit(mark), inverted(a))), "\n")


def ris(r: Reference) -> Column:
    ends = F.filter(F.transform(F.split(r.pages, "[-–]"), lambda x: F.trim(x)), lambda x: x != "")
    day = F.when(r.date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(r.date, F.lit("-"), F.lit("/")))
    tags = [("T2", r.venue), ("PY", r.year), ("DA", day), ("VL", r.volume), ("IS", r.issue), ("SP", F.try_element_at(ends, F.lit(1))), ("EP", F.when(F.size(ends) > 1, F.try_element_at(ends, F.lit(-1)))), ("DO", r.doi), ("UR", r.link), ("AN", r.pmid)]
    return joined(F.concat(F.lit("TY  - "), named(r.kind, RIS_TYPES)), _lines(r.people, "AU  - "), F.concat(F.lit("TI  - "), bare(r.title)), *[given(v, f"{t}  - ") for t, v in tags], F.lit("ER  - "), sep="\n")


def endnote(r: Reference) -> Column:
    where = F.when(r.kind == "article", given(r.venue, "%J ")).otherwise(given(r.venue, "%B "))
    tags = [("%D", r.year), ("%V", r.volume), ("%N", r.issue), ("%P", r.pages), ("%R", r.doi), ("%U", r.link), ("%M", r.pmid)]
    return joined(F.concat(F.lit("%0 "), named(r.kind, ENW_TYPES)), _lines(r.people, "%A "), F.concat(F.lit("%T "), bare(r.title)), where, *[given(v, f"{t} ") for t, v in tags], sep="\n")


def csl(r: Reference) -> Column:
    """One item as JSON, keys in order of code points, empty ones left out."""
    some = lambda c: F.when(text(c) != "", c)
    person = lambda a: F.struct(F.when(~a["literal"], a["family"]).alias("family"), F.when(F.size(a["initials"]) > 0, dots(a, " ")).alias("given"), F.when(a["literal"], a["family"]).alias("literal"))
    number = lambda i, n: F.substring(r.date, i, n).try_cast("int")
    parts = F.when(r.date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.array(number(1, 4), number(6, 2), number(9, 2))).when(r.year.rlike(r"^\d+$"), F.array(r.year.try_cast("int")))
    items = [
        ("DOI", some(r.doi)), ("PMID", some(r.pmid)), ("URL", some(r.link)), ("author", F.when(F.size(r.people) > 0, F.transform(r.people, person))), ("container-title", some(r.venue)), ("id", r.uid),
        ("issue", some(r.issue)), ("issued", F.when(parts.isNotNull(), F.struct(F.array(parts).alias("date-parts")))), ("page", some(r.pages)), ("title", bare(r.title)), ("type", named(r.kind, CSL_TYPES)), ("volume", some(r.volume)),
    ]
    return F.to_json(F.struct(*[v.alias(n) for n, v in items]), {"ignoreNullFields": "true"})


# ---------------------------------------------------------------- lists


def render(df: DataFrame, code: str, order: list, numbered: bool = True, parts: bool = False) -> DataFrame:
    """uid, n (place in order) and text of every reference in one format; numbered=False leaves out places and their marks.

    parts keeps the sorted partition of a row and its place there (_p, _i); not for BIB, whose keys need another order.
    """
    keep = [c for c in FIELDS if c in df.columns]
    df = running_number(df, order, "n", parts) if numbered else df
    by = [F.col("n")] if numbered else order
    own = F.col("authors") if "authors" in keep else F.lit("")
    df = df.withColumn("_list", author_list(own, code)) if code in STYLES else df.withColumn("_people", authors(own))
    if code == "BIB":
        df = bibtex_keys(df, by)
    r = Reference(df)
    if code in STYLES:
        out = STYLES[code](r, F.col("_list"))
        if numbered and code in NUMBERS:
            a, b = NUMBERS[code]
            out = F.concat(F.lit(a), F.col("n").cast("string"), F.lit(b), out)
    else:
        out = {"BIB": lambda: bibtex(r, F.col("cite_key")), "RIS": lambda: ris(r), "ENW": lambda: endnote(r), "CSL": lambda: csl(r)}[code]()
    return df.select(F.col("uid"), *(["n"] if numbered else []), *(["_p", "_i"] if parts else []), out.alias("text"))


#: Endings of reference files. Fixed values.
ENDINGS = {"APA": ".apa.txt", "AMA": ".ama.txt", "MLA": ".mla.txt", "CHI": ".chi.txt", "HAR": ".har.txt", "VAN": ".van.txt", "IEE": ".iee.txt", "NAT": ".nat.txt", "BIB": ".bib", "RIS": ".ris", "ENW": ".enw", "CSL": ".json"}


def pretty(c: Column) -> Column:
    """A JSON object as it stands in an indented list, in Arrow batches."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([textwrap.indent(json.dumps(json.loads(s), indent=2, ensure_ascii=False, sort_keys=True), "  ") for s in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(c)


def write_references(df: DataFrame, codes_: list[str], path: str, order: list) -> list[str]:
    """A file for each format: the given name where it is one format and has an ending, else the name with the format's ending.

    Each file is written by many tasks at once, in order; no reference comes to the driver.
    """
    out, named = [], "." in path.rpartition("/")[2]
    for code in codes_:
        target = path if len(codes_) == 1 and named else path + ENDINGS[code]
        rows = render(df, code, order, parts=code != "BIB")  # sorted once: what numbers the rows places them in the file
        by = ["n"] if code == "BIB" else None
        if code == "CSL":
            write_file(rows, target, by, pretty(F.col("text")), separator(code), "[\n", "\n]\n", "[]\n")
        else:
            write_file(rows, target, by, F.col("text"), separator(code))
        out.append(target)
    return out


def separator(code: str) -> str:
    """What stands between two references in a file."""
    return {"BIB": "\n\n", "RIS": "\n\n", "ENW": "\n\n", "CSL": ",\n"}.get(code, "\n")
