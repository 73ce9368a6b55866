"""Scalar expressions over bibliographic fields. Missing text is the empty string throughout."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """Tags out, white space squeezed, trimmed."""
    return collapse(F.regexp_replace(text(c), "<[^>]*>", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), "[ \\t\\n\\r\\f\\x0B]+", " "))


# What landing pages add to a DOI.
LANDING = ["suppl_file", "suppl", "full", "abstract", "pdf", "epdf", "html", "figures", "tables"]


def normalise_doi(c: Column) -> Column:
    """Bare DOI in lower case, or empty: cut at a comma or semicolon, without closing marks, a prefix typed twice, a landing page's ending or a preprint's version."""
    x = F.regexp_extract(F.lower(text(c)), r"\b10\.[0-9]{4,9}/[^\s\"'`<>|\]\[{},;]+", 0)
    x = F.regexp_replace(x, "[.:)]+$", "")
    x = F.regexp_replace(x, r"^(10\.[0-9]{4,9})/\1/", "$1/")
    x = F.regexp_replace(x, rf"/(?:{'|'.join(LANDING)})(?:/.*)?$", "")
    version = F.regexp_replace(x, r"(?:v[0-9]+(?:\.full)?(?:\.(?:pdf|txt|html))?|\.full(?:\.pdf)?)$", "")
    return F.when(x.startswith("10.1101/"), version).otherwise(x)


def normalise_pmid(c: Column) -> Column:
    x = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(x == "0", "").otherwise(x)


def normalise_pmcid(c: Column) -> Column:
    """PMC and digits, or empty: what begins with PMC must go on with digits alone, of the rest the digits count."""
    x = F.upper(F.trim(text(c)))
    y = F.when(x.startswith("PMC"), x).otherwise(F.concat(F.lit("PMC"), F.regexp_replace(x, "[^0-9]", "")))
    return F.when(y.rlike("^PMC[0-9]+$"), y).otherwise("")


def bare_url(c: Column) -> Column:
    """Without a web scheme, www and closing slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text(c)), "/+$", ""), r"^https?://(?:www\.)?", ""))


def make_uid(doi: Column, pmid: Column, pmcid: Column, epmc: Column, url: Column) -> Column:
    """doi > pmid > pmcid > epmc > url; an error if all are empty."""
    chain = [(normalise_doi(doi), "doi:"), (normalise_pmid(pmid), "pmid:"), (normalise_pmcid(pmcid), "pmcid:"), (F.upper(text(epmc)), "epmc:"), (bare_url(url), "url:")]
    got = F.coalesce(*[F.when(v != "", F.concat(F.lit(p), v)) for v, p in chain])
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.lit("a record without identifiers")))


def host(url: Column) -> Column:
    x = F.regexp_extract(F.lower(text(url)), "^[a-z]+://([^/?#:]+)", 1)
    return F.regexp_replace(x, r"^(?:www|m)\.", "")


def clean_url(url: Column) -> Column:
    """Without fragment, tracking query and closing slash."""
    x = F.regexp_replace(text(url), "#.*$", "")
    x = F.regexp_replace(x, r"\?utm_[^#]*$", "")
    return F.regexp_replace(x, "/+$", "")


def url_kind(url: Column) -> Column:
    """Kind by host, first match."""
    h = host(url)
    kinds = [("github.com", "repository"), ("gitlab.com", "repository"), ("zenodo.org", "archive"), ("pypi.org", "package"), ("doi.org", "doi")]
    out = F.when(h.isNull() | (h == ""), "none")
    for name, kind in kinds:
        out = out.when((h == name) | h.endswith(f".{name}"), kind)
    return out.otherwise("website")


def slug(c: Column) -> Column:
    """File-safe name of a uid, without its scheme; above 120 characters a cut and a digest of the whole uid."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"(?s)^[^:]*:", ""), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(F.length(x) > 120, F.concat(F.substring(x, 1, 111), F.lit("_"), F.substring(F.sha1(text(c)), 1, 8))).otherwise(x)


def topic_slug(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(x, 1, 60), "-+$", "")


def first_authors(c: Column, n: int = 3) -> Column:
    """The first n names of a comma list, and whether there are more."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text(c), r"\.+$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.array_join(F.slice(parts, 1, n), ", "), F.when(F.size(parts) > n, " et al.").otherwise(""))


def author_key(authors: Column, title: Column) -> Column:
    """First word of the first author, else the title."""
    first = F.trim(F.split(text(authors), ",")[0])
    return F.lower(F.when(first == "", text(title)).otherwise(F.split(first, " ")[0]))


def best_date(date: Column, year: Column) -> Column:
    d = F.trim(text(date))
    y = F.trim(F.when(text(year) == "", F.substring(d, 1, 4)).otherwise(text(year)))
    return F.when(d.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), d).when(y.rlike("^[0-9]{4}$"), F.concat(y, F.lit("-01-01"))).otherwise("")


def sharpen(date: Column, other: Column) -> Column:
    """A date that only has its year takes the other source's date of that year."""
    vague = date.endswith("-01-01") & (F.substring(date, 1, 4) == F.substring(text(other), 1, 4)) & (text(other) != "")
    return F.when(vague, text(other)).otherwise(date)


def integer(c: Column) -> Column:
    """A bad number is 0."""
    return F.coalesce(F.trim(text(c)).try_cast("int"), F.lit(0))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(text(name), r"\.([A-Za-z0-9]{1,8})$", 1))


def file_stem(name: Column) -> Column:
    """Last part of a path without its last ending, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(text(name), "[^/]*$", 0), r"\.[^.]*$", ""))


def file_ending(name: Column) -> Column:
    """What stands after the last point of a path's last part, in lower case; any length."""
    return F.lower(F.regexp_extract(F.regexp_extract(text(name), "[^/]*$", 0), r"\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(text(name), r"\.[A-Za-z0-9]{1,8}$", "")


def human_bytes(n: Column) -> Column:
    """A size with its unit; no size is ''."""
    return (
        F.when(n.isNull(), "").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.1f", n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))
    )


def open_access(flag: Column, status: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)) | text(status).isin("ok", "partial"), "yes").when(text(status) == "", "unknown").otherwise("no")


def landing_url(doi: Column, pmid: Column, url: Column) -> Column:
    return F.when(text(doi) != "", F.concat(F.lit("https://doi.org/"), doi)).when(text(pmid) != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise(text(url))


# Types named in a record's publication types, first match.
NAMED_TYPES = ["dataset", "software", "book chapter", "conference paper", "thesis", "report"]


def resource_type(preprint: Column, category: Column, pub_types: Column, source_db: Column | None = None) -> Column:
    """preprint by flag, source or type, review by category, a named type, else article."""
    p = F.lower(text(pub_types))
    out = F.when(F.coalesce(preprint, F.lit(False)) | p.contains("preprint") | (text(source_db if source_db is not None else F.lit("")) == "PPR"), "preprint").when(category == "review", "review")
    for name in NAMED_TYPES:
        out = out.when(p.contains(name), name)
    return out.otherwise("article")


def venue(c: Column, prefixes: dict[str, str]) -> Column:
    """One spelling by prefix."""
    out = None
    for p, name in prefixes.items():
        test = F.lower(text(c)).startswith(p.lower())
        out = F.when(test, name) if out is None else out.when(test, name)
    return text(c) if out is None else out.otherwise(text(c))


def work_key(title: Column, where: Column, year: Column) -> Column:
    norm = lambda x: F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", "")
    return F.concat_ws("|", norm(title), norm(where), text(year))


def abstract_from_index(index: Column) -> Column:
    """Words from a map of word to positions, in order of position and word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def attachment_summary(ok: Column, total: Column, by_ext: Column) -> Column:
    """ok/total: ext n, ext n - by extension; by_ext is an array of (ext, n)."""
    order = F.array_sort(F.transform(by_ext, lambda e: F.struct(F.when(text(e["ext"]) == "", "?").otherwise(e["ext"]).alias("ext"), e["n"].alias("n"))))
    return F.concat(ok.cast("string"), F.lit("/"), total.cast("string"), F.when(F.size(order) > 0, F.concat(F.lit(": "), F.array_join(F.transform(order, lambda e: F.concat(e["ext"], F.lit(" "), e["n"].cast("string"))), ", "))).otherwise(""))


def attachment_total(summary: Column) -> Column:
    return F.coalesce(F.regexp_extract(text(summary), "^[0-9]+/([0-9]+)", 1).try_cast("int"), F.lit(0))


def attachment_exts(summary: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text(summary), "^[^:]*:? ?", ""), ", "), lambda x: x != ""), lambda x: F.lower(F.split(F.trim(x), " ")[0]))


def fulltext_sources(doi: Column, pmcid: Column, epmc_ids: Column, oa_pdf_url: Column) -> Column:
    """Where a copy can be asked for, in the order of trying."""
    d = F.lower(text(doi))
    preprint = F.coalesce(F.exists(epmc_ids, lambda e: e.startswith("PPR/")), F.lit(False))
    found = [(text(pmcid) != "", "pmc"), (d.startswith("10.1101/"), "biorxiv"), (preprint, "europepmc"), (d.startswith("10.48550/arxiv."), "arxiv"), (d != "", "unpaywall"), (text(oa_pdf_url) != "", "openalex")]
    return F.array_join(F.array_compact(F.array(*[F.when(test, name) for test, name in found])), ",")


def list_items(c: Column) -> Column:
    """Items of a '; ' list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def keyword_union(keywords: Column, mesh: Column) -> Column:
    """Keywords, then headings, each once."""
    return F.array_join(F.array_distinct(F.concat(list_items(keywords), list_items(mesh))), "; ")


SPAN = re.compile(r"^(\d+)([dwmy])$")


def parse_date(spec: str, end: bool = False, today: dt.date | None = None) -> str:
    """ISO date of a year, month, day, 'today' or a span back; end takes the last day of a year or month."""
    today = today or dt.date.today()
    s = (spec or "").strip().lower()
    if s == "today":
        return today.isoformat()
    if m := SPAN.match(s):
        n, unit = int(m[1]), m[2]
        if unit in "dw":
            return (today - dt.timedelta(days=n * (7 if unit == "w" else 1))).isoformat()
        months = today.year * 12 + today.month - 1 - n * (12 if unit == "y" else 1)
        y, mo = divmod(months, 12)
        return dt.date(y, mo + 1, min(today.day, calendar.monthrange(y, mo + 1)[1])).isoformat()
    try:
        if re.fullmatch(r"\d{4}", s):
            return f"{s}-12-31" if end else f"{s}-01-01"
        if re.fullmatch(r"\d{4}-\d{2}", s):
            y, mo = map(int, s.split("-"))
            return dt.date(y, mo, calendar.monthrange(y, mo)[1] if end else 1).isoformat()
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
            return dt.date.fromisoformat(s).isoformat()
    except (ValueError, calendar.IllegalMonthError):
        pass
    raise ValueError(f"not a date: {spec!r}")


def window(lo: str = "", hi: str = "", span: str = "", today: dt.date | None = None) -> tuple[str, str]:
    """Bounds of a filter: lo wins over span, and span counts back from hi where that is given."""
    today = today or dt.date.today()
    end = parse_date(hi, end=True, today=today) if hi else ""
    if lo:
        return parse_date(lo, today=today), end
    if not span:
        return "", end
    back = dt.date.fromisoformat(parse_date(span, today=today))
    return (back + ((dt.date.fromisoformat(end) - today) if end else dt.timedelta())).isoformat(), end
