"""Catalogue operators: filters, resolution, merging, classification and incremental state.

All are functions of DataFrames. Orders carry a total tie-break, ordered aggregates use struct minima and maxima, lists
stay arrays until they are shown.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators.matching import literal_forms
from quarrylark.operators.ordering import running_number
from quarrylark.operators.texts import join_late

TIERS = {"landmark": 0, "core": 1, "related": 2}


# ---------------------------------------------------------------- filters


def valid_regex(pattern: str) -> str:
    """A bad pattern is an error before any row is read."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return f"(?iu){pattern}" if any(ch.isalpha() for ch in pattern) else pattern  # signs have no case


def occurs(c: Column, pattern: str) -> Column:
    """A pattern occurs in a text, in any case. One that is no more than signs is looked for as a string, without a regular expression."""
    regex = valid_regex(pattern)
    signs = literal_forms(re.sub(r"\[([^\]\\^])\]", lambda m: re.escape(m[1]), pattern)) if regex == pattern else None
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in signs]) if signs else c.rlike(regex)


def tokens(spec: str) -> list[str]:
    """A comma list in lower case; an empty token is kept, and matches everything in substring filters."""
    return [t.strip().lower() for t in spec.split(",")]


def in_window(date: Column, lo: str = "", hi: str = "") -> Column:
    """Undated rows count as before every lower bound."""
    d = F.when(S.text(date) == "", "0000").otherwise(S.text(date))
    out = F.lit(True)
    if lo:
        out &= d >= lo
    if hi:
        out &= d <= hi
    return out


def any_equal(c: Column, spec: str) -> Column:
    return F.lower(S.text(c)).isin(tokens(spec))


def any_part(c: Column, spec: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(S.text(c)).contains(t) for t in tokens(spec)])


def status_in(c: Column, spec: str) -> Column:
    """'-' stands for empty."""
    return F.lower(F.when(S.text(c) == "", "-").otherwise(S.text(c))).isin(tokens(spec))


def select(df: DataFrame, *, date_from="", date_to="", dois=None, uids=None, tier="", kind="", category="", modality="", entity="", species="", added_since="", has_fulltext=False, fulltext_status="", has_attachments=False, ext="", summary="", title="", text="", fulltext="", sort="", limit=0, summarise=None, texts="") -> DataFrame:
    """The combined filter: all given conditions hold, a comma list is any of its tokens. Cheap conditions stand first.

    What isn't in the rows is got late, for those that all other conditions left: summaries by summarise(rows), which gives them
    summary and keywords, and full texts from the folder texts (`texts.write_texts`, with a column fulltext).
    """
    lazy = bool(summary) and "summary" not in df.columns
    if lazy and summarise is None:
        raise ValueError("the rows have no summary, and there is nothing to make one")
    c, where = F.col, []
    if date_from or date_to:
        where.append(in_window(c("date"), date_from, date_to))
    # a short list is a condition, a table of any length a semi join
    if isinstance(dois, DataFrame):
        wanted = dois.select(S.normalise_doi(c(dois.columns[0])).alias("_doi")).filter("_doi <> ''").distinct()
        df = df.join(wanted, F.lower(c("doi")) == c("_doi"), "left_semi")
    elif dois is not None:
        where.append((S.text(c("doi")) != "") & F.lower(c("doi")).isin(*[S.normalise_doi(F.lit(d)) for d in dois]))
    if isinstance(uids, DataFrame):
        df = df.join(uids.select(c(uids.columns[0]).alias("_uid")).distinct(), c("uid") == c("_uid"), "left_semi")
    elif uids is not None:
        where.append(c("uid").isin(list(uids)))
    where += [any_equal(c(n), v) for n, v in (("tier", tier), ("resource_type", kind), ("category", category)) if v]
    where += [any_part(c(n), v) for n, v in (("modality", modality), ("entities" if "entities" in df.columns else "clocks", entity), ("species", species)) if v]
    if added_since:
        where.append(S.text(c("added_on")) >= added_since)  # as text, whatever it is
    if has_fulltext:
        where.append(S.text(c("fulltext_md")) != "")
    if fulltext_status:
        where.append(status_in(c("fulltext_status"), fulltext_status))
    if has_attachments:
        where.append(S.attachment_total(c("attachments")) > 0)
    if ext:
        where.append(F.arrays_overlap(S.attachment_exts(c("attachments")), F.array(*[F.lit(t.lstrip(".")) for t in tokens(ext)])))
    in_summary = F.concat_ws(" ", S.text(c("summary")), S.text(c("keywords"))).rlike(valid_regex(summary)) if summary else None
    if summary and not lazy:
        where.append(in_summary)
    if title:
        where.append(c("title").rlike(valid_regex(title)))
    if text:
        where.append(F.concat_ws(" ", *[S.text(c(n)) for n in ("title", "entities", "venue", "matched_groups", "details") if n in df.columns]).rlike(valid_regex(text)))
    paths = [S.text(c(n)) != "" for n in ("fulltext_md", "fulltext_txt") if n in df.columns]
    if fulltext and texts and paths:
        where.append(reduce(lambda a, b: a | b, paths))
    out = reduce(lambda d, w: d.where(w), where, df)
    if lazy:
        out = summarise(out).where(in_summary)
    if fulltext:
        out = join_late(out, texts) if texts else out
        out = out.where(S.text(c("fulltext")).rlike(valid_regex(fulltext))).withColumn("context", context(c("fulltext"), fulltext)).drop("fulltext")
    if sort:
        if sort not in ("date", "title", "author", "cited_by"):
            raise ValueError("sort must be date, cited_by, title or author")
        text_key = lambda: [S.author_key(c("authors"), c("title"))] if sort == "author" else [S.text(c(sort))]
        order = [S.integer(c("cited_by")).desc()] if sort == "cited_by" else text_key()
    else:
        order = []
    order += [c("ord")] if "ord" in df.columns else [c("uid")]
    if limit < 0:  # all but the last ones
        placed = running_number(out, order, "_place")
        last = placed.agg(F.max("_place")).first()[0] or 0  # of a written table
        return placed.filter(c("_place") <= last + limit).orderBy("_place").drop("_place")
    out = out.orderBy(*order) if sort else out
    return out.limit(limit) if limit else out


def context(c: Column, pattern: str, width: int = 80) -> Column:
    """The first match of a pattern with width characters before and after it, white space squeezed."""
    at, hit = F.regexp_instr(c, F.lit(valid_regex(pattern))), F.regexp_extract(c, valid_regex(pattern), 0)
    first = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, S.collapse(F.substring(c, first, at + F.length(hit) + width - first)))


# ---------------------------------------------------------------- resolution and merging


def resolve_aliases(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """records (uid, keys array in order) against aliases (alias, target): the first key that is known gives the uid."""
    hit = records.select("uid", F.posexplode("keys").alias("rank", "alias")).join(aliases, "alias")
    hit = hit.groupBy("uid").agg(F.min(F.struct("rank", "target"))["target"].alias("target"))
    return records.join(hit, "uid", "left").withColumn("resolved", F.coalesce("target", "uid")).drop("target")


def unknown(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """records (uid, keys array) none of whose keys is an alias of a known record."""
    known = records.select("uid", F.explode("keys").alias("alias")).join(aliases.select("alias"), "alias", "left_semi")
    return records.join(known.select("uid").distinct(), "uid", "left_anti")


def id_union(parts: list[DataFrame]) -> DataFrame:
    """Ids of all pieces of a split search, each once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def merge_fields(rows: DataFrame, key: str, seq: str, lists=(), largest=(), newest=(), oldest=()) -> DataFrame:
    """Field-level merge of all rows of a key in order of seq: lists unite and sort, largest wins, newest and oldest take the last and first that isn't empty.

    List items are made distinct by (key, item) before they meet, so a key of many rows is no more than its items.
    """
    full = lambda x: F.when(S.text(F.col(x)) != "", F.struct(F.col(seq), F.col(x)))
    aggs = [F.max(x).alias(x) for x in largest]
    aggs += [F.max(full(x))[x].alias(x) for x in newest]
    aggs += [F.min(full(x))[x].alias(x) for x in oldest]
    out = rows.groupBy(key).agg(*aggs) if aggs else rows.select(key).distinct()
    for x in lists:
        items = rows.select(key, F.explode(x).alias(x)).distinct().groupBy(key).agg(F.array_sort(F.collect_list(x)).alias(f"_{x}"))
        out = out.join(items, key, "left").withColumn(x, F.coalesce(f"_{x}", F.array().cast(rows.schema[x].dataType))).drop(f"_{x}")
    return out


def merge_hits(hits: DataFrame) -> DataFrame:
    """First and last sight of (uid, group, source); where hits have a scope, the scope of the first."""
    g = hits.groupBy("uid", "group", "source")
    seen = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    if "scope" not in hits.columns:
        return g.agg(*seen)
    return g.agg(*seen, F.min(F.struct("first_seen", "scope"))["scope"].alias("scope"))


def new_works(works: DataFrame, stored: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Works (uid, work_key) whose work isn't stored, one of each; and credited hits: uid, as_uid, of other versions of a work,
    which count for the stored one or else for the first in order."""
    first = works.groupBy("work_key").agg(F.min(F.struct(*[o for o in order if o != "uid"], "uid"))["uid"].alias("_first"))
    known = stored.groupBy("work_key").agg(F.min("uid").alias("_stored"))
    j = works.join(first, "work_key").join(known, "work_key", "left").withColumn("as_uid", F.coalesce("_stored", "_first"))
    fresh = j.filter("_stored IS NULL AND uid = _first").select(works.columns)
    return fresh, j.filter("uid <> as_uid").select("uid", "as_uid")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def union_priority(parts: list[DataFrame], key: str = "uid") -> DataFrame:
    """Later parts replace equal keys of earlier ones."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    return keep_first(rows, [key], [F.desc("_p")]).drop("_p")


def carry_over(old: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


# ---------------------------------------------------------------- classification


def first_match(c: Column, rules: dict[str, str], default: str) -> Column:
    out = None
    for name, pattern in rules.items():
        test = occurs(c, pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def all_matches(c: Column, rules: dict[str, str], first: str = "", also: Column | None = None) -> Column:
    """Names in the order of the rules; the name `first`, also given by another test, comes first."""
    names = [F.when(occurs(c, p), F.lit(n)) for n, p in rules.items() if n != first]
    if first:
        test = occurs(c, rules[first]) | (also if also is not None else F.lit(False))
        names.insert(0, F.when(test, F.lit(first)))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def word_bound(pattern: str) -> str:
    """A pattern standing alone; it tells cases apart unless it starts with (?i)."""
    loose = pattern.startswith("(?i)")
    out = rf"(?<![\w-])(?:{pattern[4:] if loose else pattern})(?![\w-])"
    try:
        re.compile(out)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return f"(?iU){out}" if loose else f"(?U){out}"


def entities(c: Column, rules: dict[str, str]) -> Column:
    """Names whose bounded pattern occurs, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(c.rlike(word_bound(p)), F.lit(n)) for n, p in rules.items()]).cast("array<string>"))


def by_frequency(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a column of a vocabulary, the most frequent first; one aggregated row a value comes to the driver."""
    return [r[0] for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).collect()]


def category(rules: list[dict[str, str]], pub_types: Column, title: Column, text: Column, default: str, origin: Column | None = None, origin_name: str = "method development") -> Column:
    """The first rule any of whose patterns (pub_types, title, text) occurs in its field; an origin paper has its own category."""
    fields = {"pub_types": pub_types, "title": title, "text": text}
    out = F.when(origin if origin is not None else F.lit(False), origin_name)
    for rule in rules:
        tests = [S.text(fields[f]).rlike(valid_regex(rule[f])) for f in fields if rule.get(f)]
        if tests:
            out = out.when(reduce(lambda a, b: a | b, tests), rule["name"])
    return out.otherwise(default)


def tier(landmark: Column, focused: Column, core: Column, seed: Column) -> Column:
    return F.when(landmark, "landmark").when(focused & core, "core").when(focused, "related").when(seed & core, "related").otherwise("none")


def tier_of(landmark: Column, focused: Column, core_title: Column, core_category: Column, seed: Column) -> Column:
    """landmark, core, related or empty: a seed alone counts only by its title."""
    return F.when(landmark, "landmark").when(focused & (core_title | core_category), "core").when(focused, "related").when(seed & core_title, "related").otherwise("")


def route(tier_: Column, date: Column, start: str, seed: Column, broad: Column) -> Column:
    return F.when(tier_.isin("landmark", "core", "related") & ((S.text(date) == "") | (date >= start)), "catalogue").when(tier_ != "none", "before_window").when(seed, "off_topic_seed").when(broad, "broad").otherwise("dropped")


def catalogue_keys() -> list[Column]:
    """Date (undated last), tier, title, uid."""
    d = F.when(S.text(F.col("date")) == "", "9999").otherwise(F.col("date"))
    t = F.coalesce(*[F.when(F.col("tier") == n, F.lit(i)) for n, i in TIERS.items()], F.lit(9))
    return [d, t, F.lower("title"), F.col("uid")]


def catalogue_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*catalogue_keys())


# ---------------------------------------------------------------- incremental state


def merge_catalogue(old: DataFrame, new: DataFrame, today: str, kept=("added_on", "notes", "user_tags"), flag: str = "not matched in the last run") -> DataFrame:
    """New uids get today's added_on; known ones keep the hand-written columns; missing ones stay and are flagged."""
    columns = [c for c in old.columns if c != "uid"]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.uid") == F.col("n.uid"), "full_outer")
    there, was = F.col("n.uid").isNotNull(), F.col("o.uid").isNotNull()
    out = [F.coalesce("n.uid", "o.uid").alias("uid")]
    for c in columns:
        fresh = F.col(f"n.{c}") if c in new.columns else F.lit("")
        if c == "added_on":
            e = F.when(was, F.col("o.added_on")).otherwise(today)
        elif c in kept:
            e = F.when(was, F.col(f"o.{c}")).otherwise(S.text(fresh))
        elif c == "status":
            e = F.when(there, S.text(fresh)).otherwise(flag)
        else:
            e = F.when(there, fresh).otherwise(F.col(f"o.{c}"))
        out.append(e.alias(c))
    return both.select(out)


def due(checked: Column, status: Column, today: str, days: int = 30, never=("removed", "ok")) -> Column:
    """To be tried again: not settled and not checked within the days."""
    return ~S.text(status).isin(*never) & ((S.text(checked) == "") | (checked < F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")))
