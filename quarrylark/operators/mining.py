"""Text mining: links, page heads, reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.functions.markup import attribute, resolve, tags

LINK = r"https?://[^\s<>\"'\)\]\}]+"


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, url of links in text; closing marks trimmed, at least 12 characters."""
    got = df.select(key, F.posexplode(F.regexp_extract_all(S.text(F.col(text)), F.lit(LINK), 0)).alias("pos", "url"))
    return got.withColumn("url", F.regexp_replace("url", r"[.,;:!?]+$", "")).filter(F.length("url") >= 12)


def before_references(c: Column) -> Column:
    """Text before the first heading of the reference list: a Markdown heading that begins with References, or a line that is it."""
    return F.split(S.text(c), r"(?m)^(?:#+\s*References\b|(?:References|REFERENCES)\s*$)", 2)[0]


def hrefs(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, pos, url of anchors, root-relative ones resolved against the page."""
    root = F.regexp_extract(F.col(url), "^([a-z]+://[^/?#]+)", 1)
    got = pages.select(key, root.alias("root"), F.posexplode(F.regexp_extract_all(S.text(F.col(html)), F.lit(r'href="([^"]+)"'), 1)).alias("pos", "href"))
    return got.select(key, "pos", F.when(F.col("href").startswith("/"), F.concat("root", "href")).otherwise(F.col("href")).alias("url"))


#: Characters of a title or a description.
HEAD_MAX = 300


def _head(raw: Column) -> Column:
    return F.substring(S.collapse(resolve(raw)), 1, HEAD_MAX)


def page_title(html: Column) -> Column:
    """Text of the first title element, character references resolved, blanks collapsed."""
    return _head(F.regexp_extract(S.text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_description(html: Column) -> Column:
    """Content of the first meta element that is named description, else of the first whose property is og:description.

    Attributes may stand in any order, in either quotes or none.
    """
    metas = tags(S.text(html), "meta")
    first = lambda key, value: F.try_element_at(F.filter(metas, lambda t: F.lower(F.trim(attribute(t, key))) == value), F.lit(1))
    return _head(S.text(attribute(F.coalesce(first("name", "description"), first("property", "og:description")), "content")))


def body_size(spans: DataFrame, key: str) -> DataFrame:
    """size of a document's body font: that of most bytes of text, of equals the smaller. spans: key, size, text."""
    weights = spans.groupBy(key, "size").agg(F.sum(F.octet_length(S.text(F.col("text")))).alias("w"))
    return weights.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("m"), "size"))["size"].alias("size"))
