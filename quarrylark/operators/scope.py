"""What an update works on, in which order, and from when."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators.catalogue import TIERS, in_window
from quarrylark.operators.overview import PAPERS


def expand(spec: str, vocabulary: list[str], groups: dict[str, list[str]] | None = None, what: str = "name") -> list[str]:
    """Names of a comma list, each once in order: 'all' is the vocabulary, a group its members, others must be in it."""
    out: dict[str, None] = {}
    for token in filter(None, (t.strip().lower() for t in spec.split(","))):
        members = vocabulary if token == "all" else (groups or {}).get(token, [token])
        if unknown := [m for m in members if m not in vocabulary]:
            raise ValueError(f"unknown {what} {token!r}: {unknown[0]!r} is none of {', '.join(vocabulary)}")
        out |= dict.fromkeys(members)
    return list(out)


def scoped(catalogue: DataFrame, tiers: str = "landmark,core,related", types: str = ",".join(PAPERS), uids: DataFrame | None = None, date_from: str = "", date_to: str = "") -> DataFrame:
    """Papers that a download run works on: of the tiers and types, of a uid list where there is one, of a window."""
    wanted = [t.strip() for t in types.split(",") if t.strip() in PAPERS]
    rows = catalogue.filter(F.col("resource_type").isin(wanted) & F.col("tier").isin(tiers.split(",")) & in_window(F.col("date"), date_from, date_to))
    return rows if uids is None else rows.join(uids.select("uid").distinct(), "uid", "left_semi")


def priority(tier: Column | None = None, cited_by: Column | None = None) -> list[Column]:
    """Sort keys of downloads: landmark, core, related, others; the most cited first."""
    t = F.col("tier") if tier is None else tier
    rank = F.coalesce(*[F.when(t == name, F.lit(i)) for name, i in TIERS.items()], F.lit(9))
    return [rank, S.integer(F.col("cited_by") if cited_by is None else cited_by).desc()]


def earlier_start(current: str, asked: str) -> str:
    """Where a catalogue begins after a run that asked for older work: its start only moves back."""
    return asked if asked and asked < current else current


def again(status: Column, checked: Column, today: str, days: int = 30) -> Column:
    """A paper's full text is to be tried again: after an error, in part or put off at once, without a copy after some days;
    what is there or was removed never."""
    old = checked < F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    return S.text(status).isin("partial", "deferred", "error", "") | ((status == "none") & old)


def missing(wanted: Column, there: Column) -> Column:
    """Members of a list that another one lacks."""
    return F.array_except(wanted, there)


def tried_sources(text: Column, known: Iterable[str]) -> Column:
    """Members of a comma list that are known, sorted."""
    return F.array_sort(F.array_intersect(F.transform(F.split(S.text(text), ","), F.trim), F.array(*[F.lit(k) for k in known])))
