"""Rules of the driver, which read no table: what they give for typed inputs."""

import datetime as dt

import pytest

from quarrylark.functions import flags as G
from quarrylark.functions import scalars as S
from quarrylark.functions import terms as T
from quarrylark.operators import citations as R
from quarrylark.operators import scope as U
from quarrylark.sources import config as Y
from quarrylark.sources import io, search
from quarrylark.sources.search import Busy, GivenUp, Pace, patient

CASES = {}


def typed(name, rows, columns, made):
    """What `made()` gives, against typed rows of these columns."""
    CASES[name] = rows, made


def attempt(f):
    """f(), or 'error' where it refuses its input."""
    try:
        return f()
    except ValueError:
        return "error"


def waits():
    """What the patient client does with four services: the waits, and how it ends."""
    def tell(times, seconds):
        left, slept = [times], []

        def call():
            if left[0]:
                left[0] -= 1
                raise Busy(seconds)
            return "done"

        try:
            end = patient(call, sleep=lambda s: slept.append(float(s)))
        except GivenUp:
            end = "given up"
        return " ".join([*map(str, slept), end])

    return [("busy 3 times", tell(3, None)), ("asked for 30 s", tell(1, 30.0)), ("asked for 700 s", tell(1, 700.0)), ("always busy", tell(99, None))]


def paced():
    """Seconds that requests wait for their host, by a clock of half seconds."""
    now = [0.0]
    pace = Pace(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    out = []
    for host, step in (("a", 0.0), ("b", 0.5), ("a", 0.0), ("a", 0.0), ("b", 0.5)):
        now[0] += step
        out.append((host, pace.wait(host)))
    return out


typed("topic_parse", [('a b, "c d" & e', "a+b|c d+e"), ("graph neural networks OR GNN", "graph+neural+networks|GNN"), ("dup, dup", "dup"), ("", "")], "topic string, terms string",
      lambda: [(t, "|".join("+".join(x) for x in T.parse_topic(t))) for t in ('a b, "c d" & e', "graph neural networks OR GNN", "dup, dup", "")])
typed("topic_syntax", [("pubmed", '("CRISPR"[tiab] AND "base editing"[tiab])'), ("europepmc", '(TITLE_ABS:"CRISPR" AND TITLE_ABS:"base editing")'), ("arxiv", '((ti:"CRISPR" OR abs:"CRISPR") AND (ti:"base editing" OR abs:"base editing"))'), ("openalex", '(CRISPR AND "base editing")'), ("github", '"CRISPR" "base editing"')],
      "source string, query string", lambda: [(s, T.compiled(("CRISPR", "base editing"), s)) for s in T.SYNTAX])
typed("group_query", [("europepmc", '(TITLE_ABS:"a" OR (TITLE_ABS:"b" AND TITLE_ABS:"c d")) AND (TITLE_ABS:"human")')], "source string, query string",
      lambda: [("europepmc", T.group_query(T.parse_topic('a, b & "c d"'), T.parse_topic("human"), "europepmc"))])
typed("date_spec", [("2024", "2024-12-31"), ("2024-02", "2024-02-29"), ("2024-03-15", "2024-03-15"), ("2w", "2024-03-17"), ("1m", "2024-02-29"), ("1y", "2023-03-31"), ("today", "2024-03-31"), ("2024-13", "error"), ("5x", "error")],
      "spec string, day string", lambda: [(s, attempt(lambda s=s: S.parse_date(s, end=True, today=dt.date(2024, 3, 31)))) for s in ("2024", "2024-02", "2024-03-15", "2w", "1m", "1y", "today", "2024-13", "5x")])
typed("flag_grammar", [("--limit=5 --out x.csv --dry-run", "5 x.csv True"), ("--out=a", "50 a False"), ("--limit abc", "error"), ("--bogus", "error"), ("stray", "error"), ("--out", "error"), ("--dry-run=false", "50  False")],
      "line string, got string", lambda: [(x, attempt(lambda x=x: " ".join(str(v) for v in G.parse(x.split(), {"limit": (50, int), "out": ("", str), "dry-run": (False, bool)}).values()))) for x in ("--limit=5 --out x.csv --dry-run", "--out=a", "--limit abc", "--bogus", "stray", "--out", "--dry-run=false")])
typed("format_codes", [("apa, bibtex,APA", "APA,BIB"), ("json,ieee", "CSL,IEE"), ("XYZ", "error")], "spec string, codes string", lambda: [(s, attempt(lambda s=s: ",".join(R.codes(s)))) for s in ("apa, bibtex,APA", "json,ieee", "XYZ")])
typed("window_split", [("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-04")], "lo string, hi string", lambda: search.split_window(lambda lo, hi: 4 * ((dt.date.fromisoformat(hi) - dt.date.fromisoformat(lo)).days + 1) if lo < "2024-01-03" else 3, "2024-01-01", "2024-01-04", 6))
typed("resume_offset", [("2024-03-15", "2024-03-01"), ("2024-01-05", "2024-01-01"), ("", "2024-01-01")], "last string, start string", lambda: [(x, search.resume_from(x, "2024-01-01")) for x in ("2024-03-15", "2024-01-05", "")])
typed("window_extend", [("2005-01-01", "2005-01-01"), ("2015-01-01", "2011-01-01"), ("", "2011-01-01")], "asked string, start string", lambda: [(x, U.earlier_start("2011-01-01", x)) for x in ("2005-01-01", "2015-01-01", "")])
typed("vocabulary_expand", [("all", "landmark,core,related"), ("main,related", "landmark,core,related"), ("core,core", "core"), ("nope", "error")], "spec string, names string",
      lambda: [(s, attempt(lambda s=s: ",".join(U.expand(s, ["landmark", "core", "related"], {"main": ["landmark", "core"]})))) for s in ("all", "main,related", "core,core", "nope")])
typed("back_off", [("busy 3 times", "2.0 4.0 8.0 done"), ("asked for 30 s", "30.0 done"), ("asked for 700 s", "given up"), ("always busy", "2.0 4.0 8.0 16.0 32.0 given up")], "service string, waits string", lambda: waits())
typed("csv_bytes", [("a,b,c\r\nplain,\"x,y\",\"say \"\"hi\"\"\"\r\n",)], "text string", lambda: [(io.csv_text(["a", "b", "c"], [{"a": "plain", "b": "x,y", "c": 'say "hi"', "z": 1}]),)])
typed("json_stats", [('{\n  "rows": 3,\n  "é": null\n}',)], "text string", lambda: [(io.stats_json({"rows": 3, "é": None}),)])
typed("markdown_cells", [("| a | b |\n| --- | --- |\n| x\\|y | l1 l2 |\n",)], "text string", lambda: [(io.markdown_table(["a", "b"], [("x|y", "l1\nl2")]),)])
typed("host_pace", [("a", 0.0), ("b", 0.0), ("a", 1.5), ("a", 2.0), ("b", 0.0)], "host string, slept double", lambda: paced())


@pytest.mark.parametrize("name", CASES)
def test_rule(name):
    rows, made = CASES[name]
    assert made() == rows


def test_registry_seeds(spark, tmp_path):
    where = f"file://{tmp_path}/clocks.json"
    io.write_text(spark, where, '{"entries": {"one": {"doi": "https://doi.org/10.1234/A", "year": 2013}, "two": {"doi": "10.1234/b"}, "three": {"name": "no doi"}}}')
    got = Y.registry_seeds(spark, Y.document(spark, where), "repo", "clocks").select("doi", "registry_id", "registry_year", "role")
    assert sorted(map(tuple, got.collect())) == [("10.1234/a", "one", "2013", "registry_origin"), ("10.1234/b", "two", "", "registry_origin")]
