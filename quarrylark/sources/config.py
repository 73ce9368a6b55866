"""Configuration, rule sets and registries in files, and selections that a caller names by file.

YAML needs the yaml package; where it isn't installed, JSON of the same shape is read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.sources.io import exists, read_csv

# Parts of a configuration.
SECTIONS = ["search", "classify", "repos", "websites"]


def document(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON document of any file system; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no configuration at {path}")
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise RuntimeError(f"{path} needs the yaml package; JSON of the same shape is read without it") from None
    return yaml.safe_load(text) or {}


def section(config: dict, name: str) -> dict:
    if name not in config:
        raise KeyError(f"section {name!r} is missing from the configuration")
    return config[name] or {}


def rules(config: dict) -> dict:
    """The `classify` section as the rules of `assembly.catalogue_rows`; older names of parts are taken too."""
    c = section(config, "classify")
    return {
        "category": [r for r in c.get("category", c.get("categories", []))], "default": c.get("default_category", "application/association"),
        "modality": c.get("modality", {}) or {}, "species": c.get("species", {}) or {}, "entities": c.get("entities", c.get("clock_names", {})) or {}, "core_title": c.get("core_title", ""),
        "landmark_roles": c.get("landmark_roles", []), "venues": c.get("venues", {}) or {},
    }


def resolve(spark: SparkSession, name: str, catalogue: str) -> str:
    """A file as it is named, else in the catalogue's folder, else in its exports."""
    for path in (name, f"{catalogue.rstrip('/')}/{name}", f"{catalogue.rstrip('/')}/exports/{name}"):
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"cannot find {name}")


def input_table(spark: SparkSession, name: str, catalogue: str) -> DataFrame:
    """A user's CSV, or the catalogue's own table where no name is given; all text."""
    return read_csv(spark, resolve(spark, name, catalogue) if name else f"{catalogue.rstrip('/')}/progress.csv")


def values(spark: SparkSession, spec: str, name: str = "value") -> DataFrame:
    """One column of a comma list, or of a file's lines where the list is @file; trimmed, without empty ones."""
    if not spec.startswith("@"):
        items = [(x.strip(),) for x in spec.split(",") if x.strip()]
        return spark.createDataFrame(items, f"{name} string")
    if not exists(spark, spec[1:]):
        raise FileNotFoundError(f"cannot read {spec[1:]}")
    return spark.read.text(spec[1:]).select(F.trim("value").alias(name)).filter(F.col(name) != "")


def selected(df: DataFrame, column: str | Column, wanted: DataFrame) -> DataFrame:
    """Rows whose column is in a list of any length: a semi join, broadcast only as the optimiser's size estimate allows."""
    c = F.col(column) if isinstance(column, str) else column
    w = wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()
    return df.join(w, c == F.col("_wanted"), "left_semi")


# ---------------------------------------------------------------- seeds of local projects


def manifest_seeds(rows: DataFrame, repo: str, file: str, role: str, topics: str = "") -> DataFrame:
    """Seeds of a literature manifest (doi, topic, title, question): a methods reference off the topics has a role of its own."""
    c = lambda n: S.text(F.col(n)) if n in rows.columns else F.lit("")
    own = F.lit(role)
    if role == "methods_reference" and topics:
        own = F.when(c("topic").rlike(topics), role).otherwise("methods_other")
    context = F.concat(F.lit("["), c("topic"), F.lit("] "), c("title"), F.when(c("question") != "", F.concat(F.lit(" | "), c("question"))).otherwise(""))
    out = rows.select(S.normalise_doi(c("doi")).alias("doi"), own.alias("role"), F.lit(repo).alias("source_repo"), F.lit(file).alias("source_file"), context.alias("context"))
    return out.filter("doi <> ''")


def registry_seeds(spark: SparkSession, config: dict, repo: str, file: str) -> DataFrame:
    """Seeds of a registry document: the origin paper of each entry. A registry is one document, read on the driver."""
    rows = [(as_text(e.get("doi")), key, as_text(e.get("year")), as_text(e.get("data_type")), as_text(e.get("species")), as_text(e.get("citation"))) for group in config.values() if isinstance(group, dict) for key, e in group.items() if isinstance(e, dict)]
    df = spark.createDataFrame(rows, "doi string, registry_id string, registry_year string, data_type string, species string, context string")
    return df.withColumns({"doi": S.normalise_doi(F.col("doi")), "role": F.lit("registry_origin"), "source_repo": F.lit(repo), "source_file": F.lit(file)}).filter("doi <> ''")


def as_text(x) -> str:
    return "" if x is None else str(x)


def unique_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds once for (doi, role, file, registry id); of equal ones the smallest context stays."""
    keys = ["doi", "role", "source_file", "registry_id"]
    return seeds.groupBy(*keys).agg(F.min("context").alias("context"))
