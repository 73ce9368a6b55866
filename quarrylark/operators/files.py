"""Files of catalogue rows: listing, selection, and what copying, moving or deleting them changes.

Spark plans: the action itself is done by whoever holds the files, from `plan`; `settled` then marks the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators.catalogue import tokens, valid_regex

COLUMNS = ["uid", "title", "kind", "file", "ext", "bytes", "status", "path", "label", "caption", "url"]
KINDS = ["paper", "figure", "table", "supplementary"]
ATTACHMENTS = ["figure", "table", "supplementary"]


def listing(catalogue: DataFrame, papers: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row a file: full texts on disk (uid, file, ext, bytes, path) and attachments of the given rows."""
    rows = catalogue.select("uid", "title")
    full = papers.withColumns({"kind": F.lit("paper"), "status": F.lit("ok"), "label": F.lit(""), "caption": F.lit(""), "url": F.lit("")})
    parts = [rows.join(t, "uid").select(*[S.text(F.col(c)).alias(c) if c != "bytes" else S.text(F.col(c)).try_cast("long").alias(c) for c in COLUMNS]) for t in (full, attachments.filter(S.text(F.col("file")) != ""))]
    return parts[0].unionByName(parts[1])


def kinds(spec: str) -> list[str]:
    asked = [k for k in tokens(spec) if k]
    if bad := [k for k in asked if k not in (*KINDS, "attachment", "attachments")]:
        raise ValueError(f"kind must be paper, figure, table, supplementary or attachment, not {bad[0]}")
    wide = ATTACHMENTS if {"attachment", "attachments"} & set(asked) else []
    return list(dict.fromkeys([*(k for k in asked if k in KINDS), *wide]))


def pick(files: DataFrame, ext: str = "", name: str = "", kind: str = "", status: str = "ok") -> DataFrame:
    """Files by extension, by a pattern over name, label and caption, by kind and by status ('all' for every one)."""
    if exts := [e.lstrip(".") for e in tokens(ext) if e]:
        files = files.filter(F.lower("ext").isin(exts))
    if wanted := kinds(kind):
        files = files.filter(F.col("kind").isin(wanted))
    if "all" not in (states := [s for s in tokens(status) if s]):
        files = files.filter(F.col("status").isin(states))
    if name:
        files = files.filter(F.concat_ws(" ", "file", "label", "caption").rlike(valid_regex(name)))
    return files


def destination(base: str, flat: bool) -> Column:
    paper = S.slug(F.col("uid"))
    if flat:
        return F.concat(F.lit(base.rstrip("/") + "/"), paper, F.lit("__"), F.col("file"))
    return F.concat(F.lit(base.rstrip("/") + "/"), paper, F.when(F.col("kind") == "paper", "/").otherwise("/attachments/"), F.col("file"))


def plan(files: DataFrame, action: str, base: str = "", flat: bool = False, confirmed: bool = False) -> DataFrame:
    """uid, file, path, target of every file to copy, move or delete; two files of one target are an error, deletion wants confirmation."""
    if action not in ("copy", "move", "delete"):
        raise ValueError(f"no such action: {action}")
    if action == "delete":
        if not confirmed:
            raise ValueError("deleting wants confirmation")
        return files.select("uid", "file", "kind", "path", F.lit("").alias("target"))
    out = files.select("uid", "file", "kind", "path", destination(base, flat).alias("target")).distinct()
    twice = out.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    checked = out.join(twice, "target")
    return checked.select("uid", "file", "kind", "path", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two files go to "), "target"))).otherwise(F.col("target")).alias("target"))


def settled(attachments: DataFrame, done: DataFrame, action: str, where: str = "") -> DataFrame:
    """The attachments index after the action: moved and deleted files say so, with the new path or none, and aren't fetched again."""
    if action == "copy":
        return attachments
    status, reason = ("moved", f"moved to {where}") if action == "move" else ("deleted", "deleted")
    d = done.filter("kind <> 'paper'").groupBy("uid", "file").agg(F.max("target").alias("_t")).withColumn("_d", F.lit(True))
    j = attachments.join(d, ["uid", "file"], "left")
    new = {"status": F.lit(status), "reason": F.lit(reason), "path": S.text(F.col("_t"))}
    return j.select(*[F.when(F.col("_d"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in attachments.columns])


#: Full texts by file, the index's flag and the catalogue's column of each. Fixed values.
PAPER_FILES = {"paper.pdf": "pdf", "paper.md": "md", "paper.txt": "txt", "paper.jats.xml": "xml"}


def settled_index(index: DataFrame, attachments: DataFrame, done: DataFrame, action: str) -> DataFrame:
    """The full-text index after the action: flags of files that are gone, `removed` where none is left, attachments counted anew.

    attachments is the index of attachments after the action (settled()).
    """
    if action == "copy":
        return index
    gone = done.filter("kind = 'paper'").groupBy("uid").agg(F.collect_set("file").alias("_gone"))
    left = attachments.filter(S.text(F.col("file")) != "").groupBy("uid").agg(F.concat(F.count_if(F.col("status") == "ok").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("_left"))
    j = index.join(gone, "uid", "left").join(left, "uid", "left")
    there = lambda c: F.lower(S.text(F.col(c))) == "true"
    flags = {f"has_{k}": there(f"has_{k}") & ~F.coalesce(F.array_contains("_gone", file), F.lit(False)) for file, k in PAPER_FILES.items() if f"has_{k}" in index.columns}
    some = F.lit(False)
    for still in flags.values():
        some |= still
    removed = F.col("_gone").isNotNull() & ~some
    word = "moved" if action == "move" else "deleted"
    new = {c: F.when(v, "True").otherwise("False") for c, v in flags.items()}
    new |= {"status": F.when(removed, "removed").otherwise(F.col("status")), "reason": F.when(removed, word).otherwise(F.col("reason")), "attachments": F.coalesce("_left", "attachments")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in index.columns])


def settled_catalogue(catalogue: DataFrame, index: DataFrame, summaries: DataFrame, done: DataFrame, action: str) -> DataFrame:
    """Catalogue rows after the action: status of the index, paths of files that are gone, the summary of attachments (uid, attachments)."""
    if action == "copy":
        return catalogue
    gone = done.filter("kind = 'paper'").groupBy("uid").agg(F.collect_set("file").alias("_gone"))
    j = catalogue.join(index.select("uid", F.col("status").alias("_status")), "uid", "left").join(gone, "uid", "left").join(summaries.select("uid", F.col("attachments").alias("_files")), "uid", "left")
    new = {f"fulltext_{k}": F.when(F.array_contains("_gone", file), "").otherwise(F.col(f"fulltext_{k}")) for file, k in PAPER_FILES.items() if f"fulltext_{k}" in catalogue.columns}
    new |= {"fulltext_status": F.coalesce("_status", "fulltext_status"), "attachments": F.coalesce("_files", "attachments")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in catalogue.columns])


DOWNLOAD = "fulltext struct<status: string, reason: string, source: string, license: string, fetched_on: string, files: map<string, struct<url: string>>>"


def on_disk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What lies below a folder: folder and value (the text of its metadata.json), and folder and file of all files. No file but metadata.json is opened."""
    split = lambda c: (F.regexp_extract(c, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(c, "([^/]*)$", 1).alias("file"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*split(F.col("_metadata.file_path")))
    notes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(root, wholetext=True)
    return notes.select(split(F.col("_metadata.file_path"))[0], "value"), found


def complete(present: Column, formats: set[str]) -> Column:
    """Of the formats asked for, the plain ones (md, txt) have to be there; where none of these is asked for, all of them."""
    need = formats & {"md", "txt"} or formats
    return F.size(F.array_except(F.array(*[F.lit(x) for x in sorted(need)]), present)) == 0 if need else F.lit(True)


def from_disk(wanted: DataFrame, notes: DataFrame, found: DataFrame, today: str, formats: set[str] = frozenset(PAPER_FILES.values())) -> DataFrame:
    """Index rows of wanted (uid, folder) whose earlier download is whole: nothing of them is asked for again, even if the index was lost.

    Whole is a folder whose notes say ok, all of whose listed files lie there, and which has the formats asked for. Broken or
    missing notes are no download.
    """
    own = wanted.select("uid", "folder").join(notes.select("folder", F.from_json("value", DOWNLOAD)["fulltext"].alias("_f")), "folder").filter("_f.status = 'ok'")
    there = found.join(own.select("folder").distinct(), "folder", "left_semi").groupBy("folder").agg(F.collect_set("file").alias("_there"))  # the files of one folder
    j = own.join(there, "folder", "left").withColumn("_there", F.coalesce("_there", F.array().cast("array<string>")))
    have = {k: F.array_contains("_there", file) for file, k in PAPER_FILES.items()}
    listed = F.coalesce(F.map_keys("_f.files"), F.array().cast("array<string>"))
    whole = (F.size(F.array_except(listed, F.col("_there"))) == 0) & complete(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in have.items()])), set(formats))
    checked = F.substring(F.coalesce(F.nullif(S.text(F.col("_f.fetched_on")), F.lit("")), F.lit(today)), 1, 10)
    return j.filter(whole).select(
        "uid", F.col("_f.status").alias("status"), *[S.text(F.col(f"_f.{c}")).alias(c) for c in ("reason", "source", "license")], *[c.alias(f"has_{k}") for k, c in have.items()], F.lit("").alias("attachments"), "folder",
        S.text(F.try_element_at(F.col("_f.files"), F.lit("paper.pdf"))["url"]).alias("pdf_url"), checked.alias("checked_on"), F.lit("").alias("note"),
    )
