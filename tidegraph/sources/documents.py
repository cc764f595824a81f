"""Markdown documents with front matter, and manifests of sources, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.text import slugify, strip, yaml_value
from ..plans.tables import in_order

ship(__name__)

# The manifest's columns, in order.
MANIFEST = ("doc_id", "file_path", "title", "source_url", "retrieved_at", "document_version", "license_or_permission")
LEAST_CHARS = 80
TEXT_KINDS = ("text/html", "text/plain")


def parse_markdown(raw: DataFrame) -> DataFrame:
    """raw (file, value): (id, content, metadata, ord). The last of repeated keys wins; the id is doc_id, else the file's stem.

    A file that does not begin with front matter is all content, without metadata.
    """
    whole = F.split("value", "---", 3)
    cut = F.when((F.size(whole) == 3) & (strip(whole[0]) == ""), whole).otherwise(F.array(F.lit(""), F.lit(""), F.col("value")))
    line = r'(?md)^(\w+): (".*")$'
    keys, values = (F.regexp_extract_all(cut[1], F.lit(line.replace(r"\w", r"[\p{L}\p{N}_]")), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.from_json(F.concat(F.lit('{"v": '), v, F.lit("}")), "struct<v:string>")["v"])
    pairs = F.arrays_zip(keys.alias("k"), plain.alias("v"))
    latest = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.md$", "")
    out = raw.withColumn("metadata", F.map_from_entries(latest))
    out = out.select("file", F.coalesce(F.element_at("metadata", "doc_id"), stem).alias("id"), strip(cut[2]).alias("content"), "metadata")
    return in_order(out, "file", "ord").drop("file")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return parse_markdown(spark.read.text(f"{folder}/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def load_corpus(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All folders with their name as `kb`; an empty one is an error."""
    out = None
    for kb, folder in folders.items():
        docs = read_markdown(spark, folder).withColumn("kb", F.lit(kb))
        if docs.isEmpty():
            raise ValueError(f"no documents in {folder}")
        out = docs if out is None else out.unionByName(docs)
    return out


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, type string, question string, gold string, must_include array<string>").option("multiLine", True).json(path)


def markdown(title: str = "title", body: str = "body", meta: tuple[str, ...] = ("doc_id", "title")) -> "Column":  # noqa: F821
    """A document's file: front matter, heading, body."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_value(F.coalesce(F.col(k), F.lit("")))) for k in meta]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n# "), F.col(title), F.lit("\n\n"), strip(body), F.lit("\n"))


def write_markdown(docs: DataFrame, folder: str, **parts) -> int:
    """One file `<doc_id>.md` in folder (a path or URI) for each row, written where the rows lie; the number of files.

    Ids are made safe for file names; a later attempt of a task writes the same file again. Ids must differ.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{top}/{name}.md") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    name = F.regexp_replace(F.col("doc_id").cast("string"), r"[^\p{L}\p{N}._-]+", "-").alias("name")
    return docs.select(name, markdown(**parts).alias("value")).mapInArrow(put, "name string").count()


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest after new rows came: they replace those of their doc_id."""
    both = manifest(old).withColumn("_o", F.lit(0)).unionByName(manifest(new).withColumn("_o", F.lit(1)))
    return manifest(latest(both, "_o"))


def content_gate(docs: DataFrame, content: str = "content", kind: str | None = None) -> DataFrame:
    """Documents whose extracted content has at least LEAST_CHARS characters and, if kind names a column, whose type is a text page."""
    out = docs.filter(F.length(strip(F.coalesce(F.col(content), F.lit("")))) >= LEAST_CHARS)
    return out if kind is None else out.filter(F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))).isin(*TEXT_KINDS))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows by doc_id: the last wins, blank ids go."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_o", F.monotonically_increasing_id())
    return latest(raw, "_o")


def latest(rows: DataFrame, order: str) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("doc_id", order)]
    out = rows.filter("doc_id is not null and doc_id != ''").groupBy("doc_id").agg(F.max_by(F.struct(*keep), order).alias("r"))
    return out.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in keep])


def manifest(rows: DataFrame) -> DataFrame:
    """The fixed columns, empty where missing, by doc_id."""
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in MANIFEST]).orderBy("doc_id")


def write_manifest(rows: DataFrame, path: str) -> None:
    manifest(rows).coalesce(1).write.csv(path, header=True, escape='"')


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    names = {c: c.strip() for c in raw.columns}
    if "url" not in names.values():
        raise ValueError("the header has no column url")
    out = raw.select(*[strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in names.items()])
    return out.filter("url != ''")


#: Columns of a row that its metadata names itself, or leaves to the manifest.
_OWN = ("url", "doc_id", "title", "document_version", "license_or_permission")


def page_metadata(pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """pages (url, title and any of doc_id, document_version): doc_id from the row, else the URL's last part, else the title; title from
    the row, else the id in title case; document_version, else not-stated; `extra`, the values of columns so named that are not empty
    and whose names are lower-case words."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), "/"), -1), r"\.[^.]*$", "")
    given = lambda c: F.nullif(strip(c), F.lit("")) if c in pages.columns else F.lit(None).cast("string")
    title = given("title")
    out = pages.withColumn("doc_id", slugify(F.coalesce(given("doc_id"), F.nullif(stem, F.lit("")), title, F.lit(""))))
    out = out.withColumn("title", F.coalesce(title, F.initcap(F.replace("doc_id", F.lit("-"), F.lit(" "))))).withColumn("document_version", F.coalesce(given("document_version"), F.lit("not-stated")))
    names = [c for c in extra if c not in _OWN and re.fullmatch("[a-z][a-z0-9_]*", c)]
    pairs = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))]) if names else F.create_map().cast("map<string,string>")
    return out.withColumn("extra", F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "")))


def licence(kb: str = "kb") -> "Column":  # noqa: F821
    return F.when(F.col(kb) == "law", "public-domain-legal-text").otherwise("public-news-excerpt-for-education")
