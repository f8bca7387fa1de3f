"""Sources: chunk files, pages, manifests, documents in folders."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions import text

SUFFIXES = {"pdf": ("pdf",), "docx": ("docx",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "text": ("txt", "md")}


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines without blank lines and byte-order marks; a bad line fails with its file and text, rows that are no objects go."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    filled = lines.filter(F.trim("line") != "")
    parsed = filled.withColumn("kind", F.expr("try_parse_json(line)"))
    checked = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("bad JSON in "), F.col("file"), F.lit(": "), F.substring("line", 1, 80)))).otherwise(F.col("line"))
    objects = parsed.filter(F.col("kind").isNull() | F.ltrim("line").startswith("{")).select(F.from_json(checked, schema).alias("r"))
    return objects.select("r.*")


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all files named chunks.jsonl or chunks_*.jsonl below a folder; a bad line is an error."""
    read = spark.read.schema(schemas.CHUNK).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "chunks*.jsonl").json(folder)
    named = read.withColumn("_file", F.col("_metadata.file_name"))
    return named.filter(F.col("_file").rlike(r"^chunks(_.*)?\.jsonl$")).drop("_file")


def merged_chunks(*parts: DataFrame) -> DataFrame:
    """Chunks of several inputs: the last row of a chunk_id wins, at the place of the first; rows without one go."""
    numbered = [p.select(F.lit(k).alias("_input"), *parts[0].columns) for k, p in enumerate(parts)]
    every = numbered[0]
    for p in numbered[1:]:
        every = every.unionByName(p)
    rows = every.filter(F.coalesce("chunk_id", F.lit("")) != "")
    by_id = Window.partitionBy("chunk_id")
    ranked = rows.withColumn("_n", F.row_number().over(by_id.orderBy(F.desc("_input"), F.desc("chunk_index")))).withColumn("_first", F.min("_input").over(by_id))
    return ranked.filter("_n = 1").drop("_n", "_input").withColumnRenamed("_first", "input_no")


def stored_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored chunks with their document: external id and text present; the file name from the path; in id order."""
    joined = chunks.join(documents, "doc_id").filter(F.col("external_id").isNotNull() & (F.trim("text") != ""))
    return joined.withColumn("source_filename", text.basename(F.col("source_path"))).orderBy("external_id")


def kind_of(path: Column) -> Column:
    """pdf, docx, image, text or unsupported by suffix."""
    suffix, out = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)), F.lit("unsupported")
    for kind, suffixes in SUFFIXES.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row a supported file: path, kind, size, document id, content; lock files and other suffixes go."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    classified = read.withColumn("name", name).withColumn("kind", kind_of(F.col("path"))).filter(~F.col("name").startswith("~$") & (F.col("kind") != "unsupported"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    return classified.select("path", "name", "kind", F.col("length").alias("size"), text.stable_id(stem, F.col("content")).alias("doc_id"), "content")


def docx_pages(files: DataFrame) -> DataFrame:
    """DOCX content to one logical page: paragraphs, then tables (cells by ' | ', rows by line); an empty document fails."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def body(content: bytes) -> str:
        root = ElementTree.parse(zipfile.ZipFile(io.BytesIO(content)).open("word/document.xml")).getroot().find(f"{word}body")
        line = lambda node: "".join(t.text or "" for t in node.iter(f"{word}t")).strip()
        paragraphs = [line(p) for p in root.findall(f"{word}p")]
        tables = ["\n".join(" | ".join(line(c) for c in row.findall(f"{word}tc")) for row in t.findall(f"{word}tr")) for t in root.findall(f"{word}tbl")]
        found = "\n".join(x for x in [*paragraphs, *tables] if x)
        if not found:
            raise ValueError("the document is empty")
        return found

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, "page_no": 1, "text": [body(bytes(c)) for c in frame.content]})

    return files.filter("kind = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id string, page_no int, text string")


def pending_pages(books: DataFrame, done: DataFrame) -> DataFrame:
    """Pages 1 to n_pages of each book that are not done."""
    wanted = books.filter("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_no"))
    return wanted.join(done.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")


def export_documents(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Manifests with their number of chunks; a warning where the chunks are missing."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = manifests.join(counted, "doc_id", "left").na.fill(0, ["n_chunks"])
    return joined.withColumn("warning", F.when(F.col("n_chunks") == 0, "chunks file is missing"))


def candidate_id(candidate: Column, index: Column) -> Column:
    """`lit_` and the first of the identifying fields that leaves something once it is sanitised; without any the index (from 1)."""
    clean = lambda k: F.regexp_replace(F.regexp_replace(candidate[k], "[^A-Za-z0-9_.:-]+", "_"), "^_+|_+$", "")
    named = F.coalesce(*[F.nullif(clean(k), F.lit("")) for k in ("paper_id", "paperId", "arxiv_id", "doi", "url")], index.cast("string"))
    return F.concat(F.lit("lit_"), named)


def literature(spark: SparkSession, path: str, limit: int | None = None, head: int | None = None) -> DataFrame:
    """Candidates of a captured literature search: an id from the first that is present, else from the place; snippet or abstract.

    `limit` keeps so many candidates of a search, `head` so many characters of an abstract; all without them.
    """
    fields = "title STRING, authors ARRAY<STRING>, year INT, venue STRING, doi STRING, url STRING, abstract STRING, snippet STRING, arxiv_id STRING, paper_id STRING, paperId STRING, id STRING"
    read = spark.read.schema(f"query STRING, retrieval_source STRING, candidates ARRAY<STRUCT<{fields}>>").option("multiLine", "true").json(path)
    rows = read.select("query", "retrieval_source", F.posexplode("candidates").alias("n", "c"))
    rows = rows if limit is None else rows.filter(F.col("n") < limit)
    abstract = F.col("c.abstract") if head is None else F.substring("c.abstract", 1, head)
    return rows.select("query", "retrieval_source", "n", candidate_id(F.col("c"), F.col("n") + 1).alias("candidate_id"), "c.title", "c.year", text.first_text(F.col("c.snippet"), abstract).alias("snippet"))


def settings(values: dict[str, str], env: dict[str, str], prefix: str = "MARGINALIA_") -> dict[str, str]:
    """Settings with those of the environment on top."""
    return {k: env.get(prefix + re.sub(r"\W", "_", k).upper(), v) for k, v in values.items()}
