"""Incremental ingestion: a folder of files to pages, chunks and a manifest, run after run.

A store holds three tables, `pages`, `chunks` and `manifest`, each in partitions of runs. A run lists
the files, reads only those whose size or time of change the manifest does not know, and parses only
those whose content it does not know; it writes its pages and chunks as one partition and, last, its
rows of the manifest. A run that dies before that has not happened: the next one takes its number and
overwrites its partitions, and no other. The newest row of a path counts; a file that is gone gets a
row that says so. A run that finds nothing new writes nothing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import chunking, layout
from marginalia.session import attach, written
from marginalia.sources import files

MANIFEST = "path string, size long, modified timestamp, digest string, kind string, status string, doc_id string, n_pages int, n_chunks int, content_run int, run int"
PAGES = "path string, doc_id string, page_no int, text string, run int"
CHUNKS = "path string, doc_id string, chunk_index int, page_start int, page_end int, section_key string, chunk_id string, token_estimate int, text string, run int"
#: What a file can have come to.
INGESTED, EMPTY, UNSUPPORTED, REMOVED = "ingested", "empty", "unsupported", "removed"


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{store}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """The newest row of each path, removed files included."""
    rows = _table(spark, store, "manifest", MANIFEST)
    newest = F.max_by(F.struct(*rows.columns), "run").alias("r")
    return rows.groupBy("path").agg(newest).select("r.*")


def current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Pages or chunks of the files as they are now."""
    held = manifest(spark, store).filter(F.col("status") == INGESTED).select("path", F.col("content_run").alias("run"))
    return _table(spark, store, name, {"pages": PAGES, "chunks": CHUNKS}[name]).join(held, ["path", "run"], "left_semi")


def books_of(read: DataFrame) -> DataFrame:
    """(path, doc_id, pages) of read files (path, doc_id, kind, pages, content): the pages of a text as they are, a DOCX as one page. A DOCX is parsed once."""
    plain = read.filter("kind = 'text'").select("path", "doc_id", "pages")
    word = files.docx_pages(read.select("kind", "content", F.to_json(F.struct("path", "doc_id")).alias("doc_id")))
    named = word.select(F.from_json("doc_id", "path string, doc_id string").alias("d"), F.array("text").alias("pages")).select("d.path", "d.doc_id", "pages")
    return plain.unionByName(written(named, "ingest-docx"))


def chunks_of(books: DataFrame) -> DataFrame:
    """Chunks of books (path, doc_id, pages): paragraphs at blank lines, sections at titles, no chunk over two documents. A book never leaves its row."""

    def paragraphs(page: Column, k: Column) -> Column:
        unit = lambda u, at: F.struct((k + 1).alias("page_no"), at.alias("at"), text.strip(u).alias("unit"))
        return F.filter(F.transform(F.split(page, r"\n\s*\n"), unit), lambda u: u["unit"] != "")

    # Lines are squeezed once, and only where a title can stand: the rules of the other kinds count every letter of a paragraph.
    may = lambda u: (u["at"] <= layout.TITLE_BLOCKS) & u["unit"].rlike(layout.TITLE_START)
    line = F.transform("u", lambda u: F.struct(u["at"].alias("at"), F.when(may(u), text.squeeze(u["unit"])).alias("line")))
    titles = F.transform(line, lambda u: u["line"].isNotNull() & (layout.line_kind(u["line"], u["at"]) == "title"))
    cut = books.select(F.struct("path", "doc_id").alias("doc_id"), F.flatten(F.transform("pages", paragraphs)).alias("u"))
    made = chunking.chunks(cut.select("doc_id", F.col("u.unit").alias("units"), titles.alias("titles"), F.col("u.page_no").alias("pages")))
    chunk_id = F.format_string("%s_p%04d_%05d", "doc_id.doc_id", "page_start", "chunk_index")
    return made.select("doc_id.path", "doc_id.doc_id", "chunk_index", "page_start", "page_end", "section_key", chunk_id.alias("chunk_id"), F.col("token_estimate").cast("int").alias("token_estimate"), "text")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, size, modified, content. The content is read only where it is used."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return read.filter(~name.startswith("~$")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def ingest(found: DataFrame, store: str) -> DataFrame:
    """Bring a store up to date with the files (path, size, modified, content; one row a path); returns this run's rows of the manifest, none if nothing changed.

    Files whose content is known under their path get a row with their new time and keep their pages.
    """
    spark = found.sparkSession
    known = written(manifest(spark, store), "ingest-known")
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    live = known.filter(F.col("status") != REMOVED).select(F.col("path").alias("_path"), F.struct("size", "modified", "digest", "kind", "status", "doc_id", "n_pages", "n_chunks", "content_run").alias("was"))
    # Only paths, sizes and times meet the manifest; contents are not touched before it is known which are needed.
    met = found.select("path", "size", "modified", F.lit(True).alias("there")).join(live, F.col("path").eqNullSafe(F.col("_path")), "full_outer")
    same = F.coalesce((F.col("size") == F.col("was.size")) & (F.col("modified") == F.col("was.modified")), F.lit(False))
    changes = written(met.filter(~same).select(F.coalesce("path", "_path").alias("path"), F.col("there").isNotNull().alias("there"), "was"), "ingest-changes")
    columns = ["path", "size", "modified", "digest", "kind", "status", "doc_id", "n_pages", "n_chunks", "content_run"]
    outcome = changes.filter("NOT there").select("path", "was.*").withColumn("status", F.lit(REMOVED)).select(columns)
    asked = changes.filter("there")
    if not asked.isEmpty():
        read = _read(found, asked if known.filter(F.col("status") != REMOVED).limit(1).count() else None)
        fresh = read.filter("NOT touched")
        if not fresh.isEmpty():
            partition = {"partitionOverwriteMode": "dynamic"}
            books = books_of(fresh)
            pages = books.select("path", "doc_id", F.posexplode("pages").alias("at", "text")).select("path", "doc_id", (F.col("at") + 1).alias("page_no"), "text")
            pages.withColumn("run", F.lit(run)).write.mode("overwrite").options(**partition).partitionBy("run").parquet(f"{store}/pages")
            chunks_of(books).withColumn("run", F.lit(run)).write.mode("overwrite").options(**partition).partitionBy("run").parquet(f"{store}/chunks")
        count = lambda name, schema, out: _table(spark, store, name, schema).filter(F.col("run") == run).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias(out))
        rows = fresh.select("path", "size", "modified", "digest", "kind", "doc_id")
        counted = rows.join(count("pages", PAGES, "n_pages"), "path", "left").join(count("chunks", CHUNKS, "n_chunks"), "path", "left").na.fill(0, ["n_pages", "n_chunks"])
        status = F.when(F.col("doc_id").isNull(), UNSUPPORTED).when(F.col("n_chunks") == 0, EMPTY).otherwise(INGESTED)
        new = counted.withColumn("status", status).withColumn("content_run", F.lit(run))
        touched = read.filter("touched").select("path", "size", "modified", "digest", "kind", "was.status", "was.doc_id", "was.n_pages", "was.n_chunks", "was.content_run")
        outcome = outcome.unionByName(new.select(columns)).unionByName(touched)
    outcome = written(outcome.withColumn("run", F.lit(run)), "ingest-outcome")
    if not outcome.isEmpty():
        outcome.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{store}/manifest")
    return outcome


def _read(found: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The files asked for (all for None), written once: digest, kind, doc_id, whether the content is known (`touched`), else the pages of texts and the content of DOCX.

    Contents are read and, where files are known, joined here only; what follows reads columns of this table.
    """
    nothing = F.lit(None).cast("struct<size:bigint,modified:timestamp,digest:string,kind:string,status:string,doc_id:string,n_pages:int,n_chunks:int,content_run:int>")
    if asked is None:
        placed = found.withColumn("was", nothing)
    else:
        placed = found.join(asked.select(F.col("path").alias("_path"), "was"), F.col("path").eqNullSafe(F.col("_path"))).drop("_path")
    named = placed.withColumn("digest", F.sha2("content", 256)).withColumn("kind", files.kind_of(F.col("path")))
    stem = F.regexp_replace(text.basename(F.col("path")), r"\.[^.]+$", "")
    fresh = ~F.coalesce(F.col("digest") == F.col("was.digest"), F.lit(False))
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return written(
        named.select(
            "path",
            "size",
            "modified",
            "digest",
            "kind",
            "was",
            (~fresh).alias("touched"),
            F.when(F.col("kind").isin("text", "docx"), text.digest_id(stem, F.col("digest"))).alias("doc_id"),
            F.when(fresh & (F.col("kind") == "text"), F.split(body, "\f")).alias("pages"),
            F.when(fresh & (F.col("kind") == "docx"), F.col("content")).alias("content"),
        ),
        "ingest-read",
    )


def main(argv: list[str] | None = None) -> int:
    """Command line: ingest a folder, or show the state of a store. 0: done, 1: no file could be read, 2: wrong use."""
    parser = argparse.ArgumentParser(prog="python -m marginalia.plans.ingest")
    parser.add_argument("command", choices=("ingest", "status"))
    parser.add_argument("store")
    parser.add_argument("folder", nargs="?")
    args = parser.parse_args(argv)
    if (args.command == "ingest") != bool(args.folder):
        return 2
    spark = attach(SparkSession.builder.getOrCreate())
    rows = ingest(listed(spark, args.folder), args.store) if args.folder else manifest(spark, args.store)
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    print(", ".join(f"{counts[k]} {k}" for k in sorted(counts)) or "nothing new")
    return 0 if not counts or counts.keys() - {UNSUPPORTED, EMPTY} else 1


if __name__ == "__main__":
    sys.exit(main())
