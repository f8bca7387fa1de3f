"""Sections and chunks of documents: title sections, packing with overlap, spans, hierarchy, page quality."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text

TARGET_TOKENS, OVERLAP_TOKENS = 600, 60
FRONT_MATTER = "front"
BOUNDS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "last", "section")]))


def title_level(title: Column) -> Column:
    """Depth of a title from its numbering."""
    stripped = text.strip(title)
    dotted = F.regexp_extract(stripped, r"^(\d+(?:\.\d+)+)\b", 1)
    return (
        F.when(stripped.rlike(r"(?i)^chapter\s+\d+\b"), 1)
        .when(dotted != "", F.size(F.split(dotted, r"\.")))
        .when(stripped.rlike(r"^\d+[\.)]\s+\S+"), 2)
        .when(stripped.startswith("第") & stripped.contains("章"), 1)
        .when(stripped.startswith("第") & stripped.contains("节"), 2)
        .otherwise(1)
    )


def with_sections(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_ix, unit, is_title) with section_no, section_key and section_level: a title opens a section."""
    in_order = Window.partitionBy("doc_id").orderBy("para_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = paragraphs.withColumn("section_no", F.sum(F.col("is_title").cast("int")).over(in_order).cast("int"))
    key = F.when(F.col("section_no") == 0, FRONT_MATTER).otherwise(F.format_string("s%04d", "section_no"))
    level = F.last(F.when(F.col("is_title"), title_level(F.col("unit"))), ignorenulls=True).over(in_order)
    return numbered.withColumn("section_key", key).withColumn("section_level", F.coalesce(level, F.lit(0)))


def section_spans(paragraphs: DataFrame) -> DataFrame:
    """Runs of one section key (a key may come again as a new span): doc_id, span, key, first, last, n."""
    in_order = Window.partitionBy("doc_id").orderBy("para_ix")
    opens = F.coalesce((F.lag("section_key").over(in_order) != F.col("section_key")).cast("int"), F.lit(1))
    spans = paragraphs.withColumn("_opens", opens).withColumn("span", F.sum("_opens").over(in_order).cast("int"))
    return spans.groupBy("doc_id", "span").agg(
        F.first("section_key").alias("section_key"), F.min("para_ix").alias("first_ix"), F.max("para_ix").alias("last_ix"), F.count(F.lit(1)).alias("n_paragraphs")
    )


def pack(sizes: list[int], sections: list[int], target: int, overlap: int, keep_always: bool = False) -> list[tuple[int, int]]:
    """(first, last) of each chunk of paragraphs.

    A chunk closes before a new section, before it would pass the target, and after a paragraph
    of the target's size. Only the second keeps the trailing paragraphs that reach the overlap;
    with keep_always every closing does, and sections are not looked at.
    """
    chunks, start, held = [], 0, 0
    for k, size in enumerate(sizes):
        if start < k and not keep_always and sections[k] != sections[k - 1]:
            chunks.append((start, k - 1))
            start, held = k, 0
        if start < k and held + size > target:
            chunks.append((start, k - 1))
            tail, total = k, 0
            while tail > start and total < overlap and (keep_always or sections[tail - 1] == sections[k - 1]):
                tail -= 1
                total += sizes[tail]
            start, held = tail, total
        held += size
        if size >= target:
            chunks.append((start, k))
            start, held = (k, size) if keep_always and overlap > 0 else (k + 1, 0)
    if start < len(sizes):
        chunks.append((start, len(sizes) - 1))
    return chunks


def chunk_bounds(sizes: Column, titles: Column, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, keep_always: bool = False) -> Column:
    """First and last paragraph and section of each chunk of a document.

    Each closing depends on the ones before, so it is a fold over the row.
    """
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "section")]))

    def of(sizes: list[int] | None, titles: list[bool]) -> list[dict]:
        sections = list(accumulate(int(t) for t in titles or ()))
        return [{"first": a, "last": b, "section": sections[a]} for a, b in pack(sizes or [], sections, target, overlap, keep_always)]

    @F.arrow_udf(BOUNDS)
    def bounds(sizes: pa.Array, titles: pa.Array) -> pa.Array:
        return pa.array([of(s, t) for s, t in zip(sizes.to_pylist(), titles.to_pylist())], kind)

    return bounds(sizes, titles)


def chunks(docs: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, keep_always: bool = False) -> DataFrame:
    """(doc_id, units, titles, pages) arrays a document to chunk rows.

    units: paragraphs; titles: whether each is one; pages: page of each; kinds, where it is there:
    kind of block of each, which gives `segments` of the chunk's text. A document never leaves
    its row, so nothing is shuffled, and only the numbers pass through Python.
    """
    # Documents without paragraphs have no bounds; a filter would build the paragraphs a second time below them.
    prepared = docs.withColumn("sizes", F.transform("units", text.estimated_tokens))
    bounded = prepared.withColumn("bounds", chunk_bounds(F.col("sizes"), F.col("titles"), target, overlap, keep_always))

    def chunk(b: Column, k: Column) -> Column:
        part = lambda c: F.slice(F.col(c), b["first"] + 1, b["last"] - b["first"] + 1)
        return F.struct(
            (k + 1).alias("chunk_index"),
            F.array_min(part("pages")).alias("page_start"),
            F.array_max(part("pages")).alias("page_end"),
            F.when(b["section"] == 0, FRONT_MATTER).otherwise(F.format_string("s%04d", b["section"])).alias("section_key"),
            b["first"].alias("first_ix"),
            b["last"].alias("last_ix"),
            F.array_join(part("units"), "\n\n").alias("text"),
            *([text_segments(part("units"), part("pages"), part("kinds")).alias("segments")] if "kinds" in docs.columns else []),
        )

    rows = bounded.select("doc_id", F.inline(F.transform("bounds", chunk)))
    named = rows.withColumn("chunk_id", F.format_string("%s_p%04d_%05d", F.col("doc_id").cast("string"), "page_start", "chunk_index"))
    return named.withColumn("token_estimate", text.estimated_tokens(F.col("text")))


def text_segments(units: Column, pages: Column, kinds: Column) -> Column:
    """Where each paragraph stands in the text that joins them by two line feeds: page_no, start, end, block_type."""
    node = "struct<page_no:int,start:int,end:int,block_type:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{node}>").alias("out"))

    def step(state: Column, k: Column) -> Column:
        end = state["at"] + F.length(F.get(units, k))
        one = F.struct(F.get(pages, k).cast("int").alias("page_no"), state["at"].alias("start"), end.alias("end"), F.get(kinds, k).alias("block_type"))
        return F.struct((end + 2).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    places = F.when(F.size(units) > 0, F.sequence(F.lit(0), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["out"])


def located_spans(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans (chunk_id, start, end) of chunk texts with the pages and kinds of blocks they touch.

    `segments` has one row a chunk. A span belongs to the segment that holds its first letter; in
    the gap between two it belongs to the one before, as the last that starts at or before it. A span
    that touches no letter of the chunk has no pages.
    """
    joined = spans.join(segments.select("chunk_id", "segments"), "chunk_id", "left")
    touched = F.filter("segments", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    opened = F.filter("segments", lambda s: s["start"] <= F.col("start"))
    first = F.get(opened, F.size(opened) - 1)
    return joined.select(
        *spans.columns,
        first["block_type"].alias("block_type"),
        first["page_no"].alias("page_no"),
        F.array_sort(F.array_distinct(F.transform(touched, lambda s: s["page_no"]))).alias("pages"),
        F.size(touched).alias("n_segments"),
    )


def citation_anchor(title: Column, start: Column, end: Column, authors: Column | None = None, year: Column | None = None) -> Column:
    """First of the authors (an array), et al. where there are more, and the year, else the title; then the pages."""
    pages = F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string")))
    if authors is not None and year is not None:
        first = F.concat(F.get(authors, F.lit(0)), F.when(F.size(authors) > 1, " et al.").otherwise(""))
        lead = F.coalesce(F.concat(first, F.lit(" ("), year.cast("string"), F.lit(")")), title)
    else:
        lead = title
    return F.concat_ws(", ", lead, pages)


def page_quality(chunk_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id with the least and mean confidence and the pages to review in its range.

    The range is exploded into an equi-join on (doc_id, page_no), so a long document does not
    meet all its pages with all its chunks.
    """
    wanted = chunk_rows.select("chunk_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    return (
        wanted.join(pages, ["doc_id", "page_no"], "left")
        .groupBy("chunk_id")
        .agg(
            F.min("confidence").alias("confidence_min"),
            F.avg("confidence").alias("confidence_avg"),
            F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.col("page_no")))).alias("needs_review_pages"),
        )
    )


def ancestors(sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, section_level) with parents, root first, and whether the level above is missing.

    One fold over a document's sections: those at the level or deeper close, those that stay open
    are the parents. Level 0 has no parents and closes nothing.
    """
    ordered = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_level"))).alias("found"))
    node = "struct<section_no:int,section_level:int>"
    start = F.struct(
        F.array().cast(f"array<{node}>").alias("stack"),
        F.array().cast("array<struct<section_no:int,section_level:int,parents:array<int>,gap:boolean>>").alias("out"),
    )

    def step(state: Column, x: Column) -> Column:
        level = x["section_level"]
        still = F.filter(state["stack"], lambda s: s["section_level"] < level)
        gap = (level > 1) & ~F.exists(state["stack"], lambda s: s["section_level"] == level - 1)
        parents = F.when(level > 0, F.transform(still, lambda s: s["section_no"])).otherwise(F.array().cast("array<int>"))
        row = F.struct(x["section_no"].alias("section_no"), level.alias("section_level"), parents.alias("parents"), gap.alias("gap"))
        return F.struct(F.when(level > 0, F.concat(still, F.array(x.cast(node)))).otherwise(state["stack"]).alias("stack"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = ordered.select("doc_id", F.aggregate("found", start, step, lambda s: s["out"]).alias("rows"))
    return folded.select("doc_id", F.inline("rows"))


def manifest(pages: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Counts, token sum and confidence of pages and chunks a document; two aggregates joined, no fan-out."""
    by_page = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.min("confidence").alias("page_confidence_min"),
        F.avg("confidence").alias("page_confidence_avg"),
        F.count_if("needs_review").alias("review_pages"),
    )
    by_chunk = chunk_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_estimate").alias("token_sum"))
    return by_page.join(by_chunk, "doc_id", "full_outer").na.fill(0, ["page_count", "chunk_count", "token_sum", "review_pages"])
