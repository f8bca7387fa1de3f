"""Evidence: greedy selection, near-duplicates, continuous neighbours, rows with assets, citations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.streaming.folds import ordered_fold


#: A body of this size that stands inside another repeats it; from the second size on likeness counts too.
HELD_SIZE, LIKE_SIZE, LIKENESS = 80, 120, 0.94


def likeness(a: str, b: str) -> float:
    """Matching ratio of two bodies, or 0 as soon as a bound shows that it stays below LIKENESS."""
    whole = len(a) + len(b)
    letters = sum((Counter(a) & Counter(b)).values())
    if 2 * min(len(a), len(b)) < LIKENESS * whole or 2 * letters < LIKENESS * whole:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def repeats(body: str, held: Sequence[str]) -> bool:
    """Whether a squeezed body is empty, or stands for one that was taken: equal, one inside the other, or alike."""

    def meets(other: str) -> bool:
        size = min(len(body), len(other))
        inside = size >= HELD_SIZE and (body in other or other in body)
        return body == other or inside or (size >= LIKE_SIZE and likeness(body, other) >= LIKENESS)

    return not body or any(map(meets, held))


def select_evidence(candidates: DataFrame, max_chunks: int = 12, token_budget: int = 6000) -> DataFrame:
    """query_id, chunk_id, pick (from 1), tokens of the candidates (query_id, chunk_id, text, tokens, rank) that are taken.

    In rank order: repeats are passed over, a chunk that would pass the budget is passed over too,
    and the selection ends at max_chunks. Each choice depends on the ones before, so a query's
    candidates stream past a fold that holds the bodies taken, max_chunks at most. Of candidates with equal
    texts and tokens only the first can be taken, so the others are removed before.
    """
    place = F.struct("rank", "chunk_id", "text")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    first = candidates.groupBy("query_id", sha.alias("_sha"), "tokens").agg(F.min(place).alias("_first")).select("query_id", "tokens", "_first.*")
    kind = candidates.schema["query_id"].dataType.simpleString()
    id_type = candidates.schema["chunk_id"].dataType.simpleString()

    def step(state, row):
        held, used = state or ([], 0)
        pick = None
        if len(held) < max_chunks:
            body = re.sub(r"\W+", "", (row[2] or "").casefold())
            if body and used + row[3] <= token_budget and not repeats(body, held):
                held, used = [*held, body], used + row[3]
                pick = len(held)
        return (held, used), (row[0], row[1], pick, row[3])

    taken = ordered_fold(first, "query_id", ["rank", "chunk_id"], ["query_id", "chunk_id", "text", "tokens"], step, f"query_id {kind}, chunk_id {id_type}, pick int, tokens int")
    return taken.filter("pick IS NOT NULL")


def continuous_neighbors(chunks: DataFrame, window: int = 1) -> DataFrame:
    """Pairs of a chunk and a neighbour within the window whose texts run on, as equi-joins on the shifted index."""
    flagged = chunks.select("doc_id", "chunk_index", text.continues(F.col("text")).alias("continues"), (~text.ends_sentence(F.col("text"))).alias("open"))
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    seeds = flagged.withColumn("distance", offsets).filter(F.when(F.col("distance") < 0, F.col("continues")).otherwise(F.col("open")))
    asked = seeds.withColumn("neighbor_index", F.col("chunk_index") + F.col("distance"))
    others = flagged.select("doc_id", F.col("chunk_index").alias("neighbor_index"), F.col("continues").alias("_c"), F.col("open").alias("_o"))
    joined = asked.join(others, ["doc_id", "neighbor_index"])
    return joined.filter(F.when(F.col("distance") < 0, F.col("_o")).otherwise(F.col("_c"))).select("doc_id", "chunk_index", "neighbor_index", "distance")


def rows_with_assets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, assets) to one text row and one row a distinct asset, with how often it comes."""
    body = chunks.select("chunk_id", F.lit("text").alias("kind"), F.col("text").alias("body"), F.lit(1).cast("long").alias("n"))
    assets = chunks.select("chunk_id", F.explode("assets").alias("body")).groupBy("chunk_id", "body").agg(F.count(F.lit(1)).alias("n"))
    return assets.select("chunk_id", F.lit("link").alias("kind"), "body", "n").unionByName(body)


def merged_rows(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row a chunk, the first source that has text; a lookup overrides the confidence."""
    order = Window.partitionBy("chunk_id").orderBy("origin")
    first = rows.filter(F.trim("text") != "").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.join(overrides, "chunk_id", "left").withColumn("confidence", F.coalesce("override", "confidence")).drop("override")


def chunk_confidence(confidence: Column, ocr_min: Column, score: Column) -> Column:
    """Own confidence, else the least of its pages, else its score within 0 and 1, else 1."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.coalesce(confidence, ocr_min, clamped, F.lit(1.0))


#: Fields that name the file and the title of a source, the first that is not empty counts.
FILENAME_FIELDS, TITLE_FIELDS = ("source_filename", "input_filename", "filename"), ("source_title", "title")
SNIPPET_LETTERS = 180


def snippet(body: Column, letters: int = SNIPPET_LETTERS) -> Column:
    """A text on one line, cut with an ellipsis behind so many letters; null for none."""
    line = F.regexp_replace(F.regexp_replace(body, r"(?U)\s+", " "), "^ | $", "")
    cut = F.concat(F.rtrim(F.substring(line, 1, letters)), F.lit("…"))
    return F.nullif(F.when(F.length(line) > letters, cut).otherwise(line), F.lit(""))


def cited(hits: DataFrame) -> DataFrame:
    """Citations of hits: chunk_id, doc_id, pages, evidence_type, confidence, source_filename, source_title, snippet.

    A hit needs the two identifiers, else it is left out; every other column may be missing. Pages are
    its own, or its range. The confidence is that of the chunk, else the least of its pages, else its
    score, else 1, always within 0 and 1. Without a file name the last part of its path counts;
    without a text the context does.
    """
    have = set(hits.columns)
    field = lambda name, kind="string": (F.col(name) if name in have else F.lit(None)).cast(kind)
    first = lambda names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names])
    start, end = field("page_start", "int"), field("page_end", "int")
    between = F.when(start <= end, F.sequence(start, end)).when(start > end, F.array().cast("array<int>"))
    base = F.regexp_extract(F.replace(field("source_path"), F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)
    confidence = chunk_confidence(field("confidence", "double"), field("ocr_confidence_min", "double"), field("score", "double"))
    return hits.filter(F.col("chunk_id").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.coalesce(field("pages", "array<int>"), between).alias("pages"),
        F.lit("documented").alias("evidence_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.coalesce(first(FILENAME_FIELDS), F.nullif(base, F.lit(""))).alias("source_filename"),
        first(TITLE_FIELDS).alias("source_title"),
        snippet(first(("text", "api_context"))).alias("snippet"),
    )


def unique_citations(citations: DataFrame, claims: DataFrame) -> DataFrame:
    """Citations of an answer, first of each chunk; answers without any take them from their claims."""
    order = Window.partitionBy("answer_id", "chunk_id").orderBy("seq")
    one = lambda df: df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    given = one(citations)
    derived = one(claims.filter(F.col("chunk_id").isNotNull())).join(given.select("answer_id").distinct(), "answer_id", "left_anti")
    return given.unionByName(derived.select(*given.columns))


def topic_key(topic: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(topic, F.lit(""))), r"[_\W]+", " "))


def filtered(rows: DataFrame, mode: Column, doc_id: Column | None = None, section_key: Column | None = None, topic: Column | None = None) -> DataFrame:
    """Evidence rows (doc_id, section_key, section_title, topic) of the asked document, and of section and topic in a section summary.

    Topics match where one holds the other. Reference lists go in every mode. A condition that is null asks for nothing.
    """
    in_section = mode == "section_summary"
    asked = lambda c: c.isNotNull() & (c.cast("string") != "")
    keep = ~F.trim(F.coalesce(F.nullif("section_title", F.lit("")), "topic", F.lit(""))).rlike("(?i)^(?:参考文献|references|bibliography)$")
    if doc_id is not None:
        keep = keep & (~asked(doc_id) | (F.col("doc_id").cast("string") == doc_id.cast("string")))
    if section_key is not None:
        keep = keep & (~in_section | ~asked(section_key) | F.coalesce(F.col("section_key") == section_key, F.lit(False)))
    if topic is not None:
        mine, theirs = topic_key(F.col("topic")), topic_key(topic)
        keep = keep & (~in_section | ~asked(topic) | F.contains(mine, theirs) | F.contains(theirs, mine))
    return rows.filter(keep)


def with_neighbors(seeds: DataFrame, corpus: DataFrame, window: int = 1) -> DataFrame:
    """Candidates of a selection: the seeds in rank order, then their neighbours in the document that run on.

    seeds: query_id, chunk_id, rank; corpus: chunk_id, doc_id, chunk_index, text. Returns query_id,
    chunk_id, text, tokens, rank, kind, seed_id; a chunk that is seed and neighbour comes at its
    first place. `select_evidence` takes the result.
    """
    goes_on, is_open = text.continues(F.col("text")), ~text.ends_sentence(F.col("text"))
    placed = seeds.join(corpus, "chunk_id").select("query_id", "chunk_id", "rank", "doc_id", "chunk_index", "text")
    # A seed asks only on the sides where its text runs on.
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    flagged = placed.select("query_id", F.col("chunk_id").alias("seed_id"), "rank", "doc_id", "chunk_index", goes_on.alias("goes_on"), is_open.alias("open"))
    sides = flagged.withColumn("distance", offsets).filter(F.when(F.col("distance") < 0, F.col("goes_on")).otherwise(F.col("open")))
    asked = sides.select("query_id", "seed_id", "rank", "doc_id", (F.col("chunk_index") + F.col("distance")).alias("neighbor_index"), "distance")
    others = corpus.select("doc_id", F.col("chunk_index").alias("neighbor_index"), "chunk_id", "text", goes_on.alias("goes_on"), is_open.alias("open"))
    found = asked.join(others, ["doc_id", "neighbor_index"]).filter(F.when(F.col("distance") < 0, F.col("open")).otherwise(F.col("goes_on")))
    # Neighbours follow all seeds: by the seed's rank, nearer ones first, the one before ahead of the one after.
    late = F.struct(F.lit(1).alias("late"), F.col("rank").cast("double").alias("rank"), F.abs("distance").alias("step"), F.col("distance").alias("side"))
    soon = F.struct(F.lit(0).alias("late"), F.col("rank").cast("double").alias("rank"), F.lit(0).alias("step"), F.lit(0).alias("side"))
    kind_of = lambda k: F.lit(k).alias("kind")
    every = placed.select("query_id", "chunk_id", "text", soon.alias("rank"), kind_of("seed"), F.lit(None).cast(corpus.schema["chunk_id"].dataType).alias("seed_id")).unionByName(
        found.select("query_id", "chunk_id", "text", late.alias("rank"), kind_of("adjacent"), "seed_id")
    )
    # One aggregate a column, all by the same order: what a caller does not use is not carried.
    first = every.groupBy("query_id", "chunk_id").agg(*[F.min_by(c, F.col("rank")).alias(c) for c in ("text", "kind", "seed_id")], F.min("rank").alias("rank")).select("query_id", "chunk_id", "text", "rank", "kind", "seed_id")
    return first.withColumn("tokens", text.evidence_tokens(F.col("text")))
