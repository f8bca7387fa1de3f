"""Queries of sections, chunks, layout and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import bibliography as biblio
from marginalia.functions import text
from marginalia.operators import chunking, evidence, layout
from marginalia.plans.text_queries import SQL_ESTIMATE
from marginalia.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs; short lines without a full stop open sections; five lines are a page."""
    docs = table(spark, sf_dir, "documents")
    exploded = docs.select("doc_id", "source", F.posexplode(F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")).alias("para_ix", "unit"))
    return exploded.withColumn("is_title", (F.length("unit") <= 40) & ~F.col("unit").rlike("[.!?]$")).withColumn("page_no", (F.col("para_ix") / 5).cast("int") + 1)


SQL_LINES = r"""
raw AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, e'\n'), lambda x: trim(x, e' \t\r')), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT doc_id, source, CAST(i AS INTEGER) AS para_ix, ls[i + 1] AS unit, length(ls[i + 1]) <= 40 AND NOT regexp_matches(ls[i + 1], '[.!?]$') AS is_title,
  CAST(i // 5 + 1 AS INTEGER) AS page_no FROM raw, unnest(range(0, len(ls))) AS r(i)),
secs AS (SELECT *, CAST(sum(CAST(is_title AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY para_ix) AS INTEGER) AS section_no FROM lines)"""


@query(f"""
WITH {SQL_LINES}, k AS (SELECT *, CASE WHEN section_no = 0 THEN 'front' ELSE printf('s%04d', section_no) END AS section_key FROM secs),
o AS (SELECT *, CASE WHEN lag(section_key) OVER w = section_key THEN 0 ELSE 1 END AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY para_ix)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY para_ix) AS span FROM o)
SELECT doc_id, CAST(span AS INTEGER) AS span, min(section_key) AS section_key, min(para_ix) AS first_ix, max(para_ix) AS last_ix, CAST(count(*) AS BIGINT) AS n_paragraphs
FROM s GROUP BY doc_id, span""")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_spans(chunking.with_sections(lines_of(spark, sf_dir)))


def chunk_rows(spark: SparkSession, sf_dir: str, keep_always: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    units = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    prepared = docs.select(
        "doc_id",
        units.alias("units"),
        F.transform(units, lambda u: (F.length(u) <= 40) & ~u.rlike("[.!?]$")).alias("titles"),
        F.transform(units, lambda u, k: (k / 5).cast("int") + 1).alias("pages"),
    )
    return chunking.chunks(prepared, 120, 20, keep_always)


def _sql_packed(sections: bool) -> str:
    """The packing as a recursion over paragraphs: where the open chunk starts and what it holds, and what each paragraph closes."""
    same = "section_no = before" if sections else "true"
    edge = "max(CASE WHEN section_no <> coalesce(before, section_no) THEN para_ix ELSE 0 END) OVER w" if sections else "0"
    after = "k + 1" if sections else "k"
    rest = "0" if sections else "size"
    return f"""
WITH RECURSIVE {SQL_LINES}, u AS (SELECT doc_id, para_ix AS k, unit, page_no, section_no, {SQL_ESTIMATE.format('unit')} AS size, lag(section_no) OVER (PARTITION BY doc_id ORDER BY para_ix) AS before FROM secs),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, count(*) OVER (PARTITION BY doc_id) AS n, {edge.replace('para_ix', 'k')} AS opens FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
b AS (SELECT a.doc_id, a.k, max(t.k) AS reach FROM c a JOIN c t ON t.doc_id = a.doc_id AND t.k < a.k AND t.k >= a.k - 20 AND a.cum - t.cum >= 20 GROUP BY ALL),
e AS (SELECT c.*, greatest(coalesce(b.reach, 0), coalesce(lag(opens) OVER (PARTITION BY c.doc_id ORDER BY c.k), 0)) AS tail FROM c LEFT JOIN b ON b.doc_id = c.doc_id AND b.k = c.k),
r AS (SELECT doc_id, CAST(-1 AS INTEGER) AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS b1, CAST(NULL AS BIGINT) AS a2, CAST(NULL AS BIGINT) AS b2, any_value(n) AS n FROM e GROUP BY doc_id
  UNION ALL SELECT doc_id, k, CASE WHEN size >= 120 THEN {after} ELSE s1 END, CASE WHEN size >= 120 THEN {rest} ELSE h1 + size END, a1, b1, CASE WHEN size >= 120 THEN s1 END, CASE WHEN size >= 120 THEN k END, n
  FROM (SELECT doc_id, k, size, n, CASE WHEN shut OR full_ THEN start END AS a1, CASE WHEN shut OR full_ THEN k - 1 END AS b1,
      CASE WHEN shut THEN k WHEN full_ THEN greatest(start, tail) ELSE start END AS s1, CASE WHEN shut THEN 0 WHEN full_ THEN cum - (SELECT t.cum FROM c t WHERE t.doc_id = q.doc_id AND t.k = greatest(q.start, q.tail)) ELSE held END AS h1
    FROM (SELECT e.*, r.start, r.held, r.start < e.k AND NOT ({same}) AS shut, r.start < e.k AND ({same}) AND r.held + e.size > 120 AS full_ FROM r JOIN e ON e.doc_id = r.doc_id AND e.k = r.k + 1) q)),
x AS (SELECT doc_id, k, 1 AS o, a1 AS a, b1 AS b FROM r WHERE a1 IS NOT NULL UNION ALL SELECT doc_id, k, 2, a2, b2 FROM r WHERE a2 IS NOT NULL UNION ALL SELECT doc_id, k, 3, start, n - 1 FROM r WHERE k = n - 1 AND start < n),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, o) AS INTEGER) AS chunk_index FROM x),
z AS (SELECT y.doc_id, chunk_index, CAST(a AS INTEGER) AS first_ix, CAST(b AS INTEGER) AS last_ix, min(page_no) AS page_start, max(page_no) AS page_end, min(section_no) AS section_no, string_agg(unit, chr(10) || chr(10) ORDER BY u.k) AS body
  FROM y JOIN u ON u.doc_id = y.doc_id AND u.k BETWEEN a AND b GROUP BY ALL)
SELECT doc_id, chunk_index, page_start, page_end, CASE WHEN section_no = 0 THEN 'front' ELSE printf('s%04d', section_no) END AS section_key, first_ix, last_ix,
  printf('%s_p%04d_%05d', CAST(doc_id AS VARCHAR), page_start, chunk_index) AS chunk_id, {SQL_ESTIMATE.format('body')} AS token_estimate FROM z"""


@query(_sql_packed(True))
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing into chunks with overlap inside sections."""
    return chunk_rows(spark, sf_dir).drop("text")


@query(_sql_packed(False))
def chunk_pack_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older packing: no sections, overlap after every chunk."""
    return chunk_rows(spark, sf_dir, True).drop("text")


@query(f"""
WITH {SQL_LINES}, p AS (SELECT DISTINCT doc_id, page_no, 0.5 + ((doc_id * 7 + page_no * 13) % 50) / 100.0 AS c FROM lines)
SELECT doc_id, CAST(count(*) AS BIGINT) AS page_count, round(min(c), 6) AS page_confidence_min, round(avg(c), 6) AS page_confidence_avg,
  CAST(count(*) FILTER (c < 0.6) AS BIGINT) AS review_pages FROM p GROUP BY doc_id""")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts and confidence a document."""
    rolled = chunking.manifest(pages_of(spark, sf_dir), chunk_rows(spark, sf_dir))
    rolled = rolled.filter("page_count > 0")
    return rolled.select("doc_id", "page_count", F.round("page_confidence_min", 6).alias("page_confidence_min"), F.round("page_confidence_avg", 6).alias("page_confidence_avg"), "review_pages")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines_of(spark, sf_dir).select("doc_id", "page_no").distinct()
    graded = pages.withColumn("confidence", (F.lit(50) + F.pmod(F.col("doc_id") * 7 + F.col("page_no") * 13, F.lit(50))) / 100.0)
    return graded.withColumn("needs_review", F.col("confidence") < 0.6)


@query(f"""
WITH {SQL_LINES}, p AS (SELECT DISTINCT doc_id, page_no, (50 + (doc_id * 7 + page_no * 13) % 50) / 100.0 AS c FROM lines),
r AS (SELECT doc_id, section_no, min(page_no) AS a, max(page_no) AS b FROM secs GROUP BY ALL)
SELECT doc_id || ':' || section_no AS chunk_id, round(min(c), 6) AS confidence_min, round(avg(c), 6) AS confidence_avg,
  list_sort(coalesce(list(page_no) FILTER (c < 0.6), [])) AS needs_review_pages FROM r JOIN p USING (doc_id) WHERE page_no BETWEEN a AND b GROUP BY doc_id, section_no""")
def page_range_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence over the page range of each section."""
    sections = chunking.with_sections(lines_of(spark, sf_dir)).groupBy("doc_id", "section_no").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    ranged = sections.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section_no").cast("string")))
    got = chunking.page_quality(ranged, pages_of(spark, sf_dir))
    return got.select("chunk_id", F.round("confidence_min", 6).alias("confidence_min"), F.round("confidence_avg", 6).alias("confidence_avg"), "needs_review_pages")


@query(f"""
WITH {SQL_LINES}, s AS (SELECT doc_id, section_no, CAST(any_value(length(unit)) FILTER (is_title) % 3 + 1 AS INTEGER) AS lv FROM secs WHERE section_no > 0 GROUP BY ALL),
n AS (SELECT a.doc_id, a.section_no, a.lv, b.lv AS plv, max(b.section_no) AS parent FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND b.section_no < a.section_no AND b.lv < a.lv GROUP BY ALL),
l AS (SELECT *, coalesce(max(parent) OVER (PARTITION BY doc_id, section_no ORDER BY plv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < parent AS live FROM n)
SELECT doc_id, section_no, lv AS section_level, coalesce(list(parent ORDER BY plv) FILTER (live), []) AS parents FROM l GROUP BY ALL""")
def section_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of each section; levels from the length of the title."""
    titled = chunking.with_sections(lines_of(spark, sf_dir)).filter("is_title")
    levels = titled.select("doc_id", "section_no", (F.length("unit") % 3 + 1).cast("int").alias("section_level"))
    return chunking.ancestors(levels).drop("gap")


@query(r"""
WITH c AS (SELECT doc_id, string_split_regex(text, '[,\n]') AS ls FROM documents),
b AS (SELECT doc_id, CAST(i AS INTEGER) AS ix, trim(ls[i + 1], e' \t\r') AS unit FROM c, unnest(range(0, len(ls))) AS r(i)),
g AS (SELECT doc_id, ix, regexp_matches(lower(unit), '^(当|因此|所以|并且|同时|其中|则|而|从而|when |therefore |and |also )') OR regexp_matches(unit, '^[a-z]') AS goes_on,
  NOT regexp_matches(unit, '[。！？!?；;.…．]["''”’）】》\]]*$') AS open FROM b)
SELECT s.doc_id, s.ix AS seed_ix, n.ix AS neighbor_ix, n.ix - s.ix AS distance
FROM g s JOIN g n ON s.doc_id = n.doc_id AND (n.ix = s.ix + 1 OR n.ix = s.ix - 1)
WHERE CASE WHEN n.ix < s.ix THEN s.goes_on AND n.open ELSE s.open AND n.goes_on END""")
def neighbor_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring clauses whose texts run on into each other."""
    docs = table(spark, sf_dir, "documents")
    units = docs.select("doc_id", F.posexplode(F.split("text", "[,\n]")).alias("chunk_index", "text")).withColumn("text", text.strip(F.col("text")))
    return evidence.continuous_neighbors(units, 1).select("doc_id", F.col("chunk_index").alias("seed_ix"), F.col("neighbor_index").alias("neighbor_ix"), "distance")


@query()
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy evidence selection a source: ranked by length, near-duplicates out, within a token budget."""
    docs = table(spark, sf_dir, "documents")
    rank = -F.coalesce(F.length("text"), F.lit(0))
    seeds = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", text.evidence_tokens(F.col("text")).alias("tokens"), rank.alias("rank"))
    return evidence.select_evidence(seeds, max_chunks=12, token_budget=60_000)


@query(f"""
WITH {SQL_LINES}, ctx AS (SELECT doc_id AS chunk_id, source, 0.9 AS confidence, 1 AS origin, text FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, source, 0.5, 2, text FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY origin) AS n FROM ctx WHERE trim(text) <> '')
SELECT chunk_id, CAST(coalesce(CASE WHEN chunk_id % 3 = 0 THEN 0.7 END, confidence) AS DOUBLE) AS confidence, CAST(origin AS INTEGER) AS origin FROM r WHERE n = 1""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of two sources: the first source of a chunk wins, a lookup overrides its confidence."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    first = docs.filter("chunk_id % 2 = 0").withColumn("confidence", F.lit(0.9)).withColumn("origin", F.lit(1))
    second = docs.withColumn("confidence", F.lit(0.5)).withColumn("origin", F.lit(2))
    lookup = docs.filter("chunk_id % 3 = 0").select("chunk_id", F.lit(0.7).alias("override"))
    return evidence.merged_rows(first.unionByName(second), lookup).select("chunk_id", "confidence", "origin")


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, 'link' AS kind, link AS body, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL
UNION ALL SELECT page_id, 'text', sha256(html), 1 FROM pages""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row and a row for each distinct asset (here: links) of a page."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.sha2("html", 256).alias("text"), F.regexp_extract_all("html", F.lit(r'(?s)<a [^>]*href="([^"]*)"'), 1).alias("assets"))
    return evidence.rows_with_assets(pages).select(F.col("chunk_id").alias("page_id"), "kind", "body", "n")


SQL_BLOCKS = r"""
blocks AS (SELECT page_id, CAST(i AS INTEGER) AS block_ix, trim(regexp_replace(ls[i + 1], '\s+', ' ', 'g')) AS b
  FROM (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', '', 'g'), e'\n') AS ls FROM pages) p, unnest(range(0, len(ls))) AS r(i))"""


@query(rf"""
WITH {SQL_BLOCKS}, w AS (SELECT *, len(regexp_extract_all(b, '[A-Za-z0-9_]+|[一-鿿]')) AS words, len(regexp_extract_all(b, '[A-Za-z0-9α-ωΑ-Ω]')) AS letters FROM blocks)
SELECT page_id, block_ix, CASE WHEN b = '' THEN 'unknown'
  WHEN regexp_matches(b, '(?i)^\s*(表|Table)\s*(?:[\dIVXivx一二三四五六七八九十]+|\([a-zA-Z]\))?\s*[\-\.．、:：]?') THEN 'table'
  WHEN regexp_matches(b, '(?i)^\s*(图|圖|Fig\.?|Figure)\s*(?:[\dIVXivx一二三四五六七八九十]+|\([a-zA-Z]\))?\s*[\-\.．、:：]?') THEN 'figure'
  WHEN length(replace(b, ' ', '')) >= 3 AND words <= 20 AND letters >= 2 AND (regexp_matches(b, '(=|≈|≠|≤|≥)')
    OR (regexp_matches(b, '\b(?:sin|cos|tan|sqrt|log|exp)\b|[ωΩζπ]') AND regexp_matches(b, '[A-Za-z0-9α-ωΑ-Ω)]\s*(?:\+|\*|/|\^|−)\s*[A-Za-z0-9α-ωΑ-Ω(]'))) THEN 'formula'
  WHEN block_ix < 3 AND words <= 24 AND NOT regexp_matches(b, '^\s*\d+\s*$') AND NOT regexp_matches(b, '(?i)^\s*\d+\.\s+.+(?:\bet\s+al\b|\b19\d{{2}}\b|\b20\d{{2}}\b|,)')
    AND (regexp_matches(b, '(?i)^\s*(第\s*[\d一二三四五六七八九十]+\s*[章节篇]|Chapter\s+\d+)\b') OR regexp_matches(b, '^\s*(?:\d+(?:\.\d+){{0,3}}|[一二三四五六七八九十]+)[\.、]\s*\S+')) THEN 'title'
  ELSE 'body' END AS kind FROM w""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages classified as table, figure, formula, title or body."""
    blocks = blocks_of(spark, sf_dir)
    return blocks.select("page_id", "block_ix", layout.block_kind(F.col("body"), F.col("block_ix") + 1).alias("kind"))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(F.split(F.regexp_replace("html", "<[^>]*>", ""), "\n")).alias("block_ix", "body"))


@query(rf"""
WITH {SQL_BLOCKS}, s AS (SELECT *, CAST(10 + (length(b) * 7) % 5 AS DOUBLE) AS size FROM blocks WHERE b <> ''),
c AS (SELECT page_id, size, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT page_id, arg_min(size, struct_pack(a := -n, b := size)) AS base, max(size) AS top, sum(n) AS blocks FROM c GROUP BY page_id),
f AS (SELECT s.*, base, top, blocks, blocks >= 2 AND size >= base * 1.25 AND length(b) <= 80 AND NOT regexp_matches(b, '[.!?。！？；;]["''”’）】》]*$') AS up FROM s JOIN m USING (page_id))
SELECT page_id, block_ix, CASE WHEN up AND size >= top - 0.1 THEN 'title' WHEN up THEN 'label' ELSE 'body' END AS role FROM f""")
def font_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short blocks in a larger font than the page's most frequent one."""
    blocks = blocks_of(spark, sf_dir).withColumn("body", text.squeeze(F.col("body"))).filter("body <> ''")
    sized = blocks.withColumn("font", (F.lit(10) + F.length("body") * 7 % 5).cast("double"))
    return layout.font_roles(sized, "page_id").select("page_id", "block_ix", "role")


@query(r"""
WITH l AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*\.([a-z]+)/', 1) AS host, page_id, trim(x) AS line FROM (SELECT page_id, url, unnest(string_split(html, '>')) AS x FROM pages)),
c AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l WHERE line <> '' GROUP BY ALL), s AS (SELECT host, count(DISTINCT page_id) AS pages FROM l GROUP BY host)
SELECT host, line AS signature, CAST(n AS BIGINT) AS n_pages FROM c JOIN s USING (host) WHERE n >= 3 AND n / pages >= 0.5""")
def repeated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that half of the pages of a top-level domain share."""
    pages = table(spark, sf_dir, "pages")
    lines = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)/", 1).alias("host"), "page_id", F.explode(F.split("html", ">")).alias("line"))
    return layout.repeated_signatures(lines.select("host", "page_id", F.trim("line").alias("signature")), "host", "page_id")


def _drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as layouts: each tag a small box, each run of text a block, both placed by their number."""
    pages = table(spark, sf_dir, "pages")
    width = 595.0
    box = lambda k, n: F.array(60 + (k * 13 % 31) * 4.0, 90 + (k * 29 % 23) * 5.0, 63.0 + (k * 13 % 31) * 4.0 + n % 9, 93.0 + (k * 29 % 23) * 5.0 + F.when(n % 8 == 0, 2.0).otherwise(0.0))
    images = F.transform(F.split("html", "<"), lambda tag, k: box(k, F.length(tag)))
    runs = F.filter(F.split(F.regexp_replace("html", "(?s)<[^>]*>", "\n"), "\n"), lambda x: F.trim(x) != "")
    blocks = F.transform(runs, lambda x, k: F.struct(F.array(F.lit(70.0), 50.0 + k * 14.0, 80.0 + F.length(x) % 400, 62.0 + k * 14.0).alias("box"), x.alias("text")))
    return pages.select("page_id", F.lit(width).alias("width"), F.lit(842.0).alias("height"), images.alias("images"), blocks.alias("blocks"))


@query()
def visual_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of tiny boxes on the bodies of pages."""
    found = layout.page_visuals(_drawn_pages(spark, sf_dir))
    # A plain explode gets a filter on the size of its array, for which the clusters would be made a second time.
    rows = found.select("page_id", F.posexplode_outer("clusters").alias("cluster_ix", "c")).filter("cluster_ix IS NOT NULL")
    return rows.select("page_id", "cluster_ix", "c.*")


@query(r"""
WITH r AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(html, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(string_split(regexp_replace(html, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS k FROM pages),
b AS (SELECT page_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x, 70.0 AS x0, 50.0 + k * 14.0 AS y0, 80.0 + length(x) % 400 AS x1, 62.0 + k * 14.0 AS y1 FROM r),
i AS (SELECT page_id, sum(length(x)) AS letters, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE x <> '' AND y1 > 842.0 * 0.08 AND y0 < 842.0 * 0.92 GROUP BY page_id),
c AS (SELECT page_id, sum(length(x)) AS chars FROM b GROUP BY page_id),
g AS (SELECT page_id, letters >= 100 AND n >= 3 AS ok, greatest(595.0 * 0.05, x0 - 24) AS x0, greatest(842.0 * 0.08, y0 - 24) AS y0, least(595.0 * 0.95, x1 + 24) AS x1, least(842.0 * 0.92, y1 + 24) AS y1 FROM i),
e AS (SELECT page_id, CASE WHEN ok THEN x0 ELSE 595.0 * 0.05 END AS x0, CASE WHEN ok THEN y0 ELSE 842.0 * 0.08 END AS y0, CASE WHEN ok THEN x1 ELSE 595.0 * 0.95 END AS x1, CASE WHEN ok THEN y1 ELSE 842.0 * 0.92 END AS y1 FROM pages LEFT JOIN g USING (page_id)),
t AS (SELECT page_id, unnest(string_split(html, '<')) AS tag, generate_subscripts(string_split(html, '<'), 1) - 1 AS k FROM pages),
m AS (SELECT page_id, 60 + (k * 13 % 31) * 4.0 AS x0, 90 + (k * 29 % 23) * 5.0 AS y0, 63.0 + (k * 13 % 31) * 4.0 + length(tag) % 9 AS x1, 93.0 + (k * 29 % 23) * 5.0 + CASE WHEN length(tag) % 8 = 0 THEN 2 ELSE 0 END AS y1 FROM t),
o AS (SELECT DISTINCT page_id, cx, unnest(range(CAST(floor(y0 / 4) AS BIGINT), CAST(floor((y1 - 1e-9) / 4) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(x0 / 4) AS BIGINT), CAST(floor((x1 - 1e-9) / 4) AS BIGINT) + 1)) AS cx FROM m)),
v AS (SELECT page_id, count(*) AS covered FROM o GROUP BY page_id), n AS (SELECT page_id, count(*) AS n_images, count(*) FILTER (x1 - x0 < 4 OR y1 - y0 < 4) AS n_tiny FROM m GROUP BY page_id)
SELECT page_id, CAST(coalesce(chars, 0) AS INTEGER) AS native_text_chars, CAST(n_images AS INTEGER) AS n_images, CAST(n_tiny AS INTEGER) AS n_tiny, round(CAST(n_tiny AS DOUBLE) / n_images, 6) AS tiny_ratio, round(least(1.0, covered * 16.0 / greatest((x1 - x0) * (y1 - y0), 1.0)), 6) AS coverage,
  CAST(round(x0, 6) AS DOUBLE) AS body_x0, CAST(round(y0, 6) AS DOUBLE) AS body_y0, CAST(round(x1, 6) AS DOUBLE) AS body_x1, CAST(round(y1, 6) AS DOUBLE) AS body_y1
FROM e JOIN n USING (page_id) JOIN v USING (page_id) LEFT JOIN c USING (page_id)""")
def page_visual_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, images, body region and coverage of each page."""
    found = layout.page_visuals(_drawn_pages(spark, sf_dir))
    region = [F.round(F.col("body_region")[k], 6).alias(f"body_{name}") for k, name in enumerate(("x0", "y0", "x1", "y1"))]
    return found.select("page_id", "native_text_chars", "n_images", "n_tiny", F.round("tiny_ratio", 6).alias("tiny_ratio"), F.round("coverage", 6).alias("coverage"), *region)


@query(r"""
WITH p AS (SELECT page_id, length(regexp_replace(html, '\s', '', 'g')) AS chars, len(string_split(html, '<')) AS boxes FROM pages)
SELECT page_id, CAST(chars AS BIGINT) AS meaningful_chars, round(chars / (595.0 * 842.0) * 1000, 6) AS density, chars < 40 OR chars / (595.0 * 842.0) * 1000 < 0.2 AS needs_ocr FROM p""")
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text density of a page and whether it needs OCR."""
    chars = F.length(F.regexp_replace("html", r"\s", "")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", *layout.density_profile(chars, F.lit(595.0), F.lit(842.0)))


def _sql_kept(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: regexp_replace(p, '{biblio.EDGES}', '', 'g')), lambda p: p <> '')"


def _sql_authors(raw: str) -> str:
    segments = _sql_kept(f"regexp_split_to_array({raw}, '(?i){biblio.SEPARATOR}')")
    inverted = biblio.INVERTED.replace("'", "''")
    return f"flatten(list_transform({segments}, lambda s: CASE WHEN regexp_matches(s, '{inverted}') THEN [s] ELSE {_sql_kept("regexp_split_to_array(s, '" + chr(92) + "s*," + chr(92) + "s*')")} END))"


SQL_HOUSES = " OR ".join(f"contains(lower(x), '{name}')" for name in biblio.PUBLISHERS)


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, regexp_split_to_array(t, '{biblio.LINE_ENDS}') AS ls FROM d),
n AS (SELECT *, list_filter(list_transform(ls, lambda x: coalesce(nullif(regexp_extract(x, '{biblio.AUTHOR_LABEL}', 1), ''), nullif(regexp_extract(x, '{biblio.BYLINE}', 1), ''))), lambda x: x IS NOT NULL) AS named,
  list_filter(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND length(x) <= {biblio.LONGEST_PRESS_LINE}
    AND (regexp_matches(x, '{biblio.PUBLISHER_LABEL}') OR regexp_matches(x, '{biblio.PRESS_LINE}') OR {SQL_HOUSES}))[1] AS line FROM l)
SELECT doc_id, CAST(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9][0-9]'))[1] AS INTEGER) AS year,
  coalesce(list_filter(list_transform(named, lambda r: {_sql_authors('r')}), lambda a: len(a) > 0)[1], []) AS authors,
  coalesce(nullif(regexp_extract(t, '{biblio.PRESS_HAN}'), ''), nullif(trim(regexp_extract(line, '{biblio.PUBLISHER_LABEL}', 1)), ''), line) AS publisher FROM n""")
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, authors and publisher that a document names in its text."""
    named = table(spark, sf_dir, "documents").select("doc_id", biblio.from_text(F.col("text")).alias("b"))
    return named.select("doc_id", "b.*")


@query()
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents after the repair of UTF-8 that was read as GB 18030, and whether it changed them."""
    t = F.col("text")
    mended = table(spark, sf_dir, "documents").select("doc_id", t, text.gb_repaired(t).alias("mended"))
    return mended.select("doc_id", F.sha2("mended", 256).alias("text_sha256"), (~t.eqNullSafe(F.col("mended"))).alias("changed"))


@query(rf"""
WITH {SQL_LINES}, p AS (SELECT DISTINCT doc_id, page_no, (50 + (doc_id * 7 + page_no * 13) % 50) / 100.0 AS c FROM lines),
r AS (SELECT doc_id, section_no, min(page_no) AS a, max(page_no) AS b, arg_min(unit, para_ix) AS title FROM secs GROUP BY ALL),
z AS (SELECT doc_id, section_no, a, b, any_value(title) AS title, min(c) AS least FROM r JOIN p USING (doc_id) WHERE page_no BETWEEN a AND b GROUP BY doc_id, section_no, a, b),
s AS (SELECT *, regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^ | $', '', 'g') AS line FROM z)
SELECT doc_id || ':' || section_no AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, list_transform(range(a, b + 1), lambda x: CAST(x AS INTEGER)) AS pages, 'documented' AS evidence_type, CAST(least AS DOUBLE) AS confidence,
  CAST(NULL AS VARCHAR) AS source_filename, nullif(title, '') AS source_title, nullif(CASE WHEN length(line) > 180 THEN rtrim(substr(line, 1, 180)) || '…' ELSE line END, '') AS snippet FROM s""")
def section_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation of each section: its pages, the least confidence of them, its first line as title and snippet."""
    rows = chunking.with_sections(lines_of(spark, sf_dir)).groupBy("doc_id", "section_no")
    sections = rows.agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.min_by("unit", "para_ix").alias("title"))
    named = sections.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section_no").cast("string")))
    graded = chunking.page_quality(named.drop("title"), pages_of(spark, sf_dir)).select("chunk_id", F.col("confidence_min").alias("ocr_confidence_min"))
    return evidence.cited(named.join(graded, "chunk_id").withColumn("text", F.col("title")))
