"""Queries of the text expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import redact, text
from marginalia.operators import retrieval
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


SQL_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9_]+(?:[-./][a-z0-9_]+)*')"
SQL_TOKENS = f"""flatten(list_transform({SQL_WORDS}, lambda w:
    CASE WHEN regexp_matches(w, '[-./]') THEN list_concat([w], list_filter(string_split_regex(w, '[-./]+'), lambda p: p <> '')) ELSE [w] END))"""
SQL_ESTIMATE = r"""greatest(1, CAST(floor(
    len(regexp_extract_all({0}, '[一-鿿]')) + len(regexp_extract_all({0}, '[A-Za-z0-9_]+(?:[-./][A-Za-z0-9_]+)*')) * 1.25
    + (length({0}) - len(regexp_extract_all({0}, '[一-鿿]'))) / 6) AS INTEGER))"""


@query(f"""
WITH t AS (SELECT doc_id, unnest({SQL_TOKENS}) AS term FROM documents)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM t GROUP BY doc_id, term""")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequencies of every document."""
    return retrieval.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
SELECT doc_id, {SQL_ESTIMATE.format('text')} AS estimated,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS prompt,
  CAST(greatest(1, ceil(length(trim(text, e' \\t\\n\\r')) / 4)) AS INTEGER) AS evidence
FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three token estimators side by side."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.estimated_tokens(c).alias("estimated"),
        text.prompt_tokens(c).alias("prompt"),
        text.evidence_tokens(c).alias("evidence"),
    )


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(0), ''), e'\r\n?', e'\n', 'g'), '[ \t]+', ' ', 'g'),
       e'\n{3,}', e'\n\n', 'g'), e' \t\n\r\x0b\x0c') AS body
FROM pages""")
def page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with line ends, blanks and empty lines normalised."""
    return table(spark, sf_dir, "pages").select("page_id", text.normalized_page(F.col("html")).alias("body"))


@query(r"""
WITH marked AS (SELECT doc_id, regexp_replace(trim(text, e' \t\n\r'), e'([.!?。！？；;])\n', e'\\1\x1e', 'g') AS m FROM documents),
parts AS (SELECT doc_id, string_split_regex(m, e'\n\\s*\n|\x1e') AS p FROM marked),
units AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, e'[ \t\r\f\x0b]+', ' ', 'g'), e' \t\n\r')), lambda x: x <> '') AS u FROM parts)
SELECT doc_id, CAST(i AS INTEGER) AS unit_ix, u[i + 1] AS unit FROM units, unnest(range(0, len(u))) AS r(i)""")
def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at blank lines and after lines that end a sentence."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.text_units(F.col("text"))).alias("unit_ix", "unit"))


@query(r"""
WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[一-鿿]')) AS han, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)
SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 'unknown'
  WHEN han / greatest(han + latin, 1) >= 0.25 AND latin / greatest(han + latin, 1) >= 0.25 THEN 'mixed'
  WHEN han / greatest(han + latin, 1) >= 0.30 THEN 'zh' WHEN latin / greatest(han + latin, 1) >= 0.60 THEN 'en' ELSE 'unknown' END AS detected
FROM c""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("detected"))


@query(r"""
SELECT source, CASE WHEN count(*) FILTER (lang = 'zh') > count(*) FILTER (lang = 'en') THEN 'zh' WHEN count(*) FILTER (lang = 'en') > count(*) FILTER (lang = 'zh') THEN 'en'
  WHEN sum(len(regexp_extract_all(text, '[一-鿿]'))) >= sum(len(regexp_extract_all(text, '[A-Za-z]'))) THEN 'zh' ELSE 'en' END AS dominant
FROM documents GROUP BY source""")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(text.dominant_language(F.col("lang"), F.col("text")).alias("dominant"))


SQL_LINE = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"


@query(rf"""
WITH lines AS (SELECT d.doc_id, d.source, CAST(r.i AS BIGINT) AS line_no, trim(string_split(d.text, e'\n')[r.i], e' \t\r') AS line
  FROM documents d, unnest(range(1, len(string_split(d.text, e'\n')) + 1)) AS r(i)),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down FROM lines WHERE line <> ''),
edges AS (SELECT source, doc_id, line FROM filled WHERE up <= 3 UNION ALL SELECT source, doc_id, line FROM filled WHERE down <= 3),
counted AS (SELECT source, {SQL_LINE} AS edge_line, count(*) AS n FROM edges GROUP BY 1, 2),
sizes AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT source, edge_line, CAST(n AS BIGINT) AS n FROM counted JOIN sizes USING (source)
WHERE length(edge_line) BETWEEN 3 AND 120 AND NOT regexp_matches(edge_line, '^[0-9]+$') AND n >= greatest(3, CAST(floor(pages * 0.2) AS INTEGER))""")
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers: first and last three lines that many documents of a source share."""
    return repeated_edges(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def repeated_edges(pages: DataFrame, book: str, page: str, body: str, share: float = 0.2) -> DataFrame:
    """Edge lines that at least max(3, share of the book's pages) edges hold.

    A page of fewer than six lines can give one line twice, at either edge.
    """
    lines = F.filter(F.transform(F.split(body, "\n"), text.strip), lambda x: x != "")
    edges = pages.select(book, page, lines.alias("lines")).select(
        book,
        F.explode(F.concat(F.slice("lines", 1, 3), F.when(F.size("lines") <= 3, F.col("lines")).otherwise(F.slice("lines", -3, 3)))).alias("line"),
    )
    counted = edges.groupBy(book, text.squeeze(F.col("line")).alias("edge_line")).agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy(book).agg(F.count(F.lit(1)).alias("pages"))
    enough = F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))
    usable = F.length("edge_line").between(3, 120) & ~F.col("edge_line").rlike("^[0-9]+$")
    return counted.filter(usable).join(sizes, book).filter(enough).select(book, "edge_line", "n")


@query(r"""
WITH m AS (SELECT doc_id, lang, length(text) AS n, len(regexp_extract_all(text, '[一-鿿]')) AS han,
  len(regexp_extract_all(text, '[ÃÂ�¤¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿çåèéã\x{80}-\x{9f}]')) AS marks FROM documents)
SELECT doc_id, lang, han = 0 AND marks >= 6 AND marks / greatest(n, 1) >= 0.02 AS garbled FROM m""")
def garbled_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.garbled(F.col("text")).alias("garbled"))


@query(r"""
WITH m AS (SELECT doc_id, text, length(text) - length(replace(text, 'Ã', '')) + length(text) - length(replace(text, 'Â', ''))
  + length(text) - length(replace(text, 'â', '')) + length(text) - length(replace(text, '�', '')) AS hits FROM documents)
SELECT doc_id, contains(text, '�') OR hits >= 3 OR (hits >= 2 AND hits / greatest(length(text), 1) >= 0.01) AS garbled FROM m""")
def garbled_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.garbled_strict(F.col("text")).alias("garbled"))


@query(r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, text FROM documents)
SELECT doc_id, CASE WHEN line = '' THEN NULL WHEN length(line) <= 180 THEN line ELSE rtrim(substr(line, 1, 180)) || '…' END AS preview,
  CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 99) || '…' END AS shortened FROM s""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(c).alias("preview"), text.truncated(c, 100).alias("shortened"))


@query(r"""
SELECT doc_id, sha256(text) AS text_hash FROM documents""")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(r"""
WITH h AS (SELECT source, doc_id // 1024 AS page, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), e'\n' ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT source, page // 1024 AS book, sha256(string_agg(d, e'\n' ORDER BY page)) AS d, sum(n) AS n FROM h GROUP BY ALL)
SELECT source, sha256(string_agg(d, e'\n' ORDER BY book)) AS corpus_hash, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY source""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a source, in three levels: digests of 1,024 keys, of 1,024 of those, and of the rest in order, so that rows stay small."""
    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1024).alias("page"), F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("d")).alias("x"), F.lit(1).cast("long").alias("n"))
    pages = _digested(docs, "source", "page").select("source", F.floor(F.col("page") / 1024).alias("book"), F.struct("page", "d").alias("x"), "n")
    books = _digested(pages, "source", "book").select("source", F.struct("book", "d").alias("x"), "n")
    return _digested(books, "source").select("source", F.col("d").alias("corpus_hash"), "n")


def _digested(rows: DataFrame, *keys: str) -> DataFrame:
    """The digest of the values x.d of a group in the order of x, and the sum of n."""
    values = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(values, "\n"), 256).alias("d"), F.sum("n").alias("n"))


@query(r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g') AS a FROM documents),
k AS (SELECT doc_id, regexp_replace(a, '(?i)\b([A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*)\s*=\s*[^,\s;]+', '\1=[redacted]', 'g') AS a FROM b),
w AS (SELECT doc_id, regexp_replace(a, '\b[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\s\r\n]*', '[local-path]', 'g') AS a FROM k),
p AS (SELECT doc_id, regexp_replace(a, '(^|[^A-Za-z0-9_])/(?:Users|home|tmp|var|private|mnt)(?:/[^\s,;]+)+', '\1[local-path]', 'g') AS a FROM w)
SELECT doc_id, CASE WHEN length(a) > 2000 THEN '[redacted-long-text]' ELSE a END AS masked FROM p""")
def redact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.for_log(F.col("text"), 2000).alias("masked"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, 'sk-[A-Za-z0-9_-]{16,}', '[REDACTED]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, 'gh[pousr]_[A-Za-z0-9]{20,}', '[REDACTED]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(?i)\bbearer\s+[A-Za-z0-9._\-]{10,}', 'Bearer [REDACTED]', 'g') AS t FROM c)
SELECT doc_id, regexp_replace(t, '(?i)\b(api[_-]?key|apikey|access[_-]?token|secret|password)(\s*[:=]\s*)(\S+)', '\1\2[REDACTED]', 'g') AS masked FROM d""")
def redact_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.secrets(F.col("text")).alias("masked"))


@query(r"""
WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|x-api-key)(\s*[:=]\s*)([A-Za-z0-9_\-]{8,})', '\1\2[REDACTED]', 'g'),
  '(?i)(authorization|bearer)(\s*[:=]?\s*)(Bearer\s+)?([A-Za-z0-9._\-]{8,})', '\1\2[REDACTED]', 'g') AS a FROM documents),
p AS (SELECT doc_id, text, regexp_replace(regexp_replace(a, '[A-Za-z]:\\[^\s"'']+', '[REDACTED_LOCAL_PATH]', 'g'), '(^|[^\w.])/(?:Users|home|var|tmp|mnt)/[^\s"'']+', '\1[REDACTED_LOCAL_PATH]', 'g') AS a FROM c),
f AS (SELECT doc_id, a, text, regexp_replace(text, '(^|[^\w:])/(?:Users|home|tmp|var|mnt|opt|private|Volumes)/[^\s\r\n"'']+', '\1[REDACTED_PATH]', 'g') AS b FROM p),
w AS (SELECT doc_id, a, text, regexp_replace(regexp_replace(b, '(?i)\b[A-Z]:[\\/][^\s\r\n"''<>|?*]+', '[REDACTED_PATH]', 'g'), '\\\\[^\\/\s]+[\\/][^\s\r\n"''<>|?*]+', '[REDACTED_PATH]', 'g') AS b FROM f)
SELECT doc_id, CASE WHEN length(a) > 1200 THEN substr(a, 1, 1200) || '...[TRUNCATED]' ELSE a END AS capture,
  CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '...[TRUNCATED]' WHEN contains(text, 'Bearer ') THEN 'Bearer [REDACTED]' ELSE b END AS fixture FROM w""")
def redact_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule sets of captured searches and of recorded answers."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", redact.for_capture(c, 1200).alias("capture"), redact.for_fixture(c, 4000).alias("fixture"))


@query(r"""
WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:gb\s*[/∕]?\s*t|gbt|dl\s*[/∕]?\s*t|dlt|iso|api)[\s_-]*\d{3,6}(?:\.\d+)*')) AS m FROM pages),
k AS (SELECT page_id, regexp_replace(lower(m), '[\s/∕_-]', '', 'g') AS b FROM f)
SELECT DISTINCT page_id, CASE regexp_extract(b, '^(gbt|dlt|iso|api)', 1) WHEN 'gbt' THEN 'GB/T' WHEN 'dlt' THEN 'DL/T' WHEN 'iso' THEN 'ISO' ELSE 'API' END
  || ' ' || regexp_extract(b, '^[a-z]+(\d{3,6})', 1) AS standard FROM k""")
def standard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards that pages name, as a catalogue of (page, standard)."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.standard_ids(F.col("html"))).alias("standard"))


@query(r"""
WITH d AS (SELECT DISTINCT source, doc_id AS page FROM documents),
g AS (SELECT source, page, page - row_number() OVER (PARTITION BY source ORDER BY page) AS island FROM d),
r AS (SELECT source, min(page) AS a, max(page) AS b FROM g GROUP BY source, island)
SELECT source, a AS first_page, b AS last_page, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END AS run FROM r""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive document numbers a source, one row a run; no task numbers a whole source."""
    return consecutive_runs(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page")), "source", "page").select(
        "source", F.col("first").alias("first_page"), F.col("last").alias("last_page"), "run"
    )


def consecutive_runs(pages: DataFrame, group: str, page: str, block: int = 4096) -> DataFrame:
    """Runs of consecutive numbers of a group: group, first, last, run (1-3 or 5).

    Runs are found inside blocks of numbers; of those only the ones that touch a block's edge can
    join, and of them there are two a block at most.
    """
    distinct = pages.select(group, F.col(page).alias("_p"), F.floor(F.col(page) / block).alias("_b")).distinct()
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_p"))
    parts = distinct.withColumn("_i", F.col("_p") - inside).groupBy(group, "_b", "_i").agg(F.min("_p").alias("_x"), F.max("_p").alias("_y"))
    edge = (F.pmod(F.col("_x"), F.lit(block)) == 0) | (F.pmod(F.col("_y") + 1, F.lit(block)) == 0)
    in_order = Window.partitionBy(group).orderBy("_x")
    opens = F.coalesce((F.lag("_y").over(in_order) + 1 != F.col("_x")).cast("int"), F.lit(1))
    edges = parts.filter(edge).withColumn("_o", opens).withColumn("_r", F.sum("_o").over(in_order))
    joined = edges.groupBy(group, "_r").agg(F.min("_x").alias("first"), F.max("_y").alias("last")).drop("_r")
    runs = joined.unionByName(parts.filter(~edge).select(group, F.col("_x").alias("first"), F.col("_y").alias("last")))
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return runs.withColumn("run", label)


@query(r"""
WITH l AS (SELECT page_id, list_filter(list_transform(string_split(html, e'\n'), lambda x: trim(x, e' \t\r')), lambda x: x <> '' AND NOT regexp_matches(x, '^#|:$')) AS lines FROM pages)
SELECT page_id, CASE WHEN len(lines) = 0 THEN 1.0 ELSE len(list_filter(lines, lambda x: regexp_matches(x, '[。！？!?；;.…．]["''”’）】》\]]*$'))) / len(lines) END AS share FROM l""")
def complete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.complete_line_share(F.col("html")).alias("share"))


@query(r"""
SELECT page_id, regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '[^A-Za-z0-9]+', '-', 'g') AS name,
  rtrim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') || '_' || substr(sha256(html), 1, 8) AS stable_id FROM pages""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace(text.basename(F.col("url")), "[^A-Za-z0-9]+", "-").alias("name"), text.stable_id(F.col("url"), F.col("html")).alias("stable_id"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '[{}]') AS ls FROM pages),
d AS (SELECT page_id, list_transform(ls, lambda x: CASE x WHEN '{' THEN 1 ELSE -1 END) AS steps FROM l),
s AS (SELECT page_id, list_transform(range(1, len(steps) + 1), lambda k: list_sum(steps[1:k])) AS depth FROM d)
SELECT page_id, len(depth) > 0 AND (depth[-1] <> 0 OR list_min(depth) < 0) AS unbalanced FROM s""")
def formula_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the braces of each page's text are balanced."""
    return table(spark, sf_dir, "pages").select("page_id", text.unbalanced_braces(F.col("html")).alias("unbalanced"))
