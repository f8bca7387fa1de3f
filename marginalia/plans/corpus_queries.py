"""Queries over sentences of segments, deletions in the store and audits of a corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import audit, sentences
from marginalia.session import table
from marginalia.sources import cascades, stores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


FINAL_SQL = """[。！？!?；;….．]["''”’）】》]*$"""
OWN_LABEL = rf"""regexp_matches(line, '^\d+(\.\d+)+$') OR regexp_matches(line, '^\d{{1,4}}$')
  OR regexp_matches(line, '^(?:\d+(?:\.\d+)*\s+\S|第.+[章节条部分](?:\s|$)|[（(]\d+[)）]|[-•·]\s+|[A-Z][A-Z0-9 _./:-]{{2,}}$|.{{0,30}}(?:概述|样本)$|.*\d{{2,}}[A-Z]\d+.*修订版|[^。！？!?；;]{{1,40}}[•·][^。！？!?；;]{{1,40}}$|\[\d+\]\s*\S+)')
  OR (length(line) <= 16 AND NOT regexp_matches(line, '{FINAL_SQL}') AND NOT regexp_matches(line, '是|为|表示|用于|产生|影响|规定|提供|支持|增大|减小')
      AND length(regexp_replace(line, '[^一-鿿]', '', 'g')) >= greatest(2, length(line) // 2))"""


def _sentences_sql(source: str, key: str) -> str:
    """Sentences of (id, body): lines by number, units by recursion over them, split at their points."""
    return rf"""
WITH RECURSIVE b AS ({source}),
p AS (SELECT id, unnest(ps) AS para, generate_subscripts(ps, 1) AS pi FROM (SELECT id, string_split_regex(body, '\n\s*\n') AS ps FROM b)),
ll AS (SELECT id, pi, list_filter(list_transform(string_split_regex(para, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_stripped("regexp_replace(x, '[ \t]+', ' ', 'g')")}), lambda x: x <> '') AS ls FROM p),
l AS (SELECT id, pi, unnest(ls) AS line, generate_subscripts(ls, 1) AS li FROM ll),
o AS (SELECT *, {OWN_LABEL} AS own, regexp_matches(line, '{FINAL_SQL}') AS closes FROM l),
n AS (SELECT id, pi, li, line, row_number() OVER (PARTITION BY id ORDER BY pi, li) AS k, lag(closes) OVER w AS before,
  own OR coalesce(line = lag(line) OVER w, false) OR coalesce(line = lead(line) OVER w, false) OR coalesce(regexp_matches(lag(line) OVER w, '^\d+(\.\d+)+$'), false) AS label
  FROM o WINDOW w AS (PARTITION BY id, pi ORDER BY li)),
r AS (SELECT id, k, CAST(1 AS BIGINT) AS g, line AS u, label FROM n WHERE k = 1 UNION ALL
  SELECT id, k, CASE WHEN apart THEN g + 1 ELSE g END, CASE WHEN apart THEN line WHEN regexp_matches(u, '-$') AND regexp_matches(line, '^[A-Za-z]') THEN left(u, -1) || line
    WHEN regexp_matches(u, '[A-Za-z0-9]$') AND regexp_matches(line, '^[A-Za-z0-9]') THEN u || ' ' || line ELSE u || line END, label
  FROM (SELECT n.id, n.k, r.g, r.u, n.line, n.label, r.label OR n.label OR CASE WHEN n.li > 1 THEN n.before ELSE regexp_matches(r.u, '{FINAL_SQL}') OR NOT (length(r.u) >= 18 OR regexp_matches(n.line, '^[一-鿿]{{1,2}}[，、；：。]')) END AS apart
    FROM r JOIN n ON n.id = r.id AND n.k = r.k + 1)),
u AS (SELECT id, g, arg_max(u, k) AS u FROM r WHERE NOT label GROUP BY id, g),
m AS (SELECT id, g, string_split(regexp_replace(regexp_replace(u, '([。！？!?；;…．])[\s\p{{Z}}]*', '\1' || chr(30), 'g'), '\.[\s\p{{Z}}]+', '.' || chr(30), 'g'), chr(30)) AS ss FROM u),
s AS (SELECT id, g, trim(regexp_replace(unnest(ss), '[\s\p{{Z}}]+', ' ', 'g')) AS sentence, generate_subscripts(ss, 1) AS i FROM m)
SELECT id AS {key}, CAST(row_number() OVER (PARTITION BY id ORDER BY g, i) - 1 AS INTEGER) AS sentence_ix, sentence FROM s WHERE length(sentence) >= 2 AND NOT regexp_matches(sentence, '^司[A-Z]')"""


BLOCK = r"<(h[1-6]|li|p)(?:\s[^>]*)?>([^<]*)"
SEGMENT = "array<struct<text:string,start:int,end:int,block_type:string,layout_role:string>>"


@query(_sentences_sql(rf"""SELECT page_id AS id, {_stripped("array_to_string(list_filter(list_transform(list_filter(list_zip(regexp_extract_all(html, '" + BLOCK + "', 1), regexp_extract_all(html, '" + BLOCK + "', 2)), lambda x: x[1] = 'p'), lambda x: " + _stripped("x[2]") + "), lambda x: x <> ''), chr(10) || chr(10))")} AS body FROM pages""", "page_id"))
def segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pages whose blocks are segments: headings are titles, list entries are labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1)).alias("tags"), F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2)).alias("bodies"))
    none = F.lit(None)
    segments = F.transform(
        F.arrays_zip("tags", "bodies"),
        lambda b: F.struct(b["bodies"], none, none, F.when(F.startswith(b["tags"], F.lit("h")), sentences.TITLE).otherwise("text"), F.when(b["tags"] == "li", "label").otherwise("body")),
    )
    found = sentences.segment_sentences(F.array_join("bodies", "\n\n"), segments.cast(SEGMENT))
    return pages.select("page_id", F.posexplode(found).alias("sentence_ix", "sentence"))


@query(_sentences_sql(f"SELECT doc_id AS id, CASE WHEN left(t, 1) = '[' AND contains(t, ']' || chr(10)) THEN {_stripped('substr(t, instr(t, chr(93) || chr(10)) + 2)')} ELSE t END AS body FROM (SELECT doc_id, {_stripped('text')} AS t FROM documents)", "doc_id"))
def line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that come without segments, from their lines alone."""
    found = sentences.segment_sentences(F.col("text"), F.lit(None).cast(SEGMENT))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("sentence_ix", "sentence"))


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Conversations as documents; a turn is a section under the turn before it, a chunk of the section of the last question, and a citation."""
    turns = table(spark, sf_dir, "conversations")
    ids, turn = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn")
    asked = F.when(F.col("role") == "assistant", ids - 1).otherwise(ids)
    return {
        "documents": stores.stored(turns.select(F.col("conv_id").alias("id")).distinct(), "documents"),
        "document_sections": stores.stored(turns.select(ids.alias("id"), F.col("conv_id").alias("doc_id"), F.when(turn > 0, ids - 1).alias("parent_id"), F.col("role").alias("heading")), "document_sections"),
        "chunks": stores.stored(turns.select(ids.alias("id"), F.col("conv_id").alias("doc_id"), asked.alias("section_id"), "text"), "chunks"),
        "citations": stores.stored(turns.select(ids.alias("id"), F.col("role").alias("answer_id"), ids.alias("chunk_id")), "citations"),
    }


SQL_STORE = """t AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS id FROM conversations),
sections AS (SELECT id, conv_id AS doc_id, CASE WHEN turn > 0 THEN id - 1 END AS parent_id, text FROM t),
chunks AS (SELECT id, conv_id AS doc_id, CASE WHEN role = 'assistant' THEN id - 1 ELSE id END AS section_id FROM t),
gone_documents AS (SELECT conv_id AS id FROM conversations WHERE role = 'system')"""


@query(f"""
WITH RECURSIVE {SQL_STORE},
gone_sections AS (SELECT id FROM sections WHERE doc_id IN (FROM gone_documents) OR length(text) < 60 UNION SELECT s.id FROM sections s JOIN gone_sections g ON s.parent_id = g.id)
SELECT 'documents' AS table_name, conv_id AS id, CAST(NULL AS BIGINT) AS refers_to FROM (SELECT DISTINCT conv_id FROM t) WHERE conv_id NOT IN (FROM gone_documents)
UNION ALL SELECT 'document_sections', id, parent_id FROM sections WHERE id NOT IN (FROM gone_sections)
UNION ALL SELECT 'chunks', id, CASE WHEN section_id NOT IN (FROM gone_sections) THEN section_id END FROM chunks WHERE doc_id NOT IN (FROM gone_documents)
UNION ALL SELECT 'citations', id, id FROM chunks WHERE doc_id NOT IN (FROM gone_documents)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without conversations that have a system turn and without short turns and what follows them."""
    tables = _store(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations")
    start = {
        "documents": turns.filter(F.col("role") == "system").select(F.col("conv_id").alias("id")),
        "document_sections": turns.filter(F.length("text") < 60).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")),
    }
    left = cascades.without(tables, cascades.deleted(tables, start))
    shown = {"documents": F.lit(None).cast("long"), "document_sections": F.col("parent_id"), "chunks": F.col("section_id"), "citations": F.col("chunk_id")}
    parts = [left[name].select(F.lit(name).alias("table_name"), "id", column.alias("refers_to")) for name, column in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""
WITH {SQL_STORE}, left_sections AS (FROM sections WHERE doc_id NOT IN (FROM gone_documents) AND length(text) >= 60)
SELECT 'document_sections' AS table_name, 'parent_id' AS column_name, parent_id AS value, CAST(count(*) AS BIGINT) AS n FROM left_sections WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM left_sections) GROUP BY ALL
UNION ALL SELECT 'chunks', 'doc_id', doc_id, count(*) FROM chunks WHERE doc_id IN (FROM gone_documents) GROUP BY ALL
UNION ALL SELECT 'chunks', 'section_id', section_id, count(*) FROM chunks WHERE section_id IS NOT NULL AND section_id NOT IN (SELECT id FROM left_sections) GROUP BY ALL""")
def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would refer to nothing if the same conversations and short turns went without a cascade."""
    tables = _store(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations")
    gone = turns.filter(F.col("role") == "system").select("conv_id")
    short = turns.filter(~(F.length("text") >= 60)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    tables["documents"] = tables["documents"].join(gone, F.col("id") == F.col("conv_id"), "left_anti")
    tables["document_sections"] = tables["document_sections"].join(gone, F.col("doc_id") == F.col("conv_id"), "left_anti").join(short, "id", "left_anti")
    return cascades.orphans(tables)


FOREIGN = ("ñ", "ß", "ç")


@query("""
WITH v AS (SELECT doc_id, 'lang' AS path, [lang] AS vs FROM documents UNION ALL SELECT doc_id, 'body[].line', string_split(text, chr(10)) FROM documents
  UNION ALL SELECT doc_id, 'origin{key}', ['source'] FROM documents UNION ALL SELECT doc_id, 'origin{}', [source] FROM documents),
c AS (SELECT doc_id, path, len(vs) AS n, list_filter(vs, lambda x: trim(x) <> '') AS f FROM v),
g AS (SELECT doc_id, path, n, len(f) AS filled, len(list_filter(f, lambda x: length(x) - length(replace(replace(replace(x, 'ñ', ''), 'ß', ''), 'ç', '')) >= 3
  OR (length(x) - length(replace(replace(replace(x, 'ñ', ''), 'ß', ''), 'ç', '')) >= 2 AND (length(x) - length(replace(replace(replace(x, 'ñ', ''), 'ß', ''), 'ç', ''))) / length(x) >= 0.01) OR contains(x, '�'))) AS bad FROM c)
SELECT path, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum(filled) AS BIGINT) AS n_filled, round(avg(CASE WHEN filled > 0 THEN 1.0 ELSE 0 END), 4) AS coverage, CAST(sum(bad) AS BIGINT) AS n_garbled,
  count_if(bad > 0) AS garbled_rows, array_to_string(list_sort(list(doc_id) FILTER (bad > 0))[1:3], ',') AS first_garbled FROM g GROUP BY path""")
def nested_field_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of nested documents by its path; letters that English does not have are the markers."""
    docs = table(spark, sf_dir, "documents")
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("n")))
    nested = docs.select("doc_id", "lang", line.alias("body"), F.create_map(F.lit("source"), "source").alias("origin"))
    found = audit.field_audit(nested, "doc_id", lambda v: text.garbled_strict(v, FOREIGN))
    return found.withColumn("first_garbled", F.nullif(F.array_join("first_garbled", ","), F.lit("")))


@query("""
WITH f AS (SELECT p_partkey, p_name AS alias FROM part UNION ALL SELECT p_partkey, p_type FROM part), k AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size > 45)
SELECT CAST(count(*) AS BIGINT) AS n_aliases, count_if(lower(alias) IN (FROM k)) AS n_covered, round(count_if(lower(alias) IN (FROM k)) / count(*), 4) AS rate, count_if(lower(alias) NOT IN (FROM k)) AS n_missing FROM f""")
def alias_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names and types of parts are names of large parts."""
    parts = table(spark, sf_dir, "part")
    facts = parts.select(F.col("p_partkey").alias("case_id"), F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("type")), F.array("p_name", "p_type"))).alias("fact_id", "alias"))
    return audit.alias_coverage(facts, parts.filter("p_size > 45").select(F.upper("p_name").alias("alias")))
