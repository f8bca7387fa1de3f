"""Queries of questions, claims and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import question, text
from marginalia.operators import claims, evaluation
from marginalia.plans.text_queries import SQL_TOKENS
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


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t.lower()}')" for t in terms) + ")"


SQL_INTENT = "CASE WHEN coalesce({0}, '') = '' THEN 'unknown' " + " ".join(f"WHEN {_any('{0}', m)} THEN '{n}'" for n, m in question.INTENTS) + " ELSE 'engineering' END"


@query(f"SELECT conv_id, turn, {SQL_INTENT.format('text')} AS intent FROM conversations")
def intent_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", question.intent(F.col("text")).alias("intent"))


FAMILY_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {_any('text', a)} THEN '{n}' END" for n, a in question.FAMILIES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT conv_id, turn, {FAMILY_FLAGS} AS families FROM conversations")
def alias_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", question.detected(F.col("text"), question.FAMILIES).alias("families"))


DATA_FAMILIES = {"license": ("license", "licence", "copyright"), "secret": ("token", "password", "api_key", "secret"), "contact": ("mail", "phone", "@")}


@query(
    "WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), e AS (SELECT doc_id, t, list_concat("
    + ", ".join(f"CASE WHEN {_any('t', a)} THEN {list(a)} ELSE [] END" for a in DATA_FAMILIES.values())
    + ") AS more FROM c) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || CASE WHEN len(more) > 0 THEN ' ' || array_to_string(more, ' ') ELSE '' END END AS expanded FROM e"
)
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents with the aliases of the families they name; a null text is an empty one."""
    return table(spark, sf_dir, "documents").select("doc_id", question.expanded(F.col("text"), DATA_FAMILIES, {}).alias("expanded"))


alias_expand_all = alias_expand
QUERIES["alias_expand_all"], SQL["alias_expand_all"] = alias_expand_all, SQL["alias_expand"]


#: Slots of the texts at hand: a text states something, and says on what it stands.
DATA_SLOTS = (("statement", ("is", "are", "the", "de", "der", "que")), ("support", ("token", "license", "because", "para", "und", "ing")))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(after, ["conv_id", "turn"])


SQL_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
SQL_COVERED = " + ".join(f"CASE WHEN {_any('text', a)} AND {_any('answer', a)} THEN 1 ELSE 0 END" for a in DATA_FAMILIES.values())
SQL_TOTAL = " + ".join(f"CASE WHEN {_any('text', a)} THEN 1 ELSE 0 END" for a in DATA_FAMILIES.values())


@query(f"WITH {SQL_PAIRS} SELECT conv_id, turn, CAST({SQL_COVERED} AS INTEGER) AS covered, CAST({SQL_TOTAL} AS INTEGER) AS total FROM pairs")
def alias_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of a turn that the next turn takes up."""
    covered, total = question.coverage(F.col("text"), F.col("answer"), DATA_FAMILIES)
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", covered.cast("int").alias("covered"), total.cast("int").alias("total"))


def _word(column: str, terms) -> str:
    body = "|".join(t.replace(" ", "\\s+") for t in terms)
    return f"regexp_matches({column}, '(?i)(?:^|[^A-Za-z0-9])(?:{body})(?:$|[^A-Za-z0-9])')"


def _han(terms) -> str:
    return "(" + " OR ".join(f"contains(text, '{t}')" for t in terms) + ")"


SQL_STANDARD = "regexp_replace(lower(regexp_extract(text, '(?i)(?:gb\\s*[/∕]?\\s*t|gbt|dl\\s*[/∕]?\\s*t|dlt|iso|api)[\\s_-]*\\d{3,6}')), '[\\s/∕_-]', '', 'g')"
SQL_LISTED = f"{SQL_STANDARD} IN ({', '.join(repr(s.lower().replace('/', '').replace(' ', '')) for s in question.CORPUS_STANDARDS)})"
SQL_WEAK = f"({_word('text', question.WEAK)} AND {_word('text', question.WEAK_CONTEXT)}) OR ({_han(question.WEAK_HAN)} AND {_han(question.WEAK_HAN_CONTEXT)})"
SQL_IN_SCOPE = f"NOT {_any('text', question.OUT_OF_SCOPE)} AND ({SQL_LISTED} OR {_word('text', question.STRONG)} OR {_han(question.STRONG_HAN)} OR {SQL_WEAK})"
BY_LENGTH = sorted(((-len(a), k, a.lower(), name) for k, (name, aliases) in enumerate(question.FAMILIES.items()) for a in aliases))
SQL_FOCUS = "CASE " + " ".join(f"WHEN contains(squeezed, '{alias}') THEN '{name}'" for _, _, alias, name in BY_LENGTH) + " END"
SQL_LANE_FLAGS = ", ".join(f"CASE WHEN {_any('text', terms)} THEN '{name}' END" for name, terms in question.LANES)


@query(f"""
WITH t AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed FROM conversations)
SELECT conv_id, turn, {SQL_IN_SCOPE} AS in_scope, {SQL_FOCUS} AS focus, list_filter([{SQL_LANE_FLAGS}], lambda x: x IS NOT NULL) AS lanes FROM t""")
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, focus family and advisory lanes of each turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", question.in_scope(t).alias("in_scope"), question.focus(t).alias("focus"), question.advisory_lanes(t, F.col("role")).alias("lanes")
    )


@query(f"""
SELECT conv_id, turn, CASE {' '.join(f"WHEN {_any('text', m)} THEN '{n}'" for n, m in question.SUMMARY_MODES)} ELSE 'qa' END AS mode,
  CASE {' '.join(f"WHEN {_any('text', m)} THEN '{n}'" for n, m in question.QUALITY_INTENTS)} ELSE 'general' END AS kind FROM conversations""")
def summary_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and kind of question of each turn."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", question.summary_mode(t).alias("mode"), question.quality_intent(t).alias("kind"))


@query("""
WITH f AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS failures FROM conversations)
SELECT conv_id, turn, CASE WHEN failures >= 3 THEN 'extreme' WHEN length(text) > 1500 THEN 'hard' WHEN role = 'system' THEN 'easy' ELSE 'normal' END AS difficulty FROM f""")
def difficulty_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty of a turn: by length, then role; repeated asking escalates."""
    turns = table(spark, sf_dir, "conversations")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failures = F.sum((F.col("role") == "user").cast("int")).over(so_far)
    hard, easy = F.when(F.length("text") > 1500, "hard"), F.when(F.col("role") == "system", "easy")
    return turns.withColumn("f", failures).select("conv_id", "turn", question.difficulty(hard, easy, F.lit(None).cast("string"), F.col("f"), 3).alias("difficulty"))


SQL_CLAIM_TOKENS = SQL_TOKENS.replace("(text)", "(claim)")


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims: each whole text against the text of the document before it, every fifth chunk unseen."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select(F.col("source").alias("answer_id"), F.col("doc_id").alias("claim_ix"), F.col("text").alias("claim"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") - F.col("doc_id") % 2).alias("chunk_id"))
    pairs = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("chunk_id"), "text")
    visible = made.select("answer_id", "chunk_id").filter("chunk_id is not null").distinct().join(pairs, "chunk_id")
    return made, visible


SQL_CLAIMS = r"""
made AS (SELECT source AS answer_id, doc_id AS claim_ix, text AS claim, CASE WHEN doc_id % 7 <> 0 THEN doc_id - doc_id % 2 END AS chunk_id FROM documents),
seen AS (SELECT doc_id AS chunk_id, text FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT made.*, seen.text AS body FROM made LEFT JOIN seen USING (chunk_id))"""
STOP = "[" + ", ".join(f"'{w}'" for w in claims.STOP_WORDS) + "]"


@query(f"""
WITH {SQL_CLAIMS},
t AS (SELECT *, list_filter(list_distinct({SQL_CLAIM_TOKENS}), lambda x: length(x) >= 4 AND NOT list_contains({STOP}, x)) AS own, {SQL_TOKENS.replace('(text)', '(coalesce(body, chr(32)))')} AS theirs FROM j),
g AS (SELECT *, (CASE WHEN (contains(lower(claim), 'critical') OR contains(claim, 'speed')) AND (contains(lower(body), 'critical') OR contains(body, 'speed')) THEN 1 ELSE 0 END) AS shared FROM t)
SELECT answer_id, claim_ix, CASE WHEN chunk_id IS NULL THEN 'missing chunk' WHEN body IS NULL THEN 'chunk not visible'
  WHEN len(own) > 0 AND (len(theirs) = 0 OR NOT list_has_any(own, theirs)) THEN 'no lexical support' ELSE 'ok' END AS verdict FROM g""")
def claim_support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reason against each claim."""
    gated = claims.support_gate(*_claims(spark, sf_dir), strict=False)
    return gated.select("answer_id", "claim_ix", F.coalesce(F.get("reasons", F.lit(0)), F.lit("ok")).alias("verdict"))


@query()
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, units and symbols of a claim that its evidence does not hold."""
    made, visible = _claims(spark, sf_dir)
    joined = made.join(visible.select("answer_id", "chunk_id", F.col("text").alias("body")), ["answer_id", "chunk_id"])
    return joined.select("answer_id", "claim_ix", claims.missing_items(F.col("claim"), F.col("body")).alias("missing"))


@query()
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict gate: missing items, direction and quantity conflicts of every claim."""
    return claims.support_gate(*_claims(spark, sf_dir), strict=True).select("answer_id", "claim_ix", "reasons", "blocked")


SQL_SENTENCES = r"""
s AS (SELECT source AS query_id, doc_id, i, ls[i + 1] AS sentence, (doc_id % 10) / 10.0 AS confidence
  FROM (SELECT source, doc_id, list_filter(list_transform(string_split(text, e'\n'), lambda x: trim(x, e' \t\r')), lambda x: x <> '') AS ls FROM documents), unnest(range(0, len(ls))) AS r(i))"""
CLAIM_QUESTION = "the license and the token of that password"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    exploded = docs.select(F.col("source").alias("query_id"), "doc_id", F.posexplode(lines).alias("i", "sentence"))
    return exploded.withColumn("order", F.struct("doc_id", "i")).withColumn("confidence", F.col("doc_id") % 10 / 10.0)


SQL_SCORED = f"""
w AS (SELECT list_distinct({SQL_TOKENS}) AS wanted FROM (SELECT '{CLAIM_QUESTION}' AS text)),
c AS (SELECT s.*, len(list_intersect(wanted, {SQL_TOKENS.replace('(text)', '(sentence)')})) AS overlap FROM s, w),
r AS (SELECT *, CASE WHEN overlap = 0 THEN confidence * 0.1 ELSE overlap * 10 + confidence END AS score FROM c)"""


@query(f"""
WITH {SQL_SENTENCES}, {SQL_SCORED}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY score DESC, doc_id, i) AS n FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, i) AS rank FROM d WHERE n = 1)
SELECT query_id, doc_id, CAST(i AS INTEGER) AS i, sentence, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""")
def claim_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four best sentences of each source for one question."""
    sentences = _sentences(spark, sf_dir)
    asked = sentences.select("query_id").distinct().withColumn("query", F.lit(CLAIM_QUESTION))
    return claims.rank_sentences(sentences, asked).select("query_id", "order.doc_id", "order.i", "sentence", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {SQL_SENTENCES}, {SQL_SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, i) AS n FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, i) AS rank FROM a WHERE n <= 2)
SELECT query_id, doc_id, CAST(i AS INTEGER) AS i, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6""")
def per_doc_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best sentences of a document, then six of the source."""
    wanted = F.array_distinct(text.tokens(F.lit(CLAIM_QUESTION)))
    overlap = F.size(F.array_intersect(wanted, text.tokens(F.col("sentence"))))
    scored = _sentences(spark, sf_dir).withColumn("score", F.when(overlap == 0, F.col("confidence") * 0.1).otherwise(overlap * 10 + F.col("confidence")))
    return claims.per_group_then_global(scored, "doc_id", 2, 6, F.desc("score"), F.col("order")).select("query_id", "doc_id", "i", "rank")


def _order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step graphs from orders: each order is a step of its customer and needs the two before it; some point forward or nowhere."""
    orders = table(spark, sf_dir, "orders")
    chain = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before, after = F.lag("o_orderkey").over(chain), F.lead("o_orderkey").over(chain)
    name = lambda c: c.cast("string")
    needs = F.array_compact(F.array(name(before), F.when(F.col("o_orderkey") % 11 == 0, name(after)), F.when(F.col("o_orderkey") % 17 == 0, F.lit("none")), F.when(F.col("o_orderkey") % 23 == 0, name(F.col("o_orderkey")))))
    return orders.select(F.col("o_custkey").alias("graph_id"), name(F.col("o_orderkey")).alias("step_id"), needs.alias("depends_on"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS k, lag(o_orderkey) OVER w AS b, lead(o_orderkey) OVER w AS a, row_number() OVER w AS n, max(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS x
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT *, (k % 11 = 0 AND a IS NOT NULL) OR k % 23 = 0 AS starts FROM o)
SELECT g AS graph_id, CAST(k AS VARCHAR) AS step_id, CASE WHEN k % 17 = 0 THEN ['none'] ELSE [] END AS missing, k % 23 = 0 AS self_link,
  coalesce(bool_or(starts) OVER (PARTITION BY g ORDER BY k), false) AS reaches_cycle FROM c""")
def step_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of step graphs: every step after a cycle in its chain reaches it."""
    return claims.step_problems(_order_steps(spark, sf_dir))


@query("""
WITH c AS (SELECT source AS answer_id, doc_id AS chunk_id FROM documents), h AS (SELECT source AS answer_id, doc_id AS chunk_id, CAST(length(text) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents), m AS (SELECT *, max(score) OVER (PARTITION BY answer_id) AS best FROM h)
SELECT answer_id, round(sum(CASE WHEN rank <= 10 THEN (1 / log2(rank + 1) + score / best) / 2 ELSE 0 END) / count(*), 6) AS relevance FROM c JOIN m USING (answer_id, chunk_id) GROUP BY answer_id""")
def answer_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and score of cited hits, over all citations of a source."""
    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy(F.length("text").desc(), "doc_id")
    hits = docs.select(F.col("source").alias("answer_id"), F.col("doc_id").alias("chunk_id"), F.length("text").cast("double").alias("score"), F.row_number().over(order).alias("rank")).filter("rank <= 10")
    cited = docs.select(F.col("source").alias("answer_id"), F.col("doc_id").alias("chunk_id"))
    return claims.evidence_relevance(cited, hits).withColumn("relevance", F.round("relevance", 6))


@query(f"""
WITH {SQL_PAIRS}, f AS (SELECT conv_id, turn, answer, CAST({SQL_COVERED} AS DOUBLE) AS covered, CAST({SQL_TOTAL} AS DOUBLE) AS total,
  list_filter(list_transform(string_split(answer, e'\\n'), lambda x: trim(x, e' \\t\\r')), lambda x: x <> '' AND NOT starts_with(x, '## ')) AS ls,
  CAST(len(list_distinct(list_intersect({SQL_TOKENS}, {SQL_TOKENS.replace('(text)', '(answer)')}))) AS DOUBLE) AS shared, CAST(len(list_distinct({SQL_TOKENS})) AS DOUBLE) AS asked,
  ({_any('answer', DATA_SLOTS[0][1])}) AS c1, ({_any('answer', DATA_SLOTS[1][1])}) AS c2 FROM pairs),
p AS (SELECT *, [CASE WHEN total = 0 THEN 1.0 ELSE covered / total END, CASE WHEN asked = 0 THEN 0.0 ELSE shared / asked END, (CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER)) / 2.0,
  CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '[。！？!?；;….．]["''”’）】》]*$'))) / CAST(len(ls) AS DOUBLE) END, 1.0] AS parts FROM f),
m AS (SELECT *, list_transform(parts, lambda x: CAST(floor(least(1.0, greatest(0.0, CAST(x AS DOUBLE))) * 1000 + 0.5) AS BIGINT)) AS ms FROM p),
q AS (SELECT *, floor((2 * list_sum(ms) + 5) / 10.0) / 1000.0 AS score FROM m)
SELECT conv_id, turn, score, list_filter([CASE WHEN shared = 0 THEN 'faithfulness' END, CASE WHEN score < 0.75 THEN 'score' END, CASE WHEN ms[3] < 1000 THEN 'completeness' END], lambda x: x IS NOT NULL) AS reasons FROM q""")
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sub-scores of each turn as the answer to the turn before it, and the gates that fail.

    Coverage of families, shared words as relevance, slots, complete lines, language (one here).
    """
    pairs = _turn_pairs(spark, sf_dir)
    asked, answer = F.col("text"), F.col("answer")
    covered, total = question.coverage(asked, answer, DATA_FAMILIES)
    wanted = F.array_distinct(text.tokens(asked))
    shared = F.size(F.array_intersect(wanted, text.tokens(answer)))
    relevance = F.when(F.size(wanted) == 0, 0.0).otherwise(shared / F.size(wanted))
    complete = question.filled_share([(name, question.has_any(answer, markers)) for name, markers in DATA_SLOTS])
    parts = [F.when(total == 0, 1.0).otherwise(covered / total), relevance, complete, text.complete_sentences(answer), F.lit(1.0)]
    score, reasons = claims.quality(parts, shared > 0, F.lit(True), complete)
    return pairs.select("conv_id", "turn", score.alias("score"), reasons.alias("reasons"))


@query("""
WITH m AS (SELECT doc_id AS row_id, text FROM documents), h AS (
  SELECT row_id, 'secret' AS rule FROM m WHERE contains(lower(text), 'token') UNION ALL SELECT row_id, 'license' FROM m WHERE contains(lower(text), 'license') UNION ALL SELECT row_id, 'mail' FROM m WHERE contains(lower(text), '@')),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY row_id) AS n FROM h) SELECT rule, row_id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 2""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two documents of each keyword rule."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return claims.rule_matches(docs, [("secret", "token"), ("license", "license"), ("mail", "@")])


SQL_TARGETS = "t AS (SELECT doc_id % 50 AS case_id, doc_id AS evidence_id, doc_id AS chunk_id, doc_id // 3 AS doc_id, [doc_id % 4, doc_id % 6] AS pages FROM documents WHERE doc_id % 3 = 0)"
SQL_HITS = """h AS (SELECT case_id, chunk_id, doc_id, pages, row_number() OVER (PARTITION BY case_id ORDER BY n, chunk_id) AS rank FROM (
  SELECT (doc_id + doc_id % 2) % 50 AS case_id, doc_id AS chunk_id, doc_id // 3 AS doc_id, [doc_id % 5] AS pages, length(text) AS n FROM documents))"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    targets = docs.filter("doc_id % 3 = 0").select((k % 50).alias("case_id"), k.alias("evidence_id"), k.alias("chunk_id"), F.floor(k / 3).alias("doc"), F.array(k % 4, k % 6).alias("pages"))
    order = Window.partitionBy("case_id").orderBy("n", "chunk_id")
    hits = docs.select(((k + k % 2) % 50).alias("case_id"), k.alias("chunk_id"), F.floor(k / 3).alias("doc"), F.array(k % 5).alias("pages"), F.length("text").alias("n"))
    return targets.withColumnRenamed("doc", "doc_id"), hits.withColumn("rank", F.row_number().over(order)).withColumnRenamed("doc", "doc_id")


@query(f"""
WITH {SQL_TARGETS}, {SQL_HITS} SELECT t.case_id, evidence_id, CAST(min(rank) AS INTEGER) AS rank FROM t JOIN h ON t.case_id = h.case_id AND (t.chunk_id = h.chunk_id OR (t.doc_id = h.doc_id AND list_has_any(t.pages, h.pages)))
GROUP BY ALL""")
def evidence_or_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.match_evidence(*_cases(spark, sf_dir))


@query(f"""
WITH {SQL_TARGETS}, {SQL_HITS}, m AS (SELECT t.case_id, evidence_id, min(rank) AS rank FROM t LEFT JOIN h ON t.case_id = h.case_id AND (t.chunk_id = h.chunk_id OR (t.doc_id = h.doc_id AND list_has_any(t.pages, h.pages))) GROUP BY ALL),
c AS (SELECT case_id, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS b FROM m GROUP BY case_id)
SELECT CAST(count(*) AS BIGINT) AS cases, round(avg(a), 6) AS recall_at_5, round(avg(b), 6) AS recall_at_10 FROM c""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, hits = _cases(spark, sf_dir)
    return evaluation.recall_at(targets, evaluation.match_evidence(targets, hits), 5, 10)


@query("""
WITH c AS (SELECT quality, least(length(text) / 4000.0, 1.0) AS score FROM documents JOIN labels USING (doc_id)), t AS (SELECT CAST(round(k * 0.05, 2) AS DOUBLE) AS threshold FROM range(0, 21) r(k)),
x AS (SELECT threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tu, count(*) FILTER (quality = 1 AND score < threshold) AS fb,
  count(*) FILTER (quality = 0 AND score < threshold) AS tn, count(*) FILTER (quality = 0 AND score >= threshold) AS fa FROM c, t GROUP BY threshold)
SELECT threshold, CAST(tu AS BIGINT) AS true_usable, CAST(fb AS BIGINT) AS false_block, CAST(tn AS BIGINT) AS true_unusable, CAST(fa AS BIGINT) AS false_allow, round((tu + tn) / (tu + fb + tn + fa), 3) AS accuracy,
  CASE WHEN tu + fb > 0 THEN round(tu / (tu + fb), 3) END AS usable_recall, CASE WHEN tn + fa > 0 THEN round(tn / (tn + fa), 3) END AS unusable_block_rate FROM x""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as a quality score, swept over 21 thresholds."""
    return evaluation.threshold_sweep(_labelled(spark, sf_dir), "score", "quality")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.length("text") / 4000.0, F.lit(1.0)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH c AS (SELECT lang, quality = 1 AS e, length(text) >= 800 AS p FROM documents JOIN labels USING (doc_id)),
n AS (SELECT lang, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM c GROUP BY lang)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) END AS block_rate FROM n""")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("score") >= 0.2, "lang")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS ix, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (ix = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (ix = floor((n - 1) * 0.95 + 0.5)) AS p95 FROM r GROUP BY event_type""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


SQL_PAIRED = "c AS (SELECT doc_id AS case_id, doc_id // 2 AS pair, CASE doc_id % 2 WHEN 0 THEN 'zh' ELSE 'en' END AS language, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS recall, CASE WHEN doc_id % 3 = 0 THEN 'retrieval' ELSE 'pass' END AS category FROM documents)"


@query(f"""
WITH {SQL_PAIRED} SELECT c.case_id, c.pair, c.language, CAST(c.recall AS DOUBLE) AS recall, CASE WHEN c.category = 'retrieval' AND c.recall < 1 AND max(p.recall) = 1 THEN 'terminology' ELSE c.category END AS category
FROM c LEFT JOIN c p ON c.pair = p.pair AND c.language <> p.language GROUP BY c.case_id, c.pair, c.language, c.recall, c.category""")
def paired_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    miss = k % 3 == 0
    cases = table(spark, sf_dir, "documents").select(
        k.alias("case_id"), F.floor(k / 2).alias("pair"), F.when(k % 2 == 0, "zh").otherwise("en").alias("language"), F.when(miss, 0.5).otherwise(1.0).alias("recall"), F.when(miss, "retrieval").otherwise("pass").alias("category")
    )
    return evaluation.paired_relabel(cases, "pair", "language", "recall", "category")


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS r10, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS r5, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS c FROM documents)
SELECT doc_id, CASE WHEN r10 < 1 THEN CASE WHEN doc_id % 6 = 0 THEN 'corpus-quality' ELSE 'retrieval' END WHEN r5 < r10 THEN 'ranking' WHEN doc_id % 10 = 0 AND c < 1 THEN 'cross-doc' WHEN c < 1 OR doc_id % 7 = 0 THEN 'synthesis' ELSE 'pass' END AS miss FROM s""")
def miss_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    part = lambda n: F.when(k % n == 0, 0.5).otherwise(1.0)
    found = evaluation.miss_categories(part(4), part(3), k % 6 == 0, k % 10 == 0, part(5), k % 7 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.primary_miss(found).alias("miss"))


@query("""
WITH l AS (SELECT lang, source, n_chars FROM documents), r AS (SELECT lang, source, CASE WHEN doc_id % 100 = 0 THEN n_chars + 1 ELSE n_chars END FROM documents WHERE doc_id % 50 <> 1),
a AS (SELECT count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)), b AS (SELECT count(*) AS n FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l))
SELECT CAST(a.n AS BIGINT) AS only_left, CAST(b.n AS BIGINT) AS only_right FROM a, b""")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table and a changed copy of it do not share."""
    docs = table(spark, sf_dir, "documents")
    changed = docs.filter("doc_id % 50 <> 1").withColumn("n_chars", F.when(F.col("doc_id") % 100 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return evaluation.parity(docs.select("lang", "source", "n_chars"), changed.select("lang", "source", "n_chars"))


@query("""
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 AND d.doc_id % 5 <> 0 THEN d.lang END, d.lang) AS lang, d.source, CAST(CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_changed FROM documents d""")
def field_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing languages filled from the manifest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    holes = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")))
    return evaluation.backfill(holes, docs, "doc_id", "lang")


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0 END), 4) AS text_coverage, round(avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0 END), 4) AS lang_coverage,
  round(avg(CASE WHEN doc_id % 8 <> 0 THEN 1.0 ELSE 0 END), 4) AS title_coverage FROM documents""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.when(F.col("doc_id") % 8 != 0, F.col("source")))
    return evaluation.coverage_profile(docs, "text", "lang", "title")


@query("""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT lang, doc_id, CAST(n AS INTEGER) AS sample_no FROM r WHERE n <= 3""")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_samples(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 3)


@query("""
WITH m AS (SELECT count(*) AS n, count(DISTINCT text) AS d, avg(length(text)) AS a FROM documents) SELECT n > 0 AS filled, d / n >= 0.5 AS mostly_distinct, a < 100 AS short_texts, n > 0 AND d / n >= 0.5 AND a < 100 AS eligible FROM m""")
def gate_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("d"), F.avg(F.length("text")).alias("a"))
    return evaluation.gates(measured, filled=F.col("n") > 0, mostly_distinct=F.col("d") / F.col("n") >= 0.5, short_texts=F.col("a") < 100)
