"""Claims: ranking of sentences, support gate, number and direction checks, step graphs, answer quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.question import has_any
from marginalia.session import written

# Patterns, stop words, directions, quantity terms and synonym groups of the checks.
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
UNITS = r"Hz|kHz|rpm|r/min|rad/s|m/s2|m/s\^2|mm/s|m/s|N|kN|Pa|kPa|MPa|GPa|kg|g|s|ms|V|A|W|dB"
NUMBER_UNIT = rf"(?i)(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s*(?:{UNITS}|%)\b"
UNIT = rf"\b(?:{UNITS})\b"
SYMBOL = r"(?<![A-Za-z0-9_])(?:[ζωΩαβγλμξφ]|zeta|omega_n|omega_d|omega|fn|f_n|Q)(?![A-Za-z0-9_])"
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "near", "of", "on", "or", "that", "the", "to", "with")
DOWN = ("reduce", "reduces", "reduced", "decrease", "decreases", "decreased", "lower", "lowers", "fall", "falls")
UP = ("increase", "increases", "increased", "raise", "raises", "amplify", "amplifies", "higher")
QUANTITIES = ("critical speed", "shaft speed", "rotational speed", "running speed", "vibration speed", "damping ratio")
GROUPS = {
    "damping_ratio": ("damping", "damping ratio", "zeta", "ζ", "阻尼", "阻尼比"),
    "higher": ("higher", "larger", "greater", "increased", "increase"),
    "improve": ("improves", "improve", "smooth", "smoother", "smoothly"),
    "runup": ("runup", "run-up", "passage", "passing", "traverse", "through"),
    "critical_speed": ("critical speed", "critical", "speed"),
}
AXIOMATIC, EVIDENCE = "axiomatic", "evidence"
SCOPE_CLAIM = ("适用", "本文件规定", "本标准规定", "本部分规定", "applies to", "applicable to", "scope of", "this document specifies", "this standard specifies")
SCOPE_NOT = ("引用文件", "适用于本文件")
CRITICAL_SPEED = ("临界转速", "临界速度", "critical speed", "resonant speed", "共振转速")
OUTCOME_QUESTION = ("发生什么", "会怎样", "如何变化", "影响", "what happens", "affect", "effect")
OUTCOME_CLAIM = ("响应", "振幅", "幅值", "放大", "增大", "amplified", "amplification", "response", "amplitude")
DEFINITION = ("定义", "definition")


def words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, use) -> Column:
    """use(value), with the value taken once; inside a lambda a plain column is computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def claim_tokens(tokens: Column) -> Column:
    """Distinct tokens of four letters or more that are no stop words."""
    return F.array_except(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 4)), words(STOP_WORDS))


def support_groups(body: Column, tokens: Column) -> Column:
    """Synonym groups that a text with these tokens names."""
    lowered, flags = F.lower(body), []
    for name, variants in GROUPS.items():
        found = F.lit(False)
        for v in variants:
            found = found | (F.contains(lowered, F.lit(v)) if " " in v else F.array_contains(tokens, v) | F.contains(body, F.lit(v)))
        flags.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*flags))


def supported(claim: Column, claim_all: Column, body: Column, body_all: Column) -> Column:
    """A shared token, or two shared synonym groups; a claim without tokens is supported. *_all: tokens of either text."""
    own = claim_tokens(claim_all)
    groups = F.size(F.array_intersect(support_groups(claim, claim_all), support_groups(body, body_all))) >= 2
    return F.when(F.size(own) == 0, True).when(F.size(body_all) == 0, False).when(F.arrays_overlap(own, body_all), True).otherwise(groups)


def significant(body: Column) -> Column:
    """Distinct numbers, numbers with units, units and symbols, without blanks and in lower case."""
    found = F.concat(*[F.regexp_extract_all(body, F.lit(p), 0) for p in (NUMBER_UNIT, NUMBER, UNIT, SYMBOL)])
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))), lambda x: x != ""))


def missing_items(claim: Column, body: Column) -> Column:
    """Significant items of a claim that its evidence does not hold, sorted."""
    compact = F.lower(F.regexp_replace(body, r"\s+", ""))
    own = F.array_except(significant(claim), significant(body))
    return bound(compact, lambda c: F.array_sort(F.filter(own, lambda x: ~F.contains(c, x))))


def direction_conflict(tokens: Column, body: Column) -> Column:
    """positive or negative where the claim goes up or down and clauses with two of its words go the other way only; else null."""
    up, down = F.arrays_overlap(tokens, words(UP)), F.arrays_overlap(tokens, words(DOWN))
    anchors = F.array_except(claim_tokens(tokens), words(UP + DOWN))
    clauses = F.transform(F.split(body, r"(?i)[.;,，。；]|(?:\bbut\b)"), text.tokens)
    close = bound(anchors, lambda own: F.filter(clauses, lambda c: F.size(F.array_intersect(c, own)) >= 2))

    def verdict(near: Column) -> Column:
        goes_up = F.exists(near, lambda c: F.arrays_overlap(c, words(UP)))
        goes_down = F.exists(near, lambda c: F.arrays_overlap(c, words(DOWN)))
        agreed = (up & goes_up) | (down & goes_down)
        return F.when(agreed, None).when(up & goes_down, "positive").when(down & goes_up, "negative")

    return F.when(~up & ~down, None).otherwise(bound(close, verdict))


def quantity_conflicts(claim: Column, body: Column) -> Column:
    """Values with units that claim and evidence share but bind to different quantities."""
    values = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER_UNIT), 0), lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))))
    terms = lambda c: bound(F.lower(text.squeeze(c)), lambda low: F.filter(words(QUANTITIES), lambda t: F.contains(low, t)))
    missing = F.array_except(terms(claim), terms(body))
    shared = F.array_intersect(values(claim), values(body))
    return F.when((F.size(missing) > 0) & (F.size(terms(body)) > 0), shared).otherwise(F.array().cast("array<string>"))


def visible_refs(answer: Column) -> Column:
    """Chunk references in brackets or evidence tags; plain numbers in brackets are bibliography."""
    brackets = F.filter(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_.:/#-]+)\]"), 1), lambda r: ~r.rlike(r"^\d+(?:-\d+)*$"))
    tags = F.regexp_extract_all(answer, F.lit(r"(?i)(?:\(evidence\s*:\s*|（证据\s*[:：]\s*)([A-Za-z0-9_.:/#-]+)[)）]"), 1)
    return F.array_distinct(F.concat(brackets, tags))


def support_gate(claims: DataFrame, visible: DataFrame, strict: bool = True) -> DataFrame:
    """Each claim (answer_id, claim_ix, claim, chunk_id) with its reasons against it, and whether its answer is blocked."""
    joined = claims.join(visible.select("answer_id", "chunk_id", F.col("text").alias("body")), ["answer_id", "chunk_id"], "left")
    joined = joined.withColumn("claim_all", text.tokens(F.col("claim"))).withColumn("body_all", text.tokens(F.col("body")))
    claim, body, claim_all, body_all = (F.col(c) for c in ("claim", "body", "claim_all", "body_all"))
    seen = body.isNotNull()
    reasons = [
        F.when(F.col("chunk_id").isNull(), "missing chunk"),
        F.when(F.col("chunk_id").isNotNull() & ~seen, "chunk not visible"),
        F.when(seen & ~supported(claim, claim_all, body, body_all), "no lexical support"),
    ]
    if strict:
        reasons += [
            F.when(seen & direction_conflict(claim_all, body).isNotNull(), "direction conflict"),
            F.when(seen & (F.size(quantity_conflicts(claim, body)) > 0), "quantity conflict"),
            F.when(seen & (F.size(missing_items(claim, body)) > 0), "missing items"),
        ]
    # Written, because both sides of the last join read it: the checks would run twice.
    judged = written(joined.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("body", "claim_all", "body_all"), "judged")
    # One row an answer, summed up before the shuffle, in place of a window over all its claims.
    blocked = judged.groupBy("answer_id").agg((F.max((F.size("reasons") > 0).cast("int")) == 1).alias("blocked"))
    return judged.join(blocked.withColumnRenamed("answer_id", "_answer"), F.col("answer_id").eqNullSafe(F.col("_answer"))).drop("_answer")


def rank_sentences(sentences: DataFrame, queries: DataFrame, limit: int = 4) -> DataFrame:
    """Best sentences of each query: ten a shared token plus confidence, a tenth of confidence without one.

    sentences: query_id, order, sentence, confidence. Equal sentences (case apart) count once.
    """
    scored = sentences.join(queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("wanted")), "query_id")
    overlap = F.size(F.array_intersect("wanted", text.tokens(F.col("sentence"))))
    score = F.when((F.size("wanted") > 0) & (overlap == 0), F.col("confidence") * 0.1).otherwise(overlap * 10 + F.col("confidence"))
    ranked = scored.withColumn("score", score)
    same = Window.partitionBy("query_id", F.lower("sentence")).orderBy(F.desc("score"), "order")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "order")
    distinct = ranked.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return distinct.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select("query_id", "order", "sentence", "score", "rank")


def per_group_then_global(scored: DataFrame, group: str, inner: int, outer: int, *order: Column) -> DataFrame:
    """The best `inner` of each group of a query, then the best `outer` of the query."""
    first = Window.partitionBy("query_id", group).orderBy(*order)
    second = Window.partitionBy("query_id").orderBy(*order)
    kept = scored.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= inner).drop("_n")
    return kept.withColumn("rank", F.row_number().over(second)).filter(F.col("rank") <= outer)


def step_problems(steps: DataFrame, rounds: int | None = None) -> DataFrame:
    """(graph_id, step_id) with missing dependencies, self links, and whether the step reaches a cycle.

    steps: graph_id, step_id, depends_on. Steps that only depend on settled steps are settled in
    turn; what never settles reaches a cycle. Rounds follow the longest chain.
    """
    from functools import reduce

    edges = steps.select("graph_id", "step_id", F.explode("depends_on").alias("needs")).distinct()
    known = steps.select("graph_id", F.col("step_id").alias("needs"))
    missing = edges.join(known, ["graph_id", "needs"], "left_anti").groupBy("graph_id", "step_id").agg(F.array_sort(F.collect_set("needs")).alias("missing"))
    selfish = edges.filter("step_id = needs").select("graph_id", "step_id").withColumn("self_link", F.lit(True))
    # Open steps are those of the open edges, and an edge that is settled stays so: a round is one join over the edges left.
    inner = written(edges.join(known, ["graph_id", "needs"], "left_semi"), "edges")
    before = -1
    while (n := inner.count()) != before and n:
        before = n
        inner = written(inner.join(inner.select("graph_id", F.col("step_id").alias("needs")), ["graph_id", "needs"], "left_semi"), "edges")
    open_ = inner.select("graph_id", "step_id").distinct()
    cyclic = open_.withColumn("reaches_cycle", F.lit(True))
    out = reduce(lambda a, b: a.join(b, ["graph_id", "step_id"], "left"), [missing, selfish, cyclic], steps.select("graph_id", "step_id"))
    return out.select(
        "graph_id",
        "step_id",
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        F.coalesce("self_link", F.lit(False)).alias("self_link"),
        F.coalesce("reaches_cycle", F.lit(False)).alias("reaches_cycle"),
    )


def evidence_relevance(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean over all citations of an answer of (1 / log2(rank + 1) + score / best score) / 2; citations without a hit count 0."""
    best = F.max("score").over(Window.partitionBy("answer_id"))
    known = hits.withColumn("best", best).filter("best > 0")
    value = (1 / F.log2(F.col("rank") + 1) + F.col("score") / F.col("best")) / 2
    joined = citations.join(known.select("answer_id", "chunk_id", value.alias("value")), ["answer_id", "chunk_id"], "left")
    return joined.groupBy("answer_id").agg((F.sum(F.coalesce("value", F.lit(0.0))) / F.count(F.lit(1))).alias("relevance"))


def thousandths(share: Column) -> Column:
    """A share within 0 and 1 in whole thousandths, halves up."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 1000 + 0.5).cast("long")


def quality(subscores: list[Column], faithful: Column, language_ok: Column, complete: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """(score, gate reasons): mean of the bounded sub-scores and the gates that fail.

    Sub-scores and mean are taken in whole thousandths, so that equal inputs round alike everywhere.
    """
    bounded = [thousandths(s) for s in subscores]
    n = len(bounded)
    score = F.floor((2 * sum(bounded[1:], bounded[0]) + n) / (2 * n)) / 1000.0
    reasons = F.array_compact(
        F.array(
            F.when(~faithful, "faithfulness"),
            F.when(~language_ok, "language"),
            F.when(score < threshold, "score"),
            F.when(complete < 1.0, "completeness"),
        )
    )
    return score, reasons


def rule_matches(rows: DataFrame, rules: list[tuple[str, str]], keep: int = 2) -> DataFrame:
    """First `keep` rows of each rule whose text holds the rule's marker: rule, row_id."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(m.lower())), F.lit(r)) for r, m in rules]))
    order = Window.partitionBy("rule").orderBy("row_id")
    matched = rows.select("row_id", F.explode(F.array_distinct(hits)).alias("rule"))
    return matched.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)


def is_scope_claim(sentence: Column) -> Column:
    """Whether a sentence says what a document applies to, and does not only name other documents."""
    named = F.lit(False)
    for marker in SCOPE_NOT:
        named = named | F.contains(sentence, F.lit(marker))
    return has_any(sentence, SCOPE_CLAIM) & ~named


def is_outcome_question(query: Column, subject=CRITICAL_SPEED) -> Column:
    return has_any(query, subject) & has_any(query, OUTCOME_QUESTION)


def is_outcome_claim(sentence: Column, subject=CRITICAL_SPEED, outcome=OUTCOME_CLAIM) -> Column:
    """Whether a sentence tells what comes of the subject; definitions do not."""
    return ~has_any(sentence, DEFINITION) & has_any(sentence, subject) & has_any(sentence, outcome)


def narrowed(sentences: DataFrame, wanted: list[tuple[Column, Column, bool]]) -> DataFrame:
    """Sentences of each query (query_id) after filters in turn: (asked of the query, holds of the sentence, strict).

    A filter that is asked for keeps what holds; where nothing of the query is left, a lenient one
    keeps everything and a strict one nothing.
    """
    for k, (asked, holds, strict) in enumerate(wanted):
        flagged = sentences.withColumn("_asked", F.coalesce(asked, F.lit(False))).withColumn("_holds", F.coalesce(holds, F.lit(False)))
        if strict:
            sentences = flagged.filter(~F.col("_asked") | F.col("_holds")).drop("_asked", "_holds")
            continue
        # One row a query, summed up before the shuffle.
        some = flagged.groupBy("query_id").agg(F.max("_holds").alias(f"_some{k}"))
        joined = flagged.join(some, "query_id")
        sentences = joined.filter(~F.col("_asked") | ~F.col(f"_some{k}") | F.col("_holds")).drop("_asked", "_holds", f"_some{k}")
    return sentences


def step_support(steps: DataFrame, visible: DataFrame, strict: bool = False) -> DataFrame:
    """Reasons against each derivation step (answer_id, step_id, source_type, text, chunk_id); none for axiomatic steps.

    visible: answer_id, chunk_id, text. With `strict` the step's numbers, units and symbols must stand in its chunk.
    """
    seen = visible.select("answer_id", "chunk_id", F.col("text").alias("_body"), F.lit(True).alias("_seen"))
    joined = steps.join(seen, ["answer_id", "chunk_id"], "left")
    named = F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != ""
    reasons = [
        F.when(~F.col("source_type").eqNullSafe(EVIDENCE), "source type"),
        F.when(~named, "missing chunk"),
        F.when(named & F.col("_seen").isNull(), "chunk not visible"),
    ]
    if strict:
        reasons.append(F.when(F.col("_seen") & (F.size(missing_items(F.col("text"), F.col("_body"))) > 0), "missing items"))
    found = F.when(F.col("source_type").eqNullSafe(AXIOMATIC), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*reasons)))
    return joined.withColumn("reasons", found).drop("_body", "_seen")


def uncited(answer: Column, n_claims: Column) -> Column:
    """Whether an answer says something without any structured claim."""
    return (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.coalesce(n_claims, F.lit(0)) == 0)


def framed(claims: DataFrame, visible: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """Claims whose chunk the answer can see, in order, under the headings in turn: answer_id, heading, lines."""
    seen = claims.join(visible.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi")
    at = F.least(F.row_number().over(Window.partitionBy("answer_id").orderBy("claim_ix")), F.lit(len(headings)))
    line = F.concat(F.lit("- "), F.col("claim"), F.lit(" ["), F.col("chunk_id").cast("string"), F.lit("]"))
    under = seen.withColumn("heading", F.element_at(F.array(*[F.lit(h) for h in headings]), at))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("claim_ix", line.alias("line")))), lambda x: x["line"])
    return under.groupBy("answer_id", "heading").agg(F.array_join(listed, "\n").alias("lines"), F.count(F.lit(1)).alias("n"))


def step_levels(steps: DataFrame, task: str = "task") -> DataFrame:
    """The steps (task, step_id, depends_on: array) with their `level`: 0 without dependencies, else one more than the highest of them.

    Levels are peeled one a round: what nothing is left to wait for leaves the table. Steps on a
    cycle, and those behind one, have no level (null). Dependencies that no step has do not count;
    they are among the problems of a step. A step_id comes once a task; rows with a null one have no level.
    """
    known = steps.filter("step_id IS NOT NULL")
    edges = known.select(task, "step_id", F.explode("depends_on").alias("dep")).distinct()
    edges = written(edges.join(known.select(task, F.col("step_id").alias("dep")).distinct(), [task, "dep"], "left_semi"), "step-edges")
    n = edges.groupBy(task, "step_id").agg(F.count(F.lit(1)).alias("n"))
    waiting = written(known.select(task, "step_id").distinct().join(n, [task, "step_id"], "left").na.fill(0, ["n"]), "step-waiting")
    levels = [waiting.select(task, "step_id", F.lit(None).cast("int").alias("level")).limit(0)]
    while not (free := waiting.filter("n = 0")).isEmpty():
        levels.append(free.select(task, "step_id", F.lit(len(levels) - 1).alias("level")))
        met = edges.join(free.select(task, F.col("step_id").alias("dep")), [task, "dep"]).groupBy(task, "step_id").agg(F.count(F.lit(1)).alias("met"))
        left = waiting.filter("n > 0").join(met, [task, "step_id"], "left")
        waiting = written(left.select(task, "step_id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")), "step-waiting")
    placed = reduce(DataFrame.unionByName, levels)
    return steps.join(placed, [task, "step_id"], "left")


def step_text(step_id: Column, body: Column, source_type: Column, chunk_id: Column) -> Column:
    """A step as a line: number, text, and the evidence or the word axiomatic."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    marker = F.when(source_type == AXIOMATIC, AXIOMATIC).otherwise(F.concat(F.lit("evidence: "), shown(chunk_id)))
    return F.concat(shown(step_id), F.lit(": "), shown(body), F.lit(" ("), marker, F.lit(")"))
