"""Answer texts: language, aspects, rendering, notes, text repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.question import has_any
from marginalia.functions.text import HAN, count_of, strip

# Aspects of questions, overclaiming words, answer sections.
ASPECTS = {
    "variable_speed": ("variable-speed", "varying speed", "变速", "升降速"),
    "amplitude": ("amplitude", "magnitude", "幅值", "振幅"),
    "phase": ("phase", "相位"),
    "spectrum": ("spectrum", "spectral", "频谱"),
    "direction": ("direction", "radial", "axial", "方向", "径向", "轴向"),
    "workflow": ("workflow", "procedure", "流程", "步骤"),
    "scope": ("scope", "covered", "适用", "范围"),
    "formula": ("formula", "equation", "calculate", "公式", "计算"),
}
ABSOLUTE = r"(?i)\b(?:always|never|guaranteed?|proves?|certainly)\b|必然|一定会|证明了"
SECTIONS = ("conclusion", "evidence", "limits", "next steps")


def script(text: Column) -> Column:
    """zh or en by half the Han letters against words of two letters or more; mixed where both are a quarter at least; null for none."""
    han, words = count_of(HAN, text) / 2, count_of("[A-Za-z]{2,}", text)
    whole = han + words
    return F.when(whole == 0, None).when((han / whole >= 0.25) & (words / whole >= 0.25), "mixed").when(han > words, "zh").otherwise("en")


def expected_language(question: Column) -> Column:
    """A language that the question asks for, else its own script."""
    return F.when(question.rlike(r"(?i)用中文|in chinese"), "zh").when(question.rlike(r"(?i)用英文|in english"), "en").otherwise(script(question))


def language_alignment(question: Column, answer: Column) -> Column:
    """1 where the answer has the expected language or is mixed, else 0; 1 where nothing is expected."""
    wanted, got = expected_language(question), script(answer)
    return F.when(wanted.isNull() | (wanted == "mixed"), 1.0).when(F.coalesce(got, F.lit("")).isin("mixed") | (got == wanted), 1.0).otherwise(0.0)


def aspect_coverage(question: Column, answer: Column, aspects: dict[str, tuple[str, ...]] = ASPECTS) -> Column:
    """Share of the question's aspects that the answer takes up; without aspects whether there is an answer."""
    asked = [has_any(question, terms).cast("int") for terms in aspects.values()]
    met = [(has_any(question, terms) & has_any(answer, terms)).cast("int") for terms in aspects.values()]
    total = sum(asked[1:], asked[0])
    return F.when(total == 0, (F.trim(answer) != "").cast("double")).otherwise(sum(met[1:], met[0]) / total)


def notes(question: Column, answer: Column, shared: Column) -> Column:
    """Advisory notes: no evidence section, off topic, claims without reserve."""
    return F.array_compact(
        F.array(
            F.when(~F.lower(answer).rlike("evidence|证据"), "no evidence section"),
            F.when(shared == 0, "off topic"),
            F.when(answer.rlike(ABSOLUTE), "overclaim"),
        )
    )


def rendered(parts: dict[str, Column]) -> Column:
    """Sections in their fixed order, blank ones left out."""
    made = [F.when(F.trim(F.coalesce(parts[s], F.lit(""))) != "", F.concat(F.lit(f"## {s}\n"), parts[s])) for s in SECTIONS if s in parts]
    return F.array_join(F.array_compact(F.array(*made)), "\n\n")


def span_replaced(text: Column, start: Column, end: Column, repair: Column) -> Column:
    """The text between two markers replaced; unchanged where a marker is missing or the repair is there already."""
    a = F.instr(text, start)
    after = F.substring(text, a + F.length(start), F.length(text))
    b = F.instr(after, end)
    swapped = F.concat(F.substring(text, F.lit(1), a + F.length(start) - 1), repair, F.substring(after, b, F.length(after)))
    return F.when((a > 0) & (b > 0), swapped).otherwise(text)


def numbers_missing(question: Column, evidence: Column) -> Column:
    """Distinct numbers of a question that the evidence does not hold, in order."""
    found = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\d+(?:\.\d+)?"), 0))
    return F.filter(found, lambda x: ~F.contains(evidence, x))


def reflowed(text: Column) -> Column:
    """Sentences of a text whose lines were wrapped: a line joins the one before unless that ends a sentence.

    A hyphen at a line's end joins without a blank. Titles and bracketed references go first.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^#|^\[\d+\]\s"))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"([A-Za-z])-\n([a-z])", "$1$2")
    joined = F.regexp_replace(joined, "(?<![.!?。！？；;:：])\n", " ")
    return F.filter(F.transform(F.split(joined, r"(?<=[.!?])\s+|(?<=[。！？；])\s*|\n"), strip), lambda x: x != "")


def sample_pages(pages: Column, most: int = 8) -> Column:
    """Spread zero-based page numbers: all pages, or `most` at even steps from the first to the last."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (pages - 1) / (most - 1) + 0.5).cast("int"))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= most, F.sequence(F.lit(0), (pages - 1).cast("int"))).otherwise(F.array_distinct(spread))


def boxes_match(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two boxes differ by the tolerance at most on every side."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
