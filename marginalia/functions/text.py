"""Text expressions: tokens, token estimates, normalisation, language, garble tests, identifiers.

Every function takes and returns columns and stays inside generated code, but for `gb_repaired`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word and Han patterns and the garble markers.
WORD = r"[A-Za-z0-9_]+(?:[-./][A-Za-z0-9_]+)*"
LOWER_WORD = r"[a-z0-9_]+(?:[-./][a-z0-9_]+)*"
HAN = "[一-鿿]"
GARBLE_LETTERS = "ÃÂ�¤¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿çåèéã"
GARBLE_PHRASES = ("�", "Ã", "Â", "â")
STANDARD = r"(?i)(?:gb\s*[/∕]?\s*t|gbt|dl\s*[/∕]?\s*t|dlt|iso|api)[\s_-]*\d{3,6}(?:\.\d+)*"
ORGANISATIONS = {"gbt": "GB/T", "dlt": "DL/T", "iso": "ISO", "api": "API"}


#: Bytes of text that a Python function holds as objects at a time, about.
SLICE_BYTES = 2 << 20


def slices(columns: list[pa.Array], size: int = SLICE_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of an Arrow batch in slices of about `size` bytes of text, a row at least, in order; what a slice took goes back to the system."""
    taken = np.ones(len(columns[0]), dtype=np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            taken += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, at = np.cumsum(taken), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield [c.slice(at, end - at) for c in columns]
        at = end
    pa.default_memory_pool().release_unused()


def count_of(pattern: str, text: Column) -> Column:
    """How often a pattern matches."""
    return F.regexp_count(text, F.lit(pattern))


def tokens(text: Column) -> Column:
    """Lower-case words whole and split at inner - . /, then 2-, 3- and 4-grams of Han runs (a run of one letter stays)."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit(LOWER_WORD), 0)
    whole_and_parts = F.flatten(
        F.transform(words, lambda w: F.when(w.rlike("[-./]"), F.concat(F.array(w), F.filter(F.split(w, "[-./]+"), lambda p: p != ""))).otherwise(F.array(w)))
    )

    def grams(run: Column, n: int) -> Column:
        places = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.substring(run, k, F.lit(n)))

    runs = F.regexp_extract_all(text, F.lit(f"{HAN}+"), 0)
    han = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3), grams(r, 4)))))
    # Most texts have neither compounds nor Han letters; theirs is the plain list of words.
    latin = F.when(lowered.rlike("[a-z0-9_][-./][a-z0-9_]"), whole_and_parts).otherwise(words)
    return F.when(text.rlike(HAN), F.concat(latin, han)).otherwise(latin)


def estimated_tokens(text: Column) -> Column:
    """Han letters + 1.25 a word + a sixth of all other characters, rounded down, 1 at least."""
    han = count_of(HAN, text)
    return F.greatest(F.lit(1), F.floor(han + count_of(WORD, text) * 1.25 + (F.length(text) - han) / 6).cast("int"))


def prompt_tokens(text: Column) -> Column:
    """A quarter of the characters rounded down, 1 at least; 0 for the empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def evidence_tokens(text: Column, stored: Column | None = None) -> Column:
    """The stored estimate, else a quarter of the stripped characters rounded up; 1 at least."""
    counted = F.ceil(F.length(strip(F.coalesce(text, F.lit("")))) / 4).cast("int")
    return F.greatest(F.lit(1), counted if stored is None else F.coalesce(stored.cast("int"), counted))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space of any script as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_page(text: Column) -> Column:
    """No NUL, line feeds only, single blanks, two line feeds at most, stripped."""
    text = F.regexp_replace(F.regexp_replace(text, "\u0000", ""), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def text_units(text: Column) -> Column:
    """Parts between blank lines or after a line that ends a sentence, squeezed, none empty."""
    parts = F.split(strip(text), r"\n\s*\n|(?<=[.!?。！？；;])\n")
    squeezed = F.transform(parts, lambda p: strip(F.regexp_replace(p, r"[ \t\r\f\x0b]+", " ")))
    return F.filter(squeezed, lambda p: p != "")


def language(text: Column) -> Column:
    """mixed, zh, en or unknown by the shares of Han and Latin letters."""
    han, latin = count_of(HAN, text), count_of("[A-Za-z]", text)
    whole = F.greatest(han + latin, F.lit(1))
    return (
        F.when(~F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), "unknown")
        .when((han / whole >= 0.25) & (latin / whole >= 0.25), "mixed")
        .when(han / whole >= 0.30, "zh")
        .when(latin / whole >= 0.60, "en")
        .otherwise("unknown")
    )


def dominant_language(hint: Column, text: Column) -> Column:
    """Aggregate: the more frequent hint of zh and en, else zh where Han letters are as many as Latin ones."""
    zh, en = F.count_if(hint == "zh"), F.count_if(hint == "en")
    han, latin = F.sum(count_of(HAN, text)), F.sum(count_of("[A-Za-z]", text))
    return F.when(zh > en, "zh").when(en > zh, "en").otherwise(F.when(han >= latin, "zh").otherwise("en"))


def garbled(text: Column) -> Column:
    """No Han letters, six marker letters at least, and 2 % of the text."""
    marks = count_of(f"[{GARBLE_LETTERS}\u0080-\u009f]", text)
    return (count_of(HAN, text) == 0) & (marks >= 6) & (marks / F.greatest(F.length(text), F.lit(1)) >= 0.02)


def garbled_strict(text: Column, phrases: tuple[str, ...] = GARBLE_PHRASES) -> Column:
    """The replacement character, or three marker phrases, or two and 1 % of the text."""
    hits = F.lit(0)
    for phrase in phrases:
        hits = hits + (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)
    share = hits / F.greatest(F.length(text), F.lit(1))
    return F.contains(text, F.lit("�")) | (hits >= 3) | ((hits >= 2) & (share >= 0.01))


def repaired(text: Column, charset: str = "ISO-8859-1") -> Column:
    """UTF-8 that was read in another charset, read again; the original where that leaves no fewer markers."""
    again = F.decode(F.encode(text, charset), "UTF-8")
    marks = f"[{GARBLE_LETTERS}]"
    lossless = F.decode(F.encode(text, charset), charset) == text
    return F.when(lossless & (count_of(marks, again) < count_of(marks, text)), again).otherwise(text)


# Letters that stand in texts of UTF-8 that was read as GB 18030.
GB_MARKERS = "鍥闄鏃鏈绾鐨涓浣妯杞姊璇锟"


def gb_repaired(text: Column) -> Column:
    """UTF-8 that was read as GB 18030, read again, where that leaves fewer markers and replacement letters; else the text.

    Spark's own codecs do not know this charset. Only texts that hold a marker are handed to Python.
    """

    @F.arrow_udf("string")
    def again(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode("gb18030", "ignore").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    marks = f"[{GB_MARKERS}\ufffd]"
    read = again(F.when(text.rlike(f"[{GB_MARKERS}]"), text))
    return F.when(count_of(marks, read) < count_of(marks, text), read).otherwise(text)


def slug(name: Column, longest: int = 80) -> Column:
    """Letters, digits and hyphens of a name."""
    dashed = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, longest), F.lit("-"))


def stable_id(name: Column, content: Column) -> Column:
    """Slug and eight hex digits of the content's SHA-256."""
    return digest_id(name, F.sha2(content, 256))


def digest_id(name: Column, digest: Column) -> Column:
    """The same of a digest that is there already."""
    return F.concat_ws("_", slug(name), F.substring(digest, 1, 8))


def basename(path: Column) -> Column:
    """Last part of a path with either slash; null for none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def preview(text: Column, limit: int = 180) -> Column:
    """One line of `limit` characters at most, with an ellipsis where it was cut; null for blank texts."""
    line = squeeze(F.coalesce(text, F.lit("")))
    return F.when(line == "", None).when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…")))


def truncated(text: Column, limit: int) -> Column:
    """Cut to limit - 1 characters and an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def _standard_name(match: Column) -> Column:
    """Organisation and number of a match."""
    body = F.regexp_replace(F.lower(match), r"[\s/∕_-]", "")
    organisation = F.regexp_extract(body, r"^(gbt|dlt|iso|api)", 1)
    named = F.lit(None).cast("string")
    for short, long in ORGANISATIONS.items():
        named = F.when(organisation == short, F.lit(long)).otherwise(named)
    return F.concat_ws(" ", named, F.regexp_extract(body, r"^[a-z]+(\d{3,6})", 1))


def standard_ids(text: Column) -> Column:
    """Distinct sorted names of standards (organisation and number)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STANDARD), 0)
    return F.array_sort(F.array_distinct(F.transform(found, _standard_name)))


def first_standard(text: Column) -> Column:
    """The standard that a text names first; null where it names none."""
    found = F.nullif(F.regexp_extract(text, STANDARD, 0), F.lit(""))
    return F.when(found.isNotNull(), _standard_name(found))


def page_runs(pages: Column) -> Column:
    """Sorted distinct page numbers as runs: 1-3,5."""
    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    starts = F.filter(ordered, lambda p: ~F.array_contains(ordered, p - 1))
    ends = F.filter(ordered, lambda p: ~F.array_contains(ordered, p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return F.array_join(runs, ",")


def ends_sentence(text: Column) -> Column:
    """Terminal punctuation, closing quotes and brackets allowed after it."""
    return strip(text).rlike("[。！？!?；;.…．][\"'”’）】》\\]]*$")


def continues(text: Column) -> Column:
    """Starts with a connective or a small ASCII letter."""
    # Connectives that point to the text before.
    openers = "当|因此|所以|并且|同时|其中|则|而|从而|when |therefore |and |also "
    return F.lower(strip(text)).rlike(f"^(?:{openers})") | strip(text).rlike("^[a-z]")


def complete_line_share(text: Column) -> Column:
    """Share of lines that end a sentence, headings and blank lines apart; 1 for none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike("^#|:$"))
    whole = F.filter(lines, ends_sentence)
    return F.when(F.size(lines) == 0, F.lit(1.0)).otherwise(F.size(whole) / F.size(lines))


def replace_aliases(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Aliases to canonical names, longest alias first, outside [..]; ASCII aliases at word edges only."""
    out = text
    for alias, name in sorted(rules, key=lambda r: -len(r[0])):
        body = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in alias)
        guard = rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])" if alias.isascii() else body
        out = F.regexp_replace(out, rf"(?i){guard}(?![^\[\]]*\])", name.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def unbalanced_braces(text: Column) -> Column:
    """Whether braces close before they open, or stay open."""
    letters = F.regexp_extract_all(text, F.lit("[{}]"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"))

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (state["bad"] | (depth < 0)).alias("bad"))

    return F.aggregate(letters, start, step, lambda s: s["bad"] | (s["depth"] != 0))


def complete_sentences(answer: Column) -> Column:
    """Share of an answer's lines, headings apart, that end a sentence once references are taken off; 0 for none."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?:\s*\[[A-Za-z0-9_.:/#-]+\])+\s*$", ""), r"(?i)\s*[（(](?:evidence|证据)\s*[:：].*?[)）]\s*$", "")
    lines = F.filter(F.transform(F.split(answer, "\n"), strip), lambda x: (x != "") & ~x.startswith("## "))
    whole = F.filter(lines, lambda x: bare(x).rlike("[。！？!?；;….．][\"'”’）】》]*$"))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(whole) / F.size(lines))
