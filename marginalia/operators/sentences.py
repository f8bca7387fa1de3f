"""Sentences of evidence texts: segments by their role, lines that a layout wrapped, labels between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import squeeze, strip

# Ends of sentences, lines that are labels, words that make a short Han line an assertion.
FINAL = ("。", "！", "？", "!", "?", "；", ";", "…", ".", "．")
CLOSERS = "\"'”’）】》"
SECTION_NUMBER = r"^\d+(?:\.\d+)+$"
PAGE_NUMBER = r"^\d{1,4}$"
LABEL_LINES = (
    r"\d+(?:\.\d+)*\s+\S",
    r"第.+[章节条部分](?:\s|$)",
    r"[（(]\d+[)）]",
    r"[-•·]\s+",
    r"[A-Z][A-Z0-9 _./:-]{2,}$",
    r".{0,30}(?:概述|样本)$",
    r"[^。！？!?；;]{1,40}[•·][^。！？!?；;]{1,40}$",
    r"\[\d+\]\s*\S+",
)
REVISION_CODE, REVISION = r"\d{2,}[A-Z]\d+", "修订版"
ASSERTIONS = ("是", "为", "表示", "用于", "产生", "影响", "规定", "提供", "支持", "增大", "减小")
TAIL = r"^[一-鿿]{1,2}[，、；：。]"
ORPHAN = "^司[A-Z]"
LONG_LINE, SHORT_LABEL = 18, 16
TITLE = "title"
SKIPPED_ROLES = ("label", "bibliography")
#: Texts that a task holds as objects at a time.
ROWS = 64

UNIT = pa.list_(pa.struct([("text", pa.string()), ("is_label", pa.bool_())]))
_number, _page, _tail = re.compile(SECTION_NUMBER), re.compile(PAGE_NUMBER), re.compile(TAIL)
_label = re.compile("^(?:" + "|".join(LABEL_LINES) + ")")
_code, _han, _gap, _blank = re.compile(REVISION_CODE), re.compile("[一-鿿]"), re.compile(r"\n\s*\n"), re.compile(r"[ \t]+")


def closes(line: str) -> bool:
    """Whether a line ends a sentence, quotation marks and brackets after the point allowed."""
    return line.rstrip(CLOSERS).endswith(FINAL)


def is_label(line: str) -> bool:
    """A heading, a list mark, a reference, a page number, or a short Han line that asserts nothing."""
    if _number.match(line) or _page.match(line) or _label.match(line):
        return True
    if _code.search(line, 0, max(line.rfind(REVISION), 0)):
        return True
    if len(line) > SHORT_LABEL or closes(line) or any(a in line for a in ASSERTIONS):
        return False
    return len(_han.findall(line)) >= max(2, len(line) // 2)


def _joined(left: str, right: str) -> str:
    a, b = left[-1], right[0]
    if a == "-" and b.isascii() and b.isalpha():
        return left[:-1] + right
    between = " " if a.isascii() and a.isalnum() and b.isascii() and b.isalnum() else ""
    return left + between + right


def units_of(text: str) -> list[tuple[str, bool]]:
    """(unit, is_label): the lines of a text, those of one sentence joined, in one pass.

    Inside a paragraph a line goes on with the one before unless that ends a sentence. Over a blank
    line it does so only if the unit before is long, or if the line opens with the rest of a Han
    clause. A label stays alone; so do a line after a bare section number and equal lines in a row.
    """
    out, held, held_label, ended = [], "", True, True
    for paragraph in _gap.split(text):
        lines = [line for line in (_blank.sub(" ", raw).strip() for raw in paragraph.splitlines()) if line]
        beside = [None, *lines, None]
        labels = [is_label(x) or x in (a, b) or bool(a and _number.match(a)) for a, x, b in zip(beside, lines, beside[2:])]
        for k, line in enumerate(lines):
            if k:
                apart = closes(lines[k - 1])
            else:
                opening, j = line, 1
                while len(opening) < 3 and j < len(lines) and not labels[j] and not closes(lines[j - 1]):
                    opening, j = opening + lines[j], j + 1
                apart = ended or not (len(held) >= LONG_LINE or _tail.match(opening))
            if apart or held_label or labels[k]:
                if held:
                    out.append((held, held_label))
                held, ended = line, False
            else:
                held = _joined(held, line)
            held_label = labels[k]
            if line.rstrip(CLOSERS):
                ended = closes(line)
    return [*out, (held, held_label)] if held else out


def _unit_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            found = ([{"text": u, "is_label": b} for u, b in units_of(t.as_py())] if t.is_valid else None for t in batch.slice(at, ROWS))
            yield pa.array(list(found), UNIT)


def units(text: Column) -> Column:
    """`units_of` for a column, as structs of text and is_label; null stays null."""
    return F.arrow_udf(_unit_arrays, "array<struct<text:string,is_label:boolean>>")(text)


def body_of(text: Column) -> Column:
    """The text without the bracketed heading on its first lines."""
    bare = strip(text)
    at = F.instr(bare, "]\n")
    return F.when(F.startswith(bare, F.lit("[")) & (at > 0), strip(F.substring(bare, at + 2, F.length(bare)))).otherwise(bare)


def segment_body(text: Column, segments: Column) -> Column:
    """The texts of the segments that are neither titles nor labels nor bibliographies, a blank line between.

    `segments` are structs of text, start, end, block_type and layout_role. A segment without a text
    of its own is cut from the body by its offsets, and has none where they do not lie in it. Without
    segments (null) it is the whole body; where all are left out it is empty.
    """
    body = body_of(F.coalesce(text, F.lit("")))
    wanted = F.filter(segments, lambda s: ~F.coalesce(s["block_type"] == TITLE, F.lit(False)) & ~F.coalesce(s["layout_role"].isin(*SKIPPED_ROLES), F.lit(False)))

    def words(s: Column) -> Column:
        inside = (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(body))
        cut = F.when(inside, F.substring(body, s["start"] + 1, s["end"] - s["start"]))
        return strip(F.coalesce(F.when(s["text"] != "", s["text"]), cut, F.lit("")))

    kept = F.array_join(F.filter(F.transform(wanted, words), lambda t: t != ""), "\n\n")
    return F.when(segments.isNull(), body).otherwise(body_of(kept))


def sentences(units: Column) -> Column:
    """The sentences of units that are no labels, two letters at least."""
    bodies = F.filter(units, lambda u: ~u["is_label"])
    parts = F.flatten(F.transform(bodies, lambda u: F.split(u["text"], r"(?U)(?<=[。！？!?；;…．])\s*|(?<=\.)\s+")))
    return F.filter(F.transform(parts, squeeze), lambda s: (F.length(s) >= 2) & ~s.rlike(ORPHAN))


def segment_sentences(text: Column, segments: Column) -> Column:
    """Sentences of a row by its segments (see `segment_body`), in order; an empty array where there are none."""
    return sentences(units(segment_body(text, segments)))
