"""Year, authors and publisher of a document, from its metadata and from the text of its first page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, separators and names of the rules. (?U) lets \b know letters beyond ASCII.
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
METADATA_YEAR = r"((?:19|20)\d{2})"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
AUTHOR_LABEL = r"(?:作者|著者|编著|编者)\s*[:：]\s*(.+)"
BYLINE = r"(?i)^\s*(?:by|authors?\s*[:：])\s*(.+)$"
SEPARATOR = r"\s*(?:;|&|、|，|\band\b)\s*"
INVERTED = r"^[A-Za-z][A-Za-z'`.\-]+,\s*[A-Za-z][A-Za-z'`.\-]*(?:\s+[A-Za-z][A-Za-z'`.\-]*){0,2}$"
PRESS_HAN = "[一-鿿]{2,15}出版社"
PUBLISHER_LABEL = r"(?i)^publisher\s*[:：]\s*(.+)$"
PRESS_LINE = r"^(?:[A-Z][A-Za-z&.\-]*(?:\s+[A-Z][A-Za-z&.\-]*){0,5}\s+(?:Press|Publishing|Publishers)|Springer|Elsevier|Wiley|McGraw-Hill)\b"
PUBLISHERS = ("springer", "elsevier", "wiley", "mcgraw-hill")
LONGEST_PRESS_LINE = 80
EDGES = r"^[ \t\r\n.]+|[ \t\r\n.]+$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _kept(parts: Column) -> Column:
    """Parts without blanks and full stops at their ends; empty ones go."""
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, EDGES, "")), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_ENDS)


def authors(raw: Column) -> Column:
    """Names of a list of authors, in order; `Family, Given` is one name, any other comma parts two. None for a null."""
    segments = _kept(F.split(F.coalesce(raw, F.lit("")), f"(?iU){SEPARATOR}"))
    return F.flatten(F.transform(segments, lambda s: F.when(s.rlike(INVERTED), F.array(s)).otherwise(_kept(F.split(s, r"\s*,\s*")))))


def text_authors(text: Column) -> Column:
    """Authors of the first line that names any after a label or a byline; prose is not searched for names."""
    named = F.transform(lines(text), lambda line: F.coalesce(_found(line, AUTHOR_LABEL), _found(line, BYLINE)))
    each = F.transform(F.filter(named, lambda n: n.isNotNull()), authors)
    return F.coalesce(F.get(F.filter(each, lambda a: F.size(a) > 0), F.lit(0)), F.array().cast("array<string>"))


def text_publisher(text: Column) -> Column:
    """A press named in Han letters anywhere, else the first short line with a label, the form of a press, or a known house."""

    def tells(line: Column) -> Column:
        known = F.lit(False)
        for name in PUBLISHERS:
            known = known | F.contains(F.lower(line), F.lit(name))
        return line.rlike(PUBLISHER_LABEL) | line.rlike(f"(?U){PRESS_LINE}") | known

    short = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & (F.length(x) <= LONGEST_PRESS_LINE))
    line = F.get(F.filter(short, tells), F.lit(0))
    return F.coalesce(_found(text, PRESS_HAN, 0), F.trim(_found(line, PUBLISHER_LABEL)), line)


def from_text(text: Column) -> Column:
    """struct(year, authors, publisher) that a text names."""
    return F.struct(_found(text, YEAR).cast("int").alias("year"), text_authors(text).alias("authors"), text_publisher(text).alias("publisher"))


def from_metadata(author: Column, created: Column, modified: Column) -> Column:
    """struct(year, authors, publisher) of the metadata of a file; the year of its making goes before that of its last change."""
    year = F.coalesce(_found(created, METADATA_YEAR), _found(modified, METADATA_YEAR)).cast("int")
    return F.struct(year.alias("year"), authors(author).alias("authors"), F.lit(None).cast("string").alias("publisher"))


def merged(metadata: Column, text: Column) -> Column:
    """Field by field what the metadata has, and what the text has where the metadata has nothing."""
    return F.struct(
        F.coalesce(metadata["year"], text["year"]).alias("year"),
        F.when(F.size(metadata["authors"]) > 0, metadata["authors"]).otherwise(text["authors"]).alias("authors"),
        F.coalesce(F.nullif(metadata["publisher"], F.lit("")), text["publisher"]).alias("publisher"),
    )
