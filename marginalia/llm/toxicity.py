"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts and lexicon are folded alike: case, look-alike letters of other scripts, rare accents, digits
and signs that stand for letters, and invisible characters all go, so "1d!ot" and "idiot" meet.
Letters of Latin-1 such as é keep their accents, because they tell words of many languages apart. The
lexicon is learnt from labelled rows: words whose document frequency is much higher among toxic
rows, in several contexts, weighted by their log odds. A term inside an exception phrase does not
count. The sum of weights is divided by the root of the length, and the score is x / (x + t), with
the threshold t between the labelled classes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, packed, sliced_udf, text_slices

#: Labelled rows that training reads at most, of either class.
MAX_ROWS_A_CLASS = 20_000
MIN_WEIGHT = 3.5
MIN_CONTEXTS = 3
#: Words added to a text's length, so that very short texts do not dominate.
LENGTH_FLOOR = 10
#: Rows whose crc32(key) % FOLDS is HELD_OUT never train.
FOLDS, HELD_OUT = 5, 0

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "ς": "s",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ᴏ": "o",
}
SIGNS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
#: Letters that the signs above cannot tell apart.
MERGED = {"l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a term of the lexicon is harmless.
EXCEPTIONS = ("idiot proof", "clown fish", "trash can", "trash bin", "trash talk", "scum line")

_INNER_SIGN = re.compile(r"(?<=\w)[!|](?=\w)")
_NOT_WORD = re.compile(r"[\W_]+")


def _fold_table() -> dict[int, str | None]:
    def last(letter: str) -> str:
        return MERGED.get(letter, letter)

    table: dict[int, str | None] = {ord(c): last(v) for c, v in {**LOOKALIKES, **SIGNS}.items()}
    table |= {ord(c): v for c, v in MERGED.items()} | {ord(c): None for c in INVISIBLE}
    for code in [*range(0x100, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        if plain != chr(code):
            table.setdefault(code, "".join(last(c) for c in plain))
    table |= {code: None for code in range(0x300, 0x370)}
    return table


FOLD = _fold_table()


def fold(text: str) -> str:
    """Words of a text, folded, with one space between them and one at either end."""
    text = text.lower()
    if not text.isascii():
        letters = set(text)
        if any("\u0300" <= c <= "\u036f" or "\uff00" <= c <= "\uffef" for c in letters):
            text = unicodedata.normalize("NFKC", text).lower()
    if "!" in text or "|" in text:
        text = _INNER_SIGN.sub("i", text)
    return f" {_NOT_WORD.sub(' ', text.translate(FOLD)).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Folded terms and their weights, exception phrases, and the threshold of x at score 0.5."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    threshold: float = 1.0
    _machine: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "threshold": self.threshold, "_machine": []}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def machine(self):
        """The automaton, built once a process. Terms and phrases carry a space at either end."""
        if not self._machine:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(f" {term} ", (len(term) + 2, weight))
            for phrase in self.exceptions:
                if (key := fold(phrase)).strip() not in self.weights:
                    found.add_word(key, (len(key), None))
            found.make_automaton()
            self._machine.append(found)
        return self._machine[0]

    def strength(self, text: str | None) -> float:
        """Sum of the weights of the terms outside exception phrases, by the root of the length."""
        folded = fold(text or "")
        if not self.weights or folded.isspace():
            return 0.0
        terms, spared = [], []
        for end, (length, weight) in self.machine().iter(folded):
            (spared if weight is None else terms).append((end - length + 1, end, weight))
        total = sum(w for a, b, w in terms if not any(x <= a and b <= y for x, y, _ in spared)) if spared else sum(w for *_, w in terms)
        return total / math.sqrt(folded.count(" ") - 1 + LENGTH_FLOOR) if terms else 0.0

    def score(self, text: str | None) -> float:
        x = self.strength(text)
        return x / (x + self.threshold)


def held_out(key: Column | str) -> Column:
    """Whether a row belongs to the fold that never trains."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _word_rows(batches):
    """(word, toxic, context bit) for the distinct words of each text, summed over a batch."""
    for batch in batches:
        sums: dict[str, list[int]] = {}
        texts = (t for some in text_slices([batch.column(0)]) for t in some.to_pylist())
        for text, toxic in zip(texts, batch.column(1).to_pylist()):
            words = fold(text or "").split()
            before: dict[str, int] = {}
            for left, word in zip([""] + words, words):
                before[word] = before.get(word, 0) | 1 << (sum(left.encode()) + len(left)) % 62
            for word, bits in before.items():
                entry = sums.setdefault(word, [0, 0, 0])
                entry[toxic] += 1
                if toxic:
                    entry[2] |= bits
        rows = [(w, *v) for w, v in sums.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["word", "clean", "toxic", "contexts"],
        )


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, MAX_ROWS_A_CLASS of each class at most, chosen by hash."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).cast("int").alias("_toxic"))
    order = F.xxhash64(F.lit("toxicity"), key)
    chosen = usable.filter("_toxic = 1").orderBy(order, key).limit(MAX_ROWS_A_CLASS).union(usable.filter("_toxic = 0").orderBy(order, key).limit(MAX_ROWS_A_CLASS))
    return docs.select(key, text).join(F.broadcast(chosen), key).select(F.col(text).alias("text"), F.col("_toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the lexicon and the threshold. Without toxic rows the lexicon is empty and all scores are 0.

    The lexicon has every word that meets the limits in the training rows; their bounds are its bound.
    """
    # Bounded, and read three times.
    rows = materialize(training_rows(docs, labels, key, text, label), "toxicity-rows")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1):
        return Lexicon({}, exceptions)
    sums = (
        rows.mapInArrow(_word_rows, "word string, clean long, toxic long, contexts long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))
    )
    weight = F.log((F.col("toxic") + 1) / F.lit(size[1] + 2.0)) - F.log((F.col("clean") + 1) / F.lit(size.get(0, 0) + 2.0))
    best = (
        sums.withColumn("weight", weight)
        .filter((F.col("weight") >= MIN_WEIGHT) & (F.bit_count("contexts") >= MIN_CONTEXTS))
        .orderBy(F.desc("weight"), "word")
        .collect()
    )
    lexicon = Lexicon({r["word"]: r["weight"] for r in best}, exceptions)

    strength = sliced_udf(lambda texts: pa.array([lexicon.strength(t) for t in texts.to_pylist()], pa.float64()), T.DoubleType())
    seen = rows.select("toxic", strength("text").alias("x")).collect()  # two numbers of each training row
    return Lexicon(lexicon.weights, exceptions, _threshold([r["x"] for r in seen], [r["toxic"] for r in seen]))


def _threshold(strengths: list[float], toxic: list[int]) -> float:
    """The middle of the gap below which the fewest training rows fall on the wrong side."""
    order = np.argsort(np.array(strengths), kind="stable")
    x, y = np.array(strengths)[order], np.array(toxic)[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    gaps = [k for k in range(1, len(x)) if x[k] > x[k - 1]]
    if not gaps:
        return 1.0
    k = min(gaps, key=lambda k: (wrong[k], -(x[k] - x[k - 1])))
    return float((x[k - 1] + x[k]) / 2)


def with_score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """row (all columns), score in [0, 1). Null, empty and wordless texts score 0; whole texts are read, repeated rows each."""
    score = sliced_udf(lambda texts: pa.array([lexicon.score(t) for t in texts.to_pylist()], pa.float64()), T.DoubleType())
    return packed(docs, text=text).select("row", score("text").alias("score"))
