"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same texts.

Equal texts meet in one shuffle by the full text and become one row with the number of their
copies; each distinct text is tokenised and aligned once. Texts are taken in blocks of a few
megabytes. A block's linked id pairs form its dictionary, with the number of documents that hold
each (copies counted), so a pair that every document holds is one row a block. The dictionaries are
added up to corpus-wide counts, the counts go back to the blocks, and each block adds them up over
the links of its texts. The measures of a text are joined to the rows that hold it by the text's
SHA-256.

The space that B puts before a text is given to A as well, so both cover the same bytes. The ends of
A's and B's tokens cut a text into intervals; each lies in one token of A and one of B and is their
link. An end of both closes a group.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from marginalia.llm.common import materialize, packed, text_slices
from marginalia.llm.pieces import Memory, parts_array, plainly_spaced, sums, taken
from marginalia.llm.token_output import TextEncoder

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Bits of the id of B in a pair.
SHIFT = 32
#: Bytes of the texts of a block, about: arrays of its links take some twenty times as much.
BLOCK_BYTES = 2 << 20
#: Parts of texts of one of two generations that a worker remembers.
REMEMBERED = 100_000
#: Slices of one partition at most, for the numbers of blocks.
SLICES = 1 << 24
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_COMMA, _BAR, _SEMICOLON = b",|;"


def byte_letters() -> dict[str, int]:
    """The letter of byte-level tokenizers for each byte: printable bytes stand for themselves, others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and the length of each."""
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.array([len(t) for t in tokens], dtype=np.int64)


class SpacedEncoder(TextEncoder):
    """Ids of the tokenizers library for texts with a space before them; names of added tokens are plain text."""

    def __init__(self, name: str = TOKENIZER_A):
        super().__init__(name)
        self.library.encode_special_tokens = True
        self.parts = Memory(REMEMBERED)
        letters, vocabulary = byte_letters(), self.library.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.table = _table(tokens)

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (none is empty) in a row, and how many each has."""
        plain = np.array([plainly_spaced(t) for t in texts], dtype=bool)
        units, count = parts_array(pa.array([f" {t}" for t, p in zip(texts, plain.tolist()) if p], pa.string()))
        parts, code = units.dictionary.to_pylist(), np.asarray(units.indices).astype(np.int64)
        feed = parts.index("\n") if "\n" in parts else len(parts)
        code += (code == feed) * (len(parts) - feed) - (code > feed)  # the line feed comes last
        ids, size = self.encode_parts(parts[:feed] + parts[feed + 1 :])
        ids, size = np.append(ids, np.array([self.feed], dtype=self.kind)), np.append(size, 1)
        ids, size = taken(ids, size, np.minimum(code, len(size) - 1))
        size = sums(size, count)
        if plain.all():
            return ids, size
        other = [self._ids(f" {t}") for t, p in zip(texts, plain.tolist()) if not p]
        order = np.empty(len(plain), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(plain))
        return taken(np.concatenate([ids, *other]), np.concatenate([size, [len(x) for x in other]]).astype(np.int64), order)


class PieceEncoder:
    """Ids of the sentencepiece library, which puts a space before each text itself."""

    def __init__(self, name: str = TOKENIZER_B):
        self.library = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        byte = [self.library.is_byte(k) for k in range(len(pieces))]
        self.table = _table([bytes([int(p[3:-1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte)])

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1)
        size = np.array([len(x) for x in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(size.sum())), size


_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoders(a: str, b: str) -> tuple[SpacedEncoder, PieceEncoder]:
    if (a, b) not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[a, b] = SpacedEncoder(a), PieceEncoder(b)
    return _ENCODERS[a, b]


def _covers(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, size: np.ndarray, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each text whether the bytes of its tokens are its own."""
    letters, width = table
    same = sums(width[ids], size) == length
    mine, _ = taken(letters, width, ids[np.repeat(same, size)])
    wrong = mine != raw[np.repeat(same, length)]
    same[same] = sums(wrong.astype(np.int64), length[same]) == 0
    return same


def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to `top`, with a place for one more letter, and how many there are."""
    names = [str(k).encode() for k in range(top + 1)]
    width = len(names[-1]) + 1
    return np.frombuffer(b"".join(n.ljust(width) for n in names), dtype=np.uint8).reshape(-1, width), np.array([len(n) for n in names])


class Aligner:
    """Aligns a block of distinct texts."""

    def __init__(self, a: str, b: str):
        self.a, self.b = encoders(a, b)
        self.digits, self.n_digits = _decimals(max(len(self.a.table[1]), len(self.b.table[1])))

    def _written(self, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, count: np.ndarray) -> pa.Array:
        """Groups as `a1,a2|b1;a3|b2,b3`, one string a text. `count`: tokens of both kinds of each text."""
        ends_a, ends_b = np.flatnonzero(closes_a) + 1, np.flatnonzero(closes_b) + 1
        place_a = np.arange(len(a)) + np.concatenate([[0], ends_b])[np.cumsum(closes_a) - closes_a]
        place_b = np.arange(len(b)) + ends_a[np.cumsum(closes_b) - closes_b]
        ids, after = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), _COMMA, dtype=np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[closes_a]], after[place_b[closes_b]] = _BAR, _SEMICOLON
        letters, size = self.digits[ids], self.n_digits[ids]
        letters[np.arange(len(ids)), size] = after
        size += 1
        ends = np.cumsum(count)
        size[ends[count > 0] - 1] -= 1  # nothing follows the last group
        flat = letters[np.arange(letters.shape[1]) < size[:, None]]
        offsets = np.concatenate([[0], np.cumsum(sums(size, count))])
        return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])

    def align(self, texts: list[str], copies: np.ndarray) -> dict:
        """Measures and links of each text; the block's pairs and how many documents hold each."""
        spaced = [f" {t}".encode() for t in texts]
        length, raw = np.array([len(s) for s in spaced], dtype=np.int64), np.frombuffer(b"".join(spaced), dtype=np.uint8)
        coded, whole = [], np.ones(len(texts), dtype=bool)
        for side in (self.a, self.b):
            ids, size = side.spaced(texts)
            whole &= _covers(side.table, ids, size, raw, length)
            coded.append((ids, size))
        a, b = (ids[np.repeat(whole, size)].astype(np.int64) for ids, size in coded)
        n_a, n_b = (np.where(whole, size, 0) for _, size in coded)
        total = int(length[whole].sum())
        mark_a, mark_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        ends_a, ends_b = np.cumsum(self.a.table[1][a]), np.cumsum(self.b.table[1][b])
        mark_a[ends_a], mark_b[ends_b] = True, True
        closes_a, closes_b = mark_b[ends_a], mark_a[ends_b]
        cut = np.flatnonzero(mark_a | mark_b)
        in_a, in_b = mark_a[cut], mark_b[cut]
        pair = (a[np.cumsum(in_a) - in_a] << SHIFT) | b[np.cumsum(in_b) - in_b]
        n_groups = sums(closes_a.astype(np.int64), n_a)
        n_links = n_a + n_b - n_groups
        known = pa.array(pair, pa.int64()).dictionary_encode()
        pairs, code = np.asarray(known.dictionary), np.asarray(known.indices).astype(np.int64)
        held = np.unique(np.repeat(np.arange(len(texts)), n_links) * max(1, len(pairs)) + code)
        docs = np.bincount(held % max(1, len(pairs)), weights=copies[held // max(1, len(pairs))], minlength=len(pairs))
        kind = "<u2" if len(pairs) <= 1 << 16 else "<u4"
        stored, upto = code.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(n_links)]) * np.dtype(kind).itemsize
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_links,
            "groups": self._written(a, b, closes_a, closes_b, n_a + n_b),
            "links": [stored[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())],
            "pairs": pairs,
            "docs": docs.astype(np.int64),
        }


_BLOCKS = "block long, key binary, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<long>, docs array<long>"


def _aligned(a: str, b: str, block_bytes: int):
    """One row a text, then one row with the pairs of the block."""

    def run(batches):
        from pyspark import TaskContext

        aligner, block = Aligner(a, b), TaskContext.get().partitionId() * SLICES
        for batch in batches:
            at = 0
            for texts in text_slices([batch.column(0)], block_bytes):
                n = len(texts)
                copies, keys = np.asarray(batch.column(1)[at : at + n]), batch.column(2)[at : at + n]
                at += n
                found = aligner.align(texts.to_pylist(), copies)
                one = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), keys.cast(pa.binary()), *[pa.array(found[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], found["groups"].cast(pa.string()), pa.array(found["links"], pa.binary()), one, one],
                    names=["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "docs"],
                )
                pairs = {"block": [block], "key": [None], "n_a": [None], "n_b": [None], "n_groups": [None], "n_links": [None], "groups": [None], "links": [None], "pairs": [found["pairs"]], "docs": [found["docs"]]}
                yield pa.RecordBatch.from_pydict(pairs, schema=pa.schema([("block", pa.int64()), ("key", pa.binary()), *[(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]))
                block += 1
                pa.default_memory_pool().release_unused()

    return run


def _added_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Over the links of each text of a block the sum of the pairs' counts, and how many have their A id's highest."""
    size = np.asarray(texts["n_links"])
    flat = b"".join(texts["links"].to_pylist())
    code = np.frombuffer(flat, dtype=f"<u{len(flat) // max(1, int(size.sum())) or 2}").astype(np.int64)
    at = np.asarray(counts["at"])
    count, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    count[at], best[at] = np.asarray(counts["count"]), np.asarray(counts["is_best"]).astype(np.int64)
    kept = texts.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return kept.append_column("n_best", pa.array(sums(best[code], size))).append_column("count_sum", pa.array(sums(count[code], size)))


def align(docs: DataFrame, text: str = "text", groups: Callable[[Column], Column] = lambda written: written, a: str = TOKENIZER_A, b: str = TOKENIZER_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of each document in `row`, beside n_a, n_b, n_groups, n_links, n_best, count_sum and `groups`.

    `groups` is the alignment as `a1,a2|b1;a3|b2,b3` (ids of A and B of each group), or the
    text that the parameter makes of that column: it is applied before anything is written. Null and empty texts,
    and texts that one side's tokens do not give back byte for byte, have zeros and ''. Each row is a
    document, also where keys or texts repeat. An empty table gives an empty result.
    """
    texts = docs.select(F.col(f"`{text}`").alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = texts.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key"))
    aligned = keyed.mapInArrow(_aligned(a, b, block_bytes), _BLOCKS)
    written = F.when(F.col("n_a") > 0, groups(F.col("groups"))).when(F.col("n_a") == 0, "")
    blocks = materialize(aligned.withColumn("groups", written), "aligned")
    entries = blocks.filter("pairs IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "_e")).select("of_block", "at", "_e.pairs", "_e.docs")
    counts = materialize(entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count")), "pair-counts")
    # One row an id of A: as many as its vocabulary has.
    highest = counts.groupBy(F.shiftright("pair", SHIFT).alias("id_a")).agg(F.max("count").alias("highest"))
    ranked = counts.join(F.broadcast(highest), F.shiftright("pair", SHIFT) == F.col("id_a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    known = entries.join(ranked, F.col("pairs") == F.col("pair")).select("of_block", "at", "count", "is_best")
    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    per_text = blocks.filter("key IS NOT NULL").drop("pairs", "docs").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_added_up, schema)
    rows = packed(docs, _text=text)
    filled = rows.filter("_text <> ''").withColumn("_key", F.unhex(F.sha2("_text", 256))).drop("_text")
    joined = filled.join(per_text, F.col("_key") == F.col("key"), "left").select("row", *MEASURES, "groups")
    bare = rows.filter("_text IS NULL OR _text = ''").select("row", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups"))
    return joined.unionByName(bare)
