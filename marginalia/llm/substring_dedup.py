"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last WINDOW bytes ends in zeros under a mask, so an
insertion moves the cuts near it only and the chunks after it keep their bytes. Chunks are
deduplicated by a 128-bit digest and their size: the first occurrence in the order (key, offset)
stays, later ones are repeats. Repeats that touch are one span; spans of MIN_SPAN bytes or more
are reported. With chunks of about 30 bytes a passage of 50 words holds several whole ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, packed, text_slices

MIN_CHUNK, MAX_CHUNK = 16, 256
#: Bits 20 to 23 of the hash: a place depends on 24 bytes, and one in 16 is a cut.
MASK = np.uint32(0xF << 20)
WINDOW = 24
MIN_SPAN = 128
CHUNK = "doc long, row long, start int, size int, high long, low long"


def gear_table() -> np.ndarray:
    """A random 32-bit number for each byte value, by rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=0x9E37) for b in range(256)], dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """hash[i] = 2 * hash[i - 1] + gear[byte i] modulo 2^32, for all i, by doubling the window."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(raw: bytes) -> list[int]:
    """Chunk ends, ascending; the last is the length. Cuts stand between UTF-8 characters."""
    n = len(raw)
    if not n:
        return []
    data = np.frombuffer(raw, np.uint8)
    here = gear_hashes(data) & MASK == 0
    here[:-1] &= data[1:] & 0xC0 != 0x80  # the next byte starts a character
    ends, last = [], 0
    for place in [*(np.flatnonzero(here[: n - 1]) + 1).tolist(), n]:
        while place - last > MAX_CHUNK:
            last += MAX_CHUNK
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if place - last >= MIN_CHUNK or place == n and place > last:
            ends.append(place)
            last = place
    return ends


def _chunk_rows(batches):
    for batch in batches:
        texts = (t for some in text_slices([batch.column(2)]) for t in some)
        for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            ends = cuts(raw)
            if not ends:
                continue
            starts = [0, *ends[:-1]]
            digest = xxhash.xxh3_128_digest
            pair = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts, ends)]), dtype=">i8").reshape(-1, 2).astype(np.int64)
            first = np.array(starts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), key, dtype=np.int64)),
                    pa.array(np.full(len(first), row, dtype=np.int64)),
                    pa.array(first),
                    pa.array(np.array(ends, dtype=np.int32) - first),
                    pa.array(np.ascontiguousarray(pair[:, 0])),
                    pa.array(np.ascontiguousarray(pair[:, 1])),
                ],
                names=["doc", "row", "start", "size", "high", "low"],
            )


def _joined_batches(batches):
    """Fewer, larger batches of chunk rows."""
    held, rows = [], 0
    for batch in _chunk_rows(batches):
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a chunk: doc, row (a hash of the text), start and size in UTF-8 bytes, 128-bit digest as two longs.

    Rows with a null key, null and empty texts have no chunks.
    """
    some = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.xxhash64(text), F.col(text))
    return some.mapInArrow(_joined_batches, CHUNK)


def _repeats(every: DataFrame) -> DataFrame:
    """The chunks that are not the first of their digest and size, with the first place and the number of places.

    First the digests that occur twice are found by half a digest, combined before the shuffle; what
    shares them is a small part of all chunks, and the rest is done on that part. Both joins bring a
    table of one row a digest to the chunks, so that adaptive execution can split a frequent digest.
    """
    twice = materialize(every.groupBy("high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("high"), "chunks-twice")
    shared = materialize(every.join(twice, "high", "left_semi"), "chunks-shared")
    place = F.struct("doc", "row", "start")
    firsts = shared.groupBy("high", "low", "size").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    firsts = materialize(firsts, "chunks-firsts")
    return shared.join(firsts, ["high", "low", "size"]).filter(place > F.col("first"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN, inside: bool = True) -> DataFrame:
    """Spans that repeat earlier text: key, text_hash, start, size (bytes), chunks, first_doc_id, occurrences, inside.

    Earlier is the order of key, hash of the text, and place in the text. A row is its key and its
    text: rows that share both count as one (none repeats the other, and their span is given once),
    rows that share the key alone are apart. `inside` asks for repeats of the row's own text too; the
    column `inside` is true where all chunks of a span come first in the row itself, and false where
    any comes first in another row.
    first_doc_id is the smallest key that holds the first occurrence of a chunk of the span;
    occurrences is the largest count of any of its chunks in the table.
    """
    repeats = _repeats(materialize(chunks(docs, key, text), "chunks"))
    own = (F.col("doc") == F.col("first.doc")) & (F.col("row") == F.col("first.row"))
    if not inside:
        repeats = repeats.filter(~own)
    in_order = Window.partitionBy("doc", "row").orderBy("start")
    ended = F.lag(F.col("start") + F.col("size")).over(in_order)
    spans = (
        repeats.select("doc", "row", "start", "size", F.col("first.doc").alias("first"), "occurrences", own.alias("own"))
        .withColumn("_opens", F.coalesce((ended < F.col("start")).cast("int"), F.lit(1)))
        .withColumn("_again", F.coalesce(F.lag("start").over(in_order) == F.col("start"), F.lit(False)))
        .withColumn("_span", F.sum("_opens").over(in_order))
        .groupBy("doc", "row", "_span")
        .agg(
            F.min("start").alias("start"),
            F.max(F.col("start") + F.col("size")).alias("_end"),
            F.count_if(~F.col("_again")).alias("chunks"),
            F.min("first").alias("first_doc_id"),
            F.max("occurrences").alias("occurrences"),
            F.bool_and("own").alias("inside"),
        )
    )
    sized = spans.withColumn("size", F.col("_end") - F.col("start")).filter(F.col("size") >= min_span)
    return sized.select(F.col("doc").alias(key), F.col("row").alias("text_hash"), "start", "size", "chunks", "first_doc_id", "occurrences", "inside")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """row (all columns), cleaned: the text without its repeated spans (null stays null)."""
    spans = repeated_spans(docs, key, text, min_span)
    by_row = spans.groupBy(F.col(key).alias("doc"), "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))

    @F.arrow_udf(T.StringType())
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        cleaned = []
        for value, gone in zip(texts, spans):
            raw, at, kept = value.as_buffer().to_pybytes() if value.is_valid else b"", 0, []
            for span in gone.as_py() or ():
                kept.append(raw[at : span["start"]])
                at = span["start"] + span["size"]
            cleaned.append(b"".join([*kept, raw[at:]]).decode() if value.is_valid else None)
        return pa.array(cleaned, pa.string())

    marked = packed(docs, own_key=F.col(key).cast("long"), own_hash=F.xxhash64(text), text=text)
    joined = marked.join(by_row, (F.col("own_key") == F.col("doc")) & (F.col("own_hash") == F.col("text_hash")), "left")
    return joined.select("row", cut_out("text", "spans").alias("cleaned"))
