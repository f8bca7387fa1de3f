"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

Rows are dealt to tasks by ranges of the key and sorted inside them, so file after file holds the
documents in ascending key order; how many files there are follows the bytes of the table. Each task streams its documents through the tokenizer and writes
three files: `<part>.ids` (unsigned integers of 2 bytes where the vocabulary allows it, else 4),
`<part>.offsets` (64-bit, one more than documents, in ids from the start of the file) and
`<part>.keys` (64-bit, NULL_KEY for null). A file appears under its name only when it is whole, so a lost task can run
again. What a part adds to the ids before it is the prefix sum of the parts' counts. Reading maps
the files into memory.

The folder must be seen by all executors under one path (a mounted shared store).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm.common import materialize, new_path, prefix_sums, text_slices
from marginalia.llm.pieces import Memory, parts_array, plainly_spaced, sums, taken

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Parts of texts of one of two generations that a worker remembers, and parts in one call of the library.
REMEMBERED, PARTS_A_CALL = 200_000, 10_000
#: Bytes of texts in one part of the output, about.
PART_BYTES = 24 << 20
#: What stands for a null key in the key files.
NULL_KEY = -(1 << 63)
#: Bytes of texts that are encoded at a time, about: the more, the more parts they share.
WRITE_SLICE_BYTES = 8 << 20
#: Ids that are read from a mapped file at a time.
READ_IDS = 1 << 20


class TextEncoder:
    """The ids of whole texts by the tokenizers library.

    The library's byte-level splitting starts a piece at every blank before a word and on either
    side of a line feed between words, so a text cut there has the ids of its parts in a row. The
    different parts of a slice of texts go to the library in a row, with line feeds between them,
    and frequent ones are remembered. Texts with white space in other shapes, and texts that hold
    the name of an added token, are given to the library one by one.
    """

    def __init__(self, name: str = TOKENIZER):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.kind = "<u4" if self.library.get_vocab_size() > 65536 else "<u2"
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self._ids("\n")[0]
        self.parts = Memory(REMEMBERED)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts in a row, and how many each has; no part is a line feed."""
        found = self.parts.recall(parts)
        fresh = [k for k, ids in enumerate(found) if ids is None]
        for at in range(0, len(fresh), PARTS_A_CALL):
            some = fresh[at : at + PARTS_A_CALL]
            ids = self._ids("\n".join([parts[k] for k in some]))
            ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not keep line feeds apart")
            raw, width = ids.tobytes(), ids.itemsize
            for k, a, b in zip(some, [0, *[e + 1 for e in ends]], ends):
                found[k] = raw[width * a : width * b]
        self.parts.keep({parts[k]: found[k] for k in fresh})
        size = np.array([len(x) for x in found], dtype=np.int64) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(found), dtype=self.kind), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has; null and empty texts have none."""
        values = texts.to_pylist()
        plain = np.array([bool(t) and plainly_spaced(t) and not any(name in t for name in self.added) for t in values], dtype=bool)
        units, count = parts_array(texts.filter(pa.array(plain)))
        parts, code = units.dictionary.to_pylist(), np.asarray(units.indices).astype(np.int64)
        feed = parts.index("\n") if "\n" in parts else len(parts)
        code += (code == feed) * (len(parts) - feed) - (code > feed)  # the line feed comes last
        ids, size = self.encode_parts(parts[:feed] + parts[feed + 1 :])
        ids, size = np.append(ids, np.array([self.feed], dtype=self.kind)), np.append(size, 1)
        ids, size = taken(ids, size, np.minimum(code, len(size) - 1))
        size = sums(size, count)
        if not plain.all():
            other = [self._ids(t or "") for t, p in zip(values, plain.tolist()) if not p]
            order = np.empty(len(plain), dtype=np.int64)
            order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(plain))
            ids, size = taken(np.concatenate([ids, *other]), np.concatenate([size, [len(x) for x in other]]), order)
        return ids, size


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str = TOKENIZER) -> TextEncoder:
    if name not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[name] = TextEncoder(name)
    return _ENCODERS[name]


def local_path(path: str) -> str:
    """The path of a folder on a mounted store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped output needs a mounted folder, not {path}")
    return path


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the files; returns one row a part: part, docs, ids, width, base (ids of all parts before it).

    Null and empty texts have the end id alone. Rows with a null key come first; rows that share a
    key all stay, in an order by their texts. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    total = docs.agg(F.sum(F.octet_length(text).cast("long") + 1)).first()[0] or 0
    partitions = max(1, -(-total // part_bytes))

    def write(batches):
        from pyspark import TaskContext

        part, codes = TaskContext.get().partitionId(), encoder(tokenizer)
        width, end = np.dtype(codes.kind).itemsize, 0 if end_id is None else 1
        name, mine = f"{folder}/part-{part:06d}", uuid.uuid4().hex
        sizes, keys = [np.zeros(1, np.int64)], []
        with open(f"{name}.ids.{mine}", "wb") as out:
            for batch in batches:
                keys.append(np.asarray(pc.fill_null(batch.column(0), NULL_KEY), dtype="<i8"))
                for texts in text_slices([batch.column(1)], WRITE_SLICE_BYTES):
                    ids, size = codes.encode(texts)
                    with_ends = np.full(len(ids) + end * len(size), end_id or 0, dtype=codes.kind)
                    inner = np.ones(len(with_ends), dtype=bool)
                    if end:
                        inner[np.cumsum(size + 1) - 1] = False
                    with_ends[inner] = ids
                    with_ends.tofile(out)
                    sizes.append(size + end)
        offsets, found = np.cumsum(np.concatenate(sizes), dtype="<i8"), np.concatenate([np.zeros(0, "<i8"), *keys])
        offsets.tofile(f"{name}.offsets.{mine}")
        found.tofile(f"{name}.keys.{mine}")
        for kind in ("ids", "offsets", "keys"):
            if len(found):
                os.replace(f"{name}.{kind}.{mine}", f"{name}.{kind}")
            else:
                os.remove(f"{name}.{kind}.{mine}")
        if len(found):
            row = {"part": [part], "docs": [len(found)], "ids": [int(offsets[-1])], "width": [width]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in row.items()})

    # Rows that share a key may be very many: their texts, and then their places, part them.
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.repartitionByRange(partitions, "key", "tie", "place").sortWithinPartitions("key", "tie", "place").select("key", "text")
    parts = materialize(dealt.mapInArrow(write, "part long, docs long, ids long, width long"), "token-parts")
    return prefix_sums(parts, "part", "ids", "base")


def read_tokens(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """One row a document, from the mapped files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder = local_path(path)

    def read(batches):
        for batch in batches:
            for part, base, width in zip(*(batch.column(k).to_pylist() for k in range(3))):
                name = f"{folder}/part-{part:06d}"
                ids = np.memmap(f"{name}.ids", dtype=f"<u{width}", mode="r") if os.path.getsize(f"{name}.ids") else np.zeros(0, f"<u{width}")
                offsets, keys = np.memmap(f"{name}.offsets", dtype="<i8", mode="r"), np.memmap(f"{name}.keys", dtype="<i8", mode="r")
                for at in range(0, len(keys), 4096):
                    some = offsets[at : at + 4097]
                    sums = []
                    for a, b in zip(some[:-1].tolist(), some[1:].tolist()):
                        crc = 0
                        for k in range(a, b, READ_IDS):
                            crc = zlib.crc32(ids[k : min(b, k + READ_IDS)].astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    some_keys = np.array(keys[at : at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some_keys, mask=some_keys == NULL_KEY), pa.array(np.array(some[:-1]) + base), pa.array(np.diff(some)), pa.array(sums, pa.int64())],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )

    dealt = parts.select("part", "base", "width").repartition("part")
    return dealt.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def describe(path: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID) -> None:
    """Write what a reader must know of the format beside the files."""
    codes = encoder(tokenizer)
    with open(f"{local_path(path)}/format.json", "w") as out:
        json.dump({"tokenizer": tokenizer, "ids": codes.kind, "offsets": "<i8", "keys": "<i8", "end_id": end_id}, out)


def token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = END_ID) -> DataFrame:
    """Write into a fresh folder of the shared store and read back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    parts = write_tokens(docs, path, key, text, tokenizer, end_id)
    describe(path, tokenizer, end_id)
    return read_tokens(spark, path, parts)
