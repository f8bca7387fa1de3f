"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Each task holds an embedded DuckDB with the merge table: (left id, right id, merged id) for every
way to cut a token of the rank file into two tokens; the merged id is the rank. The distinct words
of a slice of texts become token-position rows. A recursive query joins neighbouring rows with the
merge table, contracts the leftmost pair of the smallest rank in each word, and goes on until no
word has a pair left. Words that are tokens themselves are taken as they are. Decoding joins the
positions of a slice's ids with the vocabulary and concatenates the bytes in order.

Two forms of the recursion give the same ids. The first contracts one pair a word a round and suits
short words. The second, for words over LONG_WORD bytes, keeps the last state of each position only
and contracts all equal pairs of a word in one round, from left to right, where no cut of the merged
token ranks lower, so that doing so is the same as doing it one by one.

A worker remembers the words it has encoded, up to a bound, so that frequent words are encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marginalia.llm.common import packed, sliced_udf
from marginalia.llm.pieces import Memory, parts_array, plainly_spaced, sums, taken

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words of one of two generations that a worker remembers.
REMEMBERED = 150_000
#: Bytes of texts encoded at a time, about; their pieces are held as objects. More of both spare work and cost memory.
CODEC_SLICE = 2 << 20
#: Words in one recursive query.
WORDS_A_QUERY = 10_000
#: Ids in one decoding query.
IDS_A_QUERY = 100_000
#: Bytes beyond which a word takes the second form of the recursion.
LONG_WORD = 256
DUCKDB_MEMORY = "256MB"

ENCODE = """
WITH RECURSIVE state AS (
  SELECT word, pos, lead(pos) OVER w AS next_pos, token, lead(token) OVER w AS next_token, 0 AS round
  FROM positions WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL (
    WITH best AS (
      SELECT s.word, min(CAST(m.merged AS BIGINT) * 65536 + s.pos) AS k
      FROM state s JOIN merges m ON m.left_id = s.token AND m.right_id = s.next_token
      GROUP BY s.word
    ), pair AS (
      SELECT b.word, s.pos AS at, s.next_pos AS gone, CAST(b.k // 65536 AS INTEGER) AS merged
      FROM best b JOIN state s ON s.word = b.word AND s.pos = CAST(b.k % 65536 AS INTEGER)
    ), change AS (
      SELECT p.*, s.next_pos AS after_pos, s.next_token AS after_token
      FROM pair p JOIN state s ON s.word = p.word AND s.pos = p.gone
    )
    SELECT s.word, s.pos,
           CASE WHEN s.pos = c.at THEN c.after_pos ELSE s.next_pos END,
           CASE WHEN s.pos = c.at THEN c.merged ELSE s.token END,
           CASE WHEN s.pos = c.at THEN c.after_token WHEN s.next_pos = c.at THEN c.merged ELSE s.next_token END,
           s.round + 1
    FROM state s JOIN change c ON c.word = s.word
    WHERE s.pos <> c.gone
  )
), last AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, list(token ORDER BY pos) AS ids FROM state JOIN last USING (word, round) GROUP BY word ORDER BY word
"""
# Fewer rounds for long words: `stable` says that no pair with the merged token ranks below it.
ENCODE_LONG = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
  SELECT word, pos, token FROM positions
  UNION ALL (
    WITH near AS (
      SELECT word, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS gone
      FROM state WHERE token IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), pairs AS (
      SELECT n.word, n.pos, n.gone, m.merged, m.stable
      FROM near n JOIN merges m ON m.left_id = n.token AND m.right_id = n.next_token
    ), best AS (
      SELECT word, min(merged) AS merged, arg_min(pos, (merged, pos)) AS leftmost FROM pairs GROUP BY word
    ), equal AS (
      SELECT p.*, CAST(p.pos IS DISTINCT FROM lag(p.gone) OVER w AS INTEGER) AS opens
      FROM pairs p JOIN best b ON b.word = p.word AND b.merged = p.merged AND (p.stable OR p.pos = b.leftmost)
      WINDOW w AS (PARTITION BY p.word ORDER BY p.pos)
    ), runs AS (
      SELECT *, sum(opens) OVER (PARTITION BY word ORDER BY pos) AS run FROM equal
    ), hits AS (
      SELECT word, pos, gone, merged FROM runs QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
    )
    SELECT n.word, n.pos, CASE WHEN h.pos IS NOT NULL THEN h.merged WHEN g.gone IS NOT NULL THEN NULL ELSE n.token END
    FROM near n SEMI JOIN best b ON b.word = n.word
    LEFT JOIN hits h ON h.word = n.word AND h.pos = n.pos
    LEFT JOIN hits g ON g.word = n.word AND g.gone = n.pos
  )
)
SELECT word, list(token ORDER BY pos) AS ids FROM state WHERE token IS NOT NULL GROUP BY word ORDER BY word
"""
STABLE = """
CREATE TABLE merges AS
WITH uses AS (SELECT left_id AS id, merged FROM cuts UNION ALL SELECT right_id, merged FROM cuts),
least_use AS (SELECT id, min(merged) AS least FROM uses GROUP BY id)
SELECT c.left_id, c.right_id, c.merged, coalesce(u.least > c.merged, true) AS stable
FROM cuts c LEFT JOIN least_use u ON u.id = c.merged
"""
DECODE = """
SELECT string_agg(v.letters, '' ORDER BY p.pos) AS letters FROM ids p JOIN vocabulary v ON v.id = p.id
"""


def read_ranks(name: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank a line."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Vocabulary, merge table and remembered words of one worker."""

    def __init__(self, name: str = RANKS, remembered: int = REMEMBERED):
        self.ranks = read_ranks(name)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # Ids as 32-bit integers in bytes.
        self.words = Memory(remembered)
        # Bytes of each token, and whether it starts with a blank.
        self.lengths = np.zeros(len(self.ranks), dtype=np.int64)
        self.lengths[list(self.ranks.values())] = [len(token) for token in self.ranks]
        self.blank_first = np.zeros(len(self.ranks), dtype=bool)
        self.blank_first[[rank for token, rank in self.ranks.items() if token[:1] == b" "]] = True
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        cuts = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        left, right, merged = np.array(cuts, dtype=np.int32).T
        self._table("cuts", left_id=left, right_id=right, merged=merged)
        self.db.execute(STABLE)
        # Each byte as the character of its number: DuckDB then concatenates strings of any bytes.
        self._table("vocabulary", id=list(self.ranks.values()), letters=[t.decode("latin-1") for t in self.ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, query: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, query: str, raws: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, in order, by one recursive query."""
        size = np.array([len(raw) for raw in raws])
        starts = np.repeat(np.cumsum(size) - size, size)
        letters = np.frombuffer(b"".join(raws), dtype=np.uint8)
        found = self._rows(
            query,
            "positions",
            word=np.repeat(np.arange(len(raws), dtype=np.int32), size),
            pos=(np.arange(len(letters)) - starts).astype(np.int32),
            token=self.byte_ids[letters],
        )
        lists = found.column("ids").combine_chunks()
        ids, at = np.asarray(lists.flatten(), dtype=np.int32).tobytes(), 0
        for n in np.asarray(lists.value_lengths()).tolist():
            yield ids[at : at + 4 * n]
            at += 4 * n

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct words in a row, and how many each has."""
        found = self.words.recall(words)
        short: list[tuple[int, bytes]] = []
        long: list[tuple[int, bytes]] = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            raw = words[k].encode()
            rank = self.ranks.get(raw)
            if rank is None:
                (short if len(raw) <= LONG_WORD else long).append((k, raw))
            else:
                found[k] = np.int32(rank).tobytes()
        for query, some in ((ENCODE, short), (ENCODE_LONG, long)):
            for at in range(0, len(some), WORDS_A_QUERY):
                chunk = some[at : at + WORDS_A_QUERY]
                for (k, _), ids in zip(chunk, self._contract(query, [raw for _, raw in chunk])):
                    found[k] = ids
        self.words.keep({words[k]: found[k] for k, _ in short})
        return np.frombuffer(b"".join(found), dtype=np.int32), np.array([len(x) // 4 for x in found], dtype=np.int64)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct parts of plainly spaced texts; no part is a line feed."""
        # A line feed between parts is a piece of its own, whatever stands around it.
        pieces = pa.array(self.pattern.findall("\n".join(parts)), pa.string()).dictionary_encode()
        words, code = pieces.dictionary.to_pylist(), np.asarray(pieces.indices)
        mark = code == (words.index("\n") if "\n" in words else -1)
        part = np.cumsum(mark)[~mark]
        ids, size = taken(*self.encode_words(words), code[~mark])
        return ids, np.bincount(part, weights=size, minlength=len(parts)).astype(np.int64)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plainly spaced texts in a row, and how many each has."""
        units, count = parts_array(texts)
        parts, code = units.dictionary.to_pylist(), np.asarray(units.indices).astype(np.int64)
        feed = parts.index("\n") if "\n" in parts else len(parts)
        code += (code == feed) * (len(parts) - feed) - (code > feed)  # the line feed comes last
        ids, size = self.encode_parts(parts[:feed] + parts[feed + 1 :])
        last, of_last = self.encode_words(["\n"])
        ids, size = taken(np.concatenate([ids, last]), np.concatenate([size, of_last]), np.minimum(code, len(size)))
        return ids, sums(size, count)

    def _encode_other(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any texts."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        pieces = pa.array([x for some in cut for x in some], pa.string()).dictionary_encode()
        ids, size = taken(*self.encode_words(pieces.dictionary.to_pylist()), np.asarray(pieces.indices))
        return ids, sums(size, np.array([len(some) for some in cut], dtype=np.int64))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null and empty texts have none."""
        values = texts.to_pylist()
        plain = np.array([bool(t) and plainly_spaced(t) for t in values], dtype=bool)
        ids, size = self._encode_plain(texts.filter(pa.array(plain)))
        if not plain.all():
            more, of_more = self._encode_other([t for t, p in zip(values, plain.tolist()) if not p])
            order = np.empty(len(plain), dtype=np.int64)
            order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(plain))
            ids, size = taken(np.concatenate([ids, more]), np.concatenate([size, of_more]), order)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), ids)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for; null for null. Ids outside the vocabulary are an error.

        Lists are cut where a token starts with a blank, and each different run of ids is decoded once.
        """
        size = np.asarray(pc.fill_null(lists.value_lengths(), 0), dtype=np.int64)
        flat = np.ascontiguousarray(lists.flatten(), dtype=np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.ranks)):
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(size)
        opens = self.blank_first[flat]
        opens[(ends - size)[size > 0]] = True
        cuts = np.concatenate([np.flatnonzero(opens), [len(flat)]])
        runs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        known, at = self._decode_runs(runs.dictionary), np.asarray(runs.indices)
        joined = known.take(runs.indices)
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(known), dtype=np.int64)[at])])
        offsets = bounds[np.searchsorted(cuts, np.concatenate([[0], ends]))]
        out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), joined.buffers()[2]])
        return pc.if_else(lists.is_valid(), out, None) if lists.null_count else out

    def _decode_runs(self, runs: pa.BinaryArray) -> pa.BinaryArray:
        size = np.asarray(pc.binary_length(runs), dtype=np.int64) // 4
        ids, out = np.frombuffer(b"".join(runs.to_pylist()), dtype=np.int32), []
        for at in range(0, len(ids), IDS_A_QUERY):
            some = ids[at : at + IDS_A_QUERY]
            found = self._rows(DECODE, "ids", pos=np.arange(len(some), dtype=np.int32), id=some)
            out.append(found.column("letters")[0].as_py().encode("latin-1"))
        offsets = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], np.cumsum(size)])]
        return pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(out))])


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(name: str = RANKS, remembered: int = REMEMBERED) -> Codec:
    """The worker's codec, made once a process."""
    if (name, remembered) not in _CODECS:
        _CODECS[name, remembered] = Codec(name, remembered)
    return _CODECS[name, remembered]


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """row (all columns), ids: the token ids of each whole text. Null and empty texts have no ids; every row stays."""
    ids = sliced_udf(lambda texts: codec(ranks).encode(texts), T.ArrayType(T.IntegerType()), CODEC_SLICE)
    return packed(docs, text=text).select("row", ids("text").alias("ids"))


def decode(encoded: DataFrame, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """row (all columns), decoded: the bytes that the ids stand for; null for null ids. Unknown ids are an error."""
    decoded = sliced_udf(lambda lists: codec(ranks).decode(lists), T.BinaryType(), CODEC_SLICE)
    return packed(encoded, ids=ids).select("row", decoded("ids").alias("decoded"))


def encode_and_decode(docs: DataFrame, text: str = "text", ranks: str = RANKS, slice_bytes: int = CODEC_SLICE, remembered: int = REMEMBERED) -> DataFrame:
    """row (all columns), ids, decoded: `encode` and `decode` in one visit of one worker."""

    def both(texts: pa.Array) -> pa.Array:
        mine = codec(ranks, remembered)
        lists = mine.encode(texts)
        return pa.StructArray.from_arrays([lists, mine.decode(lists)], names=["ids", "decoded"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    # Not to be evaluated again for each field that a query takes.
    coded = packed(docs, text=text).select("row", sliced_udf(both, kind, slice_bytes).asNondeterministic()("text").alias("coded"))
    return coded.select("row", "coded.ids", "coded.decoded")
