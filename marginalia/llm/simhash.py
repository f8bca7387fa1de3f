"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ
in three bits or fewer differ in at most one bit in at least two of the three segments. A segment
is decoded to the index of the nearest codeword of the perfect (23, 12) Golay code; `near` are the
indices of all words within one bit. If x and y differ in one bit at most, own(y) is in near(x)
and own(x) is in near(y). So for each pair of segments (i, j) every fingerprint writes the left
keys (near_i, own_j) and the right keys (own_i, near_j); left and right keys of any two linked
fingerprints meet, and the join keeps the pairs whose bits really differ by three at most.
Fingerprints are made distinct first, so copies add nothing to the join, and components are found
over distinct fingerprints.

Texts with a Jaccard similarity of 0.8 differ in about nine bits, and a pigeonhole over 64 bits
that wide has keys too short to tell texts apart. `keep_one` therefore takes candidates from
min-hash bands as well as from links, and verifies each by the exact similarity of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, packed, sliced_udf, text_slices
from marginalia.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Bits of the three segments, low bits first.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Shingles hashed at a time; bounds the memory a very long text takes.
BLOCK = 200_000
#: What makes near copies for keep_one: shingles of so many words with a Jaccard similarity of so much.
COPY_WORDS = 5
SIMILARITY = 0.8
#: A band is the minima of BAND_ROWS hash functions; two texts at 0.8 share one of them with 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Members of a band's group that all meet each other.
SMALL_GROUP = 16
#: Rarer shingles that a shingle of the prefix filter knows of; more of them spare repeated pairs, no number loses one.
RARER = 48
#: Shingles that all hash functions take at a time.
MINIMA_BLOCK = 4_096


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def _error_table() -> np.ndarray:
    """The error pattern of weight 3 or less for each of the 2,048 syndromes."""
    single = 1 << np.arange(23, dtype=np.int64)
    two = [a | b for i, a in enumerate(single) for b in single[:i]]
    three = [a | b | c for k, a in enumerate(single) for i, b in enumerate(single[:k]) for c in single[:i]]
    errors = np.array([0, *single, *two, *three], dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndromes(errors)] = errors
    return table


_TABLE: list[np.ndarray] = []


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    if not _TABLE:
        _TABLE.append(_error_table())
    words = words.astype(np.int64)
    return (words ^ _TABLE[0][_syndromes(words)]) >> 11


def near_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each word and of its `bits` one-bit neighbours, one row a word."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    return codeword_index((words.astype(np.int64)[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1)


def shingle_hashes(text: str | None, words: int):
    """Blocks of XXH64 values of the shingles of a text; none for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if 0 < len(parts) < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], dtype=">u8")
        return
    for at in range(0, len(parts) - words + 1, BLOCK):
        some = parts[at : at + BLOCK + words - 1]
        tuples = zip(*(some[k:] for k in range(words)))
        yield np.array([xxhash.xxh64_intdigest(b" ".join(t), SEED) for t in tuples], dtype=">u8")


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for a text without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for block in shingle_hashes(text, words):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n).view(">u8")[0]) if n else 0


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """row (all columns), fingerprint as a signed 64-bit integer."""

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t, words) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64))

    return packed(docs, text=text).select("row", sliced_udf(prints, T.LongType())("text").alias("fingerprint"))


def _keys(batches):
    """Left and right keys of distinct fingerprints, for all three pairs of segments."""
    for batch in batches:
        fp = np.asarray(batch.column(0)).astype(np.int64)
        bits, at, own, near = fp.view(np.uint64), 0, [], []
        for width in SEGMENTS:
            segment = ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
            own.append(codeword_index(segment))
            sorted_near = np.sort(near_indices(segment, width), axis=1)
            fresh = np.concatenate([np.ones((len(fp), 1), bool), sorted_near[:, 1:] != sorted_near[:, :-1]], axis=1)
            row, column = np.nonzero(fresh)
            near.append((row, sorted_near[row, column]))
            at += width
        for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            for side, key, row in (
                (0, (near[i][1] << 12) | own[j][near[i][0]], near[i][0]),
                (1, (own[i][near[j][0]] << 12) | near[j][1], near[j][0]),
            ):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key | (pair << 24)).astype(np.int32)), pa.array(np.full(len(row), side, np.int8)), pa.array(fp[row])],
                    names=["key", "side", "fp"],
                )


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in max_bits (3 at most) bits or fewer."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the segments are cut for three bits at most")
    keys = fingerprints.select("fp").mapInArrow(_keys, "key int, side byte, fp long")
    left = keys.filter("side = 0").select("key", F.col("fp").alias("a"))
    right = keys.filter("side = 1").select("key", F.col("fp").alias("b"))
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = left.join(right, (left["key"] == right["key"]) & close)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: key, `fingerprint` (16 hex digits), `component_id`, the smallest key reachable over links.

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Rows
    with a null key belong to components but never name one unless no other row does.
    """
    prints = materialize(with_fingerprint(docs.select(key, text), text, words).select(F.col("row").getField(key).alias(key), F.col("fingerprint").alias("fp")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    grouped = components(links(distinct, max_bits), "a", "b").withColumnRenamed("node", "fp")
    placed = distinct.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = placed.join(heads, "component").select("fp", "component_id")
    # One row a fingerprint on the right: where many rows share one, adaptive execution splits the left side.
    return prints.join(by_print, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _minima(minima: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The minima so far with a block of shingle hashes taken in."""
    odd, shift = _FUNCTIONS
    low = (block ^ (block >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), MINIMA_BLOCK):
        minima = np.minimum(minima, (low[None, at : at + MINIMA_BLOCK] * odd + shift).min(axis=1))
    return minima


_FUNCTIONS = (
    np.random.default_rng(SEED).integers(0, 1 << 31, (BANDS * BAND_ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1),
    np.random.default_rng(SEED + 1).integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32),
)


def sketch(text: str | None, words: int = COPY_WORDS) -> tuple[int, list[int]]:
    """The fingerprint of a text and a hash of each of its bands, as signed integers."""
    ones, n, minima = np.zeros(64, dtype=np.int64), 0, np.full(BANDS * BAND_ROWS, (1 << 32) - 1, dtype=np.uint32)
    for block in shingle_hashes(text, words):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block)
        minima = _minima(minima, block.astype(np.uint64))
    bands = [xxhash.xxh64_intdigest(minima[at : at + BAND_ROWS].tobytes(), at) for at in range(0, len(minima), BAND_ROWS)]
    print_ = np.packbits(2 * ones > n).view(">u8").astype(np.uint64) if n else np.zeros(1, np.uint64)
    return int(print_.view(np.int64)[0]), np.array(bands, dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingle hashes; 1 for two texts without words."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    blocks = [np.unique(b.astype(np.uint64)) for b in shingle_hashes(text, words)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _candidates(marks: DataFrame, banded: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: of equal bands, or of equal or linked fingerprints.

    In a band's group of up to SMALL_GROUP members all meet each other; in a larger one each meets
    two, the first and the last by a hash that differs from band to band, so a group of any size
    gives pairs in proportion to its members. What such a group still leaves apart is the work of
    `_apart` and `_rare_pairs`.
    """
    large = groups.filter(F.col("n") > SMALL_GROUP).select("at", "band", F.explode(F.array("first.node", "last.node")).alias("b"))
    alike = banded.join(large, ["at", "band"]).select(F.col("node").alias("a"), "b")
    small = groups.filter(F.col("n") <= SMALL_GROUP).select("at", "band")
    few = materialize(banded.join(small, ["at", "band"]), "copies-bands")
    met = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), ["at", "band"]).filter("a < b").select("a", "b")
    named = materialize(marks.groupBy("fp").agg(F.min("node").alias("name")), "copies-prints")
    same = marks.join(named, "fp").select(F.col("node").alias("a"), F.col("name").alias("b"))
    pairs = links(named).withColumnsRenamed({"a": "fa", "b": "fb"})
    linked = pairs.join(named.select(F.col("fp").alias("fa"), F.col("name").alias("a")), "fa").join(named.select(F.col("fp").alias("fb"), F.col("name").alias("b")), "fb")
    every = alike.union(met).union(same).union(linked.select("a", "b")).filter("a <> b")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(banded: DataFrame, groups: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, component) of the members of large groups that are not all in one component."""
    large = groups.filter(F.col("n") > SMALL_GROUP).select("at", "band")
    members = banded.join(large, ["at", "band"]).join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = members.groupBy("at", "band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return members.join(split.select("at", "band"), ["at", "band"], "left_semi").select("node", "component").distinct()


def _rare_pairs(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of texts (node, component, text) in different components that can be similar enough.

    A prefix filter: of two sets with a Jaccard similarity of t or more, each has a shingle of the
    other among its size - ceil(t * size) + 1 rarest ones. A pair counts where it shares its rarest
    shingle: no more can be common than either has from there on, which bounds the overlap.
    Shingles of one component alone, which is most of what near copies share, give no pair; in the
    others only the members outside the most frequent component meet all.
    """

    def shingled(batches):
        for batch in batches:
            at = 0
            for some in text_slices([batch.column(2)]):
                sets = [_shingle_set(t, words).view(np.int64) for t in some.to_pylist()]
                here = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "component", "shingles"])
                at += len(some)

    sets = materialize(texts.select("node", "component", "text").mapInArrow(shingled, "node string, component string, shingles array<long>"), "copies-shingles")
    every = sets.select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    known = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Places count from the most frequent shingle, so that shingles of one text alone need no row.
    from_common = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle"))
    ranked = every.join(known, "shingle").select(
        "*", F.row_number().over(from_common).alias("place"), F.collect_list("shingle").over(from_common.rowsBetween(1, RARER)).alias("rarer")
    )
    rare = ranked.filter(F.col("place") >= F.ceil(F.col("size") * similarity - 1e-9)).select("shingle", "node", "component", "size", "place", "rarer")
    rare = materialize(rare, "copies-rare")
    held = rare.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = held.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    shared = materialize(rare.join(mixed.select("shingle", F.col("main.component").alias("main")), "shingle"), "copies-mixed")
    side = lambda x: [F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("size").alias(f"n{x}"), F.col("place").alias(f"r{x}"), F.col("rarer").alias(f"rarer_{x}")]
    left = shared.filter("component <> main").select("shingle", "main", *side("a"))
    right = shared.select("shingle", *side("b"))
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))  # outside the main component both orders meet
    # A pair that shares a rarer one has met there; at its rarest, what is shared lies at this place or below.
    rarest = ~F.arrays_overlap("rarer_a", "rarer_b")
    enough = F.least("ra", "rb") >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9
    met = left.join(right, "shingle").filter((F.col("ca") != F.col("cb")) & sizes & once & enough & rarest)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity."""

    @F.arrow_udf(T.BooleanType())
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out, held = [], {}
        for a, b in zip(left, right):
            pair = (a.as_py(), b.as_py())
            sets = [held[t] if t in held else _shingle_set(t, words) for t in pair]
            held = dict(zip(pair, sets))
            out.append(jaccard(*sets) >= similarity)
        return pa.array(out, pa.bool_())

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(nodes.join(asked, "node", "left_semi").dropDuplicates(["node"]), "copies-texts")
    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").filter(similar("text_a", "text_b")).select("a", "b")


def near_copies(nodes: DataFrame, words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the texts (node, text; a node has one text) that have a near copy; component is the smallest node reachable.

    Every pair of texts that share a band, or whose fingerprints link, ends in one component if it
    has the similarity: pairs that meet are verified, and where a large group is not yet one
    component, a prefix filter finds each further pair between its components.
    """

    def marked(batches):
        for batch in batches:
            found = [sketch(t, words) for some in text_slices([batch.column(1)]) for t in some.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int64()))], names=["node", "fp", "bands"]
            )

    marks = materialize(nodes.mapInArrow(marked, "node string, fp long, bands array<long>").dropDuplicates(["node"]), "copies-marks")
    banded = marks.select("node", F.posexplode("bands").alias("at", "band"))
    place = F.struct(F.xxhash64("node", "at").alias("by"), F.col("node"))
    groups = banded.groupBy("at", "band").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups, "copies-groups")
    pairs = materialize(_candidates(marks, banded, groups), "copies-pairs")
    true = materialize(_verified(pairs, nodes, words, similarity), "copies-true")
    found = components(true, "a", "b")
    apart = materialize(_apart(banded, groups, found), "copies-apart")
    if apart.isEmpty():
        return found
    texts = nodes.join(apart, "node").dropDuplicates(["node"])
    more = materialize(_rare_pairs(texts, words, similarity).join(pairs, ["a", "b"], "left_anti"), "copies-more")
    further = materialize(_verified(more, nodes, words, similarity), "copies-further")
    return found if further.isEmpty() else components(true.union(further), "a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of each component of near copies the row with the smallest key; a null key comes after all others.

    Near copies are texts whose sets of shingles have the given Jaccard similarity or more. A row
    is its key and its text, so rows that share a key, or have none, stay where their texts differ.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    node = F.substring(F.sha2(body, 256), 1, 32)
    rows = materialize(docs.select(F.col(key).alias("key"), node.alias("node")), "copies-keys")
    nodes = docs.select(node.alias("node"), body.alias("text"))
    placed = rows.join(near_copies(nodes, words, similarity), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.min(F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("node"))).alias("least")
    stays = placed.groupBy("component").agg(least).select(F.col("least.key").alias("kept_key"), F.col("least.node").alias("kept_node"))
    kept = packed(docs, key=key, node=node).join(stays, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("node") == F.col("kept_node")), "left_semi")
    twin = Window.partitionBy("key", "node").orderBy(F.xxhash64("row"))
    return kept.withColumn("twin", F.row_number().over(twin)).filter("twin = 1").select("row.*")
