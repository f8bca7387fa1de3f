"""Each corpus operator against brute force, and on nulls, empty and long texts, ties and empty tables."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import ann, bpe, exact_dedup, mixing, queries, sharding, simhash, substring_dedup, token_output, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, fp string, _size long"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
TEXTS = [
    None, "", " ", "one", "one two", "Une  phrase\tavec\nespaces", "Une phrase avec espaces", "same text here now", "same text here now",
    LONG, LONG + " tail", "é" * 700, "ß ẞ   x", "日本語 テキスト 😀", "a" * 3000, "x\r\n\r\ny", "WARC/1.0\r\n",
]


def odd_docs(spark):
    rows = [(k, t, "en", None if k % 4 == 0 else f"src{k % 3}", None, 1, "r", "f", 2) for k, t in enumerate(TEXTS)]
    rows += [(7, "same text here now", "en", "src0", 0, 1, "r", "f", 2), (None, "no key", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark)


def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Sharding


def test_shards_hold_every_row_once(spark, odd):
    got = sharding.shard(odd, bucket_bytes=10_000).select("row.*", "size", "shard", "slot").toPandas()
    want = odd.toPandas()
    assert Counter(zip(got.doc_id.fillna(-1), got.text)) == Counter(zip(want.doc_id.fillna(-1), want.text))
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()


def test_shard_order_is_random_and_repeatable(spark, sf):
    docs = sample(spark, sf).select("doc_id", "text")
    first = [r.doc_id for r in sharding.shuffle_records(docs).orderBy("position").select("row.doc_id").collect()]
    again = [r.doc_id for r in sharding.shuffle_records(docs).orderBy("position").select("row.doc_id").collect()]
    assert first == again and sorted(first) != first and len(set(first)) == 200


def test_op2_obeys_its_contract(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in sample(spark, sf).collect()}
    got = queries.op2_sharding(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(texts) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r["size"] == len(texts[r.doc_id]) + 1 for _, r in got.iterrows())
    assert set(got.shard) == set(range(8)) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert all(sorted(mine.slot) == list(range(len(mine))) for _, mine in got.groupby("shard"))


def test_equal_records_part_and_empty_tables_stay_empty(spark):
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("the same record " * 20).alias("text"))
    got = sharding.shard(same, bucket_bytes=50_000)
    assert got.count() == 4000 and got.groupBy("shard").count().filter("count = 500").count() == 8
    assert sharding.shard(empty_docs(spark)).count() == 0


def test_written_shards_are_in_slot_order(spark, sf, tmp_path):
    sharding.write_shards(sharding.shard(sample(spark, sf)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(8))


# Exact dedup


def naive_groups(rows):
    space = bytes(range(9, 14)) + b" "
    groups = defaultdict(list)
    for key, text in rows:
        out, run = [], False
        for c in text or "":
            if ord(c) < 128 and bytes([ord(c)]) in [bytes([b]) for b in space]:
                run = run or bool(out.append(" ")) or True
            else:
                run = False
                out.append(c)
        groups["".join(out)].append(key)
    return groups


def test_exact_groups_match_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = naive_groups(rows)
    got = exact_dedup.dedup_groups(odd, leaves=8).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): keys for t, keys in want.items()}
    kept = Counter()
    for r in got:
        keys = by_digest[r.text_sha256]
        known = [k for k in keys if k is not None]
        assert r.group_size == len(keys) and r.keep_id == (min(known) if known else None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    stays = exact_dedup.drop_copies(odd)
    assert stays.count() == len(want) and stays.columns == odd.columns


def test_rounds_sort_and_merge_runs(spark, odd):
    keyed = odd.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), (F.col("doc_id") % 16).cast("int").alias("_run"), F.col("doc_id").alias("_keep"))
    keyed = keyed.filter("_run is not null").dropDuplicates(["_run", "text_sha256"])
    runs = keyed.withColumn("_n", F.lit(1).cast("long")).withColumn("_proof", F.struct(F.lit(1).alias("_len"), F.lit(1).alias("_check")))
    merged = exact_dedup.merge_runs(runs, leaves=16, fan_in=4)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("RepartitionByExpression") == 2 and plan.count("two texts share a digest") >= 2
    want = {r.text_sha256: (r.keep, r.n) for r in runs.groupBy("text_sha256").agg(F.min("_keep").alias("keep"), F.count("*").alias("n")).collect()}
    assert {r.text_sha256: (r._keep, r._n) for r in merged.collect()} == want
    damaged = runs.withColumn("_proof", F.struct(F.col("_run").alias("_len"), F.lit(1).alias("_check"))).withColumn("text_sha256", F.lit("00" * 32))
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.merge_runs(damaged, leaves=16, fan_in=4).select("_n", "_keep").collect()


# SimHash


def slow_simhash(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(prints))]


def test_fingerprints_and_components_match_brute_force(spark, sf):
    base = [(r.doc_id, r.text) for r in sample(spark, sf).orderBy("doc_id").limit(60).collect()]
    random.seed(3)
    for k, (_, text) in enumerate(base[:25]):
        words = text.split(" ")
        words[random.randrange(len(words))] = "changed"
        base.append((1000 + k, " ".join(words)))
    base += [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, LONG[:6000]), (2005, LONG[:6000] + " x")]
    prints = [(k, slow_simhash(t)) for k, t in base]
    want = {prints[i][0]: (f"{prints[i][1]:016x}", prints[c][0]) for i, c in enumerate(slow_components(prints))}
    got = simhash.near_duplicates(spark.createDataFrame(base, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert any(k != c for k, (_, c) in want.items())


def test_links_find_every_pair_of_close_fingerprints(spark):
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(40)}
    for x in list(prints):
        for bits in (1, 2, 3, 3, 3, 4):
            prints.add(x ^ sum(1 << b for b in random.sample(range(64), bits)))
    prints = sorted(prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    got = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in got} == want


def test_golay_decoder_is_perfect():
    codewords = simhash.codeword_index(np.arange(1 << 12) << 11)
    assert len(np.unique(simhash.codeword_index(np.arange(1 << 23)[:: 97]))) > 4000 and codewords.max() < 4096
    counts = np.bincount(simhash.codeword_index(np.arange(1 << 23)), minlength=4096)
    assert (counts == 2048).all()


def test_keep_one_handles_odd_rows(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and ids.count(7) <= 1


def slow_jaccard(a, b):
    a, b = ({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_drops_copies_beyond_three_bits(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k, words in enumerate(base):
        changed = list(words)
        for at in range(20, 300, 56 if k % 2 else 28):
            changed[at] = "changed"
        rows.append((100 + k, " ".join(changed)))
    near = {100 + k for k in range(40) if slow_jaccard(rows[k][1], rows[40 + k][1]) >= 0.8}
    far = [(simhash.simhash(rows[k][1]) ^ simhash.simhash(rows[40 + k][1])).bit_count() > 3 for k in range(40) if 100 + k in near]
    assert len(near) == 20 and any(far)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k for k, _ in rows} - near


def chained_texts(n, seed):
    """Texts that share most words, each a few words from one before it: far from one another, but linked in chains."""
    rng, texts = random.Random(seed), []
    for k in range(n):
        words = [f"w{j}" for j in range(200)] if k < 3 else list(rng.choice(texts))
        for _ in range(rng.choice([2, 3, 4, 9])):
            words[rng.randrange(200)] = f"new{k}x{rng.randrange(9)}"
        texts.append(words)
    return [" ".join(words) for words in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies_equal_brute_force(spark, seed):
    texts = chained_texts(150, seed)
    sets = [simhash._shingle_set(t, 5) for t in texts]
    close = [(a, b) for b in range(len(texts)) for a in range(b) if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    assert all((slow_jaccard(texts[a], texts[b]) >= 0.8) for a, b in close[:50])
    nodes = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "node string, text string")
    # All pairs that can be similar pass the prefix filter, whatever the bands say.
    alone = nodes.withColumn("component", F.col("node"))
    found = {(int(r.a), int(r.b)) for r in simhash._rare_pairs(alone, 5, 0.8).collect()}
    assert set(close) <= found and len(found) < 150 * 149 // 2
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in close:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: root[k] for k in range(len(texts)) if any(k in pair for pair in close)}
    got = {int(r.node): int(r.component) for r in simhash.near_copies(nodes).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_keep_one_keeps_unique_texts_without_a_key_of_their_own(spark):
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[3]), (4, texts[3])]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, texts[0]), (0, texts[1]), (5, texts[2]), (4, texts[3])])


# Toxicity


def test_folding_meets_disguises():
    assert toxicity.fold("1D!0T") == toxicity.fold("idiot") == toxicity.fold("ıdıоt") == toxicity.fold("i​diot")
    assert toxicity.fold("ｔｒａｓｈ") == toxicity.fold("trash") and toxicity.fold("m0r0n!") == toxicity.fold("moron ")


def test_exceptions_and_whole_words_count():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot").strip(): 5.0}, threshold=0.5)
    assert lexicon.score("you idiot") > 0.5 > lexicon.score("an idiot proof design") == 0.0
    assert lexicon.score("idiotic") == 0.0 and lexicon.score(None) == lexicon.score("") == lexicon.score("!!") == 0.0
    assert lexicon.score("idiot idiot") > lexicon.score("idiot " + "word " * 200)


def test_toxicity_holds_out_a_fold_and_predicts_it(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    want = [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.index]
    assert got.held_out.tolist() == want and len(got) == 1000
    held = labels[[zlib.crc32(str(k).encode()) % 5 == 0 for k in labels.index]]
    right = (got.loc[held.index].predicted == held.toxic).mean()
    assert right >= 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, none).weights == {}
    scored = toxicity.with_score(odd, toxicity.Lexicon({"one": 4.0})).collect()
    assert len(scored) == len(TEXTS) + 2 and scored[0].score == 0.0
    assert scored[0].row.asDict().keys() == set(odd.columns)
    assert toxicity.with_score(empty_docs(spark), toxicity.Lexicon({})).count() == 0


# Mixing


def test_mixture_meets_its_weights_and_order(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    mixed = mixing.mix(docs, {"a": 0.5, "b": 0.3}, rest=0.2).select("row.*", "copy", "position").toPandas()
    share = mixed.source.fillna("*").value_counts(normalize=True)
    assert abs(share["a"] - 0.5) < 0.02 and abs(share["b"] - 0.3) < 0.02 and abs(len(mixed) - 20_000) < 600
    assert sorted(mixed.position) == list(range(len(mixed)))
    assert abs(np.corrcoef(mixed.position, mixed.doc_id)[0, 1]) < 0.05
    order = [r.doc_id for r in mixing.mix(docs, {"a": 0.5, "b": 0.3}, rest=0.2).select("row.doc_id").collect()]
    assert abs(np.corrcoef(range(len(order)), order)[0, 1]) < 0.05  # also where nobody asks for the position
    per_doc = mixed.groupby("doc_id").copy.agg(["max", "count"])
    assert (per_doc["max"] == per_doc["count"]).all()


def test_poisson_inversion_matches_the_distribution():
    cdf = mixing.poisson_cdf(2.5)
    assert abs(cdf[0] - np.exp(-2.5)) < 1e-15 and cdf == sorted(cdf) and cdf[-1] > 1 - 1e-15
    assert len(mixing.poisson_cdf(400.0)) > 500


def test_mixing_odd_and_empty_tables(spark, odd):
    mixed = mixing.mix(odd, {"src0": 1.0}, rest=3.0)
    assert mixed.select("row.*").columns == odd.columns
    given = {repr(r) for r in odd.collect()}
    rows = mixed.collect()
    assert {repr(r.row) for r in rows} <= given and sorted(r.position for r in rows) == list(range(len(rows)))
    assert mixing.mix(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("shared", ["NULL", "7", "id % 3"])
def test_mixing_rows_of_one_key_lie_apart(spark, shared, monkeypatch):
    if "%" in shared:
        monkeypatch.setattr(mixing, "BROADCAST_KEYS", 1)  # the join by a shuffle
    docs = spark.range(6_000, numPartitions=3).selectExpr(f"CAST(CASE WHEN id < 4000 THEN {shared} ELSE id END AS LONG) AS doc_id", "CASE WHEN id < 4000 THEN 'a' ELSE 'b' END AS source", "id AS place")
    mixed = mixing.mix(docs, {"a": 0.5}, rest=0.5, total=30_000).select("row.*", "copy", "position")
    rows = mixed.collect()
    from_a = [r.position for r in rows if r.source == "a"]
    copies = {key: {r.copy for r in rows if r.source == "a" and r.doc_id == key} for key in {r.doc_id for r in rows if r.source == "a"}}
    held = {key: len({r.place for r in rows if r.source == "a" and r.doc_id == key}) for key in copies}
    assert from_a and len(from_a) == sum(held[key] * len(copies[key]) for key in copies)  # rows of one key draw alike
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert abs(np.mean(from_a) / len(rows) - 0.5) < 0.03 and abs(np.std(from_a) / len(rows) - 12**-0.5) < 0.03
    assert len(set(np.array(from_a) // 1_000)) == len(rows) // 1_000 + 1  # and stand everywhere in the order
    assert rows == mixing.mix(docs, {"a": 0.5}, rest=0.5, total=30_000).select("row.*", "copy", "position").collect()


# Byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.read_ranks(bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library_and_round_trips(spark, odd, reference_encoding):
    odd = odd.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(odd).withColumn("decoded", F.lit(2))).select("row.row.text", "row.ids", "decoded").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.ids == reference_encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    both = {r.text: r for r in bpe.encode_and_decode(odd).select("row.text", "ids", "decoded").collect()}
    assert all(both[r.text].ids == r.ids and both[r.text].decoded == r.decoded for r in got)
    assert bpe.decode(bpe.encode(empty_docs(spark))).count() == 0 and bpe.encode_and_decode(empty_docs(spark)).count() == 0


def encoded(codec, texts):
    return codec.encode(pa.array(texts, pa.string())).to_pylist()


def test_encoding_of_odd_spacing_matches_the_library(reference_encoding):
    random.seed(6)
    alphabets = ["ab é'\n,1. \t", "abcdefghij ", "ab \n", "é日本😀 a 'sx", "abc 's'll\n12.,!"]
    texts = [None, "", " ", "\n", "a\n", "\na", " a", "a ", "a\nb", "a\n\nb", "a \nb"]
    texts += ["".join(random.choice(random.choice(alphabets)) for _ in range(random.randrange(60))) for _ in range(3000)]
    codec = bpe.Codec()
    want = [reference_encoding.encode_ordinary(t or "") for t in texts]
    assert encoded(codec, texts) == want and encoded(codec, texts) == want  # and once more, from memory
    lists = pa.array([*want, None], pa.list_(pa.int32()))
    assert codec.decode(lists).to_pylist() == [(t or "").encode() for t in texts] + [None]
    assert codec.decode(lists.slice(20, 50)).to_pylist() == codec.decode(lists).to_pylist()[20:70]
    with pytest.raises(ValueError):
        codec.decode(pa.array([[1, 60_000]], pa.list_(pa.int32())))


def test_long_words_take_the_same_merges(reference_encoding):
    random.seed(1)
    words = ["".join(random.choice("etaoinsrhl") for _ in range(n)) for n in (257, 600, 1500)]
    words += ["日本語テキスト" * 60, "a" * 4000, "ab" * 400]
    assert encoded(bpe.Codec(), words) == [reference_encoding.encode_ordinary(w) for w in words]


def test_op5_digests_match_the_library(spark, sf, reference_encoding):
    texts = {r.doc_id: r.text or "" for r in sample(spark, sf).collect()}
    got = queries.op5_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# Token files


def test_token_files_match_the_library(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.key: r for r in token_output.token_files(docs).collect()}
    before = 0
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        mine = got[r.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    assert len(got) == docs.count()
    assert token_output.token_files(empty_docs(spark)).count() == 0


def test_token_files_with_null_and_repeated_keys(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    got = token_output.token_files(odd.withColumn("key", F.lit("clash"))).collect()
    rows = odd.collect()
    size = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert Counter((r.key, r.n_tokens) for r in got) == size
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.key for r in in_order] == sorted((r.doc_id for r in rows), key=lambda k: -1 if k is None else k)
    assert [r.start for r in in_order] == [sum(x.n_tokens for x in in_order[:k]) for k in range(len(in_order))]


def test_text_encoder_on_spacing_and_added_tokens():
    codes, library = token_output.TextEncoder(), Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    random.seed(2)
    texts = ["".join(random.choice("ab é'\n,1. \t") for _ in range(50)) for _ in range(400)]
    texts += [None, "", "\n", "x <|endoftext|> y", "x<|endoftext|>y z", " lead", "tail ", "a\x00b", "it's we'll", "é日本😀 a\nb"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, size = codes.encode(pa.array(texts, pa.string()))
        assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# WARC


def test_archive_round_trip_with_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u\r\nX: y", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u", None), (4, "u", ""), (5, "u", f"{fake}{fake}é"), (6, "u", fake), (7, "u", "x" * 300_000), (8, "u", "😀"), (5, "u", f"{fake}{fake}é"), (None, "u", "<p>a</p>"), (None, "u", "alone"), (None, "u", "twins"), (None, "u", "twins"), (0, "u", "zero")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("body", F.lit("clash")).withColumn("id", F.lit(1))
    got = warc.archive_pages(df).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((k, len((h or "").encode())) for k, _, h in pages)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    by_digest = defaultdict(list)
    for k, _, h in pages:
        by_digest[digest(h)].append(k)
    for name, keys in by_digest.items():
        mine = [r for r in got if r.digest == name]
        latest = max((k for k in keys if k is not None), default=None)
        responses = [r for r in mine if r.type == "response"]
        assert len(mine) == len(keys) and len(responses) == 1 and responses[0].page_id == latest and responses[0].refers_to is None
        assert all(r.type == "revisit" and r.refers_to == latest for r in mine if r is not responses[0])


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.type for r in warc.archive_pages(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_a_broken_chain_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(20)], "page_id long, url string, html string")
    warc.write_archive(warc.plan_records(pages), str(tmp_path / "a"))
    whole = next((tmp_path / "a").glob("part-*.gz"))
    data = gzip.decompress(whole.read_bytes())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_bytes(data)
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == data.count(b"WARC-Record-ID")
    (tmp_path / "b" / "part-0").write_bytes(data.replace(b"<p>7</p>", b"<p>7</p"))
    with pytest.raises(ValueError, match="chain"):
        warc.read_archive(spark, str(tmp_path / "b"))


def test_archive_of_nothing(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pointer_jumping_reaches_the_chain_only(spark):
    edges = [("f", k * 10, k * 10 + 10) for k in range(37)] + [("f", 15, 20), ("f", 23, 999), ("g", 5, 10), ("g", 0, None)]
    got = {(r.file, r.start) for r in warc.reachable(spark.createDataFrame(edges, "file string, start long, next long")).collect()}
    assert got == {("f", k * 10) for k in range(37)} | {("g", 0)}


# Nearest neighbours


def test_neighbours_reach_the_recall_with_exact_scores(spark):
    random_ = np.random.default_rng(0)
    points = random_.normal(size=(1500, 16)).astype(np.float32)
    points[40:80] = points[40]
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] + [1.0] * 15), (2400, []), (None, [1.0] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    hits = 0
    for q in range(0, 1500, 50):
        away = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(1))
        away[q] = np.inf
        want = np.lexsort((np.arange(1500), away))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.allclose(mine.score, away[mine.vec_id], rtol=1e-14)
        assert mine.sort_values(["score", "vec_id"]).vec_id.tolist() == mine.vec_id.tolist()
        hits += len(set(want) & set(mine.vec_id))
    assert hits >= 0.9 * 300 and set(got.query_id) == set(range(0, 1500, 50))
    tied = got[got.query_id == 50].sort_values("rank").vec_id.tolist()
    assert tied == [40, 41, 42, 43, 44, 45, 46, 47, 48, 49]


def test_repeated_keys_are_one_query_and_one_candidate(spark):
    random_ = np.random.default_rng(1)
    points = random_.normal(size=(400, 8))
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    rows += [(0, points[0].tolist())] * 3 + [(k, (points[k] + 5).tolist()) for k in range(1, 50)] + [(7, points[7].tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("vector", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    assert got.groupby("query_id").vec_id.agg(["count", "nunique"]).values.tolist() == [[10, 10]] * 4
    for q, mine in got.groupby("query_id"):
        best = {}
        for k, p in rows:
            if k != q:
                best[k] = min(best.get(k, np.inf), float(np.sqrt(((np.array(p) - points[q]) ** 2).sum())))
        want = sorted(best, key=lambda k: (best[k], k))[:10]
        assert len(set(want) & set(mine.vec_id)) >= 8 and np.allclose(mine.score, [best[k] for k in mine.vec_id])


def test_clustered_queries_widen_until_there_are_enough(spark):
    random_ = np.random.default_rng(2)
    alone = [(100 * k, (random_.normal(size=8) * 1000).tolist()) for k in range(5)]
    crowd = [(1000 + k, random_.normal(size=8).tolist()) for k in range(1500) if k % 100]
    got = ann.nearest(spark.createDataFrame(alone + crowd, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    assert (got.groupby("query_id").vec_id.nunique() == 10).all() and set(range(0, 500, 100)) <= set(got.query_id)


def test_shorter_vectors_count_as_padded(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0]), (2, [1.0, 1.0]), (3, [0.0] * 4)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 0.0), (2, 1.0)]


def test_neighbours_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


# Substring dedup


def test_passages_shared_by_documents_are_found(spark):
    random.seed(11)

    def words(n):
        return " ".join("".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 9))) for _ in range(n))

    passage = words(60)
    docs = [(k, f"{words(80)} {passage} {words(40 + k)}" if k % 2 else words(150)) for k in range(40)]
    docs += [(100, None), (101, ""), (None, passage), (102, f"{passage} {words(5)} {passage}"), (103, words(90)), (103, words(90))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("doc", F.lit(0))
    got = substring_dedup.repeated_spans(df, inside=False).collect()
    assert {r.doc_id for r in got} == {k for k in range(3, 40, 2)} | {102}
    texts = dict(docs)
    for r in got:
        raw = texts[r.doc_id].encode()[r.start : r.start + r.size].decode()
        assert raw[16:-16] in passage and r.first_doc_id == 1  # a chunk at either end may hold letters that agree by chance
    cleaned = {r.doc_id: r.cleaned for r in substring_dedup.without_repeats(df).select("row.doc_id", "cleaned").collect()}
    assert passage not in cleaned[3] and cleaned[1] == texts[1] and cleaned[100] is None and cleaned[0] == texts[0]


def slow_spans(rows, min_span, inside):
    """Repeated spans by plain loops over the same cuts, and whether the row itself holds all that they repeat."""
    rows = sorted({(k, signed(xxhash.xxh64_intdigest(t.encode(), seed=42)), t.encode()) for k, t in rows if k is not None and t})
    first, out = {}, []
    places = [(k, h, a, raw[a:b]) for k, h, raw in rows for a, b in zip([0, *substring_dedup.cuts(raw)], substring_dedup.cuts(raw))]
    for k, h, a, piece in places:
        first.setdefault(piece, (k, h, a))
    for k, h, raw in rows:
        spans = []
        for kk, hh, a, piece in places:
            own = first[piece][:2] == (k, h)
            if (kk, hh) != (k, h) or first[piece] == (k, h, a) or not inside and own:
                continue
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], a + len(piece), min(spans[-1][2], first[piece][0]), spans[-1][3] and own)
            else:
                spans.append((a, a + len(piece), first[piece][0], own))
        out += [(k, h, a, b - a, f, own) for a, b, f, own in spans if b - a >= min_span]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("inside", [True, False])
def test_spans_match_brute_force(spark, sf, inside):
    rows = [(r.doc_id, r.text) for r in sample(spark, sf).collect()] + [(k, t) for k, t in enumerate(TEXTS)]
    rows += [(500, f"{LONG[:900]} {LONG[:900]}"), (2, "another text of row two " * 30), (2, "another text of row two " * 30), (None, LONG)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_span=64, inside=inside).collect()
    assert sorted((r.doc_id, r.text_hash, r.start, r.size, r.first_doc_id, r.inside) for r in got) == slow_spans(rows, 64, inside)


def test_substring_query_gives_repeats_of_other_rows_and_of_the_row_itself(spark, tmp_path):
    passage, other = " ".join(f"p{k * 7919 % 1009}" for k in range(80)), " ".join(f"q{k * 6007 % 997}" for k in range(80))
    rows = [(1, f"one {passage} two {passage} three"), (2, f"four {other} five"), (3, f"six {other} seven"), (4, "nothing repeats " + " ".join(f"z{k}" for k in range(90)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_substring_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.inside, r.first_doc_id) for r in got} == {(1, True, 1), (3, False, 2)}


def test_substring_dedup_of_odd_and_empty_tables(spark, odd):
    cleaned = substring_dedup.without_repeats(odd.withColumn("cleaned", F.lit("clash")))
    assert cleaned.count() == odd.count() and cleaned.select("row.*").columns == [*odd.columns, "cleaned"]
    assert substring_dedup.without_repeats(empty_docs(spark)).count() == 0


def test_cuts_keep_characters_whole_and_survive_insertions():
    random.seed(4)
    text = "".join(random.choice("aé日😀 xyz") for _ in range(4000))
    raw = text.encode()
    ends = substring_dedup.cuts(raw)
    parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(parts) == raw and all(p.decode() for p in parts)
    moved = substring_dedup.cuts(b"inserted " + raw)
    kept = {(b"inserted " + raw)[a:b] for a, b in zip([0, *moved], moved)}
    assert len(set(parts) & kept) > 0.95 * len(set(parts))
    h, mask = 0, (1 << 32) - 1
    slow = []
    for b in raw[:300]:
        h = ((h << 1) + int(substring_dedup.gear_table()[b])) & mask
        slow.append(h)
    assert substring_dedup.gear_hashes(np.frombuffer(raw[:300], np.uint8)).tolist() == slow
    assert substring_dedup.cuts(b"") == []


# Pipeline


def test_stages_keep_columns_and_their_decisions(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, "en", "src0", len(t or ""), "x", 1) for k, t in enumerate(TEXTS)] + [(50, "you idiot moron", "en", "src1", 15, "x", 1)]
    rows += [(100 + k, f"plain text number {k} w{k % 9} idiot v{k % 11} moron" if k % 2 else f"plain text number {k} about rivers", "en", "src1", 30, "x", 1) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, bucket int")
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(160)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "byte-level bpe":
            assert sorted(now.columns) == sorted(docs.columns), name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert kept[0] >= set(range(9)) and 50 not in kept[0] and not kept[0] & {101 + 2 * k for k in range(80)}
    assert 1 not in kept[1] and 0 in kept[1] and 8 not in kept[1] and 7 in kept[1]
    assert kept[2] <= kept[1] and 0 in kept[2] and 2 not in kept[2]
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert now.filter("not round_trip").count() == 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path)) if nothing.columns == docs.columns else nothing
    assert nothing.count() == 0


# Registered queries with SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
