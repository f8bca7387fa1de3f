"""Alignment, centroid clustering and extraction against brute force and on edge cases."""

import bisect
import hashlib
import html
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marginalia.llm import alignment, clustering, extraction, queries

# Alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(tokens):
    ends = list(itertools.accumulate(map(len, tokens)))
    return list(zip([0, *ends[:-1]], ends))


def plain_alignment(text, libraries):
    """ids, spans and links of one text by definition; None where the bytes differ."""
    a, b = libraries
    letters = alignment.byte_letters()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    tok_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    tok_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if not text or b"".join(tok_a) != f" {text}".encode() or b"".join(tok_b) != f" {text}".encode():
        return None
    return ids_a, ids_b, spans(tok_a), spans(tok_b)


def linked(ids_a, ids_b, spans_a, spans_b):
    """Tokens that share a byte, one pair of ids for each pair of occurrences."""
    at_a, at_b = ([k for k, (s, e) in enumerate(sp) for _ in range(s, e)] for sp in (spans_a, spans_b))
    return [(ids_a[j], ids_b[k]) for j, k in sorted(set(zip(at_a, at_b)))]


def plain_rows(texts, libraries):
    found = [plain_alignment(t, libraries) if t else None for t in texts]
    links = [[] if f is None else linked(*f) for f in found]
    count = Counter(pair for some in links for pair in set(some))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    rows = []
    for f, some in zip(found, links):
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends, sides = sorted({e for _, e in f[2]} & {e for _, e in f[3]}), []
        for ids, sp in ((f[0], f[2]), (f[1], f[3])):
            groups = defaultdict(list)
            for k, (_, e) in zip(ids, sp):
                groups[bisect.bisect_left(ends, e)].append(str(k))
            sides.append([",".join(groups[g]) for g in range(len(ends))])
        written = [f"{a}|{b}" for a, b in zip(*sides)]
        rows.append((len(f[0]), len(f[1]), len(ends), len(some), sum(count[p] == highest[p[0]] for p in some), sum(count[p] for p in some), ";".join(written)))
    return rows


ODD = [None, "", " ", "one", "one", "one two", "a  b", "x\r\n\ty", "foo▁bar", "<s> </s> <|endoftext|> <0x41>", "日本語 😀 é", "nul\x00nul", " lead", "trail ", "z" * 5000, "ﬁ ½ İ"]


def test_alignment_is_the_plain_one(spark, libraries):
    rng = random.Random(5)
    alphabet = list("abc éß,.1\n") + [" the", " of", "  ", "語", "▁", "<s>", "　"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["same hot text here"] * 40
    docs = spark.createDataFrame([(k if k != 7 else None, t, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, block int").repartition(3)
    got = alignment.align(docs).select(F.coalesce("row.doc_id", F.lit(7)).alias("k"), *alignment.MEASURES, "groups").collect()
    assert len(got) == len(texts)
    assert [tuple(r[1:]) for r in sorted(got)] == plain_rows(texts, libraries)


def test_alignment_query_is_the_plain_one(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = docs.toPandas()
    want = dict(zip(texts.doc_id, plain_rows(texts.text, libraries)))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_cross_alignment(spark, sf).collect()}
    assert got == {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in want.items()}
    # Blocks of a few texts: counts of pairs meet from many of them.
    parted = alignment.align(docs, groups=lambda w: F.md5(w), block_bytes=20_000).select("row.doc_id", *alignment.MEASURES).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in parted} == {k: w[:6] for k, w in want.items()}


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty).collect() == []
    bare = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(bare).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_no_piece_has_a_space_inside(libraries):
    """A space only opens pieces, which the byte table relies on."""
    pieces = [libraries[1].id_to_piece(k) for k in range(libraries[1].get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


# Centroid clustering


@pytest.mark.parametrize("size", [2, 6, 900])
def test_vantage_tree_finds_the_nearest(size):
    rng = np.random.default_rng(size)
    for k in range(1, 24):
        centroids, points = rng.integers(-size, size + 1, (k, 3)), rng.integers(-size, size + 1, (150, 3))
        away = ((points[:, None] - centroids[None]) ** 2).sum(2)
        owner, best = clustering.VantageTree(centroids).nearest(points)
        assert (owner == away.argmin(1)).all() and (best == away.min(1)).all()


def plain_clusters(rows, k=8, rounds=10):
    kept = [(key, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for key, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, o) in zip(kept, found) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    return sorted(((key, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (key, _), (d, j) in zip(kept, found)), key=repr)


def clustered(spark, rows, tmp_path):
    frame = spark.createDataFrame([(k, v, 0, "r") for k, v in rows], "vec_id long, embedding array<float>, cluster int, row string")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in queries.op12_centroid_clustering(spark, str(tmp_path)).collect()), key=repr)


def test_clusters_are_the_plain_ones(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, [0.25] * 64) for k in range(40)] + [(3, [0.5] * 64), (None, [-0.001] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] * 64), (307, [0.0] * 64)]
    assert clustered(spark, rows, tmp_path) == plain_clusters(rows)


def test_clusters_of_few_and_of_no_vectors(spark, tmp_path):
    few = [(k, [float(k)] * 64) for k in range(3)]
    assert clustered(spark, few, tmp_path / "few") == plain_clusters(few)
    assert clustered(spark, [(1, None)], tmp_path / "none") == []
    assert len(clustered(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)], tmp_path / "huge")) == 2


def test_cluster_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.SQL["op12_centroid_clustering"])
    columns = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in queries.op12_centroid_clustering(spark, sf).select(columns).collect())


# Extraction


def test_cut_is_the_cheapest_labelling():
    """Of all cheapest labellings the one with the most content."""
    rng = random.Random(11)
    for _ in range(400):
        n = rng.randint(1, 8)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        flow = extraction.Network(list(source), list(sink))
        for a, b, c in edges:
            flow.join(a, b, c)
        content = [x < 0 for x in flow.saturate()]

        def cost(label):
            return sum(sink[k] if x else source[k] for k, x in enumerate(label)) + sum(c for a, b, c in edges if label[a] != label[b])

        every = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, every))
        assert cost(content) == least
        assert sum(content) == max(sum(x) for x in every if cost(x) == least)


PAGES = {
    None: "",
    "": "",
    "plain text": "plain text",
    "<p>a &amp; b&nbsp;c &#233;<p>d": "a & b c é\nd",
    "<body class=has-sidebar><div class=content><p>It is long enough to read, and it ends.</div><div class=sidebar><p>Other posts of ours.</div>": "It is long enough to read, and it ends.",
    '<div id="cookieNotice"><p>We use cookies.</p></div><main><h1>Title</h1><p>One.</p></main><form><label>Name</label><input><button>Go</button></form>': "Title\nOne.",
    '<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>One.</p><aside>Side</aside><p>Two <a href="x>y">link</a>.</p></article><footer>Us</footer>': "Title\nOne.\nTwo link.",
    '<article><p>Body text.</p><section id="comments"><article class="comment"><p>I like this article so much that I write a long comment.</p></article></section></article>': "Body text.",
    "<p>kept</p><script>x='<p>no</p>'</script><style>p{}</style><!-- <p>no --><noscript>no</noscript><template><p>no</template>": "kept",
    "<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul><p>The text of the page stands here.</p>": "The text of the page stands here.",
    "<article><p>in <b>bold<br>face<p>next</b> one</article>": "in bold face\nnext one",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1 2\n3",
    "a < b & c <": "a < b & c <",
    '<p hidden>no</p><p style="display: none">no</p><p>yes</p>': "yes",
    "<![CDATA[x]]><p>y</p></div></div>": "y",
    "<script>never closed <p>x": "",
    "kept <!-- never closed <p>x</p> y": "kept",
    "kept <p>x</p> y <!-- z": "kept\nx\ny",
}


def test_pages_of_many_shapes(spark):
    rows = [(k, page, "t", 1) for k, page in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, blocks int").repartition(3)
    got = {r["k"]: r["text"] for r in extraction.extract(pages).select(F.col("row.page_id").alias("k"), "text").collect()}
    assert {page: got[k] for k, page in enumerate(PAGES)} == PAGES


def test_no_pages(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_long_and_broken_pages_end():
    assert len(extraction.labelled("<article>" + "<p>Some words here.</p>" * 20_000)) == 20_000
    assert extraction.labelled("<div>" * 20_000 + "text") == [("text", True)]
    assert extraction.labelled("</p>" * 20_000 + "<b" * 20_000)[0][1]
    rng = random.Random(3)
    parts = ["<p>Some words here.", "<nav><a>x</a></nav>", '<div class="ad">foo bar', "</div>", "<article>", "</article>", "<ul><li>", '<a href="', "&amp"]
    for _ in range(300):
        extraction.labelled("".join(rng.choice(parts) for _ in range(60)))


def test_extraction_query_is_the_article(spark, sf):
    """On the given pages the article element is the truth; it is read here by plain patterns."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op13_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for key, page in pages.items():
        article = re.sub(r"<br>", " ", re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1]))
        want = "\n".join(t for x in re.split(r"</?(?:p|h1)>", article) if (t := " ".join(html.unescape(x).split())))
        assert (got[key]["text"], got[key]["n_chars"]) == (want, len(want))


# Edge cases of earlier operators


def test_strength_is_that_of_a_plain_matcher():
    """Terms between blanks, those inside an exception phrase spared, by the root of the number of words."""
    from marginalia.llm import toxicity

    rng = random.Random(8)
    words = ["ida", "idb", "idc", "good", "kind", "ida idb"]
    lexicon = toxicity.Lexicon({toxicity.fold(w).strip(): 1.0 + k for k, w in enumerate(words[:3])}, exceptions=("good ida", "kind idb kind"))
    folded = [toxicity.fold(e).split() for e in ("good ida", "kind idb kind")]
    for _ in range(500):
        tokens = [rng.choice(["ida", "idb", "idc", "good", "kind", "xx"]) for _ in range(rng.randint(0, 12))]
        mine = toxicity.fold(" ".join(tokens)).split()
        spared = {k for e in folded for at in range(len(mine)) if mine[at : at + len(e)] == e for k in range(at, at + len(e))}
        total = sum(lexicon.weights.get(w, lexicon.weights.get(f" {w} ", 0.0)) for k, w in enumerate(mine) if k not in spared)
        want = total / np.sqrt(len(mine) + toxicity.LENGTH_FLOOR) if total else 0.0
        assert lexicon.strength(" ".join(tokens)) == pytest.approx(want)


def test_exact_and_near_copies_of_no_rows(spark):
    from marginalia.llm import exact_dedup, simhash

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert exact_dedup.dedup_groups(empty).collect() == [] and exact_dedup.drop_copies(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_near_duplicates_of_null_and_repeated_keys(spark):
    from marginalia.llm import simhash

    text = "one two three four five six seven"
    rows = [(5, text, "f"), (5, text, "f"), (None, text, "f"), (2, None, "f"), (9, "", "f"), (None, "quite other words stand in this one", "f")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(5, 5): 2, (None, 5): 1, (2, 2): 1, (9, 2): 1, (None, None): 1})


def test_mixing_keeps_rows_of_null_keys_whole(spark):
    """Rows that share a key draw alike: all copies of one draw have the same number, and the empty table stays empty."""
    from marginalia.llm import mixing

    rows = [(None, f"t{k}", "src0") for k in range(40)] + [(k, f"t{k}", "src1") for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.*", "copy").collect()
    counts = Counter(r.text for r in got if r.doc_id is None)
    assert len(set(counts.values())) <= 1 and len(counts) in (0, 40)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
