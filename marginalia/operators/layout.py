"""Page layout: block kinds, font titles, repeated decoration, visual clusters, density."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import count_of, squeeze, strip

# Patterns and thresholds of the layout rules.
FIGURE = r"(?i)^\s*(图|圖|Fig\.?|Figure)\s*(?:[\dIVXivx一二三四五六七八九十]+|\([a-zA-Z]\))?\s*[\-\.．、:：]?"
TABLE = r"(?i)^\s*(表|Table)\s*(?:[\dIVXivx一二三四五六七八九十]+|\([a-zA-Z]\))?\s*[\-\.．、:：]?"
CHAPTER = r"(?i)^\s*(第\s*[\d一二三四五六七八九十]+\s*[章节篇]|Chapter\s+\d+)\b"
SECTION = r"^\s*(?:\d+(?:\.\d+){0,3}|[一二三四五六七八九十]+)[\.、]\s*\S+"
RELATION = "(=|≈|≠|≤|≥)"
OPERATOR = r"[A-Za-z0-9α-ωΑ-Ω)]\s*(?:\+|\*|/|\^|−)\s*[A-Za-z0-9α-ωΑ-Ω(]"
MATH_WORD = r"\b(?:sin|cos|tan|sqrt|log|exp)\b|[ωΩζπ]"
REFERENCE = r"(?i)^\s*\d+\.\s+.+(?:\bet\s+al\b|\b19\d{2}\b|\b20\d{2}\b|,)"
#: The last block of a page that can be a title.
TITLE_BLOCKS = 3
#: How every title starts (CHAPTER or SECTION), once white space is stripped.
TITLE_START = r"^(?:第|(?i:chapter)|\d|[一二三四五六七八九十])"
TERMINAL = "[.!?。！？；;][\"'”’）】》]*$"
CELL, DILATION, MIN_BOXES, MIN_SIDE, MIN_AREA = 4.0, 1, 20, 40.0, 0.01
TINY, BODY_MARGIN, MOST_CLUSTERS = 4.0, 24.0, 16
#: Pairs of boxes that are compared at a time.
PAIRS = 1 << 18
SCANNED_LETTERS, SCANNED_BLOCK, SCANNED_REGION, SCANNED_COVERAGE = 15, 8, 0.5, 0.65


def block_kind(body: Column, block_index: Column, top_ratio: Column | None = None) -> Column:
    """table, figure, formula, title, body, or unknown for blank blocks."""
    return line_kind(squeeze(body), block_index, top_ratio)


def line_kind(line: Column, block_index: Column, top_ratio: Column | None = None) -> Column:
    """The same of a squeezed block."""
    words, letters = count_of(r"[A-Za-z0-9_]+|[一-鿿]", line), count_of("[A-Za-z0-9α-ωΑ-Ω]", line)
    formula = (
        (F.length(F.regexp_replace(line, r"\s", "")) >= 3)
        & (words <= 20)
        & (letters >= 2)
        & (line.rlike(RELATION) | (line.rlike(MATH_WORD) & line.rlike(OPERATOR)))
    )
    ratio = F.lit(None).cast("double") if top_ratio is None else top_ratio
    placed = lambda least: (block_index <= TITLE_BLOCKS) & (ratio.isNull() | ratio.between(least, 0.45))
    numbered = (line.rlike(CHAPTER) & placed(0.06)) | (~line.rlike(CHAPTER) & line.rlike(SECTION) & placed(0.0))
    title = numbered & (words <= 24) & ~line.rlike(r"^\s*\d+\s*$") & ~line.rlike(REFERENCE)
    return (
        F.when(line == "", "unknown").when(line.rlike(TABLE), "table").when(line.rlike(FIGURE), "figure").when(formula, "formula").when(title, "title").otherwise("body")
    )


def font_roles(blocks: DataFrame, page: str, ratio: float = 1.25) -> DataFrame:
    """Role of body blocks by font: title at the page's largest size, label above the usual size, else body.

    The usual size is the most frequent one, the smaller of equals. Long blocks and sentences stay body.
    """
    rounded = blocks.withColumn("_size", F.round("font", 1))
    counted = rounded.groupBy(page, "_size").agg(F.count(F.lit(1)).alias("_n"))
    usual = counted.groupBy(page).agg(
        F.min_by("_size", F.struct(-F.col("_n"), F.col("_size"))).alias("_usual"), F.max("_size").alias("_top"), F.sum("_n").alias("_blocks")
    )
    line = squeeze(F.col("body"))
    raised = (F.col("_blocks") >= 2) & (F.col("font") >= F.col("_usual") * ratio) & F.length(line).between(1, 80) & ~line.rlike(TERMINAL)
    role = F.when(raised & (F.col("font") >= F.col("_top") - 0.1), "title").when(raised, "label").otherwise("body")
    return blocks.join(usual, page).withColumn("role", role).drop("_usual", "_top", "_blocks")


def repeated_signatures(rows: DataFrame, book: str, page: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Signatures on at least `least` pages and that share of the book's pages."""
    pages = rows.groupBy(book).agg(F.countDistinct(page).alias("_pages"))
    counted = rows.filter(F.col("signature") != "").select(book, page, "signature").distinct().groupBy(book, "signature").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.join(pages, book).filter((F.col("n_pages") >= least) & (F.col("n_pages") / F.col("_pages") >= share)).drop("_pages")


def edge_signature(box: Column, width: Column, height: Column, origin: Column) -> Column:
    """Band, origin, rounded place and aspect of a box at the top or bottom edge; null elsewhere."""
    x0, y0, x1, y1 = (box[k] for k in range(4))
    band = F.when(y1 <= height * 0.08, "top").when(y0 >= height * 0.92, "bottom")
    place = F.concat_ws(",", *[F.bround(v * 100, 0).cast("int").cast("string") for v in (x0 / width, y0 / height, x1 / width, y1 / height)])
    aspect = F.bround((x1 - x0) / F.greatest(y1 - y0, F.lit(1e-6)) * 10, 0).cast("int").cast("string")
    return F.when(band.isNotNull(), F.concat_ws(":", band, origin, place, aspect))


def inner_blocks(height: Column, blocks: Column) -> Column:
    """Text blocks (array of box, text) that are not blank and reach into the page between its upper and lower edge."""
    return F.filter(blocks, lambda b: (strip(b["text"]) != "") & (b["box"][3] > height * 0.08) & (b["box"][1] < height * 0.92))


def body_region(width: Column, height: Column, inner: Column) -> Column:
    """The rectangle that a page's inner blocks fill, with a margin, inside the page's safe area; that area where there is too little text."""
    safe = [width * 0.05, height * 0.08, width * 0.95, height * 0.92]
    letters = F.aggregate(inner, F.lit(0), lambda n, b: n + F.length(strip(b["text"])))
    enough = F.coalesce((F.size(inner) >= 3) & (letters >= 100), F.lit(False))
    edge = lambda k, of: of(F.transform(inner, lambda b: b["box"][k]))
    found = [F.greatest(safe[k], edge(k, F.array_min) - BODY_MARGIN) for k in (0, 1)] + [F.least(safe[k], edge(k, F.array_max) + BODY_MARGIN) for k in (2, 3)]
    return F.array(*[F.when(enough, x).otherwise(y).cast("double") for x, y in zip(found, safe)])


def _cell_ranges(boxes: np.ndarray) -> np.ndarray:
    """First and last cell in both directions of each box."""
    return np.concatenate([np.floor(boxes[:, :2] / CELL), np.floor((boxes[:, 2:] - 1e-9) / CELL)], axis=1).astype(np.int64)


def _covered(cells: np.ndarray) -> int:
    """Number of cells that ranges of cells cover together: the area of a union of rectangles on compressed coordinates."""
    if not len(cells):
        return 0
    xs, ys = np.unique([cells[:, 0], cells[:, 2] + 1]), np.unique([cells[:, 1], cells[:, 3] + 1])
    depth = np.zeros((len(xs), len(ys)), dtype=np.int64)
    x0, x1, y0, y1 = (np.searchsorted(axis, edge) for axis, edge in ((xs, cells[:, 0]), (xs, cells[:, 2] + 1), (ys, cells[:, 1]), (ys, cells[:, 3] + 1)))
    for x, y, sign in ((x0, y0, 1), (x1, y1, 1), (x0, y1, -1), (x1, y0, -1)):
        np.add.at(depth, (x, y), sign)
    inside = depth.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
    return int((inside * np.diff(xs)[:, None] * np.diff(ys)[None, :]).sum())


def _groups(cells: np.ndarray) -> np.ndarray:
    """The group of each box: boxes whose cells, each grown by DILATION, touch belong together.

    A group grows by all boxes at once that touch its newest ones. Boxes are held from left to right, so only those within reach are looked at.
    """
    reach, names = 2 * DILATION + 1, np.full(len(cells), -1, dtype=np.int64)
    rest = np.argsort(cells[:, 0], kind="stable")
    widest = int((cells[:, 2] - cells[:, 0]).max(initial=0))
    while len(rest):
        name, edge, rest = rest[0], rest[:1], rest[1:]
        while len(edge):
            names[edge] = name
            grown, left = cells[edge], cells[rest, 0]
            first = int(np.searchsorted(left, grown[:, 0].min() - reach - widest, side="left"))
            last = int(np.searchsorted(left, grown[:, 2].max() + reach, side="right"))
            others, near = cells[rest[first:last], :, None], np.zeros(len(rest), dtype=bool)
            step = max(1, PAIRS // max(1, last - first))
            for at in range(0, len(grown), step):
                some = grown[at : at + step].T[None]
                touch = (others[:, 0] - reach <= some[:, 2]) & (some[:, 0] - reach <= others[:, 2]) & (others[:, 1] - reach <= some[:, 3]) & (some[:, 1] - reach <= others[:, 3])
                near[first:last] |= touch.any(axis=1)
            edge, rest = rest[near], rest[~near]
    return names


def page_clusters(boxes: np.ndarray, width: float, height: float, body: np.ndarray) -> list[dict]:
    """Groups of tiny boxes that may be one drawing, best first: many boxes, of some size, that overlap the body of the page."""
    if not len(boxes):
        return []
    every, page_area, out = boxes, max(width * height, 1.0), []
    cells = _cell_ranges(every)
    group = _groups(cells)
    for name, n in zip(*np.unique(group, return_counts=True)):
        if n < MIN_BOXES:
            continue
        mine = every[group == name]
        box = np.concatenate([mine[:, :2].min(axis=0), mine[:, 2:].max(axis=0)])
        sides = box[2:] - box[:2]
        area = float(sides.prod())
        common = np.minimum(box[2:], body[2:]) - np.maximum(box[:2], body[:2])
        overlap = float(np.maximum(common, 0).prod()) / max(area, 1.0)
        if sides.min() < MIN_SIDE or area / page_area < MIN_AREA or overlap <= 0:
            continue
        covered = _covered(cells[group == name])
        density = covered / max(1, int(np.prod(np.ceil(sides / CELL))))
        held = [min(1.0, max(0.1, x)) for x in (density, overlap)]
        score = area / page_area * held[0] * math.log2(n + 1) * held[1]
        out.append({"bbox": box.tolist(), "n_boxes": int(n), "n_cells": covered, "density": density, "area_ratio": area / page_area, "body_overlap": overlap, "score": score})
    return sorted(out, key=lambda c: (-c["score"], c["bbox"]))


_CLUSTER = "struct<bbox:array<double>,n_boxes:int,n_cells:int,density:double,area_ratio:double,body_overlap:double,score:double>"
_CLUSTER_ARROW = pa.struct([("bbox", pa.list_(pa.float64())), ("n_boxes", pa.int32()), ("n_cells", pa.int32()), *[(k, pa.float64()) for k in ("density", "area_ratio", "body_overlap", "score")]])


def page_visuals(pages: DataFrame) -> DataFrame:
    """The pages (page_id, width, height, blocks: array of box and text, images: array of boxes) with their visual profile.

    Boxes that are not four finite numbers with a positive extent do not count. Images under
    TINY in one direction are pieces of drawings: `clusters` holds the best groups of them,
    `overflow` how many more there are. The share of the body that images cover is taken on cells.
    """
    sound = F.filter("images", lambda b: F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: F.abs(x) < float("inf")) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False)))
    small = lambda b: (b[2] - b[0] < TINY) | (b[3] - b[1] < TINY)
    known = pages.withColumn("images", F.coalesce(sound, F.array().cast("array<array<double>>"))).withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<box:array<double>,text:string>>")))
    split = known.withColumn("valid", F.filter("images", lambda b: ~small(b)))

    @F.arrow_udf(f"struct<found:array<{_CLUSTER}>,covered:long,tiny:int>")
    def drawn(images: pa.Array, width: pa.Array, height: pa.Array, body: pa.Array) -> pa.Array:
        # Boxes stay numbers of one array: as Python objects those of a batch took some ten times its bytes.
        boxes, regions = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, 4) for c in (images.flatten(), body))
        found, at = [], 0
        for n, w, h, region in zip(pc.list_value_length(images).to_pylist(), width.to_pylist(), height.to_pylist(), regions):
            mine = boxes[at : at + n]
            tiny = (mine[:, 2] - mine[:, 0] < TINY) | (mine[:, 3] - mine[:, 1] < TINY)
            found.append({"found": page_clusters(mine[tiny], w, h, region), "covered": _covered(_cell_ranges(mine)), "tiny": int(tiny.sum())})
            at += n
        made = pa.array(found, pa.struct([("found", pa.list_(_CLUSTER_ARROW)), ("covered", pa.int64()), ("tiny", pa.int32())]))
        del boxes, regions, images
        pa.default_memory_pool().release_unused()
        return made

    inner = split.withColumn("_inner", inner_blocks(F.col("height"), F.col("blocks")))
    body = inner.withColumn("body", body_region(F.col("width"), F.col("height"), F.col("_inner")))
    seen = body.withColumn("_d", drawn(*[F.col(c).cast(k) for c, k in (("images", "array<array<double>>"), ("width", "double"), ("height", "double"), ("body", "array<double>"))]))
    tiny = F.col("_d.tiny")
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    page_area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    lengths = F.transform("blocks", lambda b: F.length(F.regexp_replace(F.coalesce(b["text"], F.lit("")), r"[\p{C}\p{Z}\s]", "")))
    coverage = F.least(F.lit(1.0), F.col("_d.covered") * CELL * CELL / F.greatest(area(F.col("body")), F.lit(1.0)))
    largest = F.coalesce(F.greatest(F.array_max(F.transform("valid", area)) / page_area, F.array_max(F.transform("_d.found", lambda c: c["area_ratio"]))), F.lit(0.0))
    few = (F.aggregate(lengths, F.lit(0), lambda a, n: a + n) < SCANNED_LETTERS) & (F.coalesce(F.array_max(lengths), F.lit(0)) <= SCANNED_BLOCK)
    return seen.select(
        "page_id",
        F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(strip(F.coalesce(b["text"], F.lit(""))))).alias("native_text_chars"),
        F.size("images").alias("n_images"),
        tiny.alias("n_tiny"),
        (F.size("images") - tiny).alias("n_valid"),
        F.coalesce(F.try_divide(tiny, F.size("images")), F.lit(0.0)).alias("tiny_ratio"),
        coverage.alias("coverage"),
        F.col("body").alias("body_region"),
        F.slice("_d.found", 1, MOST_CLUSTERS).alias("clusters"),
        F.greatest(F.size("_d.found") - MOST_CLUSTERS, F.lit(0)).alias("overflow"),
        (few & ((largest >= SCANNED_REGION) | (coverage >= SCANNED_COVERAGE))).alias("suspected_scanned"),
    )


def largest_assets(assets: DataFrame, page: str, k: int = 4) -> DataFrame:
    """The k largest assets of a page by area, for region OCR."""
    order = Window.partitionBy(page).orderBy(F.desc("area"), "asset_id")
    return assets.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def density_profile(chars: Column, width: Column, height: Column, least_density: float = 0.2, least_chars: int = 40) -> list[Column]:
    """Characters, characters a thousand square points, and whether OCR is needed."""
    density = chars / (width * height) * 1000
    return [chars.alias("meaningful_chars"), F.round(density, 6).alias("density"), ((chars < least_chars) | (density < least_density)).alias("needs_ocr")]


def ocr_choice(primary: DataFrame, fallback: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Primary pages, replaced by a longer fallback where they are key pages, blank, or of low confidence.

    A weak page without a longer fallback is kept and marked for review.
    """
    joined = primary.join(fallback.select("doc_id", "page_no", F.col("text").alias("_text"), F.col("confidence").alias("_confidence")), ["doc_id", "page_no"], "left")
    weak = F.col("key_page") | (F.trim(F.coalesce("text", F.lit(""))) == "") | F.col("confidence").isNull() | (F.col("confidence") < threshold)
    wins = weak & (F.length(F.coalesce("_text", F.lit(""))) > F.length(F.coalesce("text", F.lit(""))))
    return joined.select(
        "doc_id",
        "page_no",
        F.when(wins, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.when(wins, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        wins.alias("fallback_used"),
        (weak & ~wins).alias("needs_review"),
    )


#: Kinds of blocks that become assets.
ASSET_KINDS = ("table", "figure", "formula", "image")


def asset_id(doc_id: Column, page_no: Column, kind: Column, index: Column) -> Column:
    """Document, page, kind and running number of an asset."""
    safe = F.regexp_replace(F.regexp_replace(kind, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.format_string("%s_p%04d_%s_%04d", doc_id.cast("string"), page_no.cast("int"), F.when(safe == "", "asset").otherwise(safe), index.cast("int"))


def enriched_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, block_ix, kind, body) with asset_id and asset_path for tables, figures and formulas, numbered a page."""
    is_asset = F.col("kind").isin(*ASSET_KINDS)
    so_far = Window.partitionBy("doc_id", "page_no").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.sum(is_asset.cast("int")).over(so_far)
    path = F.format_string("page://%s/p%04d/b%04d", F.col("doc_id").cast("string"), F.col("page_no").cast("int"), F.col("block_ix").cast("int"))
    return blocks.withColumn("asset_id", F.when(is_asset, asset_id(F.col("doc_id"), F.col("page_no"), F.col("kind"), index))).withColumn("asset_path", F.when(is_asset, path))


def enriched_pages(blocks: DataFrame) -> DataFrame:
    """One row a page of enriched blocks: the body joined anew from body and title blocks, the assets, and a count a kind."""
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isin("body", "title") & (F.trim("body") != ""), F.struct("block_ix", "body"))))
    assets = F.array_sort(F.collect_list("asset_id"))
    return blocks.groupBy("doc_id", "page_no").agg(
        F.trim(F.array_join(F.transform(listed, lambda x: x["body"]), "\n")).alias("body"), assets.alias("assets"), F.count(F.lit(1)).alias("n_blocks")
    )


def figure_table_rows(chunk_assets: DataFrame) -> DataFrame:
    """Figures and tables of chunks (doc_id, asset_id, object_type, chunk_index, chunk_id): one row an asset, with its first chunk."""
    wanted = chunk_assets.filter(F.col("object_type").isin("figure", "table") & F.col("asset_id").isNotNull())
    return wanted.groupBy("doc_id", "asset_id").agg(F.min_by("object_type", "chunk_index").alias("kind"), F.min_by("chunk_id", "chunk_index").alias("related_chunk"))


def regions_to_read(boxes: DataFrame, most: int = 4) -> DataFrame:
    """Boxes (doc_id, page_no, box, skip) for region OCR: the largest of each page that nothing speaks against, and why others are skipped."""
    area = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    order = Window.partitionBy("doc_id", "page_no", F.col("skip").isNull()).orderBy(area.desc(), "box")
    ranked = boxes.withColumn("_at", F.row_number().over(order))
    return ranked.withColumn("skip", F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("_at") > most, "over the limit of regions")).drop("_at")
