"""Images and the paragraphs they belong to: sniffing, dedupe, id remapping, attaching, recognised text, statistics."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import is_filled, ocr_gate, plain, references
from vellumark.operators.rows import each_row

MIME_SUFFIX = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/webp": ".webp", "image/tiff": ".tif", "image/x-icon": ".ico", "image/svg+xml": ".svg"}


def sniff_mime(content: Column) -> Column:
    """The media type of image bytes by their first bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, 16))
    case = F
    for start, mime in (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("00000100", "image/x-icon")):
        case = case.when(head.startswith(start), mime)
    case = case.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    return case.when(F.decode(F.substring(content, 1, 256), "ISO-8859-1").rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<svg"), "image/svg+xml")


def container_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(head.startswith("504B0304"), "zip").when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "ole")
    return kind.when(sniff_mime(content).isNotNull(), "image").when(F.decode(F.substring(content, 1, 2048), "ISO-8859-1").rlike(r"(?im)^(mime-version|content-type):"), "mime").otherwise("markup")


def pixel_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, BMP, ICO, JPEG, WEBP, TIFF, HEIF and SVG bytes."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"\0\0\1\0":
            return data[6] or 256, data[7] or 256
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:3] == b"\xff\xd8\xff":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                kind = data[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + (0 if kind in (0x01, 0xFF) or 0xD0 <= kind <= 0xD8 else struct.unpack(">H", data[at + 2 : at + 4])[0])
        if data[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if data[0] == 73 else ">"
            (at,) = struct.unpack(e + "I", data[4:8])
            (count,) = struct.unpack(e + "H", data[at : at + 2])
            found = {}
            for k in range(count):
                tag, kind, _, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
                found[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
            return found[256], found[257]
        if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"mif1", b"msf1", b"avif", b"hevc"):
            at = data.find(b"ispe")  # the property that holds the size of the picture
            sizes = []
            while at >= 0:
                sizes.append(struct.unpack(">II", data[at + 8 : at + 16]))
                at = data.find(b"ispe", at + 4)
            return max(sizes, key=lambda s: s[0] * s[1]) if sizes else None
        head = data[:4096].decode("latin-1")
        if (tag := re.search(r"<svg\b[^>]*>", head, re.I)) is not None:
            side = lambda k: re.search(rf"\b{k}\s*=\s*[\"']\s*([0-9.]+)\s*(?:px)?\s*[\"']", tag[0])
            box = re.search(r"viewBox\s*=\s*[\"']\s*[-0-9.]+[\s,]+[-0-9.]+[\s,]+([0-9.]+)[\s,]+([0-9.]+)", tag[0])
            if side("width") and side("height"):
                return round(float(side("width")[1])), round(float(side("height")[1]))
            return (round(float(box[1])), round(float(box[2]))) if box else None
    except (struct.error, IndexError, KeyError, ValueError):
        return None
    return None


def dimensions(content: Column) -> Column:
    """struct<width, height> of image bytes; null where they cannot be read."""
    return each_row(lambda b: (None if b is None else pixel_size(b)) or (None, None), "width int, height int", content)


def describe(assets: DataFrame) -> DataFrame:
    """Add mime, sha256, width, height and suffix to assets with `content`."""
    out = assets.withColumn("mime", sniff_mime(F.col("content"))).withColumn("sha256", F.sha2("content", 256)).withColumn("_size", dimensions(F.col("content")))
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in MIME_SUFFIX.items() for x in pair]), F.col("mime"))
    return out.withColumn("width", F.col("_size.width")).withColumn("height", F.col("_size.height")).withColumn("suffix", suffix).drop("_size")


def keep_reasons(min_side: int = 20, max_bytes: int | None = None, vector: bool = True) -> Column:
    """Why an asset is left out (external, vector, small, large), null if it stays."""
    reason = F.when(F.col("content").isNull(), "external")
    if not vector:
        reason = reason.when(F.col("mime") == "image/svg+xml", "vector")
    reason = reason.when(F.least("width", "height") < min_side, "small")
    return reason.when(F.length("content") > max_bytes, "large") if max_bytes is not None else reason


def dedupe(assets: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept assets, id mapping): of assets with one sha256 the smallest arrival (`idx`) stays; `id` to `kept_id`.

    Assets without sha256 all stay. With `most` only so many are kept in order of arrival (their keys go through one task, so
    it should be a cap as of a document or a page); the mapping then has null for
    what went. The first of a hash is a map-side minimum, so a picture on every page is no burden to one task.
    """
    keyed = assets.withColumn("_key", F.coalesce("sha256", F.concat(F.lit("id:"), F.col("id").cast("string"))))
    first = keyed.groupBy("_key").agg(F.min_by("id", "idx").alias("kept_id"), F.min("idx").alias("_idx"))
    if most is not None:
        first = first.join(first.orderBy("_idx").limit(most).select("_key", F.lit(1).alias("_n")), "_key", "left")
        first = first.withColumn("kept_id", F.when(F.coalesce("_n", F.lit(most + 1)) <= most, F.col("kept_id"))).drop("_n")
    mapping = keyed.join(first, "_key").select("id", "kept_id")
    kept = assets.join(first.filter("kept_id is not null").select(F.col("kept_id").alias("id")), "id", "left_semi")
    return kept, mapping


def not_held(assets: DataFrame, held: DataFrame) -> DataFrame:
    """Assets whose sha256 is not in `held`; those without bytes all stay."""
    return assets.join(held.select("sha256").filter("sha256 is not null").distinct(), "sha256", "left_anti")


def remap_references(paragraphs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite image ids in `content` (doc_id, para_idx, content) by (id, kept_id); ids without an entry stay.

    Each paragraph's references are joined and put back as one map, whole ids only, in one pass over the text.
    """
    refs = paragraphs.select("doc_id", "para_idx", F.explode(references(F.col("content"))).alias("id")).join(mapping.filter("kept_id is not null and kept_id != id"), "id")
    maps = refs.groupBy("doc_id", "para_idx").agg(F.map_from_entries(F.collect_list(F.struct("id", "kept_id"))).alias("_map"))
    parts = F.split("content", r"(?<=\./oss/file/)(?=[0-9A-Za-z_-])")
    swapped = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.try_element_at("_map", F.regexp_extract(p, "^[0-9A-Za-z_-]+", 0)), F.regexp_extract(p, "^[0-9A-Za-z_-]+", 0)), F.regexp_replace(p, "^[0-9A-Za-z_-]+", ""))))
    return paragraphs.join(maps, ["doc_id", "para_idx"], "left").withColumn("content", F.when(F.col("_map").isNull(), F.col("content")).otherwise(F.array_join(swapped, ""))).drop("_map")


def attach(paragraphs: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, para_idx (null: unattached), asset_id, match: reference, heading, anchor, document, or null.

    paragraphs: doc_id, para_idx, title, content. assets: doc_id, id, idx, heading, anchor, role. An asset that a
    paragraph refers to goes to all such paragraphs; the others are tried by heading (equal titles, then one containing
    the other), by anchor text (whole, then its last 60, then its last 32 characters) and by role. Each step joins on
    doc_id and what it compares; each takes the first paragraph in order.
    """
    ids = assets.withColumn("asset_id", F.col("id").cast("string"))
    refs = paragraphs.select("doc_id", "para_idx", F.explode(references(F.col("content"))).alias("asset_id"))
    by_reference = refs.join(ids.select("doc_id", "asset_id"), ["doc_id", "asset_id"]).select("doc_id", "asset_id", "para_idx", F.lit(0).alias("step"))

    heads = ids.filter(is_filled(F.coalesce("heading", F.lit("")))).select("doc_id", "asset_id", plain(F.col("heading")).alias("_h"))
    titles = paragraphs.select("doc_id", "para_idx", plain(F.coalesce("title", F.lit(""))).alias("_t")).filter("_t != ''").groupBy("doc_id", "_t").agg(F.min("para_idx").alias("para_idx"))
    near = heads.join(titles, "doc_id").filter(F.col("_t").contains(F.col("_h")) | F.col("_h").contains(F.col("_t")))
    order = F.struct((F.col("_t") != F.col("_h")).alias("other"), "para_idx")
    by_heading = near.groupBy("doc_id", "asset_id").agg(F.min_by("para_idx", order).alias("para_idx")).withColumn("step", F.lit(1))

    anchor = F.btrim(F.coalesce("anchor", F.lit("")))
    probes = F.array(*[F.struct(F.lit(k).alias("rank"), p.alias("probe")) for k, p in enumerate((anchor, F.right(anchor, F.lit(60)), F.right(anchor, F.lit(32))))])
    asked = ids.select("doc_id", "asset_id", F.explode(probes).alias("p")).select("doc_id", "asset_id", "p.rank", "p.probe").filter(F.length("probe") >= 12)
    hits = asked.join(paragraphs.select("doc_id", "para_idx", "content"), "doc_id").filter(F.col("content").contains(F.col("probe")))
    by_anchor = hits.groupBy("doc_id", "asset_id").agg(F.min_by("para_idx", F.struct("rank", "para_idx")).alias("para_idx")).withColumn("step", F.lit(2))

    first = paragraphs.groupBy("doc_id").agg(F.min("para_idx").alias("para_idx"))
    by_role = ids.filter("role = 'document'").select("doc_id", "asset_id").join(first, "doc_id").select("doc_id", "asset_id", "para_idx", F.lit(3).alias("step"))
    # Every asset comes once more with the last step, so what no step attaches is left with it.
    none = ids.select("doc_id", "asset_id", F.lit(None).cast("int").alias("para_idx"), F.lit(4).alias("step"))
    every = by_reference.unionByName(by_heading).unionByName(by_anchor).unionByName(by_role).unionByName(none)
    best = every.withColumn("_best", F.min("step").over(Window.partitionBy("doc_id", "asset_id"))).filter("step = _best")
    names = F.array(*[F.lit(x) for x in ("reference", "heading", "anchor", "document")])
    return best.select("doc_id", "para_idx", "asset_id", F.get(names, F.col("step")).alias("match"))


def attachment_stats(attached: DataFrame) -> DataFrame:
    """match, n: how many assets were attached in which way; unattached is null."""
    return attached.groupBy("match").agg(F.count("*").alias("n"))


def asset_stats(assets: DataFrame) -> DataFrame:
    return assets.groupBy("mime").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))


def recognise(assets: DataFrame, extractor: Callable[[bytes, str], str], most: int = 50) -> DataFrame:
    """(doc_id, id, text): recognised text of images worth keeping; each picture once a document, the first `most` of it."""
    run = lambda c, n: extractor(c, n or "") if c is not None else None
    distinct = assets.groupBy("doc_id", "sha256").agg(F.min_by(F.struct("content", "file_name", "idx"), "idx").alias("a"))
    chosen = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("a.idx"))).filter(F.col("_n") <= most)
    texts = chosen.select("doc_id", "sha256", each_row(run, "string", F.col("a.content"), F.col("a.file_name")).alias("text")).filter(ocr_gate(F.col("text")))
    return assets.select("doc_id", "id", "sha256").join(texts, ["doc_id", "sha256"]).select("doc_id", "id", "text")


def inject_text(paragraphs: DataFrame, texts: DataFrame) -> DataFrame:
    """Put the text of (doc_id, id, text) on a line of its own after every reference to the image id in `content`."""
    refs = paragraphs.select("doc_id", "para_idx", F.explode(references(F.col("content"))).alias("id")).join(texts.withColumn("id", F.col("id").cast("string")), ["doc_id", "id"])
    maps = refs.groupBy("doc_id", "para_idx").agg(F.map_from_entries(F.collect_list(F.struct("id", "text"))).alias("_map"))
    parts = F.split("content", r"(?<=\))(?<=!\[[^\]]{0,200}\]\(\./oss/file/[0-9A-Za-z_-]{1,200}\))")
    told = F.transform(parts, lambda p: F.concat(p, F.coalesce(F.concat(F.lit("\n"), F.try_element_at("_map", F.regexp_extract(p, r"!\[[^\]]*\]\(\./oss/file/([0-9A-Za-z_-]+)\)$", 1)), F.lit("\n")), F.lit(""))))
    return paragraphs.join(maps, ["doc_id", "para_idx"], "left").withColumn("content", F.when(F.col("_map").isNull(), F.col("content")).otherwise(F.array_join(told, ""))).drop("_map")
