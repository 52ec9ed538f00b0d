"""Files as rows: bounded intake, type by leading bytes, byte signatures, trailing bytes, image statistics, manifests."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.conditions import let

MOST_INPUT_BYTES = 50 << 20
FORMATS = ("JPEG", "PNG", "WEBP", "GIF", "TIFF", "BMP")


def read_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = MOST_INPUT_BYTES) -> DataFrame:
    """(path, size_bytes, content, sha256, accepted): content only of files that aren't empty nor over the limit.

    The source drops files by their length before it reads them, so what is refused is never loaded. Empty
    files give no row at all (Spark's source leaves them out).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    d = reader.load(path)
    good = d.where((F.col("length") > 0) & (F.col("length") <= most_bytes)).select("path", F.col("length").alias("size_bytes"), "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.lit(True).alias("accepted"))
    bad = d.where((F.col("length") <= 0) | (F.col("length") > most_bytes)).select("path", F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("accepted"))
    return good.unionByName(bad)


def read_manifest(spark: SparkSession, path: str, labels: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Records of a JSON-lines manifest; blank and malformed lines are left out; a label selects records one of whose labels contains it."""
    schema = "id string, path string, source string, sha256 string, labels array<string>, expected struct<forbidden_actions: array<string>, must_not_release: boolean, maximum_critical_findings: int>, bad string"
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path).where("bad is null and id is not null").drop("bad")
    for label in labels or []:
        d = d.where(F.exists("labels", lambda x: F.contains(x, F.lit(label))))
    return d.limit(most) if most else d


def seeded_order(d: DataFrame, key: str, seed: int, most: int, top_up: DataFrame | None = None) -> DataFrame:
    """At most ``most`` rows in an order that the seed and the key alone fix; ``top_up`` fills what is missing, in its own such order."""
    pick = lambda rows: rows.withColumn("__h", F.xxhash64(key, F.lit(seed)))
    rows = pick(d).withColumn("__p", F.lit(0))
    if top_up is not None:
        rows = rows.unionByName(pick(top_up.join(d.select(key).distinct(), key, "left_anti").select(*d.columns)).withColumn("__p", F.lit(1)))
    return rows.orderBy("__p", "__h", key).limit(most).drop("__p", "__h")


def _starts(c: Column, *heads: bytes) -> Column:
    out = F.lit(False)
    for h in heads:
        out |= F.hex(F.substring(c, 1, len(h))) == h.hex().upper()
    return out


_TYPES = {"PNG": "image/png", "JPEG": "image/jpeg", "GIF": "image/gif", "WEBP": "image/webp", "TIFF": "image/tiff", "BMP": "image/bmp", "PDF": "application/pdf", "SVG": "image/svg+xml", "POSTSCRIPT": "application/postscript"}


def format_of(c: Column) -> Column:
    """The format that the first 64 bytes show."""
    head = F.decode(F.substring(c, 1, 64), "ISO-8859-1")
    text = F.regexp_replace(head, r"^[\x09-\x0d\x20]+", "")
    return (
        F.when(_starts(c, b"\x89PNG\r\n\x1a\n"), "PNG")
        .when(_starts(c, b"\xff\xd8\xff"), "JPEG")
        .when(_starts(c, b"GIF87a", b"GIF89a"), "GIF")
        .when(_starts(c, b"RIFF") & (F.substring(head, 9, 4) == "WEBP"), "WEBP")
        .when(_starts(c, b"II*\x00", b"MM\x00*"), "TIFF")
        .when(_starts(c, b"BM"), "BMP")
        .when(text.startswith("%PDF"), "PDF")
        .when((text.startswith("<svg") | text.startswith("<?xml")) & F.contains(F.lower(head), F.lit("<svg")), "SVG")
        .when(text.startswith("%!PS") | text.startswith("\x04%!PS"), "POSTSCRIPT")
        .otherwise("UNKNOWN")
    )


def mime_of(fmt: Column) -> Column:
    out = F.when(fmt == "PNG", _TYPES["PNG"])
    for name, mime in _TYPES.items():
        out = out.when(fmt == name, mime)
    return out.otherwise("application/octet-stream")


def format_of_name(c: Column) -> Column:
    """The format that a file name's extension says."""
    ext = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "JPEG").when(ext.isin("tif", "tiff"), "TIFF").when(ext.isin("png", "gif", "webp", "bmp", "svg", "pdf"), F.upper(ext)).when(ext == "ps", "POSTSCRIPT").otherwise("UNKNOWN")


def allowed(fmt: Column) -> Column:
    return fmt.isin(*FORMATS)


def signatures(c: Column) -> Column:
    """The byte rules that a content matches.

    The second rule's words compare little-endian numbers, so of its three magics only JPEG's can be
    that of a real file; the other two are kept as they are.
    """
    text = F.decode(c, "ISO-8859-1")
    magic = _starts(c, b"\xff\xd8") | _starts(c, b"GNP\x89") | _starts(c, b"8FIG")
    script = text.rlike(r"(?i)<script[\s\x0b>]") | text.rlike(r"(?i)eval[\s\x0b]*\(")
    return F.array_compact(F.array(F.when(F.contains(F.upper(text), F.lit("EICAR-STANDARD-ANTIVIRUS-TEST-FILE")), "test_string"), F.when(magic & script, "embedded_script")))


_END = {"PNG": "0000000049454E44AE426082", "JPEG": "FFD9", "GIF": "3B"}


def trailing_bytes(c: Column, fmt: Column) -> Column:
    """How many bytes follow the last end marker of a PNG, JPEG or GIF; null without a marker."""
    text = F.decode(c, "ISO-8859-1")  # a character for each byte

    def after(mark: str) -> Column:
        m = bytes.fromhex(mark).decode("latin-1")
        return F.when(F.contains(text, F.lit(m)), F.length(F.substring_index(text, m, -1)))

    return F.when(fmt == "PNG", after(_END["PNG"])).when(fmt == "JPEG", after(_END["JPEG"])).when(fmt == "GIF", after(_END["GIF"])).cast("long")


HEADER_BYTES = 1 << 16


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType()), StructField("frames", LongType())]))
def _header(heads: pd.Series) -> pd.DataFrame:
    def one(b: bytes | None) -> tuple[int | None, int | None, int | None]:
        if not b:
            return None, None, None
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            at = b.find(b"acTL")
            return *struct.unpack(">II", b[16:24]), struct.unpack(">I", b[at + 4 : at + 8])[0] if 0 < at <= len(b) - 8 else 1
        if b[:3] == b"GIF" and len(b) >= 10:
            return *struct.unpack("<HH", b[6:10]), 1
        if b[:2] == b"BM" and len(b) >= 26:
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h), 1
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X" and len(b) >= 30:
                return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, 1
            if b[12:16] == b"VP8L" and len(b) >= 25:
                bits = int.from_bytes(b[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
            if b[12:16] == b"VP8 " and len(b) >= 30:
                return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF, 1
            return None, None, None
        at = 2
        while b[:2] == b"\xff\xd8" and at + 9 <= len(b) and b[at] == 0xFF:
            kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
            if kind in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return w, h, 1
            at += 2 + max(size, 2)
        return None, None, None

    return pd.DataFrame([one(b) for b in heads], columns=["width", "height", "frames"]).astype("Int64")


def dimensions(content: Column) -> Column:
    """struct(width, height, frames) by the header of a PNG, GIF, BMP, WebP or JPEG; nulls where they can't be read.

    Only the first 64 KB go to Python. Frames are counted for animated PNG only; for others ``gif_frames`` or 1.
    """
    return _header(F.substring(content, 1, HEADER_BYTES))


def gif_frames(content: bytes, most: int = 30) -> list[tuple[int, int, int, int]]:
    """(offset, length, width, height) of the image blocks of a GIF, at most ``most``; what is cut off is left out."""
    if content[:3] != b"GIF" or len(content) < 13:
        return []
    at, out = 13 + (3 << (content[10] & 7) + 1 if content[10] & 128 else 0), []

    def blocks(at: int) -> int:
        while at < len(content) and content[at]:
            at += content[at] + 1
        return at + 1

    while at < len(content) and len(out) < most:
        start = at
        if content[at] == 0x21:
            at = blocks(at + 2)
        elif content[at] == 0x2C and at + 10 <= len(content):
            width, height, flags = struct.unpack("<HHB", content[at + 5 : at + 10])
            at = blocks(at + 10 + (3 << (flags & 7) + 1 if flags & 128 else 0) + 1)
            if at <= len(content):
                out.append((start, at - start, width, height))
        else:
            break
    return out


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("offset", "length", "width", "height")])))
def frames(contents: pd.Series) -> pd.Series:
    """The frames of GIFs, by place; an empty array for other contents."""
    return pd.Series([[dict(zip(("offset", "length", "width", "height"), f)) for f in gif_frames(b)] if b else [] for b in contents])


def image_problem(width: Column, height: Column, frames: Column | int = 1, most_side: int = 16384, most_pixels: int = 50_000_000, most_aspect: int = 200, most_frames: int = 30, most_total: int = 150_000_000) -> Column:
    """Why an image is refused by its dimensions, or null."""
    pixels = width.cast("decimal(20,0)") * height
    frames = F.lit(frames) if isinstance(frames, int) else frames
    return (
        F.when(width.isNull() | (width < 1) | (height < 1), "undecodable")
        .when((width > most_side) | (height > most_side), "side")
        .when(pixels > most_pixels, "pixels")
        .when(frames > most_frames, "frames")
        .when(F.greatest(width, height) > most_aspect * F.least(width, height), "aspect")
        .when(pixels * frames > most_total, "total_pixels")
    )


def file_problem(size: Column, fmt: Column, problem: Column, most_bytes: int = MOST_INPUT_BYTES) -> Column:
    """Why a file is refused: its size, its format, then what ``image_problem`` says; null if it isn't."""
    return F.when(size <= 0, "empty").when(size > most_bytes, "too large").when(~allowed(fmt), "format").otherwise(problem)


@F.pandas_udf(DoubleType())
def byte_entropy(contents: pd.Series) -> pd.Series:
    """Bits per value of a histogram of 256 values (grey pixels as bytes); 0 when empty. One histogram for a whole batch."""
    out = np.full(len(contents), np.nan)
    for at in range(0, len(contents), 1000):
        part = contents.iloc[at : at + 1000]
        known = part.notna().to_numpy()
        raw = [b for b in part if b is not None]
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        counts = np.bincount(np.repeat(np.arange(len(raw)), sizes) * 256 + data, minlength=256 * len(raw)).reshape(len(raw), 256)
        p = counts / np.maximum(sizes, 1)[:, None]
        out[at : at + 1000][known] = 0.0 - (p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


@F.pandas_udf(BinaryType())
def least_bits(contents: pd.Series) -> pd.Series:
    """The least significant bits of RGB bytes, packed from the highest bit on, at most 516 bytes; whole bytes only."""
    pick = lambda b: np.packbits((np.frombuffer(b, np.uint8, min(len(b), 516 * 8)) & 1)[: min(len(b), 516 * 8) // 8 * 8]).tobytes()
    return pd.Series([None if b is None else pick(b) for b in contents])


def hidden_canary(bits: Column, canaries: list[bytes]) -> Column:
    """The first of the canaries (as text) in the framed payload, else anywhere in the bits; null without one."""
    def first(c: Column) -> Column:
        text = F.decode(c, "ISO-8859-1")
        return F.coalesce(*(F.when(F.contains(text, F.lit(k.decode("latin-1"))), k.decode("latin-1")) for k in canaries))

    return F.when(F.octet_length(bits) >= 4, F.coalesce(first(framed_payload(bits)), first(bits)))


def framed_payload(bits: Column) -> Column:
    """The payload behind a big-endian length of four bytes, if it fits."""
    size = F.conv(F.hex(F.substring(bits, 1, 4)), 16, 10).cast("long")
    return F.when((size > 0) & (size <= F.octet_length(bits) - 4), F.substring(bits, F.lit(5), size.cast("int")))


@F.pandas_udf(StructType([StructField("offset", LongType()), StructField("length", LongType())]))
def thumbnail_place(heads: pd.Series) -> pd.DataFrame:
    """Where the second directory of a JPEG's EXIF block says that the thumbnail lies, from the file's first byte; nulls without one."""

    def one(b: bytes | None) -> tuple[int | None, int | None]:
        at = b.find(b"Exif\0\0") if b else -1
        if at < 0 or len(b) < at + 14 or b[at + 6 : at + 8] not in (b"II", b"MM"):
            return None, None
        tiff, e = at + 6, "<" if b[at + 6 : at + 8] == b"II" else ">"
        try:
            first = tiff + struct.unpack_from(e + "I", b, tiff + 4)[0]
            entries = struct.unpack_from(e + "H", b, first)[0]
            second = struct.unpack_from(e + "I", b, first + 2 + 12 * entries)[0]
            if not second:
                return None, None
            tags = {}
            for i in range(struct.unpack_from(e + "H", b, tiff + second)[0]):
                tag, kind, _ = struct.unpack_from(e + "HHI", b, tiff + second + 2 + 12 * i)
                tags[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), b, tiff + second + 10 + 12 * i)[0]
        except struct.error:
            return None, None
        return (tiff + tags[513], tags[514]) if 513 in tags and 514 in tags else (None, None)

    return pd.DataFrame([one(b) for b in heads], columns=["offset", "length"]).astype("Int64")


def exif_thumbnail(content: Column) -> Column:
    """The thumbnail that a JPEG carries, or null."""
    place = thumbnail_place(F.substring(content, 1, HEADER_BYTES))
    return let(place, lambda p: thumbnail(content, p["offset"], p["length"]))


def thumbnail(content: Column, offset: Column, length: Column) -> Column:
    """The slice that a header's offset and length give, if it lies within."""
    return F.when((offset >= 0) & (length > 0) & (offset + length <= F.octet_length(content)), F.substring(content, (offset + 1).cast("int"), length.cast("int")))
