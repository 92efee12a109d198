"""Media columns (operator 9): Netpbm and BMP bytes become arrays, area-resized NPY tiles and difference hashes.

The decoders, the integral-image resize and the hash are small per-row helpers; Spark partitions the rows and nothing is shuffled.
Samples of any depth are read as they are and scaled to 0..255 before tiles and hashes are made.

Null, empty or undecodable media give null outputs in media_columns(), which keeps all columns of its input whatever their names. A null
text is an empty payload in text_media(), very long ones are stored whole; equal texts give equal values; ids may be null or repeat; an
empty table gives an empty one.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.shared import dealt_documents, per_batch, utf8

WIDTH = 64


@dataclass
class Image:
    """Samples as stored, (height, width) or (height, width, 3), and the value that stands for full brightness."""

    samples: np.ndarray
    high: int

    def grey(self) -> np.ndarray:
        """Samples from 0 to 255, colours averaged."""
        flat = self.samples if self.samples.ndim == 2 else self.samples.mean(axis=2)
        return flat if self.high == 255 else flat * (255 / self.high)


def decode_netpbm(data: bytes) -> Image:
    """P1 to P6; bitmaps come out as 0 (black) and 1 (white). Anything that isn't whole and in range is a ValueError."""
    kind, fields, at = data[:2], [], 2
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    wanted = 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < wanted:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at or end - at > 9:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, high = *fields[:2], (fields[2] if wanted == 3 else 1)
    if not width or not height or not 0 < high < 65536:
        raise ValueError("no samples")
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, ">u2" if high > 255 else "u1", width * height * depth, at + 1)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, "u1", row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        samples = 1 - bits
    elif kind == b"P1":
        digits = bytes(b for b in data[at:] if b in b"01")[: width * height]
        samples = 1 - (np.frombuffer(digits, "u1") - 48)
    else:
        samples = np.array([int(x) for x in data[at:].split()[: width * height * depth]], np.int64)
    if samples.size and (samples.max() > high or samples.min() < 0):
        raise ValueError("sample out of range")
    return Image(samples.reshape(shape), high)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def decode_bmp(data: bytes) -> Image:
    """Uncompressed 8-bit (grey or palette), 24-bit and 32-bit BMP, bottom-up or top-down; colours come out as RGB."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, width, height = (int.from_bytes(data[a : a + 4], "little", signed=s) for a, s in ((10, False), (14, False), (18, True), (22, True)))
    bits, packing, colours = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little"), int.from_bytes(data[46:50], "little")
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    row = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, "u1", row * abs(height), start).reshape(abs(height), row)
    rows = (rows[::-1] if height > 0 else rows)[:, : width * bits // 8]
    if bits > 8:
        return Image(rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1], 255)
    palette = np.frombuffer(data, "u1", 4 * (colours or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == np.arange(len(palette), dtype="u1")[:, None]).all():
        return Image(rows, 255)
    return Image(palette[rows], 255)


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey, bottom-up, with a grey palette."""
    height, width = samples.shape
    row = (width + 3) // 4 * 4
    body = np.zeros((height, row), "u1")
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype="<u4") * 0x010101, 1).tobytes()
    head = b"BM" + (54 + 1024 + body.size).to_bytes(4, "little") + bytes(4) + (54 + 1024).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\1\0\x08\0" + bytes(4) + body.size.to_bytes(4, "little") + bytes(16)
    return head + info + palette + body.tobytes()


def decode(data: bytes) -> Image:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means of a grey image: the integral image, read at fractional corners."""
    h, w = samples.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def read(table: np.ndarray, n: int, m: int) -> np.ndarray:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = read(read(total, h, height).T, w, width).T
    area = (h / height) * (w / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def difference_hash(image: Image) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 tile is darker than its right neighbour."""
    tile = np.round(area_resize(image.grey(), 8, 9), 6)
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy_tile(image: Image, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(np.round(area_resize(image.grey(), side, side)).astype("u1")))
    return out.getvalue()


def media_columns(df: DataFrame, media: str = "media", side: int = 16) -> DataFrame:
    """df with height, width, tile (NPY bytes, side x side) and dhash of the binary column `media`; null where it can't be decoded."""
    schema = df.select(F.col(media).alias("media"), F.struct("*").alias("row")).schema

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for data in batch.column("media").to_pylist():
            try:
                image = decode(data or b"")
                row = [*image.samples.shape[:2], npy_tile(image, side), difference_hash(image)]
            except (ValueError, IndexError, OverflowError):
                row = [None] * 4
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["row", "height", "width", "tile", "dhash"])

    packed = df.select(F.col(media).alias("media"), F.struct("*").alias("row"))
    return per_batch(packed, make, f"row {schema['row'].dataType.simpleString()}, height long, width long, tile binary, dhash string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 16) -> DataFrame:
    """Each text's UTF-8, zero-padded to a positive multiple of 64, stored as a 64-wide PGM and read back from those bytes.

    Returns doc_id, n_bytes, payload (as read back), media (stored form), tile (NPY) and dhash. Null text: an empty payload. Equal
    texts give equal values; ids may be null or repeat.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            raw = utf8(text)
            size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
            media = encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), "u1").reshape(-1, WIDTH))
            image = decode_netpbm(media)
            rows.append((len(raw), image.samples.tobytes(), media, npy_tile(image, side), difference_hash(image)))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", "payload", "media", "tile", "dhash"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, n_bytes long, payload binary, media binary, tile binary, dhash string", 200)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text_media(dealt_documents(spark, sf_dir))
    return m.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.crc32("tile").cast("string")).alias("feature"),
    )


QUERIES = {"op9_media_columns": op9_media_columns}
SQL: dict[str, str] = {}
