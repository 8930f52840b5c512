"""Media columns: Netpbm and BMP images decoded to arrays, area-resized and stored as NPY tiles.

Images are bytes in a column, so a batch is bounded by Arrow's record limit and nothing leaves the
partition.  Resizing works on integral images of strips of rows, so beside an image's own bytes it takes
memory of a fixed size.  A null or malformed image gives null for every derived column and its reason in
``error``; other rows are unaffected.  What a header declares is compared with the bytes at hand before
anything is allocated.  Equal bytes give equal rows; null ids stay null; an empty table gives an empty one;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

TILE = 16
_SPACE = b" \t\n\x0b\x0c\r"
_COMMENT = re.compile(rb"#[^\n]*")
#: Samples of a strip of an integral image.
STRIP = 1 << 18


def _netpbm_tokens(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    out = []
    while len(out) < count:
        while at < len(data) and (data[at] in _SPACE or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if at == start:
            raise ValueError("a number is missing in a Netpbm header")
        out.append(int(data[start:at]))
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); samples above 8 bits stay 16-bit."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    header, at = _netpbm_tokens(data, 2 if bitmap else 3, 2)
    width, height, top = header[0], header[1], 1 if bitmap else header[2]
    if width < 1 or height < 1 or not 1 <= top <= 65535:
        raise ValueError("a Netpbm header out of range")
    n = width * height * channels
    # A sample takes a bit, a byte or two, or as text a digit at least (and a blank between two, but in P1).
    least = (width + 7) // 8 * height if kind == b"P4" else n if kind == b"P1" else 2 * n - 1 if kind in (b"P2", b"P3") else n * (2 if top > 255 else 1)
    if least > len(data) - at:
        raise ValueError("a Netpbm image is cut short")
    if kind == b"P1":
        bits = np.frombuffer(_COMMENT.sub(b"", data[at:]), np.uint8)
        bits = bits[(bits == 48) | (bits == 49)][:n] - 48
        samples = (1 - bits) * np.uint8(255)
    elif kind in (b"P2", b"P3"):
        values = _netpbm_tokens(data, n, at)[0]
        if max(values) > top:
            raise ValueError("a Netpbm sample above the header's maximum")
        samples = np.array(values, np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        samples = (1 - np.unpackbits(raw, axis=1)[:, :width].reshape(-1)) * np.uint8(255)
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
        samples = samples.astype(np.uint16) if top > 255 else samples
    if len(samples) != n:
        raise ValueError("a Netpbm image is cut short")
    return samples.reshape(height, width, channels)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples as a raw graymap."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit bitmaps as (height, width, 3), top row first; masks must be those of plain BGR."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, width, height, planes, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (8, 24, 32) or planes != 1 or width < 1 or height == 0:
        raise ValueError("a BMP form that is not supported")
    if packing == 3 and (depth != 32 or data[54:66] != struct.pack("<III", 0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP masks that are not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if stride * rows > len(data) - start or not 54 <= start <= len(data):
        raise ValueError("a BMP image is cut short")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if depth == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        index = raw[:, :width]
        if index.max(initial=0) >= len(palette):
            raise ValueError("a BMP palette is cut short")
        pixels = palette[index][:, :, 2::-1]
    else:
        k = depth // 8
        pixels = raw[:, : width * k].reshape(rows, width, k)[:, :, 2::-1]
    return pixels if height < 0 else pixels[::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(height, width, 3) as a bottom-up 24-bit bitmap."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    raw = np.zeros((height, stride), np.uint8)
    raw[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + raw.size, 0, 0, 54, 40, width, height, 1, 24, 0, raw.size, 2835, 2835, 0, 0) + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's exact area, from the integral images of strips of rows."""
    h, w, channels = image.shape

    def at(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(np.int64), n - 1)
        return low, edges - low

    y, fy = at(np.linspace(0, h, height + 1), h)
    x, fx = at(np.linspace(0, w, width + 1), w)
    above, cells = np.zeros((width, channels)), np.zeros((height + 1, width, channels))
    step = max(1, STRIP // (w * channels))
    for top in range(0, h, step):
        part = image[top : top + step]
        across = np.zeros((len(part), w + 1, channels))
        np.cumsum(part, axis=1, dtype=np.float64, out=across[:, 1:])
        columns = np.diff(across[:, x] + (across[:, x + 1] - across[:, x]) * fx[None, :, None], axis=1)
        down = np.concatenate([above[None], above + np.cumsum(columns, axis=0)])
        here = np.flatnonzero((y >= top) & (y < top + len(part)))
        cells[here] = down[y[here] - top] + (down[y[here] - top + 1] - down[y[here] - top]) * fy[here, None, None]
        above = down[-1]
    return np.diff(cells, axis=0) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8x8 neighbouring pairs of the 8x9 area-resized luma rises."""
    small = area_resize(image, 8, 9).mean(axis=2).round(6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def tiles(media: DataFrame, id_column: str, bytes_column: str, tile: int = TILE) -> DataFrame:
    """(id, width, height, channels, tile NPY bytes, dhash, error) of every image row."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    small = area_resize(image, tile, tile).round().astype(image.dtype)
                    rows.append((image.shape[1], image.shape[0], image.shape[2], npy(small), difference_hash(image), None))
                except (ValueError, IndexError, OverflowError, struct.error) as error:
                    rows.append((None, None, None, None, None, str(error)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "width", "height", "channels", "tile", "dhash", "error"])

    source = media.select(F.col(id_column).alias("id"), F.col(bytes_column).alias("data"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, width long, height long, channels long, tile binary, dhash string, error string").withColumnRenamed("id", id_column)


def text_as_media(payload: bytes, width: int = 64) -> tuple[bytes, bytes]:
    """(padded payload, its raw graymap of ``width`` columns)."""
    padded = payload + bytes(-len(payload) % width or (0 if payload else width))
    return padded, encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, width))


def stored_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every text stored as a graymap and read back: sizes, digests and the image's features; null is empty.

    The first pass writes a table of images, the second reads it, writes a table of NPY tiles and features, and the
    result is read from that.
    """
    ws = Workspace(docs.sparkSession)

    def store(batches):
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):  # a row at a time: an image may be large
                text = text.as_py() or b""
                stored = text_as_media(text)[1]
                yield pa.RecordBatch.from_arrays([pa.array([len(text)], pa.int64()), pa.array([stored], pa.binary())], names=["n_bytes", "media"])

    def stores(batches):
        for batch in batches:
            ids, held, size, at = batch.column(0), [], 0, 0
            for row in store([batch]):
                held.append(row)
                size += row.column(1).nbytes
                if size >= _WRITTEN or at + len(held) == batch.num_rows:
                    table = pa.Table.from_batches(held).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), *(c.chunk(0) for c in table.columns)], names=["id", "n_bytes", "media"])
                    at, held, size = at + len(held), [], 0

    def features(batches):
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                stored = stored.as_py()
                image = decode(stored)
                back = image.tobytes()
                tile = npy(area_resize(image, TILE, TILE).round().astype(np.uint8))
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), tile))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", *_STORED])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    media = ws.save(source.mapInArrow(stores, f"id {kind}, n_bytes long, media binary"), "media")
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    tiled = ws.save(media.mapInArrow(features, schema), "tiles")
    ws.drop(media)
    return tiled.withColumn("tile", F.sha2("tile", 256)).withColumnsRenamed({"id": id_column, "tile": "tile_sha256"})


#: Bytes of images that leave a task together, unless one is larger.
_WRITTEN = 8 << 20
_STORED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
