"""Media columns: TIFF. Reads image directories, strips and tiles, PackBits, LZW and deflate, undoes predictors; one row per page.

Reading: both byte orders, any number of directories (a circle of directories ends the walk), 8- and 16-bit unsigned samples, chunky
or planar, horizontal predictor. A null or empty value has no pages. A value that is not a TIFF, uses another compression or is cut
short gives one row with page 0 and the reason in error; the job goes on. Rows are otherwise kept one for one with their pages; repeated
and null keys too. All columns of the input but the media column are kept as they are; one that has the name of an output fails early.

Writing: bytes as 8-bit samples of pages 64 wide, zero-padded to whole rows, at least one. The layout follows from the length alone,
so equal values give equal files: LZW strips up to 1 KB, PackBits tiles up to 2 KB, else deflate strips with horizontal predictor.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDTH = 64
# Tag numbers, compressions and field sizes of the format.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD = {1: "B", 3: "H", 4: "I"}


# -- compressions ------------------------------------------------------------------
def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1:i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1:i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends; widths grow one code early."""
    bits, held, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
    known = {bytes((i,)): i for i in range(256)}
    put(256, 9)
    width, after, word = 9, 258, b""
    for i in range(len(data)):
        more = word + data[i:i + 1]
        if more in known:
            word = more
            continue
        put(known[word], width)
        known[more] = after
        after += 1
        width += after == 1 << width
        if after >= 4095:
            put(256, width)
            known = {bytes((i,)): i for i in range(256)}
            width, after = 9, 258
        word = data[i:i + 1]
    if word:
        put(known[word], width)
        width += after + 1 == 1 << width
    put(257, min(width, 12))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, width, held, bits, last = list(first), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, last = list(first), 9, None
            continue
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out.append(word)
        last = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 3), PACKBITS: packbits}
EXPANDS = {NONE: 1, LZW: 2800, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}  # the most bytes that a stored byte can stand for


def inflate(b: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(b, most)


UNPACK = {NONE: bytes, LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpackbits}


# -- reading -----------------------------------------------------------------------
def directories(b: bytes) -> list[dict]:
    """The fields of every image directory."""
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if order is None or len(b) < 8 or struct.unpack_from(order + "H", b, 2)[0] != 42:
        raise ValueError("no TIFF header")
    out, at, seen = [], struct.unpack_from(order + "I", b, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n, = struct.unpack_from(order + "H", b, at)
        fields = {"order": order}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", b, at + 2 + 12 * k)
            if kind in FIELD:
                code = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(code) > 4:
                    where, = struct.unpack_from(order + "I", b, where)
                fields[tag] = struct.unpack_from(code, b, where)
        out.append(fields)
        at, = struct.unpack_from(order + "I", b, at + 2 + 12 * n)
    return out


def image(b: bytes, f: dict) -> tuple[int, int, int, int, bytes]:
    """width, height, samples, bits and the samples of a page, row by row, in little-endian order."""
    one = lambda tag, default=None: f.get(tag, (default,))[0]
    width, height, samples, bits = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES, 1), one(BITS, 1)
    unpack = UNPACK.get(one(COMPRESSION, NONE))
    if unpack is None or bits not in (8, 16) or len(set(f.get(BITS, (1,)))) > 1 or not width or not height:
        raise ValueError("this compression or sample size is not read")
    if not 0 < samples <= 64 or not all(isinstance(x, int) for x in (width, height)):
        raise ValueError("no such number of samples")
    dtype = np.dtype(f["order"] + f"u{bits // 8}")
    planes, deep = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    tiled = TILE_OFFSETS in f
    tw, th = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not (isinstance(tw, int) and isinstance(th, int) and tw > 0 and th > 0):
        raise ValueError("a strip or tile has no size")
    across, down = -(-width // tw), -(-height // th)
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise ValueError("strips or tiles are missing or too many")
    whole = planes * across * down * tw * th * deep * dtype.itemsize if tiled else height * width * samples * dtype.itemsize
    if whole > EXPANDS[one(COMPRESSION, NONE)] * (sum(min(n, len(b)) for n in counts) + 64):
        raise ValueError("the file cannot hold that many samples")  # before memory is taken for them
    out = np.zeros((planes, height, width, deep), dtype.newbyteorder("<"))
    for k, (at, n) in enumerate(zip(offsets, counts)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        need = rows * tw * deep * dtype.itemsize
        raw = inflate(b[at:at + n], need) if unpack is inflate else unpack(b[at:at + n])
        if len(b) < at + n or len(raw) < need:
            raise ValueError("a strip or tile is cut short")
        part = np.frombuffer(raw[:need], dtype).reshape(rows, tw, deep)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("this predictor is not read")
        part = part[:height - y, :width - x]
        out[plane, y:y + part.shape[0], x:x + part.shape[1]] = part
    return width, height, samples, bits, np.moveaxis(out, 0, 2).tobytes() if planes > 1 else out.tobytes()


def features(samples: np.ndarray) -> str:
    """Count, sum, sum of squares, extremes and most common value of the samples, and the sum of absolute steps."""
    if not len(samples):
        return "n=0"
    n = np.bincount(samples)
    v = np.arange(len(n), dtype=np.int64)
    steps = int(np.abs(np.diff(samples.astype(np.int32))).sum())
    at = np.flatnonzero(n)
    return f"n={len(samples)};sum={int(n @ v)};squares={int(n @ (v * v))};min={at[0]};max={at[-1]};mode={int(n.argmax())};steps={steps}"


def pages(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns, the media column, and page (from 1), width, height, samples, bits, pixels, feature, error."""
    new = ["page", "width", "height", "samples", "bits", "pixels", "feature", "error"]
    if set(new) & set(media.columns):
        raise ValueError(f"columns {sorted(set(new) & set(media.columns))} would clash")
    at = media.columns.index(column)

    def rows(value: bytes):
        try:
            for k, f in enumerate(directories(value)):
                w, h, s, bits, pixels = image(value, f)
                yield k + 1, w, h, s, bits, pixels, features(np.frombuffer(pixels, f"<u{bits // 8}")), None
        except (ValueError, struct.error, zlib.error, IndexError, KeyError, TypeError, ArithmeticError, MemoryError) as e:
            yield 0, None, None, None, None, None, None, str(e) or type(e).__name__

    def run(batches):
        types = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                take, out = [], []
                for i, v in enumerate(part.column(at).to_pylist()):
                    for r in rows(v) if v else ():
                        take.append(i)
                        out.append(r)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(take, pa.int64())).columns, *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], [*part.schema.names, *new])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, schema + ", page int, width int, height int, samples int, bits int, pixels binary, feature string, error string")


# -- writing -----------------------------------------------------------------------
def layout(size: int) -> tuple[int, int, bool]:
    """Compression, predictor and whether tiled, by the number of bytes."""
    return (LZW, 1, False) if size <= 1024 else (PACKBITS, 1, True) if size <= 2048 else (DEFLATE, 2, False)


def write(planes: list[bytes], how: tuple[int, int, bool] | None = None, rows: int = 1024, order: str = "<") -> bytes:
    """A TIFF with a page for each value."""
    out, links = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), [4]
    for data in planes:
        data = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
        compression, predictor, tiled = how or layout(len(data))
        height = len(data) // WIDTH
        step = 32 if tiled else rows
        a = np.zeros((-(-height // step) * step if tiled else height, WIDTH), np.uint8)
        a[:height] = np.frombuffer(data, np.uint8).reshape(height, WIDTH)
        parts = [a[y:y + step, x:x + (step if tiled else WIDTH)] for y in range(0, len(a), step) for x in range(0, WIDTH, step if tiled else WIDTH)]
        if predictor == 2:
            parts = [np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1) for x in parts]
        parts = [x.tobytes() for x in parts]
        offsets, counts = [], []
        for p in map(PACK[compression], parts):
            offsets.append(len(out))
            counts.append(len(p))
            out += p
        out += bytes(len(out) % 2)
        fields = {IMAGE_WIDTH: (WIDTH,), IMAGE_LENGTH: (height,), BITS: (8,), COMPRESSION: (compression,), PHOTOMETRIC: (1,), SAMPLES: (1,), PREDICTOR: (predictor,)}
        fields |= {TILE_WIDTH: (step,), TILE_LENGTH: (step,), TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: (step,), STRIP_COUNTS: counts}
        entries = bytearray()
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                packed, extra = struct.pack(order + "I", len(out)), packed
                out += extra
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + packed
        struct.pack_into(order + "I", out, links[-1], len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        links.append(len(out))
        out += bytes(4)
    return bytes(out)


def payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: the text's UTF-8 (null: empty) as a TIFF of one page."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                data = [v or b"" for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(v) for v in data], pa.int64()), pa.array([write([v]) for v in data], pa.binary())], ["key", "n_bytes", "media"])
    out = docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")
    return out.withColumnRenamed("key", key)
