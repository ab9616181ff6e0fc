"""GIF media: coding, decoding and frame tables.

The decoder reads whole GIF89a and GIF87a streams: LZW codes of growing width
with clears at any place (late ones too), global and local palettes,
interlacing, transparency, and the disposal rules, giving timed frames. The
encoder writes animated GIFs with 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored

GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


class GifError(ValueError):
    """The bytes are not a complete GIF."""


def _widths(index: np.ndarray, bits: int) -> np.ndarray:
    """Width of the code at each place after a clear, for palettes of ``bits`` bits."""
    following = np.maximum((1 << bits) + 2, (1 << bits) + 1 + index)
    return np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, bits + 1, 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    codes = [clear]
    emit = codes.append
    table: dict[int, int] = {}
    find = table.get
    free = stop + 1
    if data:
        rest = iter(data)
        word = next(rest)
        for value in rest:
            key = word << 8 | value
            code = find(key)
            if code is not None:
                word = code
            else:
                emit(word)
                table[key] = free
                free += 1
                word = value
                if free == 4096:
                    emit(clear)
                    table.clear()
                    free = stop + 1
        emit(word)
    emit(stop)
    c = np.array(codes, dtype=np.int64)
    place = np.arange(len(c))
    after = np.where(c == clear, place, -1)
    last = np.concatenate(([-1], np.maximum.accumulate(after)[:-1]))
    width = _widths(place - last - 1, bits)
    at = np.cumsum(width) - width
    spread = c << (at & 7)
    byte = at >> 3
    size = int(at[-1] + width[-1] + 7) // 8
    out = np.zeros(size + 3, dtype=np.float64)
    for k in range(3):
        out += np.bincount(byte + k, weights=(spread >> (8 * k)) & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """``size`` samples of a code stream; GifError if it is damaged."""
    if not 1 <= bits <= 8:
        raise GifError(f"samples of {bits} bits")
    clear, stop = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total = 8 * len(stream)
    single = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, at = 0, 0
    while at < total and made < size:
        count = 4096 - clear
        while True:
            width = _widths(np.arange(count), bits)
            offset = at + np.concatenate(([0], np.cumsum(width)))
            whole = int(np.searchsorted(offset, total, side="right")) - 1
            o, w = offset[:whole], width[:whole]
            b = o >> 3
            codes = ((data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (o & 7)) & ((1 << w) - 1)
            ends = np.flatnonzero((codes == clear) | (codes == stop))
            if len(ends) or whole < count:
                break
            count *= 2  # the table is full and the clear comes late
        n = int(ends[0]) if len(ends) else whole
        if n:
            table = single.copy()
            add, put = table.append, out.append
            before = b""
            for code in codes[:n].tolist():
                if code < len(table):
                    entry = table[code]
                elif before and code == len(table):
                    entry = before + before[:1]
                else:
                    raise GifError("a code points past the table")
                put(entry)
                if before and len(table) < 4096:
                    add(before + entry[:1])
                before = entry
            made += sum(map(len, out[-n:]))
        if not len(ends) or codes[n] == stop:
            break
        at = int(offset[n + 1])
    pixels = b"".join(out)
    if len(pixels) < size:
        raise GifError("the code stream ends early")
    return pixels[:size]


@dataclass
class Frame:
    """One image of a stream: its samples as stored, and how it is shown."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(part),)) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(frames: list[np.ndarray], palette: np.ndarray = GREY, delay: int = 10) -> bytes:
    """An animated GIF of 8-bit frames with one palette of 256 colours."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.tobytes()]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        out.append(_blocks(lzw_encode(f.tobytes())))
    return b"".join(out) + b"\x3b"


def _interlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = np.concatenate([np.arange(first, n, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and the frames of a GIF; GifError if the bytes are cut or not a GIF."""
    try:
        return _decode(data)
    except (IndexError, ValueError, struct.error) as e:
        raise e if isinstance(e, GifError) else GifError("the stream is cut or damaged") from e


def _decode(data: bytes, most_pixels: int = 1 << 24) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF89a", b"GIF87a"):
        raise GifError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("a palette is cut")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def gathered(at: int) -> tuple[bytes, int]:
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(out), at + 1

    if flags & 0x80:
        common, at = colours(flags, at)
    frames, shown = [], (0, 0, None)
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, after = gathered(at + 2)
            if label == 0xF9:
                how, delay, clear = struct.unpack_from("<BHB", body, 0)
                shown = (delay, how >> 2 & 7, clear if how & 1 else None)
            at = after
        elif kind == 0x2C:
            left, top, w, h, how = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if how & 0x80:
                palette, at = colours(how, at)
            bits = data[at]
            stream, at = gathered(at + 1)
            if w * h > most_pixels:
                raise GifError(f"a frame of {w} x {h}")
            rows = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8).reshape(h, w)
            frames.append(Frame(left, top, _interlaced(rows) if how & 0x40 else rows, GREY if palette is None else palette, *shown))
            shown = (0, 0, None)
        else:
            raise GifError(f"unknown block {kind:#x}")
    return width, height, frames


def canvases(width: int, height: int, frames: list[Frame], most_pixels: int = 1 << 24):
    """(frame, RGBA picture shown) in time order, under the disposal and transparency rules.

    The header alone sets the canvas, so one of more than ``most_pixels`` is a
    GifError, as a few bytes could else ask for any memory.
    """
    if width * height > most_pixels:
        raise GifError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        h, w = f.samples.shape
        area = (slice(f.top, min(f.top + h, height)), slice(f.left, min(f.left + w, width)))
        before = canvas[area].copy() if f.disposal == 3 else None
        samples = f.samples[: max(0, height - f.top), : max(0, width - f.left)]
        colour = np.full((*samples.shape, 4), 255, dtype=np.uint8)
        colour[..., :3] = f.palette[np.minimum(samples, len(f.palette) - 1)]
        if f.transparent is None:
            canvas[area] = colour
        else:
            drawn = samples != f.transparent
            canvas[area][drawn] = colour[drawn]
        yield f, canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas[area] = before


LEVELS = 4


def colour_histogram(picture: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by red, green and blue, each in ``LEVELS`` steps."""
    x = picture[..., :3] // np.uint8(256 // LEVELS)
    bins = (x[..., 0] * np.uint8(LEVELS) + x[..., 1]) * np.uint8(LEVELS) + x[..., 2]
    return np.bincount(bins[picture[..., 3] > 0].ravel(), minlength=LEVELS**3)


def shown_histogram(f: Frame, picture: np.ndarray) -> np.ndarray:
    """``colour_histogram`` of what is shown with a frame; of one that covers the canvas, counted by palette entry."""
    if f.transparent is not None or (f.left, f.top) != (0, 0) or f.samples.shape != picture.shape[:2]:
        return colour_histogram(picture)
    n, most = np.bincount(f.samples.ravel(), minlength=256), len(f.palette)
    n[most - 1] += n[most:].sum()
    x = f.palette.astype(np.int64) * LEVELS // 256
    return np.bincount((x[:, 0] * LEVELS + x[:, 1]) * LEVELS + x[:, 2], weights=n[:most], minlength=LEVELS**3).astype(np.int64)


_FRAME = pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
_FRAMES = "array<struct<frame:int,start_cs:bigint,delay_cs:int,width:int,height:int,histogram:array<bigint>>>"


def media_frames(media: DataFrame, *keep: str, column: str = "media") -> DataFrame:
    """``keep``, and what a GIF shows: its timed frames with colour histograms, and digests of its bytes and pictures.

    frames: array of struct<frame, start_cs, delay_cs, width, height,
    histogram>; times are in hundredths of a second. payload_bytes,
    payload_sha256, tail_crc32: the red samples of each frame's area in turn
    (of grey media, the samples). Null, empty or damaged media have ``error``
    and nulls.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        told, plain, hists, counts, errors = [], [], [], [], []
        for data in batch.column(len(keep)).to_pylist():
            own, payload, time, error = [], [], 0, None
            try:
                width, height, frames = decode_gif(data or b"")
                for i, (f, picture) in enumerate(canvases(width, height, frames)):
                    h, w = f.samples.shape
                    payload.append(np.ascontiguousarray(picture[f.top : f.top + h, f.left : f.left + w, 0]).tobytes())
                    own.append((i, time, f.delay, w, h, shown_histogram(f, picture)))
                    time += f.delay
            except GifError as e:
                own, error = [], str(e)
            raw = b"".join(payload)
            told.append((None,) * 5 if error else (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(data), hashlib.sha256(data).hexdigest()))
            errors.append(error)
            plain += [x[:5] for x in own]
            hists += [x[5] for x in own]
            counts.append(None if error else len(own))
        bins = pa.ListArray.from_arrays(pa.array(np.arange(len(hists) + 1, dtype=np.int32) * LEVELS**3), pa.array(np.concatenate(hists) if hists else np.empty(0, np.int64), pa.int64()))
        columns = [pa.array([x[i] for x in plain], _FRAME.field(i).type) for i in range(5)]
        each = pa.StructArray.from_arrays([*columns, bins], fields=list(_FRAME))
        ends = np.cumsum([0, *(c or 0 for c in counts)]).tolist()
        offsets = pa.array([None if i < len(counts) and counts[i] is None else e for i, e in enumerate(ends)], pa.int32())
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        digests = [pa.array([r[i] for r in told], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *digests, pa.ListArray.from_arrays(offsets, each), pa.array(errors, pa.string())], [*keep, *names, "frames", "error"])

    rows = media.select(*keep, F.col(column).alias("media"))
    own = "".join(f"`{x}` {rows.schema[x].dataType.simpleString()}, " for x in keep)
    return map_batches(rows, one, own + f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {_FRAMES}, error string")


def frame_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row a frame: key, frame, start_cs, delay_cs, width, height, histogram, error; one row with ``error`` for damaged media."""
    return media_frames(media, key, column=column).select(key, F.explode_outer("frames").alias("f"), "error").select(key, "f.*", "error")


WIDTH, FRAME_ROWS = 192, 192


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an animated GIF of frames 192 samples wide.

    The UTF-8 bytes are padded with blanks to a positive multiple of 192.
    Null texts count as empty; repeated rows come out once each.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for text in batch.column("text").to_pylist():
            raw = text.encode("utf-8", "surrogatepass")
            padded = raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))
            rows = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
            sizes.append(len(raw))
            media.append(encode_gif([rows[i : i + FRAME_ROWS] for i in range(0, len(rows), FRAME_ROWS)]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, one, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def show_feature(frames: Column) -> Column:
    """Frames, size of the first and show time, then the pixels of each grey step over all frames.

    The steps of a grey picture are the histogram's cells of equal red, green
    and blue.
    """
    first = F.element_at(frames, 1)
    time = F.aggregate(frames, F.lit(0).cast("bigint"), lambda t, f: t + f["delay_cs"])
    counted = lambda at: F.aggregate(frames, F.lit(0).cast("bigint"), lambda n, f: n + f["histogram"][at])
    grey = [counted(k * (LEVELS**2 + LEVELS + 1)).cast("string") for k in range(LEVELS)]
    return F.concat(F.size(frames).cast("string"), F.lit("x"), first["width"].cast("string"), F.lit("x"), first["height"].cast("string"), F.lit("@"), time.cast("string"), F.lit(":"), F.concat_ws(",", *grey))


def store_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, frames) of every row.

    Texts are stored as GIFs, these are read back, and their timed frames are
    stored with colour histograms; the feature is computed from the stored
    frames. Null texts count as empty, repeated rows and null ids come out
    once each, other columns are ignored, an empty table gives an empty one.
    """
    frames = stored(spark, media_frames(stored(spark, text_media(docs), "gif"), "doc_id", "n_bytes"), "gif-frames")
    return frames.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", show_feature(F.col("frames")).alias("feature"), "frames")
