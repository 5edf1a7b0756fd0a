"""Media columns for GIF: files to timed frames with colour histograms, and samples to files.

Reading follows the public format: LZW code streams are unpacked and resolved, palettes are applied, interlaced rows are put in order,
and each frame is drawn onto the canvas under the transparency and disposal rules (0 and 1 leave it, 2 clears the frame's rectangle, 3
brings back what was there). A code of an LZW stream stands for a stretch of what was written before, so a stream is resolved with
arrays: the lengths of all codes first, then all bytes, by following references in steps that double.

Defined cases: null content has null frames and the error "null", and null samples have null content; very long samples become many
frames, and a large file is worked on in a slice of its own; bytes that are no GIF, or that break off, give the frames before the fault
and say so in `error`; a frame outside the canvas is cut at its border; a GIF without frames has none; pixels that no frame has drawn are
transparent; repeated rows are decoded one by one, and ties don't arise; an empty table gives an empty result; other columns are carried
along and never read (one with the name of a column to be made goes on as {name}_in).
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import aside, fresh
from riskweave.llm.pretokens import slices

_BLOCK = 2 << 20
_FULL = 4096  # codes have 12 bits at most
FRAME = "delay_ms int, disposal int, mode string, left int, top int, width int, height int, pixels binary, histogram array<long>"
_LEFT = "struct<delay_ms:int,disposal:int,mode:string,left:int,top:int,width:int,height:int,pixels:binary,histogram:array<bigint>>"


@lru_cache(maxsize=8)
def _widths(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, for sample sizes of `least` bits, and where each begins."""
    first = (1 << least) + 2
    entries = first + np.maximum(np.arange(_FULL + 1) - 1, 0)
    width = np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, least + 1, 12)
    return width, np.append(0, np.cumsum(width))


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """The code stream of samples below 2^least."""
    clear, end = 1 << least, (1 << least) + 1
    first = end + 1
    most = _FULL - first  # codes after a clear code until the table is full
    codes: list[int] = []
    cuts = [0]  # where a clear code stands in codes
    codes.append(clear)
    if samples:
        known: dict[int, int] = {}
        get, put = known.get, codes.append
        new, whole = first, samples[0]
        for c in memoryview(samples)[1:]:
            key = whole << 8 | c
            longer = get(key)
            if longer is None:
                put(whole)
                known[key] = new
                new += 1
                whole = c
                if new == _FULL:
                    cuts.append(len(codes))
                    put(clear)
                    known.clear()
                    new = first
            else:
                whole = longer
        put(whole)
    codes.append(end)
    width, _ = _widths(least)
    value = np.array(codes, np.uint32)
    at = np.arange(len(codes)) - np.repeat(cuts, np.diff([*cuts, len(codes)])) - 1
    bits = width[np.minimum(at, most + 1)]
    # A clear code is read in the width that the codes before it have come to.
    for k, c in enumerate(cuts):
        bits[c] = width[min(c - cuts[k - 1] - 1, most + 1)] if k else least + 1
    begin = np.cumsum(bits) - bits
    total = int(begin[-1] + bits[-1])
    out = np.zeros(total // 8 + 4, np.uint8)
    shifted = value << (begin & 7).astype(np.uint32)
    first_byte = begin >> 3
    for j in range(3):  # a code reaches into three bytes at most; those of two codes share no bits
        part = (shifted >> np.uint32(8 * j)).astype(np.uint8)
        if least >= 7:  # codes of 8 bits and more begin in bytes of their own
            out[first_byte + j] |= part
        else:
            np.bitwise_or.at(out, first_byte + j, part)
    return out[: (total + 7) // 8].tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> tuple[np.ndarray, bool]:
    """Up to `most` samples of a code stream, and whether it is whole: it ends with its end code, or has all samples."""
    clear, end = 1 << least, (1 << least) + 1
    first = end + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    width, offset = _widths(least)
    bit, bits, parts, got = 0, 8 * len(stream), [], 0
    while got < most:
        room = 4096
        while True:
            places = bit + (offset[:room] if room <= 4096 else np.append(offset[:4096], offset[4096] + 12 * np.arange(room - 4096)))
            sizes = width[np.minimum(np.arange(room), _FULL)]
            fits = int(np.searchsorted(places + sizes, bits, side="right"))
            p = places[:fits]
            byte = p >> 3
            codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (p & 7).astype(np.uint32)
            codes = (codes & ((1 << sizes[:fits]) - 1).astype(np.uint32)).astype(np.int64)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or fits < room:
                break
            room *= 2  # the table is full and no clear code has come
        n = int(stops[0]) if len(stops) else fits
        if n:
            own = codes[:n]
            entry = own - first  # the entry's number; entry j is code j's string and one more byte
            bad = np.flatnonzero((entry >= np.arange(n)) & (own >= first))
            broken = len(bad) > 0
            if broken:
                n = int(bad[0])
                own, entry = own[:n], entry[:n]
            size = np.ones(n, np.int64)
            refers = own >= first
            size[refers] = 0
            parent = np.where(refers, entry, -1)
            size = np.where(refers, 1, 1)
            jump = parent.copy()
            while (live := jump >= 0).any():
                size = size + np.where(live, size[jump], 0)
                jump = np.where(live, jump[jump], -1)
            begin = np.append(0, np.cumsum(size))
            if begin[-1] > 4 * (most - got) + 4 * _FULL:  # far more than the frame holds
                n = int(np.searchsorted(begin, most - got)) + 1
                own, size, parent, begin = own[:n], size[:n], parent[:n], begin[: n + 1]
            total = int(begin[-1])
            back = np.where(parent >= 0, begin[:-1] - begin[np.maximum(parent, 0)], 0)
            source = np.arange(total, dtype=np.int32) - np.repeat(back.astype(np.int32), size)
            while True:
                further = source[source]
                if np.array_equal(further, source):
                    break
                source = further
            literal = np.zeros(total, np.uint8)
            alone = own < clear
            literal[begin[:-1][alone]] = own[alone]
            parts.append(literal[source])
            got += total
            if broken:
                return np.concatenate(parts)[:most], got >= most
        if not len(stops):
            break
        at = int(stops[0])
        bit += int(places[at] - bit + sizes[at])
        if codes[at] == end:
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint8))[:most], True
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8))[:most], got >= most


def _interlaced(height: int) -> np.ndarray:
    """The rows of an interlaced frame in the order that they are stored in."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _palette(data: bytes, at: int, size: int) -> np.ndarray:
    out = np.zeros((256, 3), np.uint8)
    part = np.frombuffer(data[at : at + 3 * size], np.uint8)
    out[: len(part) // 3] = part[: len(part) // 3 * 3].reshape(-1, 3)
    return out


def _frame(canvas: np.ndarray, delay: int, disposal: int, box: tuple[int, int, int, int]) -> dict:
    """The canvas as it is shown, in as few channels as hold it, with a histogram of 4 x 4 x 4 colours."""
    flat = canvas.reshape(-1, 4)
    red, green, blue, alpha = (flat[:, i] for i in range(4))
    opaque = bool((alpha == 255).all())
    grey = opaque and np.array_equal(red, green) and np.array_equal(red, blue)
    if grey:
        levels = np.bincount(red >> 6, minlength=4)
        histogram = np.zeros(64, np.int64)
        histogram[[0, 21, 42, 63]] = levels
    else:
        shown = flat[alpha == 255] >> 6
        histogram = np.bincount((shown[:, 0].astype(np.int64) << 4) | (shown[:, 1] << 2) | shown[:, 2], minlength=64)
    pixels = red.tobytes() if grey else (flat[:, :3] if opaque else flat).tobytes()
    left, top, width, height = box
    return {"delay_ms": delay, "disposal": disposal, "mode": "L" if grey else "RGB" if opaque else "RGBA", "left": left, "top": top, "width": width, "height": height, "pixels": pixels, "histogram": histogram.tolist()}


def read_gif(data: bytes) -> tuple[tuple[int, int], list[dict], str | None]:
    """Canvas size, frames as shown, and what is wrong with the file (None: nothing)."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return (0, 0), [], "no GIF"
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        palette, at = _palette(data, at, size), at + 3 * size
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[dict] = []
    delay, disposal, transparent = 0, 0, -1

    def joined(at: int) -> tuple[bytes, int]:
        """Sub-blocks end to end, and where they end."""
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        return b"".join(out), at + 1

    try:
        while True:
            kind = data[at]
            if kind == 0x3B:
                return (width, height), frames, None
            if kind == 0x21:
                label = data[at + 1]
                body, at = joined(at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack_from("<H", body, 1)[0]
                    transparent = body[3] if body[0] & 1 else -1
                continue
            if kind != 0x2C:
                return (width, height), frames, "unknown block"
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, palette
            if flags & 0x80:
                size = 2 << (flags & 7)
                colours, at = _palette(data, at, size), at + 3 * size
            least = data[at]
            body, at = joined(at + 1)
            if colours is None or not 2 <= least <= 8:
                return (width, height), frames, "no palette" if colours is None else "bad code size"
            samples, whole = lzw_decode(body, least, w * h)
            if not whole or len(samples) < w * h:
                return (width, height), frames, "short frame"
            rows = samples.reshape(h, w)
            if flags & 0x40:
                ordered = np.empty_like(rows)
                ordered[_interlaced(h)] = rows
                rows = ordered
            before = canvas.copy() if disposal == 3 else None
            shown = rows[: max(0, height - top), : max(0, width - left)]
            box = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
            if transparent < 0:
                box[..., :3] = colours[shown]
                box[..., 3] = 255
            else:
                drawn = shown != transparent
                box[drawn, :3] = colours[shown[drawn]]
                box[drawn, 3] = 255
            frames.append(_frame(canvas, delay, disposal, (left, top, shown.shape[1], shown.shape[0])))
            if disposal == 2:
                box[...] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
    except (IndexError, struct.error):
        return (width, height), frames, "breaks off"


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def write_gif(samples: bytes, width: int = 64, rows: int = 1024, delay: int = 10) -> bytes:
    """Grey samples (a multiple of width) as frames of up to `rows` rows. Every frame has all the canvas but the last, which has its top."""
    height = min(rows, max(1, len(samples) // width))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    step = width * rows
    for i in range(0, len(samples), step):
        part = samples[i : i + step]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def encode(df: DataFrame, samples_col: str, media_col: str = "media", width: int = 64, rows: int = 1024, keep: bool = True) -> DataFrame:
    """df with 8-bit samples (binary, a multiple of width) stored as GIF files of grey frames; without the samples if they are not to be kept."""
    df = aside(df, media_col) if samples_col.lower() != media_col.lower() else df
    new = fresh(df, media_col)[0]
    at = df.columns.index(samples_col)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, at, _BLOCK):
            media = [None if s is None else write_gif(s, width, rows) for s in part.column(at).to_pylist()]
            own = [i for i in range(part.num_columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), pa.array(media, pa.binary())], names=[*(part.schema.names[i] for i in own), new])

    keep = keep and samples_col.lower() != media_col.lower()
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for i, f in enumerate(df.schema.fields) if keep or i != at)
    return df.mapInArrow(run, f"{kinds}`{new}` binary").withColumnRenamed(new, media_col)


def decode(df: DataFrame, media_col: str = "media", frames_col: str = "frames", error_col: str = "error", width_col: str = "canvas_width") -> DataFrame:
    """df with the frames of GIF files (see FRAME: pixels of the whole canvas, and the rectangle that the frame has drawn), the canvas's
    width, and what is wrong with a file."""
    df = aside(df, frames_col, error_col, width_col)
    names = fresh(df, frames_col, error_col, width_col)
    at = df.columns.index(media_col)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("delay_ms", pa.int32()), ("disposal", pa.int32()), ("mode", pa.string()), *((c, pa.int32()) for c in ("left", "top", "width", "height")), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]))
        for part in slices(batches, at, _BLOCK):
            found = [((None, None), None, "null") if m is None else read_gif(m) for m in part.column(at).to_pylist()]
            columns = [pa.array([f for _, f, _ in found], kind), pa.array([e for _, _, e in found], pa.string()), pa.array([s[0] for s, _, _ in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.mapInArrow(run, f"{kinds}, `{names[0]}` array<{_LEFT}>, `{names[1]}` string, `{names[2]}` int")
    return out.withColumnsRenamed(dict(zip(names, (frames_col, error_col, width_col), strict=True)))


def grey_samples(frames: Column, canvas_width: Column) -> Column:
    """The samples of grey frames that take whole rows: each frame's own rows, end to end."""
    own = F.transform(frames, lambda f: F.substring(f["pixels"], f["top"] * canvas_width + 1, f["height"] * canvas_width))
    return F.when(F.size(own) == 1, own[0]).otherwise(F.unhex(F.array_join(F.transform(own, F.hex), "")))  # joined once, not frame by frame


def padded(text: Column, unit: int = 64) -> Column:
    """UTF-8 bytes of a text (null: none) and zero bytes up to a positive multiple of unit."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(raw)
    return F.rpad(raw, F.greatest(F.ceil(n / unit) * unit, F.lit(unit)).cast("int"), F.lit(b"\0"))


def described(frames: Column) -> Column:
    """A line of text for frames: size, delay and colour histogram of each."""
    one = lambda f: F.concat_ws(" ", f["mode"], F.concat_ws("x", f["width"].cast("string"), f["height"].cast("string")), F.concat(f["delay_ms"].cast("string"), F.lit("ms")), F.array_join(F.transform(f["histogram"], lambda n: n.cast("string")), ","))
    return F.array_join(F.transform(frames, one), ";")
