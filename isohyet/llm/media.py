"""Baseline JPEG columns: lossless byte storage in DC coefficients, and a DC-only reader.

``store`` writes each payload byte as the DC coefficient of one flat 8x8 block (a DC
quantiser of 8 makes the block's level the byte itself), 64 blocks a row, with a restart
marker after each row. Payloads beyond the height limit of one image become several
images in a row. A comment segment keeps the unpadded length.

``read`` parses markers, Huffman-decodes the scans of general baseline files (any
sampling, tables and restart interval) and keeps the DC luminance of each block, that is
the picture at an eighth of its size. All restart segments of a group of files
are decoded side by side in numpy.

Defined results: null or empty texts are a payload of 64 zero bytes; null media give
null results; files that are not baseline JPEG give null results and an error text;
repeated rows give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.llm.common import small_batches

BLOCKS = 64  # a row, and so a restart interval
MOST_ROWS = 8191  # 65535 picture lines / 8
GROUP_BYTES = 1 << 20

#: Markers of the format (fixed values).
SOI, EOI, SOS, DQT, SOF0, DHT, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC0, 0xC4, 0xDD, 0xFE

#: Twelve DC categories of four bits each; one AC symbol, end of block, of one bit.
DC_BITS, DC_VALUES = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
AC_BITS, AC_VALUES = bytes([1] + [0] * 15), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_LEAD = (
    _segment(DQT, bytes([0, 8] + [1] * 63))
    + _segment(DHT, b"\x00" + DC_BITS + DC_VALUES)
    + _segment(DHT, b"\x10" + AC_BITS + AC_VALUES)
    + _segment(DRI, struct.pack(">H", BLOCKS))
)
_SCAN = _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))


def _scans(samples: np.ndarray, last_row: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows of 64 samples with restart markers; and where each row ends.

    last_row marks rows that end an image and so have no marker behind them. Marker
    numbers are written afterwards, as they count from each image's start.
    """
    v = samples.reshape(-1, BLOCKS).astype(np.int16) - 128
    diff = np.diff(v, axis=1, prepend=np.int16(0))
    size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.uint16)
    low = np.where(diff < 0, diff + (1 << size.astype(np.int32)) - 1, diff).astype(np.uint32)
    length = (size + 5).astype(np.uint16)
    code = ((size.astype(np.uint32) << size) | low) << 1  # category, magnitude, end of block
    pad = (-length.sum(axis=1, dtype=np.int64)) % 8
    code = np.concatenate([code << (16 - length), np.full((len(v), 1), 0xFFFF, np.uint32)], axis=1).astype(">u2")
    length = np.concatenate([length, pad[:, None].astype(np.uint16)], axis=1)
    bits = np.unpackbits(code.view(np.uint8).reshape(len(v), BLOCKS + 1, 2), axis=2)
    packed = np.packbits(bits[np.arange(16) < length[:, :, None]])
    row_end = np.cumsum(length.sum(axis=1, dtype=np.int64) // 8)
    extra = (packed == 0xFF).astype(np.int64)
    at = np.arange(len(packed)) + np.cumsum(extra) - extra
    marks = 2 * (~last_row).astype(np.int64)
    shift = np.cumsum(marks) - marks
    at += np.repeat(shift, np.diff(row_end, prepend=0))
    ends = np.concatenate([at, [0]])[row_end - 1] + extra[row_end - 1] + 1
    out = np.zeros(int(ends[-1] + marks[-1]), np.uint8)
    out[at] = packed
    m = ends[~last_row]
    out[m], out[m + 1] = 0xFF, 0xD0
    return out, ends + marks


def _write(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """One stored form for each payload (a positive multiple of 64 bytes)."""
    rows = np.concatenate([[min(MOST_ROWS, len(p) // BLOCKS - k) for k in range(0, len(p) // BLOCKS, MOST_ROWS)] for p in payloads]).astype(np.int64)
    ends = np.cumsum(rows)
    last = np.zeros(ends[-1], bool)
    last[ends - 1] = True
    scan, at = _scans(np.frombuffer(b"".join(payloads), np.uint8), last)
    number = np.arange(len(last)) - np.repeat(ends - rows, rows)
    scan[at[~last] - 1] = 0xD0 + (number[~last] % 8)
    raw, stops = scan.tobytes(), at[ends - 1]
    out, image = [], 0
    for p, n in zip(payloads, lengths):
        parts = []
        for k in range(-(-len(p) // (BLOCKS * MOST_ROWS))):
            frame = _segment(SOF0, struct.pack(">BHHBBBB", 8, 8 * rows[image], 8 * BLOCKS, 1, 1, 0x11, 0))
            note = _segment(COM, b"bytes=%d" % n) if k == 0 else b""
            parts += [b"\xff\xd8", note, _LEAD, frame, _SCAN, raw[stops[image - 1] if image else 0 : stops[image]], b"\xff\xd9"]
            image += 1
        out.append(b"".join(parts))
    return out


class _Image:
    """What the markers of one picture say, and where its scan lies."""

    def __init__(self) -> None:
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.interval = 0
        self.note = b""


def _parse(data: bytes) -> list[_Image]:
    images, at, image = [], 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
        elif marker == SOI:
            image = _Image()
        elif marker == EOI:
            image = None
        elif image is None:
            raise ValueError("no start of image")
        else:
            size = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + size], at + size
            if size < 2 or len(body) != size - 2:
                raise ValueError("a segment is cut short")
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0]] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == DRI:
                image.interval = int.from_bytes(body, "big")
            elif marker == COM:
                image.note = body
            elif marker == SOF0:
                depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not image.height or not image.width:
                    raise ValueError("not eight bits a sample, or without size")
                image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == SOS:
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if not hasattr(image, "parts") or chosen.keys() != {p[0] for p in image.parts}:
                    raise ValueError("scans of single components are not read")
                image.chosen = chosen
                image.start = at
                while True:
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= len(data):
                        raise ValueError("no end of image")
                    if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                        at += 2
                    else:
                        break
                image.stop = at
                images.append(image)
    if not images:
        raise ValueError("no image")
    return images


def _lookup(bits: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16 bits that a code may start; length 0: no code."""
    size, symbol, at, n = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            span = 1 << (16 - length)
            size[at : at + span], symbol[at : at + span] = length, values[n]
            at, n = at + span, n + 1
    return size, symbol


_looked: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def _decode(blobs: list[bytes], images: list[tuple[int, _Image]]) -> list[np.ndarray]:
    """Luminance planes at an eighth of the size; images: (blob's number, its image)."""
    table_ids: dict[tuple[bytes, bytes], int] = {}
    layouts: dict[tuple, int] = {}
    image_rows, raw = [], []
    for n, im in images:
        first = im.parts[0]
        most_h, most_v = max(p[1] for p in im.parts), max(p[2] for p in im.parts)
        blocks = []
        for name, h, v, _ in im.parts if len(im.parts) > 1 else [(first[0], 1, 1, 0)]:
            dc, ac = im.chosen[name] >> 4, im.chosen[name] & 15
            t = [table_ids.setdefault(im.tables[k], len(table_ids)) for k in (dc, 16 + ac)]
            blocks += [(list(im.chosen).index(name), *t, x, y) for y in range(v) for x in range(h)]
        h, v = (first[1], first[2]) if len(im.parts) > 1 else (1, 1)
        if len(im.parts) == 1:
            most_h = most_v = 1
        mcus_x, mcus_y = -(-im.width // (8 * most_h)), -(-im.height // (8 * most_v))
        lay = layouts.setdefault(tuple(blocks), len(layouts))
        image_rows.append((lay, len(blocks), mcus_x, mcus_y, h, v, im.interval or mcus_x * mcus_y, im.quant[first[3]]))
        raw.append(blobs[n][im.start : im.stop])
    lay, per, mx, my, h, v, interval, quant = np.array(image_rows, np.int64).T
    deep = max(map(len, layouts))
    layout = np.zeros((len(layouts), deep, 5), np.int64)
    for blocks, k in layouts.items():
        layout[k, : len(blocks)] = blocks
    for t in table_ids:
        if t not in _looked:
            if len(_looked) > 64:
                _looked.clear()
            _looked[t] = _lookup(*t)
    sizes, symbols = (np.concatenate([_looked[t][k] for t in table_ids]) for k in (0, 1))

    data = np.frombuffer(b"".join(raw) + bytes(2), np.uint8)
    scan_end = np.cumsum([len(r) for r in raw])
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    keep = np.ones(len(data) - 2, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    starts = np.sort(np.concatenate([scan_end - np.array([len(r) for r in raw]), marks + 2]))
    seg_image = np.searchsorted(scan_end, starts, "right")
    seg_number = np.arange(len(starts)) - np.searchsorted(seg_image, seg_image)
    stream = np.concatenate([data[:-2][keep], np.full(16, 0xFF, np.uint8)]).tobytes()
    window = np.ndarray((len(stream) - 8,), ">u8", stream, strides=(1,))

    stride = mx * h
    base = np.concatenate([[0], np.cumsum(stride * my * v)])
    planes = np.zeros(base[-1], np.int64)
    pos = place[starts] * 8
    mcu = seg_number * interval[seg_image]
    stop = np.minimum(mcu + interval[seg_image], (mx * my)[seg_image])
    live = np.flatnonzero(mcu < stop)
    pos, mcu, stop, im = pos[live], mcu[live], stop[live], seg_image[live]
    block, coefficient = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    predicted = np.zeros((len(live), 4), np.int64)
    limit = 8 * len(stream) - 64
    while len(pos):
        win = window[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        part, dc, ac, dx, dy = layout[lay[im], block].T
        opening = coefficient == 0
        code = (dc << 16) + (win >> np.uint64(48)).astype(np.int64)
        used = np.where(opening, sizes[code], 0).astype(np.uint64)
        size = np.where(opening, symbols[code], 0).astype(np.uint64)
        if (opening & (used == 0)).any() or (size > 11).any():
            raise ValueError("no such code in a scan")
        win <<= used
        low = ((win >> np.uint64(1)) >> (np.uint64(63) - size)).astype(np.int64)
        win <<= size
        whole = np.int64(1) << size.astype(np.int64)
        diff = np.where(2 * low < whole, low - whole + 1, low)
        own = np.arange(len(pos))
        predicted[own, part] += diff
        lum = opening & (part == 0)
        of, m = im[lum], mcu[lum]
        planes[base[of] + (m // mx[of] * v[of] + dy[lum]) * stride[of] + m % mx[of] * h[of] + dx[lum]] = predicted[lum, 0]
        coefficient = np.where(opening, 1, coefficient)
        code = (ac << 16) + (win >> np.uint64(48)).astype(np.int64)
        length, symbol = sizes[code].astype(np.int64), symbols[code].astype(np.int64)
        if (length == 0).any():
            raise ValueError("no such code in a scan")
        pos = pos + used.astype(np.int64) + size.astype(np.int64) + length + (symbol & 15)
        coefficient += (symbol >> 4) + 1
        done = (symbol == 0) | (coefficient > 63)
        block += done
        coefficient[done] = 0
        full = block == per[im]
        mcu += full
        block[full] = 0
        if (pos > limit).any():
            raise ValueError("a scan ends early")
        if full.any() and (over := mcu >= stop).any():
            stay = ~over
            pos, mcu, stop, im, block, coefficient, predicted = (x[stay] for x in (pos, mcu, stop, im, block, coefficient, predicted))
    out = []
    for k, (_, i) in enumerate(images):
        plane = planes[base[k] : base[k + 1]].reshape(-1, stride[k]) * quant[k]
        lines, width = -(-i.height * v[k] // (8 * max(p[2] for p in i.parts))) if len(i.parts) > 1 else -(-i.height // 8), -(-i.width * h[k] // (8 * max(p[1] for p in i.parts))) if len(i.parts) > 1 else -(-i.width // 8)
        out.append(np.clip((plane[:lines, :width] + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(plane: np.ndarray) -> str:
    """64 bits, as 16 hex digits: which of 8x8 bands is brighter than their mean."""
    rows, columns = (np.arange(8) * n // 8 for n in plane.shape)
    total = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), rows, 0), columns, 1)
    area = np.diff(np.append(rows, plane.shape[0])).clip(1)[:, None] * np.diff(np.append(columns, plane.shape[1])).clip(1)
    mean = total / area
    return np.packbits(mean > mean.mean()).tobytes().hex()


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for hi, n in enumerate(sizes):
        if hi > lo and total + n > GROUP_BYTES:
            yield lo, hi
            lo, total = hi, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): every whole text, in UTF-8 and zero-padded to 64 bytes, as baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            for lo, hi in _groups([len(r) for r in raw]):
                some = raw[lo:hi]
                media = _write([r.ljust(max(1, -(-len(r) // BLOCKS)) * BLOCKS, b"\0") for r in some], [len(r) for r in some])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(media, pa.binary())], names=["id", "media"])

    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def _read(blobs: list[bytes | None]) -> list[dict]:
    """What read() returns of each blob, decoded together."""
    found, images = [{} for _ in blobs], []
    for n, blob in enumerate(blobs):
        try:
            if blob is not None:
                images += [(n, im) for im in _parse(blob)]
        except (ValueError, IndexError, KeyError, struct.error) as e:
            found[n]["error"] = str(e) or "cut short"
    try:
        planes = _decode(blobs, images) if images else []
    except (ValueError, KeyError, IndexError) as e:
        if len(blobs) > 1:
            return [_read([b])[0] for b in blobs]
        return [{"error": str(e)}]
    for (n, im), plane in zip(images, planes):
        x = found[n]
        x.setdefault("planes", []).append(plane)
        if im.note.startswith(b"bytes=") and im.note[6:].isdigit():
            x["n_bytes"] = int(im.note[6:])
        x.setdefault("width", im.width)
        x["height"] = x.get("height", 0) + im.height
    for x in found:
        if planes := x.pop("planes", None):
            x["pixels"] = b"".join(p.tobytes() for p in planes)
            x["thumbnail_hash"] = thumbnail_hash(np.concatenate(planes) if len({p.shape[1] for p in planes}) == 1 else planes[0])
    return found


READ = "width int, height int, n_bytes long, pixels binary, thumbnail_hash string, error string"


def read(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, media, width, height, n_bytes, pixels, thumbnail_hash, error) of JPEG columns.

    pixels: the DC-only luminance thumbnail, row by row, images of one blob in a row.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            for lo, hi in _groups([len(x or b"") for x in blobs]):
                got = _read(blobs[lo:hi])
                columns = [pa.array([x.get(n) for x in got], k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *columns], names=["id", "media", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return small_batches(df).select(id_col, media_col).mapInArrow(run, f"id {kind}, media binary, {READ}").withColumnRenamed("id", id_col)
