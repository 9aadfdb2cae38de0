"""GIF images: writing and reading of LZW code streams, palettes, disposal, transparency and timing."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np

CLEAR_AT = 4094
#: Bits of the i-th code after a clear code, for 8-bit samples, and where its bits begin.
_BITS12 = np.arange(12)
_SINGLE = [bytes([i]) for i in range(256)]


def _widths(start: int, n: int) -> np.ndarray:
    """Code widths of the first ``n`` codes after a clear: the table has start + 2 + i - 1 entries before code i."""
    size = np.arange(n) + (1 << start) + 1
    size[:1] = 0
    grown = np.floor(np.log2(np.maximum(size, 1))).astype("int64") + 1
    return np.clip(grown, start + 1, 12)


_W8 = _widths(8, 8192)
_AT8 = np.concatenate([[0], np.cumsum(_W8)])


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as an LZW code stream; the table is cleared when it is full."""
    codes: list[int] = [256]
    cuts = [0]
    emit = codes.append
    table: dict[int, int] = {}
    get = table.get
    following = 258
    prefix = data[0]
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        prefix = byte
        if following < CLEAR_AT:
            table[key] = following
            following += 1
        else:
            emit(256)
            cuts.append(len(codes))
            table.clear()
            following = 258
    emit(prefix)
    emit(257)
    cuts[0] = 1
    value = np.array(codes, "int64")
    width = np.empty(len(codes), "int64")
    width[0] = 9
    for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True):
        width[a:b] = _W8[: b - a]
    out = []
    for i in range(0, len(codes), 1 << 16):  # a bounded number of codes at once; bits carry over in ``rest``
        v, w = value[i : i + (1 << 16)], width[i : i + (1 << 16)]
        out.append(((v[:, None] >> _BITS12) & 1).astype("uint8")[_BITS12 < w[:, None]])
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def lzw_decode(stream: bytes, start: int, most: int) -> bytes:
    """The samples of a code stream with ``start``-bit samples, ``most`` of them at most."""
    raw = np.frombuffer(stream + b"\0\0\0", "uint8").astype("int64")
    triples = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    end_of_bits = len(stream) * 8
    clear, end = 1 << start, (1 << start) + 1
    widths, begins = (_W8, _AT8) if start == 8 else (w := _widths(start, 8192), np.concatenate([[0], np.cumsum(w)]))
    single = _SINGLE[:clear]
    out: list[bytes] = []
    size = at = 0
    done = False
    while not done and at < end_of_bits and size < most:
        table, previous, index = [*single, b"", b""], None, 0
        stop = False
        while not stop:
            if index < 4096:
                w = widths[index : index + 4200]
                place = at + begins[index : index + len(w)] - begins[index]
            else:
                w = np.full(4096, 12)
                place = at + 12 * np.arange(4096)
            fits = place + w <= end_of_bits
            place, w = place[fits], w[fits]
            if not len(place):
                done = stop = True
                break
            codes = triples[place >> 3] >> (place & 7) & ((1 << w) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == end))
            n = int(marks[0]) if len(marks) else len(codes)
            add, put = table.append, out.append
            known = len(table)
            for code in codes[:n].tolist():
                if previous is None:
                    entry = table[code] if code < known else b""
                else:
                    if code < known:
                        entry = table[code]
                    elif code == known:
                        entry = previous + previous[:1]
                    else:
                        raise ValueError("a code beyond the table")
                    if known < 4096:
                        add(previous + entry[:1])
                        known += 1
                put(entry)
                size += len(entry)
                previous = entry
            if len(marks):
                stop, done = True, bool(codes[n] == end)
                at = int(place[n] + w[n])
            else:
                index += len(codes)
                at = int(place[-1] + w[-1])
                if size >= most:
                    stop = True
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


GREY = np.repeat(np.arange(256, dtype="uint8"), 3).tobytes()


def write(frames: Sequence[tuple[bytes, int]], width: int, delay: int = 10, palette: bytes = GREY) -> bytes:
    """A GIF of ``frames`` (8-bit samples, rows) at the left upper corner, each shown for ``delay`` hundredths of a second."""
    height = max(rows for _, rows in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for samples, rows in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, rows, 0) + b"\x08")
        out.append(_blocks(lzw_encode(samples)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """``picture``: the whole canvas (height, width, RGBA) after this frame; the box is the part that it drew."""

    at_ms: int
    for_ms: int
    picture: np.ndarray
    left: int
    top: int
    width: int
    height: int

    def box(self) -> np.ndarray:
        return self.picture[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, bins: int = 16) -> list[int]:
        """Counts of each channel in ``bins`` equal steps, over the drawn box; transparent pixels do not count."""
        shown = self.box()[..., :3][self.box()[..., 3] > 0]
        return np.concatenate([np.bincount(shown[:, c] // (256 // bins), minlength=bins) for c in range(3)]).tolist()


def _rows_in_order(rows: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(rows)
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


class _Ends(Exception):
    """The data stops before the structure does."""


def _part(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise _Ends
    return data[at : at + n]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := _part(data, at, 1)[0]:
        parts.append(_part(data, at + 1, size))
        at += 1 + size
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, bits: int) -> tuple[np.ndarray | None, int]:
    if not bits & 0x80:
        return None, at
    n = 3 << (bits & 7) + 1
    return np.frombuffer(_part(data, at, n), "uint8").reshape(-1, 3), at + n


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as they are shown, one at a time: a frame's picture is the canvas itself, which the next one draws on.

    Data that ends early or has a code beyond its table gives the frames before the break; what is no GIF gives none.
    """
    try:
        yield from _drawn(data)
    except (_Ends, ValueError):
        return


def read(data: bytes) -> list[Frame]:
    """All frames, each with a picture of its own."""
    return [replace(f, picture=f.picture.copy()) for f in frames(data)]


def _drawn(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return
    width, height, flags = struct.unpack("<HHB", _part(data, 6, 5))
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), "uint8")
    disposal, delay, clear_index, clock = 0, 0, -1, 0
    while (kind := _part(data, at, 1)[0]) in (0x21, 0x2C):  # anything else ends the stream
        if kind == 0x21:
            label = _part(data, at + 1, 1)[0]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else -1
            continue
        left, top, w, h, bits = struct.unpack("<HHHHB", _part(data, at + 1, 9))
        own, at = _palette(data, at + 10, bits)
        palette = shared if own is None else own
        start = _part(data, at, 1)[0]
        if not 1 <= start <= 11:
            raise _Ends
        stream, at = _sub_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, start, w * h).ljust(w * h, b"\0"), "uint8").reshape(h, w)
        index = np.empty_like(samples)
        index[_rows_in_order(h, bool(bits & 0x40))] = samples
        before = canvas.copy() if disposal == 3 else None
        w_seen, h_seen = max(0, min(w, width - left)), max(0, min(h, height - top))
        seen = index[:h_seen, :w_seen]
        target = canvas[top : top + h_seen, left : left + w_seen]
        drawn = seen != clear_index
        colours = np.zeros((256, 3), "uint8")
        if palette is not None:
            colours[: len(palette)] = palette
        target[drawn] = np.concatenate([colours[seen[drawn]], np.full((int(drawn.sum()), 1), 255, "uint8")], axis=1)
        yield Frame(clock, delay * 10, canvas, left, top, w_seen, h_seen)
        clock += delay * 10
        if disposal == 2:
            canvas[top : top + h_seen, left : left + w_seen] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1
