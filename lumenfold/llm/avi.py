"""Media columns: motion-JPEG in AVI files.

A payload becomes a clip of 24 x 24 grey frames, each a baseline JPEG image.  Baseline JPEG
keeps quantised DCT coefficients without loss, so a payload byte is stored as one nonzero
coefficient in -128..128; a frame has nine blocks of 64 of them.  The Huffman table in each
frame gives a coefficient of s bits a code of 9 - s bits, so that every symbol is 9 bits
wide and a whole clip is packed and unpacked with array arithmetic.  Frames with other
tables, sizes or zero runs go through a general bit-by-bit decoder.

Reading parses the RIFF chunks and the idx1 index, decodes the intra frames to pixels by an
exact integer inverse DCT, and detects shots: a cut lies where the difference of adjacent
histograms is a local maximum, over a floor and over a multiple of the local mean.

Defined results: a null text is the empty text; an empty payload is padded to one frame;
a payload that is not a multiple of 576 bytes is refused; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrow import map_rows
from lumenfold.llm.names import col

SIDE, BLOCK, FRAME = 24, 64, 576
FPS = 25
#: Frames handled at a time, so that what a text becomes on the way is bounded whatever its length.
PART = 2048
# Fixed values of the JPEG standard: positions of coefficients along the zigzag of a block.
ZIGZAG = np.array([
     0,  1,  8, 16,  9,  2,  3, 10, 17, 24, 32, 25, 18, 11,  4,  5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13,  6,  7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def pad_payload(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def _coefficients() -> np.ndarray:
    """Coefficient of each byte value: -128..-1, 1..128."""
    v = np.arange(256) - 128
    return np.where(v < 0, v, v + 1)


def _symbols() -> np.ndarray:
    """The 9-bit symbol of each byte value: Huffman code of the size, then its extra bits."""
    out = np.zeros(256, dtype=np.uint16)
    for b, v in enumerate(_coefficients()):
        s = int(abs(v)).bit_length()
        code = (1 << (9 - s)) - 2  # canonical codes 0, 10, 110, ... for sizes 8, 7, 6, ...
        out[b] = code << s | (v if v > 0 else v - 1 + (1 << s))
    return out


SYMBOL = _symbols()
BYTE = np.full(512, -1, dtype=np.int16)
BYTE[SYMBOL] = np.arange(256)
COEFFICIENT = _coefficients().astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    lengths = bytes([1] * 8 + [0] * 8)
    tables = b"".join(bytes([kind << 4]) + lengths + bytes(range(8, 0, -1)) for kind in (0, 1))
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + _segment(0xC4, tables) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


HEAD = _jpeg_head()


def _scans(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all frames, zero-stuffed, and the length of each frame's."""
    v = SYMBOL[payload].reshape(-1, 8)
    packed = np.empty((len(v), 9), dtype=np.uint8)
    packed[:, 0] = v[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = (v[:, k - 1] << (8 - k)) & 0xFF | v[:, k] >> (k + 1)
    packed[:, 8] = v[:, 7] & 0xFF
    frames = packed.reshape(-1, FRAME * 9 // 8)
    full = frames == 0xFF
    flat = packed.reshape(-1)
    return np.insert(flat, np.flatnonzero(full.reshape(-1)) + 1, 0), frames.shape[1] + full.sum(1)


def _chunks(payload: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The 00dc chunks of some frames, and the size of each frame's image."""
    scan, lengths = _scans(payload)
    n = len(lengths)
    sizes = lengths + len(HEAD) + 2
    starts = np.r_[0, np.cumsum(sizes + (sizes & 1) + 8)]
    movi = np.zeros(int(starts[-1]), dtype=np.uint8)
    head = np.frombuffer(HEAD, dtype=np.uint8)
    movi[(starts[:-1, None] + np.arange(4)).ravel()] = np.tile(np.frombuffer(b"00dc", dtype=np.uint8), n)
    movi[(starts[:-1, None] + 4 + np.arange(4)).ravel()] = sizes.astype("<u4").view(np.uint8)
    movi[(starts[:-1, None] + 8 + np.arange(len(head))).ravel()] = np.tile(head, n)
    first = starts[:-1] + 8 + len(head)
    shift = first - np.r_[0, np.cumsum(lengths)[:-1]]
    movi[np.arange(len(scan)) + np.repeat(shift, lengths)] = scan
    movi[first + lengths], movi[first + lengths + 1] = 0xFF, 0xD9
    return movi.tobytes(), sizes


def write_avi(payload: bytes) -> bytes:
    """An AVI file with one JPEG frame for each 576 bytes of the payload."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    parts, sizes = [], []
    for at in range(0, len(payload), PART * FRAME):
        part, own = _chunks(np.frombuffer(payload, dtype=np.uint8, count=min(PART * FRAME, len(payload) - at), offset=at))
        parts.append(part)
        sizes.append(own)
    sizes = np.concatenate(sizes)
    n = len(sizes)
    starts = np.cumsum(sizes + (sizes & 1) + 8) - (sizes + (sizes & 1) + 8)
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1], index[:, 2], index[:, 3] = 0x10, starts + 4, sizes
    largest = int(sizes.max())
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    lists = lambda kind, body: chunk(b"LIST", kind + body)
    body = lists(b"hdrl", chunk(b"avih", avih) + lists(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    body += lists(b"movi", b"".join(parts)) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


@dataclass(frozen=True)
class Index:
    """Where the frames of an AVI file lie: byte offsets and sizes; and its frame rate."""

    offsets: np.ndarray
    sizes: np.ndarray
    fps: float


def parse_riff(data: bytes) -> Index:
    """Walk the RIFF chunks of an AVI file and read its idx1 index."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    movi, index, fps = None, None, float(FPS)
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif tag == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 20)[0])
        elif tag == b"idx1":
            index = np.frombuffer(data, dtype="<u4", count=size // 16 * 4, offset=at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without movi or idx1")
    rows = index[(index[:, 0] == struct.unpack("<I", b"00dc")[0]) & (index[:, 1] & 0x10 > 0)]
    if not len(rows):
        raise ValueError("an AVI file without key frames")
    offsets = rows[:, 2].astype(np.int64)
    base = movi if data[movi + int(offsets[0]) : movi + int(offsets[0]) + 4] == b"00dc" else 0
    found = Index(offsets + base + 8, rows[:, 3].astype(np.int64), fps)
    if (found.offsets + found.sizes > len(data)).any() or (found.sizes < 4).any():
        raise ValueError("a frame lies outside the file")
    return found


def _read_fast(data: np.ndarray, index: Index) -> np.ndarray | None:
    """Byte values of frames that all have HEAD, or None."""
    if (index.sizes < len(HEAD) + 2).any():
        return None
    heads = data[index.offsets[:, None] + np.arange(len(HEAD))]
    if not (heads == np.frombuffer(HEAD, dtype=np.uint8)).all():
        return None
    lengths = index.sizes - len(HEAD) - 2
    starts = index.offsets + len(HEAD)
    at = np.arange(int(lengths.sum())) + np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    scan = data[at]
    stuffed = np.zeros(len(scan), dtype=bool)
    stuffed[1:] = (scan[:-1] == 0xFF) & (scan[1:] == 0)
    p = scan[~stuffed]
    if len(p) != len(lengths) * FRAME * 9 // 8:
        return None
    p = p.reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(p), 8), dtype=np.uint16)
    for k in range(8):
        v[:, k] = (p[:, k] << (k + 1) | p[:, k + 1] >> (7 - k)) & 0x1FF
    out = BYTE[v.reshape(-1)]
    return None if (out < 0).any() else out.astype(np.uint8).reshape(-1, FRAME)


def decode_jpeg(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks, 64, in zigzag order; the DC as its difference from the block before)
    and quantiser of a grey baseline JPEG image with any tables: the general decoder."""
    try:
        return _decode(image)
    except (IndexError, KeyError, StopIteration, struct.error) as e:
        raise ValueError("a broken image") from e


def _decode(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    tables: dict[int, dict[tuple[int, int], int]] = {}
    quant, at, shape = np.ones(64, dtype=np.int64), 2, None
    while True:
        if image[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = np.frombuffer(body[1:65], dtype=np.uint8).astype(np.int64)
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
            if body[5] != 1:
                raise ValueError("only grey images are decoded")
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                values, code, own = iter(body[17 : 17 + n]), 0, {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        own[length, code] = next(values)
                        code += 1
                    code <<= 1
                tables[body[0] >> 4] = own
                body = body[17 + n :]
        elif marker == 0xDA:
            break
    if shape is None or 0 not in tables or 1 not in tables:
        raise ValueError("a frame or table header is missing")
    bits = np.unpackbits(np.frombuffer(image[at : image.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff"), dtype=np.uint8)).tolist()
    place = 0

    def symbol(table: dict[tuple[int, int], int]) -> int:
        nonlocal place
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits[place]
            place += 1
            if (found := table.get((length, code))) is not None:
                return found
        raise ValueError("a code is not in the table")

    def extra(size: int) -> int:
        nonlocal place
        value = int("0" + "".join(map(str, bits[place : place + size])), 2)
        place += size
        return value if not size or value >> (size - 1) else value + 1 - (1 << size)

    blocks = -(-shape[0] // 8) * -(-shape[1] // 8)
    out = np.zeros((blocks, 64), dtype=np.int64)
    for b in range(blocks):
        out[b, 0] = extra(symbol(tables[0]))
        k = 1
        while k < 64:
            run, size = divmod(symbol(tables[1]), 16)
            if not size and run < 15:
                break
            k += run
            if size:
                out[b, k] = extra(size)
            k += 1
    return out, quant


def _basis() -> np.ndarray:
    """(64 zigzag coefficients, 64 pixels) of the inverse DCT, times 1024, in whole numbers;
    sums of them stay below 2**24, so that float32 products are exact in any order."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)[None, :] / 2
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 1024).astype(np.float32)


BASIS = _basis()


def parts_of(data: bytes, part: int = PART) -> Iterator[tuple[np.ndarray, float]]:
    """Coefficients (frames, 9, 64), with DC differences, of ``part`` frames at a time, and the frame rate."""
    index = parse_riff(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(index.sizes), part):
        own = Index(index.offsets[at : at + part], index.sizes[at : at + part], index.fps)
        got = _read_fast(raw, own)
        if got is not None:
            yield COEFFICIENT[got].reshape(len(got), -1, BLOCK), index.fps
        else:
            yield np.stack([decode_jpeg(data[o : o + s])[0] for o, s in zip(own.offsets, own.sizes, strict=True)]).astype(np.float32), index.fps


def frames_of(data: bytes) -> tuple[np.ndarray, Index]:
    """Coefficients of all frames of an AVI file, and its index."""
    return np.concatenate([c for c, _ in parts_of(data)]), parse_riff(data)


def payload_of(coefficients: np.ndarray) -> bytes:
    v = coefficients.astype(np.int64).reshape(-1)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()


def pixels_of(coefficients: np.ndarray) -> np.ndarray:
    """(frames, 9 * 64) pixels, by block, from coefficients with DC differences."""
    c = coefficients.copy()
    c[:, :, 0] = np.cumsum(c[:, :, 0], axis=1)
    y = c.reshape(-1, BLOCK) @ BASIS
    y += 512
    y *= 1 / 1024
    np.floor(y, out=y)
    y += 128
    return np.clip(y, 0, 255).astype(np.uint8).reshape(len(c), -1)


def histograms(pixels: np.ndarray, bins: int = 16) -> np.ndarray:
    """(frames, bins) counts of pixel values."""
    n = len(pixels)
    which = (pixels >> 4).astype(np.int64) if bins == 16 else pixels.astype(np.int64) * bins >> 8
    return np.bincount((which + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins)


def shots(h: np.ndarray, *, reach: int = 4, ratio: float = 1.5, floor: int = 144) -> list[tuple[int, int]]:
    """(first, last + 1) frames of each shot, by the histograms of the frames.

    The difference of two frames is the sum of absolute differences of their histograms.
    A cut needs one of at least ``floor`` pixels, no larger one within ``reach`` frames
    (the earliest wins a tie), and more than ``ratio`` times the mean of the others there.
    """
    d = np.abs(np.diff(h, axis=0)).sum(1)
    cuts = []
    if len(d):
        wide = np.pad(d, reach)
        near = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
        before, after = near[:, :reach].max(1), near[:, reach + 1 :].max(1)
        others = np.convolve(np.ones(len(d), dtype=np.int64), np.ones(2 * reach + 1, dtype=np.int64))[reach : reach + len(d)] - 1
        high = (d >= floor) & (d > before) & (d >= after) & (d * np.maximum(others, 1) > ratio * (near.sum(1) - d))
        cuts = (np.flatnonzero(high) + 1).tolist()
    edges = [0, *cuts, len(h)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _clips(found: list[tuple[int, int]], fps: float) -> list[tuple[int, int, float, float]]:
    return [(a, b - a, round(a / fps, 3), round(b / fps, 3)) for a, b in found]


def clips_of(data: bytes, **options) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start and end in seconds) of each shot of an AVI file."""
    parts = [(histograms(pixels_of(c)), fps) for c, fps in parts_of(data)]
    return _clips(shots(np.concatenate([h for h, _ in parts]), **options), parts[0][1])


CLIP = "first_frame int, frames int, start_s double, end_s double"


def media_clips(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each clip of a column of AVI files: key, clip, first_frame, frames, start_s, end_s."""

    def make():
        return lambda columns: [[None if data is None else [(k, *c) for k, c in enumerate(clips_of(data))] for data in columns[0]]]

    found = map_rows(media, [column], f"clips array<struct<clip: int, {CLIP}>>", make, keep=[key])
    return found.select(col(key), F.inline("clips"))


def store_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: each text's padded payload as an AVI file."""

    def make():
        return lambda columns: [[write_avi(pad_payload((t or "").encode())) for t in columns[0]]]

    return map_rows(docs, [text], "media binary", make, keep=[key])


def media_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe what was read; ``clips`` has a row for each shot."""

    def one(t: str | None) -> tuple:
        data = (t or "").encode()
        media = write_avi(pad_payload(data))
        digest, size, tail, found, fps = hashlib.sha256(), 0, b"", [], float(FPS)
        for coefficients, fps in parts_of(media):
            payload = payload_of(coefficients)
            digest.update(payload)
            size, tail = size + len(payload), payload[-32:]
            found.append(histograms(pixels_of(coefficients)))
        clips = _clips(shots(np.concatenate(found)), fps)
        feature = f"mjpeg;fps={fps:g};frames={size // FRAME};clips=" + ",".join(f"{a:.2f}-{b:.2f}" for _, _, a, b in clips)
        return len(data), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, len(clips), clips

    def make():
        return lambda columns: [*map(list, zip(*map(one, columns[0]), strict=True))]

    schema = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int, clips array<struct<{CLIP}>>"
    return map_rows(docs, [text], schema, make, keep=[key])
