"""Media columns: AVI motion-JPEG in binary columns, read to timed clips (operator 5).

Reading: the RIFF chunks give the headers and the index (`idx1`; without one, the `movi` list is walked), each
video chunk is one JPEG image that decodes on its own. Two JPEG processes are read: lossless (SOF3) with one
8-bit component, and baseline (SOF0) in grey or with chroma, of which the luma samples are kept. Shots are cut
where the difference of neighbouring frames' histograms exceeds mean + `SENSITIVITY` standard deviations of
the last `MEMORY` differences, and a floor; every clip is a row with its times.

Writing: bytes are the samples of 24 x 24 lossless frames. Predicted differences of 8-bit samples have sizes of
0 to 8 bits; with a Huffman code of 9 - s bits for size s, any difference takes 9 bits with its extra bits. The code is
complete but for the all-ones word that JPEG leaves free, and the fixed width lets whole arrays be coded at once.
Other lossless frames are decoded symbol by symbol.

Defined cases of `text_to_avi`: a null text is empty, and an empty text is one frame of bytes 255; the payload is
padded with bytes 255 (never part of UTF-8) to a multiple of 576. Of `clips`: null and broken media give one row
with clip null and an error, as do headers that promise more samples than their data can hold, and no frames give no row; a very long
media value is one unit of work; equal differences at a shot's threshold start none. Repeated rows are handled one by one; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import slices, table

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
SENSITIVITY = 3.0
MEMORY = 16
FLOOR = 0.1
BINS = 16
#: Lists within lists that a reader follows; files in use have three.
NESTED = 16
#: What decoding a broken image can raise.
BROKEN = (ArithmeticError, LookupError, TypeError, ValueError, RecursionError, struct.error)

# --- samples to lossless JPEG frames -----------------------------------------------------------------------------------


def _code_of_difference() -> np.ndarray:
    """The 9-bit word of each difference -255 .. 255: a canonical code of 9 - s bits, then s bits of the value."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1  # ones and a zero, 9 - s bits
        extra = d if d >= 0 else d + (1 << s) - 1
        out[d + 255] = (prefix << s) | extra
    return out


_WORD = _code_of_difference()
_DIFFERENCE = np.zeros(512, np.int16)
_DIFFERENCE[_WORD] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(height: int, width: int) -> bytes:
    """Start, lossless frame of one component, its table (sizes 8 .. 0 with 1 .. 9 bits), and a scan with predictor 1 (left)."""
    frame = struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])
    codes = bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)])
    scan = bytes([1, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + _segment(0xC3, frame) + _segment(0xC4, codes) + _segment(0xDA, scan)


_HEAD, _TAIL = _header(SIDE, SIDE), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of (n, SIDE, SIDE) 8-bit samples."""
    x = samples.astype(np.int16)
    guess = np.empty_like(x)
    guess[:, :, 1:] = x[:, :, :-1]
    guess[:, 1:, 0] = x[:, :-1, 0]
    guess[:, 0, 0] = 128
    words = _WORD[(x - guess + 255).reshape(len(x), -1, 8)]
    packed = np.zeros((len(x), words.shape[1], 9), np.uint16)
    for i in range(8):  # word i starts at bit i of byte i of each group
        packed[:, :, i] |= words[:, :, i] >> (1 + i)
        packed[:, :, i + 1] |= (words[:, :, i] << (7 - i)) & 255
    data = packed.astype(np.uint8).reshape(len(x), -1)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + _TAIL for row in data]


def write_avi(samples: np.ndarray, rate: int = RATE) -> bytes:
    """An AVI file of (n, SIDE, SIDE) samples as motion JPEG with an index."""
    frames = encode_frames(samples)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    headers = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + headers + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


# --- AVI and JPEG reading ---------------------------------------------------------------------------------------------


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the compressed images, in index order."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movi, index = 0.0, None, None

    def walk(at: int, end: int, depth: int = 0) -> None:
        nonlocal rate, movi, index
        if depth > NESTED:
            raise ValueError("lists nest too deep")
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            body = at + 8
            if name == b"LIST" and media[body : body + 4] == b"movi":
                movi = (body, min(body + size, end))
            elif name == b"LIST":
                walk(body + 4, min(body + size, end), depth + 1)
            elif name == b"avih" and not rate:
                micro = struct.unpack_from("<I", media, body)[0]
                rate = 1e6 / micro if micro else 0.0
            elif name == b"strh" and media[body : body + 4] == b"vids":
                scale, per = struct.unpack_from("<2I", media, body + 20)
                rate = per / scale if scale else rate
            elif name == b"idx1":
                index = (body, min(body + size, end))
            at = body + size + size % 2

    walk(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    video = lambda name: name[2:] in (b"dc", b"db")
    frames = []
    if index is not None:
        entries = [(media[i : i + 4], *struct.unpack_from("<3I", media, i + 4)) for i in range(index[0], index[1] - 15, 16)]
        spots = [(at, size) for name, _, at, size in entries if video(name)]
        origin = movi[0] if spots and media[movi[0] + spots[0][0] : movi[0] + spots[0][0] + 4][2:] in (b"dc", b"db") else 0
        frames = [media[origin + at + 8 : origin + at + 8 + size] for at, size in spots]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if video(name):
                frames.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return rate or float(RATE), frames


def _table(body: bytes) -> tuple[dict[tuple[int, int], int], int]:
    """Codes (length, word) -> symbol of one Huffman table, and the bytes it took."""
    counts, symbols = body[1:17], body[17:]
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out, 17 + k


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise ValueError("scan ends early")
        last = (self.at + 7) >> 3
        return (int.from_bytes(self.data[first >> 3 : last], "big") >> (8 * last - self.at)) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def signed(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def decode_jpeg(image: bytes) -> np.ndarray:
    """The (height, width) 8-bit samples of a lossless or baseline image; of a colour image, the luma."""
    at, quant, codes, every, kind = 2, {}, {}, 0, None
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    while True:
        if at + 4 > len(image) or image[at] != 255:
            raise ValueError("no marker where one is due")
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                made, took = _table(body)
                codes[body[0]] = made
                body = body[took:]
        elif marker in (0xC0, 0xC3):
            kind, (_, height, width, n) = marker, struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} is not read")
    if kind is None:
        raise ValueError("no frame header")
    scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    end = image.rfind(b"\xff\xd9")
    data = image[at : end if end >= at else len(image)]
    if not parts or not height or not width or any(not 1 <= f <= 4 for p in parts for f in p[1:3]):
        raise ValueError("no such frame")
    # A sample of a lossless image takes a bit at least, a block of 64 two bits: no header makes room for more than its data can fill.
    if height * width > len(data) * (8 if kind == 0xC3 else 256 * max(p[1] * p[2] for p in parts)):
        raise ValueError("more samples than data")
    if kind == 0xC3:
        return _lossless(data, codes[scan[parts[0][0]] >> 4], height, width, body[1 + 2 * body[0]], n, every)
    return _baseline(data, codes, quant, parts, scan, height, width, every)


def _lossless(data: bytes, codes: dict, height: int, width: int, predictor: int, n: int, every: int) -> np.ndarray:
    if n != 1 or every or not 1 <= predictor <= 7:
        raise ValueError("lossless images have one component and no restarts here")
    bits = _Bits(data.replace(b"\xff\x00", b"\xff"))
    x = np.zeros((height, width), np.int64)
    for r in range(height):
        for c in range(width):
            a, b, d = (int(x[r, c - 1]) if c else 0), (int(x[r - 1, c]) if r else 0), (int(x[r - 1, c - 1]) if r and c else 0)
            if not r and not c:
                guess = 128
            elif not r:
                guess = a
            elif not c:
                guess = b
            else:
                guess = (a, b, d, a + b - d, a + (b - d) // 2, b + (a - d) // 2, (a + b) // 2)[predictor - 1]
            x[r, c] = (guess + bits.signed(bits.symbol(codes))) & 255
    return x.astype(np.uint8)


def _baseline(data: bytes, codes: dict, quant: dict, parts: list, scan: dict, height: int, width: int, every: int) -> np.ndarray:
    tall, wide = max(p[2] for p in parts), max(p[1] for p in parts)
    rows, cols = -(-height // (8 * tall)), -(-width // (8 * wide))
    if len(parts) == 1:
        tall = wide = 1
        rows, cols = -(-height // 8), -(-width // 8)
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    luma = np.zeros((rows * parts[0][2] * 8, cols * parts[0][1] * 8))
    pieces = [data]
    if every:
        pieces, cut, i = [], 0, 0
        while (i := data.find(b"\xff", i)) >= 0:
            if i + 1 < len(data) and 0xD0 <= data[i + 1] <= 0xD7:
                pieces.append(data[cut:i])
                cut = i + 2
            i += 2
        pieces.append(data[cut:])
    done, bits, last = 0, None, [0] * len(parts)
    for unit in range(rows * cols):
        if unit == done:
            bits, last = _Bits(pieces[unit // every if every else 0].replace(b"\xff\x00", b"\xff")), [0] * len(parts)
            done = unit + every if every else -1
        for i, (name, h, v, q) in enumerate(parts):
            dc, ac = codes[scan[name] >> 4], codes[16 + (scan[name] & 15)]
            for part in range(h * v):
                block = np.zeros(64)
                last[i] += bits.signed(bits.symbol(dc))
                block[0], k = last[i], 1
                while k < 64:
                    s = bits.symbol(ac)
                    if not s:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = bits.signed(s & 15)
                    k += 1
                if i == 0:
                    square = np.zeros(64)
                    square[_ZIGZAG] = block * quant[q]
                    y, x = 8 * (unit // cols * v + part // h), 8 * (unit % cols * h + part % h)
                    luma[y : y + 8, x : x + 8] = _DCT.T @ square.reshape(8, 8) @ _DCT + 128
    return np.clip(np.rint(luma[:height, :width]), 0, 255).astype(np.uint8)


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """The samples of each image. Images with this module's header and no other are decoded together."""
    own = [i for i, x in enumerate(images) if x.startswith(_HEAD) and x.endswith(_TAIL)]
    rows = [images[i][len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for i in own]
    own = [i for i, r in zip(own, rows, strict=True) if len(r) == FRAME // 8 * 9]
    out: list = [None] * len(images)
    if own:
        data = np.frombuffer(b"".join(r for r in rows if len(r) == FRAME // 8 * 9), np.uint8).reshape(len(own), -1, 9).astype(np.uint16)
        d = np.empty((len(own), FRAME // 8, 8), np.int16)
        for i in range(8):
            d[:, :, i] = _DIFFERENCE[(((data[:, :, i] << 8) | data[:, :, i + 1]) >> (7 - i)) & 511]
        d = d.reshape(-1, SIDE, SIDE)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        x = np.cumsum(d, axis=2, dtype=np.int64).astype(np.uint8)
        for i, frame in zip(own, x, strict=True):
            out[i] = frame
    return [decode_jpeg(images[i]) if f is None else f for i, f in enumerate(out)]


# --- shots ------------------------------------------------------------------------------------------------------------


def shot_starts(frames: list[np.ndarray]) -> list[int]:
    """The first frame of each shot, by adaptive histogram differences."""
    if not frames:
        return []
    hist = np.stack([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    starts, past = [0], []
    for i, d in enumerate(diff.tolist(), 1):
        recent = past[-MEMORY:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(FLOOR, mean + SENSITIVITY * spread):
            starts.append(i)
            past = []
        else:
            past.append(d)
    return starts


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per clip of each media value: id, clip, first_frame, n_frames, start_s, end_s, brightness, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "clip", "first_frame", "n_frames", "start_s", "end_s", "brightness", "error"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.string()]
        for batch in slices(batches, 1):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, images = read_avi(value or b"")
                    frames = decode_frames(images)
                    starts = shot_starts(frames)
                    ends = [*starts[1:], len(frames)]
                    rows = [(key, i, a, b - a, a / rate, b / rate, float(np.mean([f.mean() for f in frames[a:b]])), None) for i, (a, b) in enumerate(zip(starts, ends, strict=False))]
                except BROKEN as e:
                    rows = [(key, None, None, None, None, None, None, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    slim = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return slim.mapInArrow(run, "id long, clip long, first_frame long, n_frames long, start_s double, end_s double, brightness double, error string")


def text_to_avi(text: str | None) -> tuple[int, bytes]:
    """The unpadded length and the AVI file whose samples are the padded UTF-8 bytes."""
    data = (text or "").encode()
    size = max(FRAME, -(-len(data) // FRAME) * FRAME)
    return len(data), write_avi(np.frombuffer(data.ljust(size, b"\xff"), np.uint8).reshape(-1, SIDE, SIDE))


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id and digests of the payload read back from each text's AVI file, the file's own, and its shots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, media = text_to_avi(text)
                rate, images = read_avi(media)
                frames = decode_frames(images)
                payload = b"".join(f.tobytes() for f in frames)
                starts = shot_starts(frames)
                feature = f"frames={len(frames)};seconds={len(frames) / rate:.2f};mean={np.frombuffer(payload, np.uint8).mean():.3f};shots={','.join(map(str, starts))}"
                rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def encoded_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the AVI file of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            files = [text_to_avi(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed clip rows of the media made of every text."""
    return clips(encoded_media(table(spark, sf_dir, "documents")))
