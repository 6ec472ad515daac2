"""Media columns: baseline JPEG as a container whose DC samples carry bytes.

`encode` writes a grey baseline JPEG with one block for each payload byte: the quantised DC
coefficient is byte - 128 under a DC quantiser of 8, so the DC-only thumbnail of the image is the
payload itself. A row of 192 blocks is one restart interval. `decode` parses the markers,
Huffman-decodes the scans and rebuilds the DC-only luminance thumbnail; intervals are decoded side
by side in numpy. Images with other tables, AC coefficients, several components or no restart
intervals go through `decode_any`, which decodes them block by block.

Null text counts as empty; an empty text is stored as one row of 192 blanks. A text of more than
192 * 8191 bytes takes several images in a row, as a JPEG is at most 65,535 pixels high. Very long
texts are coded and decoded in parts. Equal texts, and so repeated rows, get equal values; an empty table
gives an empty result. Only the key and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, small_batches, table, text_buffers

ROW = 192
MOST_ROWS = 8191
#: Rows that are coded, and stored bytes that are decoded (or one longer image), at a time: a byte takes some 60 in between.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2048, 1 << 19
#: Code lengths of the DC categories 0 to 8; letters and blanks differ mostly by categories 3, 4, 6 and 7.
DC_LENGTHS = (4, 4, 4, 3, 3, 4, 3, 2, 5)


def canonical(lengths_by_symbol: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Symbols' code lengths as a JPEG table: counts of lengths 1 to 16, symbols in order, and code by symbol."""
    order = sorted(lengths_by_symbol, key=lambda s: (lengths_by_symbol[s], s))
    counts = [sum(v == n for v in lengths_by_symbol.values()) for n in range(1, 17)]
    return counts, order, codes(counts, order)


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_DC = canonical(dict(enumerate(DC_LENGTHS)))
_AC = canonical({0: 1})


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All bytes before the entropy-coded data of an image of `rows` rows of 192 blocks."""
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *_DC[0], *_DC[1]]))
        + _segment(0xC4, bytes([0x10, *_AC[0], *_AC[1]]))
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block of DC difference d, at d + 255: DC code, magnitude, end of block."""
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    end, end_size = _AC[2][0]
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = _DC[2][category]
        low = (d if d > 0 else d - 1) & ((1 << category) - 1)
        bits[d + 255] = ((code << category | low) << end_size) | end
        sizes[d + 255] = length + category + end_size
    return bits, sizes


_BITS, _SIZES = _symbols()


def _scans(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of 192, stuffed and without markers, and the rows' bounds in them."""
    lanes = payload.reshape(-1, ROW).astype(np.int32) - 128
    diff = lanes.copy()
    diff[:, 1:] -= lanes[:, :-1]
    diff += 255
    sizes = _SIZES[diff]
    ends = np.cumsum(sizes, axis=1)
    lane_bytes = (ends[:, -1] + 7) >> 3
    at = np.zeros(len(lanes) + 1, np.int64)
    np.cumsum(lane_bytes, out=at[1:])
    place = (ends - sizes + at[:-1, None] * 8).ravel()
    word = (_BITS[diff].ravel().astype(np.uint32)) << (24 - (place & 7) - sizes.ravel()).astype(np.uint32)
    first = place >> 3
    new = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    word, first = np.add.reduceat(word, new), first[new]
    out = np.zeros(at[-1] + 3, np.uint8)
    out[first] += (word >> 16).astype(np.uint8)
    out[first + 1] += (word >> 8 & 255).astype(np.uint8)
    out[first + 2] += (word & 255).astype(np.uint8)
    out = out[: at[-1]]
    spare = lane_bytes * 8 - ends[:, -1]
    out[at[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the unused bits of a row are ones
    full = out == 255
    shift = np.cumsum(full)
    stuffed = np.zeros(len(out) + int(shift[-1]), np.uint8)
    stuffed[np.arange(len(out)) + shift - full] = out
    before = np.r_[0, shift]
    return stuffed, at + before[at]


def encode(raw: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The stored form of each row's bytes."""
    out: list[bytes] = []
    for a, b in pieces(bounds, 1 << 18):
        sizes = bounds[a + 1 : b + 1] - bounds[a:b]
        rows = np.maximum(1, -(-sizes // ROW))
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(rows, out=start[1:])
        payload = np.full(start[-1] * ROW, 32, np.uint8)
        for i in range(b - a):
            payload[start[i] * ROW : start[i] * ROW + sizes[i]] = raw[bounds[a + i] : bounds[a + i + 1]]
        coded = [_scans(payload[k * ROW : (k + ROWS_AT_ONCE) * ROW]) for k in range(0, int(start[-1]), ROWS_AT_ONCE)]
        data = b"".join(x.tobytes() for x, _ in coded)
        at = np.r_[0, np.cumsum(np.concatenate([np.diff(x) for _, x in coded]))]
        for i in range(b - a):
            parts, lane = [], int(start[i])
            while lane < start[i + 1]:
                stop = min(lane + MOST_ROWS, int(start[i + 1]))
                parts.append(header(stop - lane))
                for k in range(lane, stop):
                    parts.append(data[at[k] : at[k + 1]])
                    parts.append(bytes((0xFF, 0xD0 + (k - lane) % 8)) if k + 1 < stop else b"\xff\xd9")
                lane = stop
            out.append(b"".join(parts))
    return out


def parse(data: bytes, at: int = 0) -> dict:
    """Markers of the image that begins at `at`: size, components, tables, restart interval, bounds of its scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image: dict = {"quant": {}, "dc": {}, "ac": {}, "interval": 0}
    at += 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 128 if wide else 64
                image["quant"][body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1 : 1 + step])
                body = body[1 + step :]
        elif marker in (0xC0, 0xC1):
            _, image["height"], image["width"], n = struct.unpack(">BHHB", body[:6])
            image["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            image["interval"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            image["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
    image["start"] = at
    while True:  # the scan ends at the first marker other than a restart
        at = data.index(b"\xff", at)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            break
        at += 2
    image["end"] = at
    return image


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits of a scan: length of a block without AC << 16 | difference + 32768; 0 where there is none."""
    key = (counts, symbols)
    if key not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int64)
        for category, (code, length) in codes(list(counts), list(symbols)).items():
            for low in range(1 << category) if length + category < 16 else ():
                d = low if not category or low >> (category - 1) else low - (1 << category) + 1
                size = length + category + 1
                word = (code << category | low) << 1
                first = word << (16 - size)
                out[first : first + (1 << (16 - size))] = size << 16 | d + 32768
        _LOOKUPS[key] = out
    return _LOOKUPS[key]


def _plain(image: dict) -> bool:
    """Whether an image has grey blocks without AC, in restart intervals of a row."""
    return len(image["parts"]) == 1 and image["interval"] > 0 and image["ac"] == {0: (bytes(_AC[0]), bytes(_AC[1]))} and -(-image["width"] // 8) == image["interval"]


def _lanes(data: np.ndarray, starts: list[int], ends: list[int], rows: list[int], counts: bytes, symbols: bytes, width: int) -> np.ndarray:
    """DC values, one row for each restart interval of the scans data[start:end]."""
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    after = np.r_[0, data[:-1]] == 255
    follows = after & np.r_[False, inside[:-1]] & inside
    marker = follows & (data >= 0xD0) & (data <= 0xD7)
    keep = inside & ~(follows & (data == 0)) & ~marker
    keep[np.flatnonzero(marker) - 1] = False
    kept_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    begins = np.sort(np.r_[np.asarray(starts, np.int64), np.flatnonzero(marker) + 1])
    if len(begins) != sum(rows):
        raise ValueError("restart intervals are missing")
    place = kept_before[begins] * 8
    clean = np.r_[data[keep], np.zeros(4, np.uint8)].astype(np.int32)
    words = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    table_ = _lookup(counts, symbols)
    out = np.empty((width, len(begins)), np.int32)
    for k in range(width):
        found = table_[words[place >> 3] >> (8 - (place & 7)) & 0xFFFF]
        out[k] = (found & 0xFFFF) - 32768
        place += found >> 16
    if not (words.size and (place <= np.r_[kept_before[begins[1:]], len(clean) - 4] * 8).all()):
        raise ValueError("a scan is broken")
    return np.cumsum(out, axis=0, dtype=np.int32, out=out).T


def decode_any(data: bytes, image: dict) -> np.ndarray:
    """DC-only luminance thumbnail of any baseline image, block by block."""
    scan = bytes(data[image["start"] : image["end"]])
    if image["interval"]:
        chunks, last, i = [], 0, 0
        while (i := scan.find(b"\xff", i)) >= 0:
            if 0xD0 <= scan[i + 1] <= 0xD7:
                chunks.append(scan[last:i])
                last = i + 2
            i += 2
        chunks.append(scan[last:])
    else:
        chunks = [scan]
    trees = {(kind, k): {(n, c): s for s, (c, n) in codes(list(t[0]), list(t[1])).items()} for kind in ("dc", "ac") for k, t in image[kind].items()}
    tall, wide = max(p[2] for p in image["parts"]), max(p[1] for p in image["parts"])
    one = len(image["parts"]) == 1
    first = image["parts"][0]
    columns = -(-image["width"] // (8 if one else 8 * wide))
    lines = -(-image["height"] // (8 if one else 8 * tall))
    out = np.zeros((lines * (1 if one else first[2]), columns * (1 if one else first[1])), np.float64)
    step = image["quant"][first[3]][0]
    unit = 0
    for chunk in chunks:
        bits = "".join(f"{x:08b}" for x in chunk.replace(b"\xff\x00", b"\xff"))
        at, past = 0, dict.fromkeys((p[0] for p in image["parts"]), 0)

        def symbol(tree):
            nonlocal at
            n = code = 0
            while n < 16:
                code, n, at = code << 1 | (bits[at] == "1"), n + 1, at + 1
                if (n, code) in tree:
                    return tree[n, code]
            raise ValueError("no such code")

        for _ in range(image["interval"] or lines * columns):
            if unit == lines * columns:
                break
            for part, h, v, _ in image["parts"]:
                dc, ac = image["scan"][part]
                for block in range(1 if one else h * v):
                    size = symbol(trees["dc", dc])
                    low = int(bits[at : at + size] or "0", 2)
                    at += size
                    past[part] += low if not size or low >> (size - 1) else low - (1 << size) + 1
                    k = 1
                    while k < 64:
                        s = symbol(trees["ac", ac])
                        if s == 0:
                            break
                        k += (s >> 4) + 1
                        at += s & 15
                    if part == first[0]:
                        y, x = divmod(block, 1 if one else h)
                        row = unit // columns * (1 if one else v) + y
                        out[row, unit % columns * (1 if one else h) + x] = past[part] * step / 8 + 128
            unit += 1
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only thumbnails of each stored value, one for each of its images."""
    found: list[list] = []
    groups: dict[tuple, list] = {}
    base = 0
    for n, data in enumerate(stored):
        found.append([])
        at = 0
        while at < len(data):
            image = parse(data, at)
            at = image["end"] + 2
            if _plain(image):
                key = (image["dc"][0], image["interval"], image["quant"][image["parts"][0][3]][0])
                groups.setdefault(key, []).append((n, len(found[n]), base + image["start"], base + image["end"], -(-image["height"] // 8)))
                found[n].append(None)
            else:
                found[n].append(decode_any(data, image))
        base += len(data)
    flat = np.frombuffer(b"".join(stored), np.uint8)
    for (dc, width, step), images in groups.items():
        for a, b in pieces(np.array([*(x[2] for x in images), images[-1][3]]), BYTES_AT_ONCE):
            part, low = images[a:b], images[a][2]
            values = _lanes(flat[low : part[-1][3]], [x[2] - low for x in part], [x[3] - low for x in part], [x[4] for x in part], *dc, width)
            pixels = np.clip((values * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
            row = 0
            for n, k, _, _, rows in part:
                found[n][k] = pixels[row : row + rows]
                row += rows
    return found


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 evenly spaced samples is darker than the next in its line."""
    tall, wide = pixels.shape
    grid = pixels[(np.arange(8) * tall) // 8][:, (np.arange(9) * wide) // 9]
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and media (the stored JPEG images) for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, bounds = text_buffers(batch.column(1))
            for a, b in pieces(bounds):
                media = encode(raw, bounds[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(bounds[a : b + 1])), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def media_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back: payload length and hashes, the stored form's, and the feature.

    feature is width x height of each image in pixels and its thumbnail hash.
    """

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x.as_py()) for x in batch.column(2)], np.int64)
            for a, b in pieces(np.r_[0, np.cumsum(sizes)], 1 << 18):
                media = [x.as_py() for x in batch.column(2)[a:b]]
                out = []
                for data, images in zip(media, decode(media), strict=True):
                    payload = b"".join(x.tobytes() for x in images)
                    feature = ";".join(f"{x.shape[1] * 8}x{x.shape[0] * 8}:{thumbnail_hash(x)}" for x in images)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(c) for c in zip(*out, strict=True))], names)

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(key, "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(table(spark, sf_dir, "documents")))
