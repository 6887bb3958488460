"""Media columns: baseline JPEG, written and read here.

``encode`` stores bytes losslessly as quantised coefficients, the unit of a baseline scan: byte k of a 64-byte unit is coefficient k (in
zigzag order) of one block. Byte 0 is coefficient 0; bytes that texts often have are the small ones, so that they take few bits. Each block
is a restart interval. A comment holds the number of units. ``decode`` reads any baseline stream: it parses the markers, undoes byte stuffing, and decodes all restart intervals of a batch side by
side, one Huffman symbol of each at a time. DC coefficients alone give a luminance thumbnail of one pixel a block.

Null text is empty; an empty text is one unit of zeros. Equal texts give equal media. Other columns play no part, equal rows give
equal rows, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import blocks, raw, ship, written

UNIT = 64
WIDEST = 8191  # blocks; 65,535 pixels at most
_NOTE = b"units="
#: Blocks that are encoded at a time.
_AT_A_TIME = 2048


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Bytes by how common they are in texts; the others follow in their order.
_COMMON = b" eanisrtodlucmp\xc3hgbvf.,qzykjxw"
_RANKED = [*_COMMON, *(b for b in range(1, 256) if b not in _COMMON)]
#: Code lengths of sizes 0 to 8: of DC differences, and of AC coefficients without zeros before them (0: the rest is zeros).
_DC_LENGTHS = (8, 2, 2, 2, 3, 5, 6, 7, 8)
_AC_LENGTHS = (5, 2, 2, 2, 3, 5, 6, 7, 8)
#: Code length of AC coefficients after zeros, and of 16 zeros.
_RARE_LENGTH = 12


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, and the byte of each coefficient + 128: the more common, the smaller."""
    of = np.zeros(256, np.int64)
    for j, byte in enumerate(_RANKED):
        of[byte] = (j // 2 + 1) * (1 if j % 2 == 0 else -1)
    back = np.zeros(257, np.uint8)
    back[of + 128] = np.arange(256)
    return of, back


def _codes(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, int]]:
    """A Huffman table as a segment has it: counts of code lengths and symbols; and each symbol's code."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == size for n in lengths.values()) for size in range(1, 17))
    codes, code, size = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s] = code
        code += 1
    return counts, bytes(symbols), codes


_OF_BYTE, _BYTE_OF = _coefficients()
_DC_OF = dict(enumerate(_DC_LENGTHS))
_AC_OF = {s: n for s, n in enumerate(_AC_LENGTHS)} | {run << 4 | s: _RARE_LENGTH for run in range(1, 16) for s in range(1, 9)} | {0xF0: _RARE_LENGTH}
_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = _codes(_DC_OF)
_AC_COUNTS, _AC_SYMBOLS, _AC_CODES = _codes(_AC_OF)
#: The table of streams without zeros before other coefficients: the codes are the same.
_SHORT_COUNTS, _SHORT_SYMBOLS, _ = _codes({s: n for s, n in _AC_OF.items() if n < _RARE_LENGTH})


def _table(of: dict[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(of)] = list(of.values())
    return out


_DC_CODE, _DC_SIZE, _AC_CODE, _AC_SIZE = _table(_DC_CODES), _table(_DC_OF), _table(_AC_CODES), _table(_AC_OF)


def _scans(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded blocks (rows of 64 coefficients), a marker behind each; where each ends, and whether it has zeros before others."""
    total = len(coefficients)
    size = np.frexp(np.abs(coefficients))[1].astype(np.int64)
    extra = np.where(coefficients < 0, coefficients + (1 << size) - 1, coefficients)
    value, length = np.zeros((total, UNIT + 1), np.int64), np.zeros((total, UNIT + 1), np.int64)
    there = size > 0
    there[:, 0] = True  # zeros are counted from behind the DC coefficient
    last = UNIT - 1 - np.argmax(there[:, ::-1], axis=1)
    zeros = (~there & (np.arange(UNIT) < last[:, None])).any(axis=1)
    value[:, 1:UNIT] = _AC_CODE[size[:, 1:]] << size[:, 1:] | extra[:, 1:]
    length[:, 1:UNIT] = np.where(there[:, 1:], _AC_SIZE[size[:, 1:]] + size[:, 1:], 0)
    value[:, 0], length[:, 0] = _DC_CODE[size[:, 0]] << size[:, 0] | extra[:, 0], _DC_SIZE[size[:, 0]] + size[:, 0]
    for u in np.flatnonzero(zeros).tolist():
        ac = np.flatnonzero(there[u, 1:]) + 1
        run = np.diff(ac, prepend=0) - 1
        for k, r in zip(ac[run > 0].tolist(), run[run > 0].tolist(), strict=True):
            n = int(size[u, k])
            symbol = (r & 15) << 4 | n
            value[u, k], length[u, k] = int(_AC_CODE[symbol]) << n | int(extra[u, k]), int(_AC_SIZE[symbol]) + n
            for _ in range(r >> 4):  # 16 zeros each
                value[u, k] |= _AC_CODES[0xF0] << int(length[u, k])
                length[u, k] += _RARE_LENGTH
    ends = last < UNIT - 1
    value[:, UNIT], length[:, UNIT] = _AC_CODES[0], np.where(ends, _AC_OF[0], 0)

    n_bytes = -(-length.sum(axis=1) // 8)
    after = np.cumsum(n_bytes)
    first = after - n_bytes
    until = (np.cumsum(length, axis=1) + first[:, None] * 8).reshape(-1)
    value, length = value.reshape(-1), length.reshape(-1)
    bits = np.ones(int(after[-1]) * 8 + 1, np.uint8)  # one more, for what isn't there
    short = np.minimum(length, 6)
    for k in range(6):  # the k-th bit of each code from behind
        bits[np.where(short > k, until - 1 - k, -1)] = value >> k & 1
    long = np.flatnonzero(length > 6)
    value, length, until = value[long] >> 6, length[long] - 6, until[long] - 6
    while len(value):
        bits[until - 1] = value & 1
        more = length > 1
        value, length, until = value[more] >> 1, length[more] - 1, until[more] - 1
    data = np.packbits(bits[:-1])
    stuffed = data == 0xFF
    place = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(total), n_bytes)
    out = np.zeros(len(data) + int(stuffed.sum()) + 2 * total, np.uint8)
    out[place] = data
    behind = place[after - 1] + 1 + stuffed[after - 1]
    out[behind] = 0xFF
    return out, behind, zeros


def encode(payloads: list[bytes]) -> list[bytes]:
    """For each payload, a positive multiple of 64 bytes, a grey baseline JPEG whose coefficients are its bytes."""
    units = np.array([len(p) // UNIT for p in payloads])
    wide = np.array([min(WIDEST, math.isqrt(n - 1) + 1) for n in units.tolist()])
    high = -(-units // wide)
    if (high > WIDEST).any():
        raise ValueError("payload is larger than an image can be")
    until = np.cumsum(wide * high)
    data = np.frombuffer(b"".join(p + bytes(UNIT * (n - len(p) // UNIT)) for p, n in zip(payloads, (wide * high).tolist(), strict=True)), np.uint8).reshape(-1, UNIT)
    parts, zeros = [], []
    for a in range(0, len(data), _AT_A_TIME):
        out, behind, some = _scans(_OF_BYTE[data[a : a + _AT_A_TIME]])
        nth = np.arange(a, a + len(behind))
        out[behind + 1] = 0xD0 + (nth - np.repeat(until - wide * high, wide * high)[nth]) % 8
        parts.append((out, behind + 2))
        zeros.append(some)
    scans = b"".join(out.tobytes() for out, _ in parts)
    starts = np.cumsum([0, *(len(out) for out, _ in parts)])
    ends = np.concatenate([b + s for (_, b), s in zip(parts, starts.tolist(), strict=False)])[until - 1].tolist()
    full = np.logical_or.reduceat(np.concatenate(zeros), until - wide * high).tolist()
    made = []
    for n, w, h, a, b, rare in zip(units.tolist(), wide.tolist(), high.tolist(), [0, *ends[:-1]], ends, full, strict=True):
        ac = _AC_COUNTS + _AC_SYMBOLS if rare else _SHORT_COUNTS + _SHORT_SYMBOLS
        made.append(b"".join([
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(0xFE, _NOTE + str(n).encode()),
            _segment(0xDB, b"\0" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 1) + b"\x01\x11\0"),
            _segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS + b"\x10" + ac),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
            scans[a : b - 2],
            b"\xff\xd9",
        ]))
    return made


class Image:
    """What the markers of a baseline stream say, and its restart intervals without stuffing."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.restart, self.note, at = 0, None, 2
        self.intervals: list[bytes] = []
        self.components: list[tuple[int, int, int, int]] = []  # id, across, down, quantisation table
        self.tables: dict[int, int] = {}
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                continue
            (size,) = struct.unpack_from(">H", data, at)
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                while body:
                    wide, key = body[0] >> 4, body[0] & 15
                    self.quant[key] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + 64 * (wide + 1) :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("only 8-bit samples are read")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline streams are read")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xFE and body.startswith(_NOTE):
                self.note = int(body[len(_NOTE) :])
            elif marker == 0xDA:
                if body[0] != len(self.components):
                    raise ValueError("only streams with one scan are read")
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                at = self._scan(data, at)
        self.across = max(c[1] for c in self.components)
        self.down = max(c[2] for c in self.components)
        if len(self.components) == 1:  # a scan of one component has a block for each unit
            self.components, self.across, self.down = [(self.components[0][0], 1, 1, self.components[0][3])], 1, 1
        self.wide = -(-self.width // (8 * self.across))
        self.high = -(-self.height // (8 * self.down))

    def _scan(self, data: bytes, at: int) -> int:
        """Split entropy-coded data at its restart markers; where the next marker is."""
        array = np.frombuffer(data, np.uint8, offset=at)
        marks = np.flatnonzero(array[:-1] == 0xFF)
        after = array[marks + 1]
        real = marks[(after != 0) & (after != 0xFF)]
        kinds = array[real + 1]
        stop = int(np.argmax((kinds < 0xD0) | (kinds > 0xD7)))
        ends = real[: stop + 1].tolist()
        stuffed = bool((after == 0).any())
        start = 0
        for end in ends:
            part = data[at + start : at + end]
            self.intervals.append(part.replace(b"\xff\0", b"\xff") if stuffed else part)
            start = end + 2
        return at + ends[-1]

    def alike(self) -> tuple:
        """Images with the same key can be decoded side by side."""
        return (tuple(self.components), tuple(sorted(self.tables.items())), tuple(sorted(self.huffman.items())))


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits; length 0 where no code fits."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            low = code << (16 - size)
            length[low : low + (1 << (16 - size))] = size
            symbol[low : low + (1 << (16 - size))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def decode(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of images that are alike: for each, blocks in scan order x 64 in zigzag order, DC differences undone."""
    first = images[0]
    layout = [i for i, (_, h, v, _) in enumerate(first.components) for _ in range(h * v)]
    per = len(layout)
    keys = sorted(first.huffman)
    lookups = [_lookup(*first.huffman[k]) for k in keys]
    lengths, symbols = np.concatenate([x[0] for x in lookups]), np.concatenate([x[1] for x in lookups])
    table = lambda i, ac: keys.index((ac << 4) | (first.tables[first.components[i][0]] >> (0 if ac else 4) & 15)) << 16
    dc = np.array([table(i, 0) for i in layout], np.int64)
    ac = np.array([table(i, 1) for i in layout], np.int64)

    parts, units = [], []
    for image in images:
        left = image.wide * image.high
        for part in image.intervals:
            n = min(image.restart or left, left)
            parts.append(part)
            units.append(n * per)
            left -= n
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + b"\xff" * 8, np.uint8)
    words = np.zeros(len(data) - 4, np.uint32)  # 32 bits from each byte on
    for k in range(4):
        words |= data[k : len(words) + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    at = (np.cumsum(sizes) - sizes) * 8
    limit = np.cumsum(sizes) * 8
    n_units = np.array(units, np.int64)
    base = np.cumsum(n_units) - n_units
    out = np.zeros((int(n_units.sum()), UNIT), np.int32)
    flat = out.reshape(-1)

    lane = np.flatnonzero(n_units)
    at, limit, end = at[lane], limit[lane], (base + n_units)[lane]
    block, k = base[lane].copy(), np.zeros(len(lane), np.int64)
    start = base[lane]

    def peek(pos: np.ndarray) -> np.ndarray:
        return (words[pos >> 3] << (pos & 7).astype(np.uint32) >> np.uint32(16)).astype(np.int64)

    while len(at):
        unit = (block - start) % per if per > 1 else 0
        is_dc = k == 0
        which = np.where(is_dc, dc[unit], ac[unit]) + peek(at)
        length, symbol = lengths[which], symbols[which]
        if not length.all():
            raise ValueError("a code that no table has")
        at = at + length
        size = symbol & 15
        run = np.where(is_dc, 0, symbol >> 4)
        value = peek(at) >> (16 - size)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        at = at + size
        if (at > limit).any():
            raise ValueError("a scan ends early")
        k = k + run
        some = (size > 0) & (k < UNIT)
        flat[(block * UNIT + k)[some]] = value[some]
        stop = ~is_dc & (size == 0) & (run < 15)
        k = np.where(stop, UNIT, k + 1)
        done = k >= UNIT
        if done.any():
            block = block + done
            k = np.where(done, 0, k)
            alive = block < end
            if not alive.all():
                at, limit, end, block, k, start = (x[alive] for x in (at, limit, end, block, k, start))
    for i in range(len(first.components)):  # sum up the DC differences of each component in each interval
        mine = np.flatnonzero(np.array(layout) == i)
        if (n_units == 1).all():
            break
        for b, n in zip(base.tolist(), n_units.tolist(), strict=True):
            if n > 1:
                places = (b + np.arange(n // per)[:, None] * per + mine).reshape(-1)
                out[places, 0] = np.cumsum(out[places, 0])
    ends = np.cumsum([image.wide * image.high * per for image in images])
    return np.split(out, ends[:-1])


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from the DC coefficients, a pixel for each 8 x 8 block of the first component."""
    _, h, v, q = image.components[0]
    per = sum(a * b for _, a, b, _ in image.components)
    dc = coefficients[:, 0].reshape(image.high, image.wide, per)[:, :, : h * v].reshape(image.high, image.wide, v, h)
    grid = dc.transpose(0, 2, 1, 3).reshape(image.high * v, image.wide * h)
    grid = grid[: -(-(-(-image.height * v // image.down)) // 8), : -(-(-(-image.width * h // image.across)) // 8)]
    return np.clip(np.rint(grid * (image.quant[q][0] / 8) + 128), 0, 255).astype(np.uint8)


def fingerprint(pixels: np.ndarray) -> str:
    """Sixteen hex digits: whether each of 8 x 8 places is darker than the next in its row."""
    high, wide = pixels.shape
    grid = pixels[np.arange(8) * high // 8][:, np.arange(9) * wide // 9].astype(np.int16)
    return np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes().hex()


def payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    return _BYTE_OF[coefficients[: image.note] + 128].tobytes()


def read(media: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Parse and decode streams, those that are alike together."""
    images = [Image(m) for m in media]
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.alike(), []).append(i)
    out: list = [None] * len(images)
    for places in groups.values():
        for i, c in zip(places, decode([images[i] for i in places]), strict=True):
            out[i] = (images[i], c)
    return out


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a JPEG stream."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=1 << 20):
            texts = raw(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """From media(key, n_bytes, media), the stored bytes alone: dimensions, thumbnail hash, payload and stored form."""
    ship(media.sparkSession)
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", 1 << 20):
            streams = batch.column(2).to_pylist()
            rows = []
            for stream, (image, coefficients) in zip(streams, read(streams), strict=True):
                data = payload(image, coefficients)
                pixels = thumbnail(image, coefficients)
                look = f"{image.width}x{image.height}:{fingerprint(pixels)}:{sha256(pixels.tobytes()).hexdigest()[:16]}"
                rows.append((len(data), sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stream), sha256(stream).hexdigest(), look, image.width, image.height))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"
    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document of ``documents`` as a JPEG stream, stored in a table and read back from it."""
    return features(written(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "none"))  # the streams are compressed themselves
