"""Baseline JPEG as a container for bytes, and a reader of baseline JPEGs.

A payload byte is one quantised DCT coefficient: quantiser 1, byte b stored as b-128, with the values from 0 up moved up
by one, so that no coefficient is zero and every one has its own Huffman symbol. 192 bytes are one MCU of three 8 x 8
blocks (Y, Cb, Cr, 4:4:4), in zigzag order, and each MCU is a restart interval. A comment segment holds the payload's
length without padding. The reader works for any baseline JPEG: it parses the markers and decodes the Huffman codes of
all restart intervals of many files in step, one symbol of every interval at a time.
"""

from __future__ import annotations

import struct

import numpy as np

MCU = 192
#: Most MCUs down a picture: 65535 lines of 8.
TALLEST = 8191
#: MCUs that one call of the coder treats; bounds its memory.
SLICE = 16384
#: Huffman lengths 1 to 9 go to these symbols (the bit length of a coefficient; 0 ends a block).
BY_LENGTH = (5, 4, 7, 3, 6, 8, 2, 1, 0)
TAG = b"payload "


def _tables():
    """For each byte: its code word with the extra bits, and their number."""
    b = np.arange(256)
    v = np.where(b >= 128, b - 127, b - 128)
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(int)
    at = {s: k + 1 for k, s in enumerate(BY_LENGTH)}
    length = np.array([at[s] for s in size])
    code = (1 << length) - 2
    extra = np.where(v > 0, v, v + (1 << size) - 1)
    return ((code << size) | extra).astype(np.uint32), (length + size).astype(np.int64)


CODE, BITS = _tables()
_DHT = bytes([1] * 9 + [0] * 7) + bytes(BY_LENGTH)
#: A padding MCU: in each of its blocks a DC difference of 0, then the end of the block.
_EMPTY = int("111111110" * 6, 2), 54


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _layout(n: int) -> tuple[int, int]:
    """MCUs across and down a picture of n MCUs."""
    across = -(-n // TALLEST)
    return across, -(-n // across)


def _header(n: int, n_bytes: int) -> bytes:
    across, down = _layout(n)
    frame = struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return (
        b"\xff\xd8"
        + _segment(0xFE, TAG + struct.pack(">QQ", n_bytes, n))
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, frame)
        + _segment(0xC4, b"\x00" + _DHT + b"\x10" + _DHT)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    )


def _scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of MCUs (rows of 192 bytes), with stuffing, without markers; the length of each."""
    bits = BITS[rows]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    n_bytes = (total + 7) // 8
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (ends - bits + 8 * first[:-1, None]).ravel()
    word = CODE[rows].ravel() << (24 - (at & 7) - bits.ravel()).astype(np.uint32)
    at >>= 3
    size = int(first[-1])
    out = np.bincount(at, weights=word >> 16, minlength=size + 2)
    out[1:] += np.bincount(at, weights=(word >> 8) & 255, minlength=size + 2)[: size + 1]
    out[2:] += np.bincount(at, weights=word & 255, minlength=size + 2)[:size]
    out = out[:size].astype(np.uint8)
    out[first[1:] - 1] |= ((1 << (8 * n_bytes - total)) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = np.flatnonzero(out == 255)
    if len(full):
        n_bytes = n_bytes + np.bincount(np.searchsorted(first, full, side="right") - 1, minlength=len(rows))
        out = np.insert(out, full + 1, 0)
    return out, n_bytes


def encode(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """JPEG files of payloads, each a positive multiple of 192 bytes; lengths without padding."""
    counts = np.array([len(p) // MCU for p in payloads], dtype=np.int64)
    rows = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, MCU)
    scans, sizes = zip(*(_scan(rows[i : i + SLICE]) for i in range(0, len(rows), SLICE)), strict=True)
    scan, sizes = np.concatenate(scans), np.concatenate(sizes)
    # a marker follows each MCU; the last of a file becomes the end of the image
    at = np.cumsum(sizes) + 2 * np.arange(len(sizes))
    out = np.empty(len(scan) + 2 * len(sizes), dtype=np.uint8)
    marks = np.zeros(len(out), dtype=bool)
    marks[at] = marks[at + 1] = True
    out[~marks] = scan
    starts = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(len(sizes)) - np.repeat(starts[:-1], counts)
    out[at] = 255
    out[at + 1] = 0xD0 + within % 8
    ends = at[starts[1:] - 1]
    files, begin = [], 0
    for n, n_bytes, end in zip(counts.tolist(), lengths, ends.tolist(), strict=True):
        across, down = _layout(n)
        body, tail = out[begin:end].tobytes(), b""
        for k in range(n, across * down):
            code, length = _EMPTY
            tail += bytes([255, 0xD0 + (k - 1) % 8]) + ((code << 2) | 3).to_bytes(7, "big").replace(b"\xff", b"\xff\0")
        files.append(_header(n, n_bytes) + body + tail + b"\xff\xd9")
        begin = end + 2
    return files


# -- reading ----------------------------------------------------------------------------------------------------------


class Picture:
    """What the markers of a baseline JPEG say; scan: where its entropy-coded data begins."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huff, self.restart, self.comment = {}, {}, 0, b""
        self.parts: list[tuple[int, int, int, int]] = []  # component: id, h, v, quantiser
        at = 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.scan = at
                break
        hs, vs = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        self.mcus = self.across * self.down
        #: for each block of an MCU: its component, its DC table, its AC table
        self.blocks = [(k, self.huff[chosen[i] >> 4], self.huff[16 | chosen[i] & 15]) for k, (i, h, v, _) in enumerate(self.parts) for _ in range(h * v)]
        self.every = self.restart or self.mcus
        self.kind = (tuple(self.blocks), self.every)

    def _quantisers(self, body: bytes) -> None:
        while body:
            n = 128 if body[0] >> 4 else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if n == 128 else np.uint8)
            body = body[1 + n :]

    def _codes(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.huff[body[0]] = body[1 : 17 + n]
            body = body[17 + n :]


_known: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For any next 16 bits: the symbol << 8 | the code's length; a length of 0 is no code."""
    if table not in _known:
        out, code, k = np.zeros(65536, dtype=np.uint16), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[code << (16 - length) : (code + 1) << (16 - length)] = table[k] << 8 | length
                code, k = code + 1, k + 1
            code <<= 1
        _known[table] = out
    return _known[table]


def _intervals(data: bytes, scan: int) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes without stuffing and markers; where each restart interval begins in them, and the end."""
    a = np.frombuffer(data, dtype=np.uint8)[scan:]
    ff = np.flatnonzero(a[:-1] == 255)
    after = a[ff + 1]
    stop = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 255)]
    end = int(stop[0]) if len(stop) else len(a)
    inside = ff < end
    ff, after = ff[inside], after[inside]
    marks = ff[(after & 0xF8) == 0xD0]
    keep = np.ones(end, dtype=bool)
    keep[np.minimum(ff[after == 0] + 1, end - 1)] = False
    keep[marks] = False
    keep[marks + 1] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    return a[:end][keep], np.concatenate([[0], before[marks], [before[-1]]])


def _decode(stream: np.ndarray, starts: np.ndarray, blocks, every: int) -> np.ndarray:
    """Coefficients, in zigzag order, of intervals that begin at starts: [interval, block, 64]. All intervals advance together."""
    n, per = len(starts), len(blocks) * every
    words = np.ndarray((len(stream) - 7,), dtype=">u8", buffer=stream, strides=(1,))
    at = starts.astype(np.int64) * 8
    out = np.zeros((per * 64, n), dtype=np.int16)
    pred = np.zeros((max(b[0] for b in blocks) + 1, n), dtype=np.int64)
    limit = (len(stream) - 8) * 8
    for block in range(per):
        part, dc, ac = blocks[block % len(blocks)]
        dc, ac = _lookup(dc), _lookup(ac)
        k, live = np.zeros(n, dtype=np.int64), None  # live: those still in this block, None for all
        while live is None or len(live):
            pos = at if live is None else at[live]
            here = k if live is None else k[live]
            top = words[np.minimum(pos, limit) >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
            first = live is None and here[0] == 0
            found = (dc if first else ac)[(top >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            length, symbol = found & 255, found >> 8
            if not length.all():
                raise ValueError("no such code")
            size = symbol & 15
            rest = top << length.astype(np.uint64)
            value = ((rest >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value += np.where(value < (1 << size) >> 1, 1 - (1 << size), 0)
            run = symbol >> 4
            if first:
                value = pred[part] = pred[part] + value
                run = np.zeros_like(run)
            ended = (symbol == 0) & (not first)
            to = here + run
            who = np.arange(n) if live is None else live
            put = ~ended & (to < 64)
            if put.all() and live is None and (to == to[0]).all():
                out[block * 64 + to[0]] = value
            else:
                out[block * 64 + to[put], who[put]] = value[put]
            pos, to = pos + length + size, np.where(ended, 64, to + 1)
            if live is None:
                at, k = pos, to
            else:
                at[live], k[live] = pos, to
            if live is not None or (to >= 64).any():
                live = who[to < 64]
    return out.T.reshape(n, per, 64)


def read(files: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """For each file: its Picture and its coefficients [mcu, block, 64] in zigzag order."""
    pictures = [Picture(f) for f in files]
    done: list = [None] * len(files)
    by_kind: dict = {}
    for i, p in enumerate(pictures):
        by_kind.setdefault(p.kind, []).append(i)
    for (blocks, every), own in by_kind.items():
        streams, firsts, owner, base = [], [], [], 0
        for i in own:
            stream, starts = _intervals(files[i], pictures[i].scan)
            need = -(-pictures[i].mcus // every)
            if len(starts) - 1 < need:
                raise ValueError("a restart interval is missing")
            streams.append(stream)
            firsts.append(starts[:need] + base)
            owner.append(need)
            base += len(stream)
        stream = np.concatenate([*streams, np.full(64, 255, dtype=np.uint8)])
        starts = np.concatenate(firsts)
        # the last interval of a file may be short of MCUs; those without restarts are decoded one by one
        parts = [_decode(stream, starts[i : i + SLICE], blocks, every) for i in range(0, len(starts), SLICE)]
        got = np.concatenate(parts).reshape(len(starts) * every, len(blocks), 64)
        edge = 0
        for i, need in zip(own, owner, strict=True):
            done[i] = (pictures[i], got[edge * every : edge * every + pictures[i].mcus])
            edge += need
    return done


def payload(picture: Picture, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The stored bytes with their padding, and their number without it."""
    n_bytes, n = struct.unpack(">QQ", picture.comment[len(TAG) :])
    v = coefficients[:n].ravel()
    return np.where(v > 0, v + 127, v + 128).astype(np.uint8).tobytes(), n_bytes


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel a block, from its DC coefficient alone."""
    _, h, v, q = picture.parts[0]
    dc = coefficients[:, : h * v, 0].astype(np.int64) * int(picture.quant[q][0])
    pixels = np.clip((dc >> 3) + 128, 0, 255).astype(np.uint8)
    grid = pixels.reshape(picture.down, picture.across, v, h).swapaxes(1, 2)
    return grid.reshape(picture.down * v, picture.across * h)
