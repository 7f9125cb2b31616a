"""Sorted hash arrays in one file, read through a memory map.

A table keeps 64-bit keys in order: a directory by their top bits, with about 64 keys an entry, and the next 32 bits of
each. A key that is absent is taken for a present one with a chance of about 2**-26, at any size. A file holds several
named arrays behind a small header.
"""

from __future__ import annotations

import json

import numpy as np

from textloom.llm.common import map_file, put_file

PER_ENTRY = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def keyed(keys: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a table: where/rest for the keys, and values in the keys' order. Small counts take a byte; larger ones follow apart."""
    order = np.argsort(keys)
    keys = keys[order]
    bits = max(0, int(np.ceil(np.log2(max(len(keys), 1) / PER_ENTRY))))
    tops = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), dtype=np.uint64)
    out = {"where": np.searchsorted(tops, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint64), "rest": ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)}
    for name, v in values.items():
        v = v[order].astype(np.uint64)
        high = np.flatnonzero(v > 254)
        out[name] = np.minimum(v, 255).astype(np.uint8)
        out[f"{name}+at"], out[f"{name}+value"] = high.astype(np.uint64), v[high]
    return out


def find(table: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    where, rest = table["where"], table["rest"]
    if not len(rest):
        return np.full(len(keys), -1, dtype=np.int64)
    bits = (len(where) - 1).bit_length() - 1
    top = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    want = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low, high = where[top].astype(np.int64), where[top + 1].astype(np.int64)
    end = high
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (middle < high) & (rest[np.minimum(middle, len(rest) - 1)] < want)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    hit = (low < end) & (rest[np.minimum(low, len(rest) - 1)] == want)
    return np.where(hit, low, -1)


def value(table: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The counts at places; 0 where a place is -1."""
    if not len(table[name]):
        return np.zeros(len(at), dtype=np.int64)
    v = table[name][np.maximum(at, 0)].astype(np.int64)
    full = np.flatnonzero((v == 255) & (at >= 0))
    if len(full):
        v[full] = table[f"{name}+value"][np.searchsorted(table[f"{name}+at"], at[full].astype(np.uint64))]
    return np.where(at >= 0, v, 0)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, at, a.size)
        pad = -a.nbytes % 8
        parts += [a.data.cast("B") if a.size else b"", b"\0" * pad]
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    put_file(uri, [len(text).to_bytes(8, "little"), text, *parts])


_open: dict[str, dict[str, np.ndarray]] = {}


def load(uri: str) -> dict[str, np.ndarray]:
    """Views into the mapped file; kept open by this worker."""
    if uri not in _open:
        if len(_open) > 4096:
            _open.clear()
        data = map_file(uri)
        n = int.from_bytes(data[:8].to_pybytes(), "little")
        head = json.loads(data[8 : 8 + n].to_pybytes())
        _open[uri] = {name: np.frombuffer(data, dtype=np.dtype(kind), count=size, offset=8 + n + at) if size else np.zeros(0, dtype=np.dtype(kind)) for name, (kind, at, size) in head.items()}
    return _open[uri]


def part(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed byte planes, for a shuffle."""
    import pyarrow as pa

    out = []
    for c in columns:
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes()
        body = pa.compress(planes, "zstd", asbytes=True)
        out.append(c.dtype.str.encode().ljust(4) + len(c).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(blob) -> list[np.ndarray]:
    import pyarrow as pa

    out, at = [], 0
    while at < len(blob):
        kind, n, size = np.dtype(bytes(blob[at : at + 4]).decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        planes = np.frombuffer(pa.decompress(blob[at + 20 : at + 20 + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 20 + size
    return out
