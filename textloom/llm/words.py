"""Texts of an Arrow column as words and 64-bit word hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.common import trim
from textloom.llm.hashstore import mix

_ODD = 0x9E3779B97F4A7C15
PART, KEPT = 1 << 18, 1 << 22
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64. What is kept for the next call is small."""
    if len(_powers.get(base, ())) >= n:
        return _powers[base][:n]
    out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= KEPT:
        _powers[base] = out
    return out[:n]


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes. Bytes are taken in parts that fit in a cache, but for longer strings."""
    strings = strings.cast(pa.large_string())
    out = np.empty(len(strings), dtype=np.uint64)
    if not len(strings):
        return out
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], dtype=np.uint8) if strings.buffers()[2] else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(out):
        j = max(int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1, i + 1)
        out[i:j] = _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    return out


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)))])
        h = (sums[offsets[1:]] - sums[offsets[:-1]]) * powers(pow(_ODD, -1, 1 << 64), len(data) + 1)[offsets[:-1]]
        return mix(h + (offsets[1:] - offsets[:-1]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words: the text that each stands in, its place in the array of distinct words, and that array."""
    # a copy without an offset: ascii_lower of pyarrow 23 reads a slice of large strings from the wrong place
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    return owner[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def pieces(batches, together: int, column: str = "text"):
    """Slices of the batches with about together bytes of text each."""
    for b in batches:
        begin = size = 0
        for i, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            size += (n or 0) + 64
            if size > together or i + 1 == b.num_rows:
                yield b.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        trim()
