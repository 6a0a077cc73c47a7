"""How a block's words, and their ids, are packed into one value: numbers of words, a stretch of data for each, zstd."""

from __future__ import annotations

import numpy as np
import zstandard


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, first all lowest bytes, then the next ones: high bytes are mostly zero and pack well."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def pack(number: np.ndarray, lens: np.ndarray, data: bytes) -> bytes:
    """Ascending word numbers, and a stretch of data for each."""
    head = np.array([len(number)], np.int32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + planes(np.diff(number, prepend=0)) + planes(lens) + data)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = 4 * int(np.frombuffer(raw[:4], np.int32)[0])
    return np.cumsum(unplanes(raw[4 : 4 + n])), unplanes(raw[4 + n : 4 + 2 * n]), raw[4 + 2 * n :]
