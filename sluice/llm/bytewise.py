"""Texts as one stream of bytes: words as runs of word bytes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another and where each begins, with the end; nulls are empty."""
    text = pc.fill_null(text, "")
    _, ends, data = text.buffers()
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(ends, width)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Runs:
    """Maximal runs of word bytes that stay inside a text: first byte, byte after the last, text, word."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray, inside: np.ndarray):
        own = inside[raw]
        edge = rows[(rows > 0) & (rows < len(raw))]
        opens, shuts = own.copy(), own.copy()
        opens[1:] &= ~own[:-1]
        opens[edge] = own[edge]
        shuts[:-1] &= ~own[1:]
        shuts[edge - 1] = own[edge - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        self.rows = np.searchsorted(rows, self.starts, side="right") - 1
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=at[1:])
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[raw[own]])])
