"""Cutting whole texts into words without a Python step for each word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """The words of some texts in order: their numbers in ``names``, and the row and piece that each stands in."""

    codes: np.ndarray
    names: pa.Array
    rows: np.ndarray
    pieces: np.ndarray


def cut(texts: pa.Array, gaps: bytes, breaks: bytes = b"") -> Words:
    """Words of ``texts``, A-Z in lower case: runs of bytes that are in neither ``gaps`` nor ``breaks`` (ASCII only).

    A byte of ``breaks``, like the end of a text, also ends a piece. Null counts as empty.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[places[0]:places[-1]] if raw is not None else np.zeros(0, np.uint8)
    data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
    places = places - places[0] if len(places) else np.zeros(1, np.int64)
    kind = np.zeros(256, np.uint8)
    kind[np.frombuffer(gaps, np.uint8)], kind[np.frombuffer(breaks, np.uint8)] = 1, 2
    kinds = kind[data]
    word = kinds == 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[places] = True
    fresh = fresh[:-1]
    begins = word.copy()
    begins[1:] &= fresh[1:] | ~word[:-1]
    starts = np.flatnonzero(begins)
    # Word bytes move together; what lies between them is left out.
    seen = np.cumsum(word)
    ends = np.append(seen[starts] - 1, seen[-1] if len(seen) else 0).astype(np.int64)
    packed = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[word]))
    coded = packed.dictionary_encode()
    pieces = np.cumsum(fresh | (kinds == 2))[starts]
    rows = np.searchsorted(places, starts, side="right") - 1
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, rows, pieces)


def word_hashes(names: pa.Array) -> np.ndarray:
    """32 bits of a polynomial hash of each word (none is empty), as whole numbers."""
    names = names.cast(pa.large_string())
    if not len(names):
        return np.zeros(0, np.int64)
    places = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[places[0]:places[-1]].astype(np.uint64) + np.uint64(1)
    places = places - places[0]
    powers = np.cumprod(np.full(int(np.diff(places).max()), 0x9E3779B97F4A7C15, np.uint64))
    total = np.add.reduceat(data * powers[np.arange(len(data)) - np.repeat(places[:-1], np.diff(places))], places[:-1])
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (total >> np.uint64(32)).astype(np.int64)
