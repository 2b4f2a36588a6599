"""Terms of many texts at once: maximal runs of the bytes of a class, after A-Z became lower-case."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillstone.llm import text as tx
from quillstone.llm.common import release_memory, texts_of

#: Running states of CRC-32 (reflected polynomial 0xEDB88320) after one more byte, and the state before any byte.
CRC_START = np.uint32(0xFFFFFFFF)
_crc_table = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc_table = np.where(_crc_table & np.uint32(1), _crc_table >> np.uint32(1) ^ np.uint32(0xEDB88320), _crc_table >> np.uint32(1))

#: Spans of more bytes than this take their checksum one by one.
_LONG = 64


def byte_class(*others: tuple[int, int]) -> np.ndarray:
    """Whether a byte lies in none of the ranges, ends included."""
    inside = np.ones(256, bool)
    for a, b in others:
        inside[a : b + 1] = False
    return inside


#: Letters and digits, and letters alone; bytes beyond ASCII belong to both.
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LETTERS = byte_class((0x00, 0x60), (0x7B, 0x7F))


def term_spans(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all texts in lower case, and each term's text, start and end in it."""
    buffer, bounds = tx.joined(texts)
    buffer = tx.lower_az(buffer)
    edge = np.zeros(len(buffer) + 2, np.int8)
    edge[1:-1] = inside[buffer]
    step = np.diff(edge)
    starts = np.flatnonzero(step == 1)
    return buffer, np.searchsorted(bounds, starts, "right") - 1, starts, np.flatnonzero(step == -1)


def crc_states(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The running states of CRC-32 after each span's bytes, begun from `states`: place after place, for all spans that reach it."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    long = int(np.searchsorted(-lens[order], -_LONG, "left"))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = np.uint32(zlib.crc32(buffer[starts[i] : ends[i]].tobytes(), int(states[i] ^ CRC_START))) ^ CRC_START
    rest = order[long:]
    at, state, size = starts[rest], states[rest].astype(np.uint32), lens[rest]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # spans of more than j bytes
        state[:n] = _crc_table[(state[:n] ^ buffer[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[rest] = state
    return out


def crc_step(states: np.ndarray, byte: int) -> np.ndarray:
    return _crc_table[(states ^ np.uint32(byte)) & np.uint32(255)] ^ (states >> np.uint32(8))


def encoded(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each term's number among the distinct ones, told apart by their bytes, and these. The terms are all of term_spans."""
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    inner = pa.py_buffer(buffer[inside[buffer]].tobytes())
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), inner]).dictionary_encode()
    return spans.indices.to_numpy().astype(np.int64), spans.dictionary


def text_parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """Texts and rows of parts of the batches, each with about `most` bytes of text, or one longer text."""
    for batch in batches:
        texts, at, held = texts_of(batch), 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= most or i == len(texts) - 1:
                yield texts[at : i + 1], batch.slice(at, i + 1 - at)
                at, held = i + 1, 0
        del texts
        release_memory()
