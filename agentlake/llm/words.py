"""Word and shingle hashing over Arrow batches (numpy, whole texts, bounded memory)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Texts are gathered into blocks of about so many bytes before they are hashed.
BLOCK_BYTES = 4 << 20


def tidy(f: Callable) -> Callable:
    """A function over Arrow batches that gives its memory back to the system when its task ends, as idle Python workers
    stay beside the executor that started them."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_blocks(batch: pa.RecordBatch, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices (ids, texts as large strings) of a batch (id, text) of about ``size`` bytes; a longer text is one of its own."""
    texts = batch.column(1)
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (int(upto[a - 1]) if a else 0) + size, side="right")))
        # taken, not sliced: kernels misread strings whose first offset isn't 0
        yield batch.column(0).slice(a, b - a), texts.take(pa.array(np.arange(a, b))).cast(pa.large_string())
        a = b


def raw_texts(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text without decoding; null stays None."""
    return texts.cast(pa.large_binary()).to_pylist()


def word_lists(texts: pa.Array) -> pa.Array:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lower-cased, as lists; a blank or null text is one empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles. With fewer words the whole sequence is one."""
    words = word_lists(texts)
    coded = words.flatten().dictionary_encode()
    each = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, each), dtype=np.uint64, count=len(each))
    flat = hashed[coded.indices.to_numpy()]
    edges = words.offsets.to_numpy()
    edges = edges - edges[0]
    sizes = np.diff(edges)
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))), 0).to_numpy(zero_copy_only=False)
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
    out: list[np.ndarray] = []
    n = len(flat) - k + 1
    window = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if n > 0 else 0):
            window += mixed(flat[j : j + n] + U(j + 1)) * odd[j % len(odd)]
        window = mixed(window)
        for a, size, none in zip(edges.tolist(), sizes.tolist(), blank.tolist(), strict=False):
            if none:
                out.append(np.empty(0, dtype=np.uint64))
            elif size >= k:
                out.append(np.unique(window[a : a + size - k + 1]))
            else:
                short = U(size * 7919)
                for j in range(size):
                    short += mixed(flat[a + j : a + j + 1] + U(j + 1))[0] * odd[(j + 3) % len(odd)]
                out.append(mixed(np.array([short], dtype=np.uint64)))
    return out
