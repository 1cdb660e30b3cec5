"""Array helpers that run inside tasks: words, hashes and n-grams of a batch of texts.

A batch is one UTF-8 buffer with offsets.  All loops over bytes and words are numpy
calls; batches are cut into slices of a few megabytes so that the arrays stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import bound_batches, ship_package, use_checkpoint_dir

SLICE_BYTES = 1 << 20
#: Id that stands for a missing doc_id inside tasks: later than every real one.
NO_ID = np.iinfo(np.int64).max

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Contract words: runs of anything but space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Words for models: letters and digits; bytes of non-ASCII characters count as letters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    column = column.cast(wide) if column.type != wide else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text, or one row."""
    _, offsets = column_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def scan(docs: DataFrame, columns: list[str], work: Callable, schema: str) -> DataFrame:
    """Run ``work(record batch) -> record batches`` over slices of the given columns."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield from work(part)

    return docs.select(*columns).mapInArrow(run, schema)


def keep(frame: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read it back."""
    use_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def positions(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray = WHITE, cuts=None):
    """Start, end and row of every word; words never cross rows.

    ``cuts`` lists further places at which a word ends and another starts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    if cuts is not None:
        breaks[cuts] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | breaks[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**position, from which every substring's hash follows."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span, the same wherever its content stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return span_hashes(prefix_sums(values), starts, ends)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position; length len(words) - n + 1."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * STEP + words[j : m + j]
    return mix(out)


def whole(rows: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one row start."""
    m = max(0, len(rows) - n + 1)
    return rows[:m] == rows[n - 1 : n - 1 + m]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths laid end to end: owner and index of each element."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - first[owner]


def cover(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``length`` at one of the starts."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, size), -1)
    return np.cumsum(steps[:-1]) > 0
