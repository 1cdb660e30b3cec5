"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: positions marked 1 are hashed, positions marked
0 are ignored.  Every mask is laid on every position of the test items and of the
training texts; equal hashes are hits.  Around a hit, item and text are laid side by side
on the hit's diagonal and compared word by word, so substituted words do not break an
overlap.  A document overlaps an item when some window of aligned words has at least
``SIMILARITY`` equal words.  The window is ``WINDOW`` words, the whole item when that is
shorter, or the whole document when that is shorter and has ``SHORTEST`` words at least: a
document that is a piece of an item counts, a phrase of a few words does not.

The masks find every window of 13 words with at most two substitutions.  In a window of n
words with e substitutions allowed some (n - e) / (e + 1) words in a row are equal, so one
more mask of that many words finds the shorter windows, and those of 13 words when a lower
similarity allows more substitutions.  It is laid on short items and all documents, and on
short documents and all items; tests try all patterns of every length.  Words are
lower-cased (A-Z) runs of letters and digits.

The seeds of the test items are broadcast in blocks of at most ``BLOCK_SEEDS``; more items
mean more blocks, each over one further scan, so the broadcast has a fixed bound.
Null ids, null and empty texts: no overlap.  Repeated items and documents each give their
rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.kernels import (
    NOT_WORD, STEP, column_buffers, id_array, ids_of, mix, positions, scan, word_hashes,
)

MASKS = ("11111", "110111", "1101011")
WINDOW = 13
SIMILARITY = 0.8
SHORTEST = 8
BLOCK_SEEDS = 1_000_000
ANY, SHORT_ITEM, SHORT_TEXT = range(3)  # which items and texts a mask is laid on


def sure_mask(n: int, similarity: float) -> str:
    """Words in a row that some part of every allowed window of ``n`` words keeps."""
    least = next(same for same in range(n + 1) if same >= similarity * n)
    misses = n - least
    return "1" * -(-least // (misses + 1))


def seed_hashes(words: np.ndarray, mask: str, kind: int = ANY) -> np.ndarray:
    """Hash of the words under the mask, at each position where all of it fits."""
    m = max(0, len(words) - len(mask) + 1)
    out = np.full(m, len(mask) + 64 * kind, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * STEP + words[j : m + j]
    return mix(out)


def in_row(rows: np.ndarray, width: int) -> np.ndarray:
    m = max(0, len(rows) - width + 1)
    return rows[:m] == rows[width - 1 : width - 1 + m]


def laid_masks(sizes: np.ndarray, similarity: float, masks=MASKS) -> list[tuple[str, int, int]]:
    """(mask, kind, words): on rows of any length, or of ``words`` words on the short side."""
    wide = sure_mask(WINDOW, similarity)
    out = [(mask, ANY, 0) for mask in masks]
    if WINDOW - next(n for n in range(WINDOW + 1) if n >= similarity * WINDOW) > 2 and wide:
        out.append((wide, ANY, 0))
    short = np.unique(sizes[(sizes > 0) & (sizes < WINDOW)])
    out += [(sure_mask(int(n), similarity), SHORT_ITEM, int(n)) for n in short]
    out += [(sure_mask(n, similarity), SHORT_TEXT, n) for n in range(SHORTEST, WINDOW)]
    return [laid for laid in out if laid[0]]


def seeds_at(words: np.ndarray, rows: np.ndarray, mask: str, kind: int, wanted: np.ndarray | None):
    """Hash and word position of a mask's seeds, on the wanted rows (None: all)."""
    fits = in_row(rows, len(mask))
    if wanted is not None:
        fits = fits & wanted[rows[: len(fits)]]
    at = np.flatnonzero(fits)
    return seed_hashes(words, mask, kind)[at], at


def best_window(equal: np.ndarray, item_words: int, text_words: int, window: int = WINDOW) -> tuple[int, int, int]:
    """Equal words, start and length of the best aligned window; (0, 0, 1) if none fits."""
    width = min(window, item_words, max(text_words, SHORTEST))
    if len(equal) < width:
        return 0, 0, 1
    sums = np.cumsum(np.insert(equal.astype(np.int64), 0, 0))
    per = sums[width:] - sums[:-width]
    at = int(per.argmax())
    return int(per[at]), at, width


class Items:
    """Words and seeds of one block of test items, laid end to end."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, masks=MASKS):
        self.ids = np.array([r[0] for r in rows], np.int64)
        data, offsets = column_buffers(pa.array([r[1] for r in rows], pa.string()))
        starts, ends, owner = positions(offsets, data, NOT_WORD)
        self.words, self.owner = word_hashes(data, starts, ends, lower=True), owner
        self.first = np.searchsorted(owner, np.arange(len(rows) + 1))
        sizes = np.diff(self.first)
        self.masks = laid_masks(sizes, similarity, masks)
        found = {}  # masks of short texts are alike for several lengths
        for mask, kind, n in self.masks:
            key = (mask, kind, n if kind == SHORT_ITEM else 0)
            if key not in found:
                found[key] = seeds_at(self.words, owner, mask, kind, sizes == n if kind == SHORT_ITEM else None)
        hashes, where = (np.concatenate(part) for part in zip(*found.values()))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.where = hashes[order], where[order]
        # A one-byte table answers most lookups; its size is fixed.
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True


def overlaps_in(items: Items, data: np.ndarray, offsets: np.ndarray, similarity: float):
    """(row, item, equal words, window length, word position) per overlapping pair."""
    starts, ends, owner = positions(offsets, data, NOT_WORD)
    words = word_hashes(data, starts, ends, lower=True)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    sizes = np.diff(first)
    pairs = []
    for mask, kind, n in items.masks:
        wanted = sizes == n if kind == SHORT_TEXT else None
        if wanted is not None and not wanted.any():
            continue
        hashes, at = seeds_at(words, owner, mask, kind, wanted)
        maybe = items.seen[(hashes >> np.uint64(42)).astype(np.int64)]
        hashes, at = hashes[maybe], at[maybe]
        lo = np.searchsorted(items.hashes, hashes, "left")
        hi = np.searchsorted(items.hashes, hashes, "right")
        n = hi - lo
        where = np.repeat(at, n)
        step = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
        item_at = items.where[np.repeat(lo, n) + step]
        pairs.append(np.stack([owner[where], items.owner[item_at], where - item_at]))
    if not pairs:
        return
    # One alignment per row, item and diagonal, however many seeds hit it.
    best: dict[tuple[int, int], tuple] = {}
    for row, item, shift in np.unique(np.concatenate(pairs, 1), axis=1).T.tolist():
        a, b = items.first[item], items.first[item + 1]
        lo, hi = max(a, first[row] - shift), min(b, first[row + 1] - shift)
        equal = items.words[lo:hi] == words[lo + shift : hi + shift]
        same, at, width = best_window(equal, b - a, sizes[row])
        if same >= similarity * width:
            found = (same / width, -(lo + shift + at - first[row]), same, width)
            best[row, item] = max(best.get((row, item), found), found)
    for (row, item), (_, at, same, width) in best.items():
        yield row, item, same, width, -at


def item_blocks(items: DataFrame, limit: int):
    """Rows (item_id, text) of the usable items, in blocks of about ``limit`` seeds at most."""
    tests = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word takes two bytes at least; short items and texts add masks of up to four lengths.
    n = max(1, -(-size // 2 * (len(MASKS) + 4) // limit))
    for k in range(n):
        block = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        yield items.sparkSession.sparkContext.broadcast(sorted(rows))


def find_overlaps(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """``doc_id, item_id, n_equal, n_window, position, similarity`` per overlapping pair."""
    known = docs.where(F.col("doc_id").isNotNull())
    return reduce(DataFrame.unionByName, [
        scan(known, ["doc_id", "text"], _finder(shared, similarity), OVERLAP_SCHEMA)
        for shared in item_blocks(items, block_seeds)
    ])


OVERLAP_SCHEMA = (
    "doc_id long, item_id long, n_equal long, n_window long, position long, similarity double"
)


def _finder(shared, similarity):
    made: list[Items] = []

    def work(batch):
        if not made:
            made.append(Items(shared.value, similarity))
        ids = ids_of(batch.column("doc_id"))
        found = sorted(overlaps_in(made[0], *column_buffers(batch.column("text")), similarity))
        row, item, same, width, at = np.array(found, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays(
            [id_array(ids[row]), pa.array(made[0].ids[item]), pa.array(same), pa.array(width), pa.array(at),
             pa.array(same / np.maximum(width, 1))],
            ["doc_id", "item_id", "n_equal", "n_window", "position", "similarity"],
        )

    return work


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that overlap no item, unchanged."""
    for shared in item_blocks(items, BLOCK_SEEDS):
        docs = scan(docs, docs.columns, _dropper(shared, similarity), docs.schema)
    return docs


def _dropper(shared, similarity):
    made: list[Items] = []

    def work(batch):
        if not made:
            made.append(Items(shared.value, similarity))
        clean = np.ones(batch.num_rows, bool)
        for row, *_ in overlaps_in(made[0], *column_buffers(batch.column("text")), similarity):
            clean[row] = False
        yield batch.filter(pa.array(clean))

    return work
