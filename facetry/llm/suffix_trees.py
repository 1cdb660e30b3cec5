"""Substring deduplication by prefix-partitioned suffix trees over words.

The suffixes of all documents are split into groups by prefixes of different lengths:
the first word decides where that prefix has at most ``GROUP_SUFFIXES`` suffixes,
otherwise the first two, four, six ... words do.  A word counts as one of 256 edge
labels in a prefix.  The table of prefixes is bounded: per length only the ``SPLIT_ROWS``
largest are lengthened, and what is still too large is dealt into several groups by the
hash of the whole path, which keeps equal paths together.  Each group's subtree is built alone, from its suffixes in sorted
order; it is cut at a depth of ``window`` words, because deeper branches cannot change
which windows repeat.  An internal node at that depth with several leaves is a repeat:
its leaves are the documents whose texts hold that word sequence.

Below the routing prefix a path of the tree is one 64-bit hash of the suffix's first
``window`` words, so equality holds up to hash collisions (odds of any at all among n
different windows: about n * n / 2**65).  Suffixes of a batch of documents with the same
words are one leaf: batches are ranges of doc_id, so for a leaf it is enough to know
whether an earlier batch has it too; order inside a batch is settled in the batch.

A word is removed when a window covering it also starts in a document with a smaller
id.  Null ids count as larger than all; equal ids are not smaller.  Null and empty texts
have no words.  Repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.exchange import (
    BATCH_BYTES, batched, by_group, meet, pack_bits, pack_sorted, rows_of, sorted_rows, text_bytes, unpack_bits,
    unpack_sorted,
)
from facetry.llm.kernels import (
    column_buffers, cover, grams, id_array, ids_of, positions, slices, whole, word_hashes,
)

WINDOW = 13
GROUP_SUFFIXES = 500_000
LABELS = 256
PAIR = LABELS * LABELS
SPLIT_ROWS = 16

SENT = "grp int, batch int, leaves binary"
SENT_ARROW = pa.schema([("grp", pa.int32()), ("batch", pa.int32()), ("leaves", pa.binary())])
ANSWER = "batch int, grp int, earlier binary"
ANSWER_ARROW = pa.schema([("batch", pa.int32()), ("grp", pa.int32()), ("earlier", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept string"


class Prefixes:
    """Group of every suffix by a trie of word-label pairs.

    ``tables[l]`` has a row per split prefix of 2*l words and a column per label pair;
    values at or over 0 are subtrees, others point to a row of the next table.  Subtree s
    has the groups first[s] to first[s] + parts[s] - 1, by ranges of the path's hash.
    """

    def __init__(self, window: int):
        self.tables: list[np.ndarray] = []
        self.first = np.zeros(0, np.int64)
        self.parts = np.zeros(0, np.int64)
        self.window = window

    def pairs(self, labels: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
        """Labels of words 2*level and 2*level + 1 of the suffixes; past the window, 0."""
        a, b = 2 * level, 2 * level + 1
        second = labels[at + b] if b < self.window else np.zeros(len(at), np.int64)
        return labels[at + a] * LABELS + second

    def route(self, labels: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Subtrees of the suffixes at the positions; -1 - row for those still to be split."""
        out = np.full(len(at), -1, np.int64)
        for level, table in enumerate(self.tables):
            open_ = np.flatnonzero(out < 0)
            out[open_] = table[-1 - out[open_], self.pairs(labels, level, at[open_])]
        return out

    def groups(self, labels: np.ndarray, at: np.ndarray, paths: np.ndarray) -> np.ndarray:
        subtree = self.route(labels, at)
        part = (paths >> np.uint64(32)) * self.parts[subtree].astype(np.uint64) >> np.uint64(32)
        return self.first[subtree] + part.astype(np.int64)

    def extend(self, counts: np.ndarray, limit: int, most: int = SPLIT_ROWS) -> bool:
        """Turn counts (rows x pairs) into a table; True if some prefix is still to be split."""
        last = 2 * (len(self.tables) + 1) >= self.window
        per_word = counts.reshape(len(counts), LABELS, LABELS).sum(2)
        # One word is prefix enough where it is rare; its pairs then share a group.
        rare = np.repeat(per_word <= limit, LABELS, axis=1)
        unit = np.where(rare, np.repeat(np.arange(LABELS) * LABELS, LABELS), np.arange(PAIR))
        sums = np.stack([np.bincount(u, c, PAIR).astype(np.int64) for u, c in zip(unit, counts)])
        flat = sums.ravel()
        large = np.flatnonzero(flat > limit) if not last else np.zeros(0, np.int64)
        large = large[np.argsort(-flat[large], kind="stable")][:most]
        place = np.full(flat.shape, -1, np.int64)
        place[large] = -1 - np.arange(len(large))
        rest = np.setdiff1d(np.flatnonzero(flat), large)
        parts, load = self.parts.tolist(), limit
        for u, n in zip(rest.tolist(), flat[rest].tolist()):
            if load + n > limit:
                parts.append(-(-n // limit))
                load = 0
            place[u] = len(parts) - 1
            load += n
        self.parts = np.array(parts, np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        self.tables.append(np.take_along_axis(place.reshape(counts.shape), unit, 1))
        return len(large) > 0


def windows_of(part: pa.RecordBatch, window: int):
    """Word positions, rows, hashes, and the positions at which a window starts."""
    data, offsets = column_buffers(part.column("text"))
    starts, ends, rows = positions(offsets, data)
    words = word_hashes(data, starts, ends)
    return data, offsets, starts, ends, rows, words, np.flatnonzero(whole(rows, window))


def split_prefixes(docs: DataFrame, suffixes: int, window: int, limit: int) -> Prefixes:
    """Count prefixes over all suffixes, level by level, until every group is small."""
    found = Prefixes(window)
    if suffixes <= limit:
        found.tables.append(np.zeros((1, PAIR), np.int64))
        found.first, found.parts = np.zeros(1, np.int64), np.ones(1, np.int64)
        return found
    rows, more = 1, True
    while more:
        level = len(found.tables)

        def count(batches, rows=rows, level=level):
            total = np.zeros(rows * PAIR, np.int64)
            for batch in batches:
                for part in slices(batch):
                    *_, words, at = windows_of(part, window)
                    labels = (words >> np.uint64(56)).astype(np.int64)
                    row = -1 - found.route(labels, at)
                    at, row = at[row >= 0], row[row >= 0]
                    total += np.bincount(row * PAIR + found.pairs(labels, level, at), minlength=len(total))
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

        counted = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        counts = np.zeros(rows * PAIR, np.int64)
        table = counted.toArrow()  # at most SPLIT_ROWS * PAIR rows
        counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
        more = found.extend(counts.reshape(rows, PAIR), limit)
        rows = -int(min(0, found.tables[-1].min()))
    return found


def leaves_of(batch: pa.RecordBatch, prefixes: Prefixes, window: int):
    """The batch's distinct windows in the order of (group, hash), and all its windows.

    Returns groups, hashes and smallest document of each leaf, and per slice its arrays
    with the window hashes.
    """
    doc = ids_of(batch.column("doc_id"))
    parts, hashes, owners, groups, base = [], [], [], [], 0
    for part in slices(batch):
        data, offsets, starts, ends, rows, words, at = windows_of(part, window)
        key = grams(words, window)[at]
        labels = (words >> np.uint64(56)).astype(np.int64)
        parts.append((part.num_rows, data, offsets, starts, ends, rows, at, key))
        hashes.append(key)
        owners.append(doc[base + rows[at]])
        groups.append(prefixes.groups(labels, at, key))
        base += part.num_rows
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), parts
    keys, first = np.unique(np.concatenate(hashes), return_index=True)  # rows are in the order of ids
    group, owner = np.concatenate(groups)[first], np.concatenate(owners)[first]
    order = np.argsort(group, kind="stable")
    return group[order], keys[order], owner[order], parts


def deep_nodes(hashes: np.ndarray, batches: np.ndarray) -> np.ndarray:
    """For leaves in any order: does an earlier batch have a leaf below the same deep node?

    Sorting the leaves is building the subtree; its deep nodes are the runs.
    """
    order = np.lexsort((batches, hashes))
    out = np.zeros(len(hashes), bool)
    same = hashes[order][1:] == hashes[order][:-1]
    out[order[1:][same]] = True  # all but the run's first, which is the earliest batch
    return out


def kept_text(data, offsets, starts, ends, rows, removed) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept words, joined by one space."""
    keep = np.flatnonzero(~removed)
    last = np.ones(len(keep), bool)
    last[:-1] = rows[keep][1:] != rows[keep][:-1]
    stop = ends[keep] + ~last  # the separator after a word stands for the space
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts[keep]] += 1
    np.add.at(steps, stop, -1)
    mask = np.cumsum(steps[:-1], dtype=np.int8) > 0
    text = data.copy()
    text[ends[keep][~last]] = 32
    sizes = np.bincount(rows[keep], stop - starts[keep], len(offsets) - 1).astype(np.int64)
    return text[mask], np.concatenate([[0], np.cumsum(sizes)])


def string_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    wide = pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )
    return wide.cast(pa.string())


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row."""
    size = text_bytes(docs)
    docs = batched(docs, size, batch_bytes)
    prefixes = split_prefixes(docs, size // 2, window, group_suffixes)

    def send(table: pa.Table) -> pa.Table:
        out = {"grp": [], "batch": [], "leaves": []}
        group, keys, _, _ = leaves_of(sorted_rows(table), prefixes, window)
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out["grp"].append(int(group[a]))
            out["batch"].append(table.column("batch")[0].as_py())
            out["leaves"].append(pack_sorted(keys[a:b]))
        return rows_of(out, SENT_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        leaves = [unpack_sorted(x) for x in table.column("leaves").to_pylist()]
        batch = table.column("batch").to_numpy()
        sizes = np.array([len(x) for x in leaves])
        earlier = deep_nodes(np.concatenate(leaves), np.repeat(batch, sizes))
        ends = np.cumsum(sizes)
        bits = [pack_bits(earlier[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        return rows_of({"batch": batch, "grp": table.column("grp").to_numpy(), "earlier": bits}, ANSWER_ARROW)

    def mark(answers: pa.Table, table: pa.Table) -> pa.Table:
        batch = sorted_rows(table)
        group, keys, owner, parts = leaves_of(batch, prefixes, window)
        bits = dict(zip(answers.column("grp").to_pylist(), answers.column("earlier").to_pylist()))
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        earlier = [unpack_bits(bits[int(group[a])], b - a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        earlier = np.concatenate(earlier) if earlier else np.zeros(0, bool)
        order = np.argsort(keys)
        keys, owner, earlier = keys[order], owner[order], earlier[order]
        doc, base, out = ids_of(batch.column("doc_id")), 0, []
        for n, data, offsets, starts, ends, rows, at, key in parts:
            leaf = np.searchsorted(keys, key)
            hit = earlier[leaf] | (doc[base + rows[at]] > owner[leaf])
            removed = cover(len(starts), at[hit], window)
            text, cut = kept_text(data, offsets, starts, ends, rows, removed)
            out.append(pa.table({
                "doc_id": id_array(doc[base : base + n]),
                "n_words": np.bincount(rows, minlength=n).astype(np.int64),
                "n_removed": np.bincount(rows[removed], minlength=n).astype(np.int64),
                "kept": string_column(text, cut),
            }))
            base += n
        return pa.concat_tables(out) if out else pa.table(
            {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
             "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    answers = by_group(by_group(docs, "batch", send, SENT), "grp", answer, ANSWER)
    return meet(answers, docs, mark, RESULT)
