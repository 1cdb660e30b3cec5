"""Substring deduplication over bytes by a run-length index.

Which strings have to be compared is settled by anchors.  Every window of ``length``
bytes has one anchor: of its ``GRAM``-byte strings the one with the smallest hash.  Equal
windows have equal anchors, so windows are compared only below one anchor.  The windows
of one anchor occurrence together span a piece of text, its context.

1. Batches of documents send (anchor, context) hashes to groups.  An anchor seen once has
   no repeats; one whose contexts are all equal repeats in full; no text travels.
2. For other anchors one batch sends each distinct context.  A block of contexts gets a
   suffix array, the Burrows-Wheeler transform is cut into runs, and the length of the
   match with the neighbouring suffix is sampled at run heads and tails only.  Streaming
   over the text then gives the longest match at every position: between samples it
   falls by one a byte.  Matches of ``length`` or more mark their windows.
3. Anchors with more than ``CONTEXTS`` distinct contexts (frequent passages at their edges)
   would make one large block.  Their windows are dealt by their own full hash instead and
   counted; this is exact as well, and it has no key that grows with the corpus.

A byte is removed when a window covering it also starts anywhere else.  Equality of grams,
contexts and windows is that of 64-bit hashes; matches in blocks compare hashes of the
matched strings.  Null text is empty.  Ids may be null or repeat; rows are texts of their
own, so a repeated row repeats its windows.  Removed bytes may split a character: the kept
bytes are returned as binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm.exchange import (
    by_group, dealt, meet, pack_bits, rows_of, sorted_rows, text_bytes, unpack_bits,
)
from facetry.llm.kernels import (
    STEP, column_buffers, cover, id_array, ids_of, mix, prefix_sums, ragged, slices, span_hashes,
)

LENGTH = 400
GRAM = 32
CONTEXTS = 128
GROUP_ENTRIES = 50_000
GROUP_BYTES = 4 << 20
BLOCK_BYTES = 128 << 10
END = 0xFF  # in no UTF-8 text

NONE, REPEATED, ASK, GIVE, ASK_WINDOWS, GIVE_WINDOWS = range(6)
ENTRIES, PIECES, WINDOWS = range(3)

SENT = "grp int, batch int, kind int, keys binary, values binary, sizes binary, text binary"
SENT_ARROW = pa.schema([
    ("grp", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()),
    ("values", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()),
])
ANSWER = "batch int, kind int, grp int, bits binary"
ANSWER_ARROW = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("grp", pa.int32()), ("bits", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    m = len(values) - width + 1
    return np.minimum(out[:m], out[width - size : width - size + m])


class Part:
    """One slice of a batch: its bytes, and its anchor occurrences."""

    def __init__(self, batch: pa.RecordBatch, length: int, gram: int):
        self.rows = batch.num_rows
        self.data, self.offsets = column_buffers(batch.column("text"))
        n, empty = len(self.data), np.zeros(0, np.int64)
        self.first = self.last = self.anchor = empty
        self.keys = self.contexts = np.zeros(0, np.uint64)
        self.sums = prefix_sums(self.data.astype(np.uint64) + np.uint64(1))
        if n < length:
            return
        owner = np.repeat(np.arange(self.rows), np.diff(self.offsets))
        at = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
        if not len(at):
            return
        spots = np.arange(n - gram + 1)
        hashes = span_hashes(self.sums, spots, spots + gram)
        shift = np.uint64(max(20, n.bit_length()))
        ranked = (hashes >> shift << shift) | spots.astype(np.uint64)
        least = sliding_min(ranked, length - gram + 1)[at]
        anchor = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.anchor = at[begin], anchor[begin]
        self.last = at[np.append(begin[1:], len(at)) - 1]
        self.keys = hashes[self.anchor]
        self.contexts = mix(
            span_hashes(self.sums, self.first, self.last + length)
            + (self.anchor - self.first).astype(np.uint64) * STEP
        )

    def window_hashes(self, entries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner (index into ``entries``) and hash of every window of the given occurrences."""
        owner, step = ragged(self.last[entries] - self.first[entries] + 1)
        start = self.first[entries][owner] + step
        return owner, span_hashes(self.sums, start, start + length)


class Batch:
    """A batch's parts and its distinct (anchor, context) entries in sorted order."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.rows = sorted_rows(table)
        self.number = table.column("batch")[0].as_py() if table.num_rows else 0
        self.parts = [Part(p, length, gram) for p in slices(self.rows)]
        join = lambda name: np.concatenate([getattr(p, name) for p in self.parts] or [np.zeros(0, np.uint64)])
        keys, contexts = join("keys"), join("contexts")
        order = np.lexsort((contexts, keys))
        new = np.ones(len(order), bool)
        k, c = keys[order], contexts[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        index = np.cumsum(new) - 1
        self.keys, self.contexts = k[new], c[new]
        self.counts = np.bincount(index, minlength=len(self.keys))
        self.entry = np.empty(len(order), np.int64)  # entry of each occurrence, over all parts
        self.entry[order] = index
        # One occurrence that stands for each entry: part and index in it.
        sizes = np.array([len(p.keys) for p in self.parts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)]) if len(sizes) else np.zeros(1, np.int64)
        sample = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        self.part = np.searchsorted(self.base, sample, "right") - 1
        self.local = sample - self.base[self.part] if len(order) else order

    def pieces(self, entries: np.ndarray, length: int):
        """Text, and (anchor distance, number of windows) of the entries' contexts, in order."""
        text, left, count = [], [], []
        for p, i in zip(self.part[entries].tolist(), self.local[entries].tolist()):
            part = self.parts[p]
            a, b = part.first[i], part.last[i]
            text.append(part.data[a : b + length].tobytes())
            left.append(part.anchor[i] - a)
            count.append(b - a + 1)
        return text, np.array(left, np.int64), np.array(count, np.int64)

    def windows(self, entries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner and hash of every window of the entries."""
        owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for p in range(len(self.parts)):
            own = np.flatnonzero(self.part[entries] == p)
            if len(own):
                o, h = self.parts[p].window_hashes(self.local[entries[own]], length)
                owners.append(own[o])
                hashes.append(h)
        return np.concatenate(owners), np.concatenate(hashes)


def groups_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def by_part(group: np.ndarray):
    """(group, positions) in ascending order of group, positions in their given order."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(group[order[a]]), order[a:b]


def classify(keys, contexts, counts, batches, most: int) -> np.ndarray:
    """Status of each (anchor, context, batch) entry of a group."""
    order = np.lexsort((batches, contexts, keys))
    k, c = keys[order], contexts[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    key_index, index = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    per_key = np.bincount(key_index, counts[order])
    per_context = np.bincount(index, counts[order])
    distinct = np.bincount(key_index[new])[key_index]
    repeated = per_context[index] > 1
    status = np.where(repeated, REPEATED, NONE)
    mixed = (distinct > 1) & (per_key[key_index] > 1) & new  # the first batch speaks for a context
    few = distinct <= most
    status = np.where(mixed & few, np.where(repeated, GIVE, ASK), status)
    status = np.where(mixed & ~few, np.where(repeated, GIVE_WINDOWS, ASK_WINDOWS), status)
    out = np.empty(len(k), np.uint8)
    out[order] = status
    return out


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``longest`` bytes at least."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    width = 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.zeros(n, np.uint64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new) + np.uint64(1)
        if width >= longest or int(rank[order[-1]]) == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: max(0, n - width)] = rank[width:]
        key = (rank << np.uint64(32)) | after
        width *= 2


def common_prefix(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by bisection on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = span_hashes(sums, x, x + middle) == span_hashes(sums, y, y + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


def longest_matches(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest match with another place of the block at each position, and the pieces' starts."""
    text = np.frombuffer(b"".join(p + bytes([END]) for p in pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    end = np.repeat(starts + sizes, sizes + 1)
    n = len(text)
    order = suffix_array(text, int(sizes.max()) + 1)
    before = text[order - 1]  # the transform: the byte before each suffix
    change = np.ones(n + 1, bool)
    change[1:n] = before[1:] != before[:-1]
    change[1:n] |= (before[1:] == END) | (before[:-1] == END)  # a match cannot have begun before its piece
    heads = np.flatnonzero(change[:n])
    tails = np.flatnonzero(change[1:])
    sums = prefix_sums(text.astype(np.uint64) + np.uint64(1))
    reach = np.zeros(n, np.int64)
    for at, beside in ((heads[heads > 0], -1), (tails[tails < n - 1], 1)):
        a, b = order[at], order[at + beside]
        match = common_prefix(sums, a, b, np.minimum(end[a] - a, end[b] - b))
        np.maximum.at(reach, a, a + match)
    # Streaming: a match reaches as far as any match that began before it.
    farthest = np.maximum.accumulate(reach)
    return np.maximum(np.minimum(farthest, end) - np.arange(n), 0), starts


def repeated_windows(keys: np.ndarray, pieces: list[bytes], counts: np.ndarray, length: int, block: int):
    """Per piece, which of its windows repeat; blocks hold whole anchors."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pieces)
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(p) for p in pieces], np.int64)[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    cuts, load = [0], 0
    for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(order)]):
        size = int(sizes[a:b].sum())
        if load and load + size > block:
            cuts.append(a)
            load = 0
        load += size
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        match, starts = longest_matches([pieces[i] for i in order[a:b]])
        for i, start in zip(order[a:b].tolist(), starts.tolist()):
            out[i] = match[start : start + counts[i]] >= length
    return out


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = CONTEXTS,
    group_entries: int = GROUP_ENTRIES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row."""
    size = text_bytes(docs)
    docs = dealt(docs, size)
    n_groups = max(1, 2 * size // (length - gram) // group_entries)
    n_blocks = max(1, size // group_bytes)

    def send_entries(table: pa.Table) -> pa.Table:
        batch, out = Batch(table, length, gram), {f.name: [] for f in SENT_ARROW}
        for group, at in by_part(groups_of(batch.keys, n_groups)):
            add(out, group, batch.number, ENTRIES, batch.keys[at], batch.contexts[at],
                np.minimum(batch.counts[at], 2).astype(np.uint8))
        return rows_of(out, SENT_ARROW)

    def answer_entries(table: pa.Table) -> pa.Table:
        keys, contexts, counts = arrays(table, np.uint64, np.uint64, np.uint8)
        sizes = [len(k) for k in keys]
        number = table.column("batch").to_numpy()
        status = classify(
            np.concatenate(keys), np.concatenate(contexts), np.concatenate(counts), np.repeat(number, sizes), most
        )
        ends = np.cumsum(sizes).tolist()
        bits = [status[e - n : e].tobytes() for e, n in zip(ends, sizes)]
        return rows_of({"batch": number, "kind": [ENTRIES] * len(bits), "grp": table.column("grp").to_numpy(),
                        "bits": bits}, ANSWER_ARROW)

    def statuses(batch: Batch, answers: pa.Table) -> np.ndarray:
        bits = {g: b for k, g, b in answer_rows(answers) if k == ENTRIES}
        out = np.zeros(len(batch.keys), np.uint8)
        for group, at in by_part(groups_of(batch.keys, n_groups)):
            out[at] = np.frombuffer(bits[group], np.uint8)
        return out

    def send_text(answers: pa.Table, table: pa.Table) -> pa.Table:
        batch, out = Batch(table, length, gram), {f.name: [] for f in SENT_ARROW}
        status = statuses(batch, answers)
        own = np.flatnonzero((status == ASK) | (status == GIVE))
        for group, at in by_part(groups_of(batch.keys[own], n_blocks)):
            text, _, count = batch.pieces(own[at], length)
            asked = np.where(status[own[at]] == ASK, count, 0)
            add(out, group, batch.number, PIECES, batch.keys[own[at]], asked, count, b"".join(text))
        own = np.flatnonzero((status == ASK_WINDOWS) | (status == GIVE_WINDOWS))
        _, hashes = batch.windows(own, length)
        hashes, n = np.unique(hashes, return_counts=True)
        for group, at in by_part(groups_of(hashes, n_blocks)):
            add(out, group, batch.number, WINDOWS, hashes[at], np.minimum(n[at], 2).astype(np.uint8), np.zeros(0))
        return rows_of(out, SENT_ARROW)

    def answer_text(table: pa.Table) -> pa.Table:
        out = {f.name: [] for f in ANSWER_ARROW}
        kinds = table.column("kind").to_numpy()
        for kind in (PIECES, WINDOWS):
            own = table.take(pa.array(np.flatnonzero(kinds == kind)))
            if not own.num_rows:
                continue
            number, group = own.column("batch").to_pylist(), own.column("grp").to_pylist()
            if kind == PIECES:
                keys, asked, count = arrays(own, np.uint64, np.int64, np.int64)
                sizes = [len(k) for k in keys]
                cut = [np.concatenate([[0], np.cumsum(c + length - 1)]) for c in count]
                pieces = [
                    raw[a:b] for raw, c in zip(own.column("text").to_pylist(), cut)
                    for a, b in zip(c[:-1].tolist(), c[1:].tolist())
                ]
                asked = np.concatenate(asked)
                found = repeated_windows(
                    np.concatenate(keys), pieces, np.concatenate(count), length, BLOCK_BYTES
                )
                ends = np.cumsum(sizes).tolist()
                bits = [
                    pack_bits(np.concatenate([f for f, n in zip(found[e - s : e], asked[e - s : e]) if n] or [np.zeros(0, bool)]))
                    for e, s in zip(ends, sizes)
                ]
            else:
                keys, counts, _ = arrays(own, np.uint64, np.uint8, np.int64)
                sizes = [len(k) for k in keys]
                _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                again = np.bincount(inverse, np.concatenate(counts))[inverse] > 1
                ends = np.cumsum(sizes).tolist()
                bits = [pack_bits(again[e - s : e]) for e, s in zip(ends, sizes)]
            out["batch"] += number
            out["grp"] += group
            out["kind"] += [kind] * len(number)
            out["bits"] += bits
        return rows_of(out, ANSWER_ARROW)

    def mark(answers: pa.Table, table: pa.Table) -> pa.Table:
        batch = Batch(table, length, gram)
        status = statuses(batch, answers)
        bits = {(k, g): b for k, g, b in answer_rows(answers)}
        # Windows that repeat, per entry: all, or by the answers' bits.
        whole = np.isin(status, (REPEATED, GIVE, GIVE_WINDOWS))
        some: dict[int, np.ndarray] = {}
        own = np.flatnonzero((status == ASK) | (status == GIVE))
        for group, at in by_part(groups_of(batch.keys[own], n_blocks)):
            entries = own[at]
            entries = entries[status[entries] == ASK]
            counts = [int(batch.parts[p].last[i] - batch.parts[p].first[i] + 1)
                      for p, i in zip(batch.part[entries].tolist(), batch.local[entries].tolist())]
            flags, done = unpack_bits(bits[PIECES, group], sum(counts)), 0
            for e, n in zip(entries.tolist(), counts):
                some[e] = flags[done : done + n]
                done += n
        own = np.flatnonzero((status == ASK_WINDOWS) | (status == GIVE_WINDOWS))
        owner, hashes = batch.windows(own, length)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        again = np.zeros(len(distinct), bool)
        for group, at in by_part(groups_of(distinct, n_blocks)):
            again[at] = unpack_bits(bits[WINDOWS, group], len(at))
        flags = again[inverse]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(own) + 1))
        for j, e in enumerate(own.tolist()):
            if status[e] == ASK_WINDOWS:
                some[e] = flags[order[cuts[j] : cuts[j + 1]]]
        asked = np.zeros(len(batch.keys), bool)
        asked[list(some)] = True
        doc, base, out = ids_of(batch.rows.column("doc_id")), 0, []
        for p, part in enumerate(batch.parts):
            entry = batch.entry[batch.base[p] : batch.base[p + 1]]
            full = np.flatnonzero(whole[entry])
            steps = np.zeros(len(part.data) + 1, np.int32)
            np.add.at(steps, part.first[full], 1)
            np.add.at(steps, part.last[full] + length, -1)
            removed = np.cumsum(steps[:-1]) > 0
            hits = [part.first[i] + np.flatnonzero(some[e]) for i in np.flatnonzero(asked[entry]).tolist()
                    for e in (int(entry[i]),)]
            if hits:
                removed |= cover(len(part.data), np.concatenate(hits), length)
            out.append(result_of(part, removed, doc[base : base + part.rows]))
            base += part.rows
        return pa.concat_tables(out) if out else RESULT_ARROW.empty_table()

    first = by_group(by_group(docs, "batch", send_entries, SENT), "grp", answer_entries, ANSWER)
    second = by_group(meet(first, docs, send_text, SENT), "grp", answer_text, ANSWER)
    return meet(first.unionByName(second), docs, mark, RESULT)


RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept", pa.binary()),
])


def result_of(part: Part, removed: np.ndarray, doc: np.ndarray) -> pa.Table:
    sums = np.concatenate([[0], np.cumsum(removed)])
    begin = removed.copy()
    begin[1:] &= ~removed[:-1]
    edge = part.offsets[:-1][np.diff(part.offsets) > 0]
    begin[edge] = removed[edge]
    spans = np.concatenate([[0], np.cumsum(begin)])
    n_bytes = np.diff(part.offsets)
    n_removed = np.diff(sums[part.offsets])
    kept = np.ascontiguousarray(part.data[~removed])
    offsets = np.concatenate([[0], np.cumsum(n_bytes - n_removed)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
    ).cast(pa.binary())
    return pa.table(
        [id_array(doc), pa.array(n_bytes), pa.array(n_removed), pa.array(np.diff(spans[part.offsets])), column],
        schema=RESULT_ARROW,
    )


def add(out: dict, group: int, batch: int, kind: int, keys, values, sizes, text: bytes = b"") -> None:
    row = (group, batch, kind, keys.tobytes(), values.tobytes(), sizes.tobytes(), text)
    for column, value in zip(out.values(), row):
        column.append(value)


def arrays(table: pa.Table, *kinds) -> list[list[np.ndarray]]:
    return [
        [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        for name, kind in zip(("keys", "values", "sizes"), kinds)
    ]


def answer_rows(answers: pa.Table):
    return zip(*(answers.column(c).to_pylist() for c in ("kind", "grp", "bits")))
