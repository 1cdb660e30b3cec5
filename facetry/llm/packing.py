"""Best-fit packing of token pieces, certified by lower bounds.

Documents become token ids followed by one end id; longer ones are cut into pieces of
``CAPACITY``.  Pieces are dealt by hash into groups of about ``GROUP_PIECES``; each group
runs best-fit decreasing and compares its number of sequences with lower bounds from
dual-feasible functions.  Equality certifies the group.  Groups with a gap give their
sequences that are not full into a pool with other such groups, which runs best-fit
decreasing again; the new packing is taken where it needs fewer sequences.

Ids come from the tokenizer word by word: it drops white space and never looks across
it, so each distinct word of a batch is encoded once.

Null and empty texts are one piece with the end id.  Repeated rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.kernels import (
    LOWER, WHITE, column_buffers, id_array, ids_of, keep, positions, ragged, scan, word_hashes,
)

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 16_384
POOLED_GROUPS = 8
ROUNDS = 2
CACHE_WORDS = 800_000
TOKENIZER = "word_bpe_49k.json"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
CLOSING = np.zeros(256, bool)
CLOSING[[ord("."), ord(",")]] = True
MARK = "\x01"


class WordEncoder:
    """Token ids of whole texts from a cache of words.

    The tokenizer ends a token before and after white space, and between an ASCII letter
    and a following last "." or ",".  It lower-cases, so ASCII case is dropped first (but
    for texts that spell out a special token, where case counts).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.cache: dict[int, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; many words go through one call, told apart by a mark."""
        if len(self.mark) != 1 or any(MARK in w for w in words):
            found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return [np.array(e.ids, np.uint32).tobytes() for e in found]
        out: list[bytes] = []
        joint = f" {MARK} "
        texts = [joint.join(words[at : at + 512]) for at in range(0, len(words), 512)]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, np.uint32)
            begin = 0
            for end in np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist():
                out.append(ids[begin:end].tobytes())
                begin = end + 1
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        rows = len(offsets) - 1
        if b"<|" not in data.tobytes():
            data = LOWER[data]
        last = np.append(WHITE[data[1:]], True) if len(data) else np.zeros(0, bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True
        cuts = np.flatnonzero(CLOSING[data[1:]] & ASCII_LETTER[data[:-1]] & last[1:]) + 1
        starts, ends, owner = positions(offsets, data, cuts=cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        hashes, first, inverse = np.unique(
            word_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        cache, keys = self.cache, hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in cache]
        raw = data.tobytes()
        words = [raw[starts[first[i]] : ends[first[i]]].decode("utf-8", "replace") for i in new]
        cache.update(zip((keys[i] for i in new), self.encode_words(words)))
        parts = [cache[h] for h in keys]
        if len(cache) > CACHE_WORDS:
            self.cache = {}
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(sizes) - sizes
        per_word = sizes[inverse]
        word, step = ragged(per_word)
        ids = flat[begin[inverse][word] + step]
        return ids, np.bincount(owner, per_word, rows).astype(np.int64)


#: One encoder per tokenizer file and worker process: its cache serves many tasks.
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    def work(batch):
        ids, sizes = encoder(path).encode(*column_buffers(batch.column("text")))
        doc = ids_of(batch.column("doc_id"))
        at, rows = 0, []
        for row, size in enumerate(sizes.tolist()):
            own = np.append(ids[at : at + size], np.uint32(END_ID)).astype("<u4")
            at += size
            for piece, start in enumerate(range(0, size + 1, capacity)):
                part = own[start : start + capacity]
                rows.append((row, piece, start, len(part), zlib.crc32(part.tobytes())))
        row, *rest = np.array(rows, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays(
            [id_array(doc[row]), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return scan(docs, ["doc_id", "text"], work, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by best-fit decreasing.

    Bins are kept in lists by free space; a bit per non-empty list finds the tightest fit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, mask, n = [], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            target = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            target, space = n, capacity
            filled.append(0)
            n += 1
        bins[i], offsets[i] = target, filled[target]
        filled[target] += size
        left = space - size
        if left:
            free[left].append(target)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    Both map lengths so that whatever fits into a bin still sums to one bin at most.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    number, weight = np.cumsum(count), np.cumsum(count * x)
    # Lengths over capacity - e count whole, those under e not at all.
    e = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - e]
    middle = weight[capacity - e] - np.where(e > 0, weight[np.maximum(e - 1, 0)], 0)
    best = int(np.max(big + -(-middle // capacity)))
    # Lengths are rounded down to multiples of 1/k, exact multiples of 1/(k + 1) stay.
    for k in range(1, 31):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        value = np.where(exact, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def _pack_group(frame: pd.DataFrame, turn: int, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "piece", "ids_crc32", "start"], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy(np.int64)
    bins, offsets = best_fit(lengths, capacity)
    group = int(frame["_group"].iloc[0])
    n = int(bins.max()) + 1
    if turn == 0 or n < frame["sequence_id"].nunique():
        frame["sequence_id"] = (turn << 56) + (group << 28) + bins
        frame["offset"] = offsets
    else:
        n = frame["sequence_id"].nunique()
    full = frame.groupby("sequence_id")["length"].transform("sum") == capacity
    frame["_open"] = ~full & (n > lower_bound(lengths, capacity))
    return frame


def _packer(turn: int, capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(frame, turn, capacity)

    return pack


def pack_pieces(
    pieces: DataFrame, group_pieces: int = GROUP_PIECES, capacity: int = CAPACITY, rounds: int = ROUNDS,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``PIECE_SCHEMA``."""
    pieces = keep(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = PIECE_SCHEMA + ", sequence_id long, offset long, _open boolean, _group long"
    state = pieces.withColumns({
        "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "_open": F.lit(True),
    })
    done = []
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    for turn in range(rounds + 1):
        pool = F.floor(dealt / POOLED_GROUPS**turn)
        state = keep(
            state.withColumn("_group", pool.cast("long")).groupBy("_group").applyInPandas(_packer(turn, capacity), schema)
        )
        done.append(state.where(~F.col("_open")))
        state = state.where("_open").drop("_group")
        if groups <= POOLED_GROUPS**turn:
            break
    done.append(state.withColumn("_group", F.lit(0).cast("long")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("_open", "_group")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    return pack_pieces(token_pieces(docs, tokenizer_path))
