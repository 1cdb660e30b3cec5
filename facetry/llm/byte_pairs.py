"""Byte-pair encoding by forced boundaries, and decoding.

A pair of bytes that stands inside no token of the vocabulary can never be merged, so a
text may be cut between the two and its pieces encoded apart.  Forced boundaries are
looked up for all bytes of a batch at once.  Those between a character and white space
after it end a word of the tokenizer too, so nothing outside such a fragment matters to
it.  Fragments of plain letters, digits and signs are cut at all their forced boundaries
and where one kind ends; in others the tokenizer finds the words first.  Each distinct
piece goes through the tokenizer's merges once, and a text's ids are those of its pieces
end to end.

Strings of special tokens become their ids, as the tokenizer does, and are never cut.
Null and empty texts have no ids and decode to the empty text; ids outside the vocabulary
decode to nothing.  Every row gives a row, repeated ones too; other columns are ignored.
Pieces are told apart by 64-bit hashes within a worker.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from facetry.llm.kernels import (
    WHITE, column_buffers, id_array, ids_of, prefix_sums, ragged, scan, span_hashes,
)
from facetry.session import ship_package

TOKENIZER = "byte_bpe_50k.json"
CACHE_PIECES = 400_000
#: Bytes of a piece up to which it is kept for other texts.
CACHE_BYTES = 256

#: Kinds of bytes in words that need no Unicode tables: letters, digits and signs but the apostrophe.
#: Two-byte characters from U+00C0 to U+024F count as letters, but for two signs among them.
OTHER, ALPHA, DIGIT, SIGN = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[ord("'")] = OTHER
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123)]] = ALPHA

#: Bytes that end a character other than white space: ASCII here; of two bytes, see `cuts`.
SOLID = ~WHITE
SOLID[[*range(28, 32), *range(128, 256)]] = False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, and the pairs of bytes that no token holds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        tokens = {i: t for t, i in stored["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        never = np.ones(1 << 16, bool)
        size = max([*tokens, *self.special.values()]) + 1
        self.raw = [b""] * size
        for i, token in tokens.items():
            raw = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            self.raw[i] = raw
            held = np.frombuffer(raw, np.uint8).astype(np.int64)
            never[held[:-1] * 256 + held[1:]] = False
        for token, i in self.special.items():
            self.raw[i] = token.encode()
        self.never = never
        self.letters = letters
        self.written = {b: c for c, b in letters.items()}
        self.lengths = np.array([len(r) for r in self.raw] + [0])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)


class FragmentEncoder:
    """Token ids of whole texts from those of their pieces."""

    def __init__(self, path: str, words: Vocabulary):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = words
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(n.encode()) for n in names)) if names else None
        self.pieces: dict[int, bytes] = {}

    def special_places(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        raw = data.tobytes()
        if self.special is None or not self.special.search(raw):
            return []
        return [
            (a + found.start(), a + found.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            for found in self.special.finditer(raw[a:b])
        ]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of the pieces of all texts, laid end to end, and which of them are whole words or less.

        The others are fragments whose words only the tokenizer knows.
        """
        size = len(data)
        starts = np.zeros(size, bool)
        starts[offsets[:-1][offsets[:-1] < size]] = True
        following = np.append(data[1:], np.uint8(0))
        lead = ((data >= 0xC3) & (data <= 0xC8)) | ((data == 0xC9) & (following < 0x90))
        lead &= ~((data == 0xC3) & ((following == 0x97) | (following == 0xB7)))
        latin = lead.copy()
        latin[1:] |= lead[:-1]
        kind = np.where(latin, np.uint8(ALPHA), KIND[data])
        apart = np.zeros(size, bool)
        apart[1:] = self.vocabulary.never[data[:-1].astype(np.int64) * 256 + data[1:]]
        solid = SOLID[data] | latin
        starts[1:] |= solid[:-1] & WHITE[data[1:]] & apart[1:]
        plain = kind != OTHER
        # One space may lead a word.
        plain |= starts & (data == 32)
        for begin, end in self.special_places(data, offsets):
            starts[begin + 1 : end] = False
            starts[begin] = True
            plain[begin] = False
            if end < size:
                starts[end] = True
        first = np.flatnonzero(starts)
        whole = np.logical_and.reduceat(plain, first) if size else np.zeros(0, bool)
        inner = np.repeat(whole, np.diff(np.append(first, size)))
        inner[1:] &= apart[1:] | ((kind[1:] != kind[:-1]) & (data[:-1] != 32))
        inner[:1] = False
        places = np.flatnonzero(starts | inner)
        return places, np.repeat(whole, np.diff(np.append(first, size)))[places]

    def merge(self, letters: str) -> list[int]:
        """Ids of a piece that holds no forced boundary."""
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def encode_piece(self, raw: bytes, whole: bool) -> bytes:
        letters = raw.decode("latin-1").translate(self.vocabulary.written)
        if whole:
            return array("i", self.merge(letters)).tobytes()
        if self.special is not None and self.special.fullmatch(raw):
            return array("i", [self.vocabulary.special[raw.decode()]]).tobytes()
        ends, at = set(), 0
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(raw.decode("utf-8", "replace")):
            at += len(word)
            ends.add(at)
        held = np.frombuffer(raw, np.uint8).astype(np.int64)
        ends.update((np.flatnonzero(self.vocabulary.never[held[:-1] * 256 + held[1:]]) + 1).tolist())
        ids, begin = [], 0
        for end in sorted(ends):
            ids += self.merge(letters[begin:end])
            begin = end
        return array("i", ids).tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        starts, whole = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
        hashes, first, inverse = np.unique(
            span_hashes(sums, starts, ends) ^ whole, return_index=True, return_inverse=True
        )
        raw, known, parts = data.tobytes(), self.pieces, []
        for key, a, b, plain in zip(*(x.tolist() for x in (hashes, starts[first], ends[first], whole[first]))):
            ids = known.get(key)
            if ids is None:
                ids = self.encode_piece(raw[a:b], plain)
                if b - a <= CACHE_BYTES:
                    known[key] = ids
            parts.append(ids)
        if len(known) > CACHE_PIECES:
            self.pieces = {}
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        piece, step = ragged(each)
        owner = np.searchsorted(offsets, starts, "right") - 1
        return flat[begin[inverse][piece] + step], np.bincount(owner, each, rows).astype(np.int64)


#: One per tokenizer file and worker process: the caches serve many tasks.
_encoders: dict[str, FragmentEncoder] = {}
_vocabularies: dict[str, Vocabulary] = {}


def encoder(path: str) -> FragmentEncoder:
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path, vocabulary(path))
    return _encoders[path]


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _encoded(path: str, texts: pa.Array) -> pa.ListArray:
    ids, sizes = encoder(path).encode(*column_buffers(texts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))


def _decoded(path: str, lists: pa.ListArray) -> pa.Array:
    words = vocabulary(path)
    ids = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    ids = np.where((ids >= 0) & (ids < len(words.raw)), ids, len(words.raw))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    token, step = ragged(words.lengths[ids])
    raw = words.flat[words.starts[ids][token] + step].tobytes()
    ends = np.append(0, np.cumsum(words.lengths[ids]))[np.append(0, np.cumsum(sizes))].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every document."""
    path = tokenizer_path or default_path()

    def work(batch):
        lists = _encoded(path, batch.column("text"))
        yield pa.RecordBatch.from_arrays([id_array(ids_of(batch.column("doc_id"))), lists], ["doc_id", "ids"])

    return scan(docs, ["doc_id", "text"], work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: the text that the ids stand for."""
    path = tokenizer_path or default_path()
    ship_package(encoded.sparkSession)

    def work(batches):
        for batch in batches:
            lists = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, _decoded(path, lists)], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: every document encoded and decoded again, in one pass of one worker."""
    path = tokenizer_path or default_path()

    def work(batch):
        lists = _encoded(path, batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [id_array(ids_of(batch.column("doc_id"))), lists, _decoded(path, lists)], ["doc_id", "ids", "text"]
        )

    return scan(docs, ["doc_id", "text"], work, "doc_id long, ids array<int>, text string")
