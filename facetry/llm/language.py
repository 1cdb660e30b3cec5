"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (lengths 1 to 3 inside words, words
marked by a boundary), of unit length.  Per language, spherical k-means over a bounded
sample gives ``CLUSTERS`` centroids; a text gets the language of the centroid with the
largest cosine.  The distance to it decides about rejection: beyond the ``REJECT``
quantile of the training distances of that language the row is flagged ``rejected``.
Document frequencies are counted over all training documents; the centroids use at
most ``SAMPLE_ROWS`` texts of each language, in the order of a hash of their id.  Only
ids whose hash is below a threshold are ranked: it lets about ``SPARE * SAMPLE_ROWS``
distinct ids of a language through, however many there are.  Of the texts of one id and
language the least is learnt from.

Null texts and texts without a letter get ``und`` and score 0.  Without training rows
every text gets ``und``.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.kernels import LOWER, NOT_WORD, column_buffers, scan
from facetry.llm.toxicity import fold

BITS = 12
DIMENSIONS = 1 << BITS
SAMPLE_ROWS = 1_500
SPARE = 4
BLOCK_ROWS = 512
CLUSTERS = 3
REJECT = 0.999
TURNS = 12

NO_LETTER = NOT_WORD.copy()
NO_LETTER[48:58] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x DIMENSIONS matrix of n-gram counts."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((rows, DIMENSIONS), np.float32)
    low = LOWER[data].astype(np.uint32)
    low[NO_LETTER[data]] = 0
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.zeros(rows * DIMENSIONS, np.float32)
    code = np.zeros(len(low), np.uint32)
    for n in (1, 2, 3):
        m = len(low) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + low[n - 1 :]
        # A gram stays in one row and is not a run of separators only.
        ok = (owner[:m] == owner[n - 1 :]) & (low[n - 1 :] + low[:m] > 0)
        slot = ((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(32 - BITS)).astype(np.int64)
        total += np.bincount(
            (owner[:m] * DIMENSIONS + slot)[ok], minlength=len(total)
        ).astype(np.float32)
    return total.reshape(rows, DIMENSIONS)


def count_blocks(data: np.ndarray, offsets: np.ndarray):
    """First row and counts of every ``BLOCK_ROWS`` rows, so that short texts make no large matrix."""
    for row in range(0, len(offsets) - 1, BLOCK_ROWS):
        cut = offsets[row : row + BLOCK_ROWS + 1]
        yield row, counts(data[cut[0] : cut[-1]], cut - cut[0])


def vectors(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(matrix) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter, by Unicode where a row has no ASCII one."""
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), out=letters[1:])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for row in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        found[row] = any(c.isalpha() for c in text)
    return found


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """IDF, centroids, their languages and their rejection distances from (doc_id, text, lang)."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequency(batch):
        seen = np.zeros(DIMENSIONS, np.int64)
        for _, block in count_blocks(*column_buffers(batch.column("text"))):
            seen += (block > 0).sum(0)
        slots = np.append(np.arange(DIMENSIONS), DIMENSIONS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.append(seen, batch.num_rows))], ["slot", "n"]
        )

    df = np.zeros(DIMENSIONS + 1)
    for row in (
        scan(rows, ["text"], frequency, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    ).collect():  # one row per slot: bounded
        df[row["slot"]] = row["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    # Only texts below the threshold travel; of those, ids are ranked first.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_ids"))  # a row per language
    order = F.xxhash64("doc_id")
    share = (order / F.lit(2.0**64)) + 0.5  # the hash on a scale of 0 to 1
    low = (
        rows.select("doc_id", "lang", "text", order.alias("_order"), share.alias("_share"))
        .join(F.broadcast(sizes), "lang")
        .where(F.col("_share") * F.col("_ids") <= SPARE * SAMPLE_ROWS)
    )
    sample_ids = (
        low.select("doc_id", "lang", "_order").distinct()
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id")))
        .where(F.col("_rank") <= SAMPLE_ROWS).select("doc_id", "lang")
    )
    # The ids are distinct; a semi join would be pushed below the threshold and move every text.
    sample = low.join(sample_ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(
        F.min("text").alias("text")
    )

    def vector(batch):
        for row, block in count_blocks(*column_buffers(batch.column("text"))):
            cut = batch.slice(row, len(block))
            yield pa.RecordBatch.from_arrays(
                [cut.column("doc_id"), cut.column("lang"),
                 pa.array([v.tobytes() for v in vectors(block, idf)], pa.binary())],
                ["doc_id", "lang", "vector"],
            )

    # A vector has one size, whatever its text's; so has the sample of a language.
    sampled = scan(sample, ["doc_id", "lang", "text"], vector, "doc_id long, lang string, vector binary")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        x = np.frombuffer(b"".join(frame["vector"]), np.float32).reshape(len(frame), DIMENSIONS)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "limit": []})
        picked = [int(np.argmax(x @ x.mean(0)))]
        while len(picked) < min(CLUSTERS, len(x)):  # farthest first
            picked.append(int(np.argmin((x @ x[picked].T).max(1))))
        centers = x[picked]
        for _ in range(TURNS):
            nearest = (x @ centers.T).argmax(1)
            centers = np.stack([
                x[nearest == k].mean(0) if (nearest == k).any() else centers[k] for k in range(len(centers))
            ])
            centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        limit = float(np.quantile(1 - (x @ centers.T).max(1), REJECT))
        return pd.DataFrame({
            "lang": frame["lang"].iloc[0], "centroid": list(centers.astype(np.float32)), "limit": limit,
        })

    found = sampled.groupBy("lang").applyInPandas(
        cluster, "lang string, centroid array<float>, limit double"
    ).collect()  # CLUSTERS rows per language
    found.sort(key=lambda r: (r["lang"], list(r["centroid"])))
    centers = np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMENSIONS)
    return idf, centers, [r["lang"] for r in found], np.array([r["limit"] for r in found])


def identify(docs: DataFrame, model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row; the score is (1 + cosine) / 2."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        idf, centers, names, limits = shared.value
        data, offsets = column_buffers(batch.column("text"))
        ok = has_letter(data, offsets)
        lang = np.full(batch.num_rows, "und", object)
        score = np.zeros(batch.num_rows)
        rejected = np.ones(batch.num_rows, bool)
        if len(names):
            best, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, block in count_blocks(data, offsets):
                cosine = vectors(block, idf) @ centers.T
                best[row : row + len(block)] = cosine.argmax(1)
                top[row : row + len(block)] = cosine.max(1)
            lang[ok] = np.array(names, object)[best[ok]]
            score[ok] = np.clip((1 + top[ok]) / 2, 0, 1)
            rejected[ok] = 1 - top[ok] > limits[best[ok]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return scan(docs, ["doc_id", "text"], work, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_language(docs: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the folds other than ``held_out``, predict every row.

    Rows without an id are never learnt from and count as held out.
    """
    learn = docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), parts) != held_out)
    return identify(docs, train(learn)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(True)).alias("held_out"),
        "lang_pred", "score", "rejected",
    )
