"""Removal of repeated word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.keys import among, bucket_count, key_set, repeated_keys
from varienne.llm.store import renamed, total_bytes
from varienne.llm.text import Words, slices

WINDOW = 13


def covered(positions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of the positions."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, np.minimum(positions + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def runs_per_document(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of a mask that end at document bounds: document, first and end place in it."""
    if not mask.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(mask & (np.concatenate([[True], ~mask[:-1]]) | edge[:-1]))
    end = np.flatnonzero(mask & (np.concatenate([~mask[1:], [True]]) | edge[1:])) + 1
    doc = np.searchsorted(bounds, begin, "right") - 1
    return doc, begin - bounds[doc], end - bounds[doc]


def interval_lists(doc, start, end, n: int) -> pa.Array:
    """One Arrow list of (start, end) per document."""
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def window_keys(window: int):
    def keys(data, offsets):
        _, hashes, bounds = Words(data, offsets, seed=6).windows(window, seed=6)
        return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))

    return keys


def kept_text(words: Words, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, per document."""
    keep = ~removed
    starts, ends = words.starts[keep], words.ends[keep]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))[keep]
    joined = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 2, np.int8)
    edge[starts] += 1
    np.subtract.at(edge, ends + joined, 1)
    chosen = np.cumsum(edge, dtype=np.int8)[:len(data)] > 0
    out = data.copy()
    out[ends[joined]] = 0x20
    sizes = np.concatenate([[0], np.cumsum(chosen)])[offsets]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(out[chosen].tobytes()))


def cut(window: int):
    def run(batches):
        for batch in batches:
            ids, texts, found = batch.column(0), batch.column(1), batch.column(2)
            for row, data, offsets in slices(texts):
                n = len(offsets) - 1
                words = Words(data, offsets, seed=6)
                at, hashes, bounds = words.windows(window, seed=6)
                hit = np.zeros(len(hashes), bool)
                for d in range(n):
                    if found[row + d].is_valid and bounds[d] < bounds[d + 1]:
                        hit[bounds[d]:bounds[d + 1]] = among(hashes[bounds[d]:bounds[d + 1]], key_set(found[row + d]))
                removed = covered(at[hit], window, len(words.starts))
                spans = runs_per_document(removed, words.bounds)
                gone = np.concatenate([[0], np.cumsum(removed)])[words.bounds]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, n), pa.array(np.diff(words.bounds), pa.int64()), pa.array(np.diff(gone), pa.int64()),
                    interval_lists(*spans, n), kept_text(words, data, offsets, removed)], names=["id", "n_words", "n_removed", "removed", "kept_text"])

    return run


CUT = "id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose words also begin in a smaller id.

    Returns id_col, n_words, n_removed, removed (maximal intervals of word positions, end exclusive)
    and kept_text (the other words joined by one space), one row per input row.

    Every window gets a Rabin-Karp hash of its words, from prefix sums over a whole batch.  The 64-bit
    hashes are counted in buckets, where the smallest document of each is found; windows of other
    documents come back by document and merge into intervals.  A task ships one entry per hash, so a
    passage in a third of all documents weighs as many entries as there are tasks.  Two different
    windows share a hash with probability 2**-64; among n windows n**2 / 2**65 such pairs are expected.

    Words are runs of characters other than ASCII white space, unchanged.  Null or empty text: no words,
    empty kept_text.  Rows that repeat an id are one document: what only they share stays.  Null id:
    neither removes nor loses anything.  An empty table gives no rows.  Texts of any length are read whole, about a megabyte of them
    at a time or one longer text.  Other columns are ignored.
    """
    source = renamed(docs, id_col, text_col, to=("id", "text")).withColumn("id", F.col("id").cast("bigint"))
    buckets = bucket_count(docs.sparkSession, total_bytes(docs, text_col) * 8 // 6)
    found = repeated_keys(source, window_keys(window), buckets)
    out = source.join(found, "id", "left").select("id", "text", "keys").mapInArrow(cut(window), CUT)
    return out.withColumnRenamed("id", id_col)
