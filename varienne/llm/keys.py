"""Which 64-bit keys occur in more than one document, and which document is the first to have each.

Keys travel packed: one row holds thousands of them, so a shuffle moves little more than eight
bytes per distinct key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varienne.llm.text import slices

#: Keys that a task gathers before it removes repeats and ships them.
FLUSH_KEYS = 2_000_000
#: Bytes of keys that one bucket should hold.
BUCKET_BYTES = 16 << 20

PACKED = "bucket int, final boolean, docs binary, counts binary, keys binary"
ROUTED = "bucket int, docs binary, counts binary, keys binary"


def bucket_count(spark, key_bytes: int) -> int:
    """Buckets for so many bytes of keys: about 16 MB each, and work for every shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), key_bytes // BUCKET_BYTES + 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _grouped(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents, their key counts, and the keys in that order."""
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    at = _runs(docs)
    return docs[at], np.diff(np.append(at, len(docs))), keys


def _by_key(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and keys sorted by key; first place and smallest document of every key."""
    order = np.argsort(keys, kind="stable")
    docs, keys = docs[order], keys[order]
    at = _runs(keys)
    return docs, keys, at, np.minimum.reduceat(docs, at) if len(at) else docs


def _reported(docs, keys, at, owner, owners_too: bool):
    """(document, key) of keys that several documents hold: all of them, or only the later ones."""
    repeat = np.diff(np.append(at, len(keys)))
    later = docs > np.repeat(owner, repeat)
    if owners_too:
        later = np.repeat(np.logical_or.reduceat(later, at), repeat) if len(at) else later
    return docs[later], keys[later]


def _routed(docs: np.ndarray, keys: np.ndarray, buckets: int):
    """(bucket, documents, counts, keys) with a bucket per document."""
    d, n, k = _grouped(docs, keys)
    to = ((d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    first = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(to, kind="stable")
    for part in np.split(order, _runs(to[order])[1:]) if len(d) else []:
        yield int(to[part[0]]), d[part], n[part], np.concatenate([k[first[i]:first[i + 1]] for i in part])


def _blobs(rows: list) -> list[pa.Array]:
    """Arrow columns of (documents, counts, keys); ids as differences, which compress well."""
    return [pa.array([np.diff(x[0], prepend=0).tobytes() for x in rows], pa.binary()), pa.array([x[1].astype(np.uint32).tobytes() for x in rows], pa.binary()),
            pa.array([x[2].tobytes() for x in rows], pa.binary())]


def _opened(docs, counts, keys) -> tuple[np.ndarray, np.ndarray]:
    """The document of every key, and the keys."""
    d = np.cumsum(np.frombuffer(docs.as_buffer(), np.int64))
    return np.repeat(d, np.frombuffer(counts.as_buffer(), np.uint32)), np.frombuffer(keys.as_buffer(), np.uint64)


def pack(key_function, buckets: int, owners_too: bool, flush: int = FLUSH_KEYS):
    """Function for ``mapInArrow``: id and text to packed keys.

    Of the documents a task has gathered only the smallest one is shipped with a key, so a key that
    very many documents hold costs one entry per task; what the others need to know is settled here
    and passes through the shuffle as final rows.
    """

    def rows(held):
        docs, keys, at, owner = _by_key(np.concatenate([d for d, _ in held]), np.concatenate([k for _, k in held]))
        out = [(b, True, *x) for b, *x in _routed(*_reported(docs, keys, at, owner, owners_too), buckets)]
        keys = keys[at]
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, owner = bucket[order], keys[order], owner[order]
        starts = _runs(bucket)
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            out.append((int(bucket[lo]), False, *_grouped(owner[lo:hi], keys[lo:hi])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), *_blobs([x[2:] for x in out])],
                                          names=["bucket", "final", "docs", "counts", "keys"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in slices(batch.column(1)):
                keys, owner = key_function(data, offsets)
                if len(keys):
                    held.append((ids[row:row + len(offsets) - 1][owner], keys))
                    size += len(keys)
                if size >= flush:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def resolve(buckets: int, owners_too: bool):
    """Function for ``applyInArrow`` on a bucket of keys: those found elsewhere, by bucket of documents."""

    def run(group: pa.Table) -> pa.Table:
        done, docs, keys = [], [], []
        bucket = group.column("bucket")[0].as_py()
        for final, *blobs in zip(*(group.column(c) for c in ("final", "docs", "counts", "keys"))):
            d, k = _opened(*blobs)
            if final.as_py():
                done.append((bucket, *_grouped(d, k)))
            else:
                docs.append(d)
                keys.append(k)
        if keys:
            done.extend(_routed(*_reported(*_by_key(np.concatenate(docs), np.concatenate(keys)), owners_too), buckets))
        return pa.Table.from_arrays([pa.array([x[0] for x in done], pa.int32()), *_blobs([x[1:] for x in done])], names=["bucket", "docs", "counts", "keys"])

    return run


def by_document(group: pa.Table) -> pa.Table:
    """Function for ``applyInArrow`` on a bucket of documents: (id, keys), one row per document."""
    opened = [_opened(*x) for x in zip(*(group.column(c) for c in ("docs", "counts", "keys")))]
    d, n, k = _grouped(np.concatenate([x[0] for x in opened]), np.concatenate([x[1] for x in opened]))
    ends = np.cumsum(n)
    return pa.table({"id": pa.array(d, pa.int64()), "keys": pa.array([k[e - c:e].tobytes() for e, c in zip(ends, n)], pa.binary())})


def repeated_keys(source: DataFrame, key_function, buckets: int, owners_too: bool = False, flush: int = FLUSH_KEYS) -> DataFrame:
    """(id, packed keys) of documents that hold keys which smaller ids hold too.

    With ``owners_too`` the smallest holder is reported as well.  ``source`` has id and text;
    rows without an id are left out.
    """
    packed = source.where("id is not null").mapInArrow(pack(key_function, buckets, owners_too, flush), PACKED)
    found = packed.groupBy("bucket").applyInArrow(resolve(buckets, owners_too), ROUTED)
    return found.groupBy("bucket").applyInArrow(by_document, "id bigint, keys binary")


def key_set(blob) -> np.ndarray:
    """Sorted distinct keys of a packed Arrow value, empty for null."""
    return np.unique(np.frombuffer(blob.as_buffer(), np.uint64)) if blob is not None and blob.is_valid else np.zeros(0, np.uint64)


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys
