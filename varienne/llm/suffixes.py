"""Removal of repeated byte strings by merging Burrows-Wheeler transforms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.keys import _by_key, _grouped, _reported, _runs, among, bucket_count, bucket_of
from varienne.llm.store import materialize, renamed, total_bytes
from varienne.llm.substrings import interval_lists, runs_per_document
from varienne.llm.text import SLICE_BYTES, byte_table, mix, powers, slices, utf8
from varienne.operators.ordered import ordered
from varienne.session import hint_if_small

LENGTH = 50
#: Bytes of the substring that stands for a window: the one with the smallest hash among those it holds.
ANCHOR = 26
#: Window starts that one string may carry; longer runs are cut.
RUN = 4096
#: Bytes of strings that a task gathers before it removes copies and ships them.
FLUSH_BYTES = 4 << 20
#: Anchors that a task gathers before it ships them.
FLUSH_KEYS = 1_000_000
#: Bytes of text that are looked at together.
BLOCK_BYTES = 1 << 18
#: Most windows of one removed run; longer ones travel in parts.
MOST_WINDOWS = 0xFFFF
#: Symbols that are merged at once.
MERGE_SYMBOLS = 1 << 18


def _smallest(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Anchor hash of every window of ``length`` bytes."""
    forward, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(8, False)[data] * forward[:-1], out=sums[1:])
    best = mix((sums[anchor:] - sums[:-anchor]) * back[:len(data) - anchor + 1], 8)
    # Minimum over the anchors of a window, by doubling.
    width, have = length - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:len(best) - step], best[step:])
        have += step
    return best


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor hash, row; never across documents.

    The bytes are hashed a block at a time, so the memory of a very long document is that of its runs.
    """
    last = offsets[1:] - length + 1
    starts, counts, names, rows = [], [], [], []
    for a in range(0, len(data) - length + 1, BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data) - length + 1)
        lo = np.maximum(offsets[:-1], a)
        n = np.maximum(np.minimum(last, b) - lo, 0)
        if not n.any():
            continue
        at = _ragged(lo, n)
        best = _smallest(data[a:b + length - 1], length, anchor)[at - a]
        row = np.repeat(np.arange(len(n)), n)
        edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
        for out, values in zip((starts, counts, names, rows), (at[edge], np.diff(np.append(edge, len(best))), best[edge], row[edge])):
            out.append(values)
    cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return cat(starts, np.int64), cat(counts, np.int64), cat(names, np.uint64), cat(rows, np.int64)


class Strings:
    """Runs of windows with one anchor: anchor, owner, windows, bytes, and every place where it begins in its owner."""

    def __init__(self, parts: list[tuple]):
        cat = lambda i, t: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
        self.anchor, self.doc, self.count, self.size, self.copies = (cat(i, t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64)))
        self.starts, self.data = cat(5, np.int64), cat(6, np.uint8)
        self.first, self.place = (np.concatenate([[0], np.cumsum(n)]) for n in (self.size, self.copies))

    def take(self, rows: np.ndarray) -> tuple:
        return self.anchor[rows], self.doc[rows], self.count[rows], self.size[rows], self.copies[rows], self.starts[_ragged(self.place[rows], self.copies[rows])], self.data[_ragged(self.first[rows], self.size[rows])]

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first window and number of windows of every place of the rows."""
        n = self.copies[rows]
        return np.repeat(self.doc[rows], n), self.starts[_ragged(self.place[rows], n)], np.repeat(self.count[rows], n)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every string, some megabytes at a time."""
        table, out, row = byte_table(5, False), np.zeros(len(self.size), np.uint64), 0
        while row < len(out):
            end = max(row + 1, int(np.searchsorted(self.first, self.first[row] + SLICE_BYTES, "right")) - 1)
            first = self.first[row:end + 1] - self.first[row]
            forward, back = powers(int(first[-1]) + 1)
            sums = np.zeros(int(first[-1]) + 1, np.uint64)
            np.cumsum(table[self.data[self.first[row]:self.first[end]]] * forward[:-1], out=sums[1:])
            out[row:end] = (sums[first[1:]] - sums[first[:-1]]) * back[first[:-1]]
            row = end
        return mix(out + self.size.astype(np.uint64), 5) ^ self.anchor

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One row of the first owner of every string, and rows of later owners, all of whose windows repeat.

        Whatever else the first owner has of a string moves to that one row: its places are all kept.
        """
        order = np.lexsort((self.doc, keys := self.hashes()))
        at = _runs(keys[order])
        first = np.repeat(order[at], np.diff(np.append(at, len(order))))
        own = self.doc[order] == self.doc[first]
        later, owned = order[~own], order[own]
        # Places by string, then those of later owners, whose rows stay as they are.
        rows = np.concatenate([owned, later])
        starts = self.starts[_ragged(self.place[rows], self.copies[rows])]
        held = np.bincount(first[own], weights=self.copies[owned], minlength=len(self.doc)).astype(np.int64)
        held[later] = self.copies[later]
        self.place = np.zeros(len(held) + 1, np.int64)
        rows = np.concatenate([order[at], later])
        self.place[rows] = np.cumsum(held[rows]) - held[rows]
        self.copies, self.starts = held, starts
        return order[at], later


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of so many elements each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def joined(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows per document: document, first window, number."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + count[order]
    # Every document has a range of its own, so that one running maximum serves all.
    rank = np.repeat(np.arange(len(at := _runs(doc))), np.diff(np.append(at, len(doc)))) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(rank + end)
    first = np.flatnonzero(np.concatenate([[True], (rank + start)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - rank[last] - start[first]


def spans_of(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and runs of windows, packed as first window * 2**16 + number."""
    pieces = -(-count // MOST_WINDOWS)
    order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + order * MOST_WINDOWS
    count = np.minimum(np.repeat(count, pieces) - order * MOST_WINDOWS, MOST_WINDOWS)
    return np.repeat(doc, pieces), (start.astype(np.uint64) << np.uint64(16)) | count.astype(np.uint64)


def shard_bwt(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of one shard in the order of their first ``depth`` symbols, and the symbols before them."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(depth + 7, np.uint64)])
    word = np.zeros(len(padded) - 6, np.uint64)
    for j in range(7):  # seven 9-bit symbols fit one word
        word |= padded[j:len(padded) - 6 + j] << np.uint64(9 * (6 - j))
    columns = []
    for lo in range(0, depth, 7):
        w = word[lo:lo + len(text)]
        columns.append(w if lo + 7 <= depth else w >> np.uint64(9 * (lo + 7 - depth)))
    suffix = np.lexsort(columns[::-1])
    return suffix, text[suffix - 1]


def merge_bwt(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the transforms of several texts until all suffixes are ordered by ``depth`` symbols.

    Returns, in merged order: the shard and place of each suffix, and the length of the prefix it has in common with the
    suffix before it, at most ``depth`` (0 for the first).  The interleave says which shard each row comes from.
    Walking it and dealing the shards by the symbol before each row orders the rows by one symbol
    more; a row begins a new interval where the symbol or the interval it came from changes, and the round in which it first
    does is its common prefix.  The rows of a shard never change their order.
    """
    shards = [shard_bwt(t, depth) for t in texts]
    symbols = np.concatenate([s[1] for s in shards])
    interleave = np.repeat(np.arange(len(texts), dtype=np.uint16), [len(t) for t in texts])
    interval = np.zeros(len(symbols), np.int32)
    common = np.full(len(symbols), depth, np.int16 if depth < 1 << 15 else np.int64)
    common[:1] = 0
    for round_ in range(depth):
        before = np.empty(len(symbols), np.uint16)
        before[np.argsort(interleave, kind="stable")] = symbols
        dealt = np.argsort(before, kind="stable")
        before, from_ = before[dealt], interval[dealt]
        interleave = interleave[dealt]
        fresh = np.empty(len(symbols), bool)
        fresh[:1] = False
        fresh[1:] = (before[1:] != before[:-1]) | (from_[1:] != from_[:-1])
        # Borders of intervals stay where they are, so only new ones get a prefix.
        common[fresh & (common == depth)] = round_
        interval = np.cumsum(fresh, dtype=np.int32)
    place = np.empty(len(symbols), np.int64)
    place[np.argsort(interleave, kind="stable")] = np.concatenate([s[0] for s in shards])
    return interleave, place, common


def may_meet(strings: Strings, rows: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Which strings can share a window with another one of their anchor; ``rows`` are sorted by anchor.

    Around the anchor a window has ``length - anchor`` further symbols, at least half of them on one side.  So two strings
    with a common window agree in the anchor and half of these symbols before it, or as many after it.  Strings of an
    anchor that occurs several times in one of them all stay.
    """
    half, at = (length - anchor + 1) // 2, _runs(strings.anchor[rows])
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rows))))
    sides, several = np.zeros((2, len(rows)), np.uint64), np.zeros(len(at), bool)
    known = np.zeros((2, len(rows)), bool)
    part = (np.cumsum(strings.size[rows]) - strings.size[rows]) // BLOCK_BYTES
    table = byte_table(8, False)
    for a, b in zip(_runs(part), np.append(_runs(part)[1:], len(rows))):
        size = strings.size[rows[a:b]]
        data = strings.data[_ragged(strings.first[rows[a:b]], size)]
        ends = np.cumsum(size)
        forward, back = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * forward[:-1], out=sums[1:])
        names = _low(mix((sums[anchor:] - sums[:-anchor]) * back[:len(data) - anchor + 1], 8))
        row = np.repeat(np.arange(b - a), size)[:len(names)]
        place = np.arange(len(names))
        hit = np.flatnonzero((names == strings.anchor[rows[a:b]].astype(np.uint32)[row]) & (place + anchor <= ends[row]))
        several[group[a:b][np.bincount(row[hit], minlength=b - a) != 1]] = True
        place, row = hit, row[hit]
        for side, first, last in ((0, place - half, place + anchor), (1, place, place + anchor + half)):
            inside = (first >= (ends - size)[row]) & (last <= ends[row])
            first, last = first[inside], last[inside]
            sides[side, a + row[inside]] = mix((sums[last] - sums[first]) * back[first], 9 + side)
            known[side, a + row[inside]] = True
    keep = several[group]
    for values, there in zip(sides, known):
        order = np.flatnonzero(there)
        order = order[np.lexsort((values[order], group[order]))]
        same = (values[order][1:] == values[order][:-1]) & (group[order][1:] == group[order][:-1])
        keep[order[1:][same]] = keep[order[:-1][same]] = True
    return keep


def later_windows(strings: Strings, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of windows that a smaller document holds too, among distinct strings.

    Shards are ranges of owners.  Strings are text with separators; a suffix counts if it is a whole window.
    """
    n = len(strings.size)
    ends = np.cumsum(strings.size + 1)
    text = np.zeros(int(ends[-1]), np.uint16)
    row = np.repeat(np.arange(n), strings.size + 1)
    place = np.arange(len(text)) - np.repeat(ends - strings.size - 1, strings.size + 1)
    text[place < strings.size[row]] = strings.data.astype(np.uint16) + 1
    cuts = np.searchsorted(ends, np.linspace(0, len(text), min(n, 4) + 1)[1:-1])
    edges = np.unique(np.concatenate([[0], ends[cuts[cuts < n - 1]], [len(text)]])).astype(np.int64)
    shard, at, common = merge_bwt([text[a:b] for a, b in zip(edges, edges[1:])], length)
    # A repeated interval ends where less than a window is common.
    interval, at = np.cumsum(common < length), at + edges[shard]
    whole = place[at] < strings.count[row[at]]
    at, interval = at[whole], interval[whole]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = strings.doc[row[at]]
    starts = _runs(interval)
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
    at, doc = at[doc > least], doc[doc > least]
    n = strings.copies[row[at]]
    return np.repeat(doc, n), strings.starts[_ragged(strings.place[row[at]], n)] + np.repeat(place[at], n)


#: Rows for a bucket of documents hold what is settled; the others hold keys or strings.  Blobs are compressed column after column.
SHARED = "bucket int, rows int, keys int, body binary"
TOLD = "bucket int, final boolean, rows int, keys int, body binary"
PACKED = "bucket int, final boolean, rows int, keys int, body binary"


def _pressed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _columns(body, *shapes: tuple[int, type]) -> list[np.ndarray]:
    """Columns of so many values of a type each; the last one takes the rest."""
    data, out, at = zstandard.ZstdDecompressor().decompress(body.as_buffer()), [], 0
    for n, kind in shapes:
        out.append(np.frombuffer(data, kind, n, at) if n else np.zeros(0, kind))
        at += n * np.dtype(kind).itemsize
    return out


def _packed(docs: np.ndarray, keys: np.ndarray) -> tuple[int, int, bytes]:
    """Keys by document, in the order of documents, whose ids travel as differences."""
    d, n, k = _grouped(docs, keys)
    return len(d), len(k), _pressed(np.diff(d, prepend=0), n.astype(np.uint32), k)


def _unpacked(rows, keys, body, kind) -> tuple[np.ndarray, np.ndarray]:
    d, n, k = _columns(body, (rows.as_py(), np.int64), (rows.as_py(), np.uint32), (keys.as_py(), kind))
    return np.repeat(np.cumsum(d), n), k


def _dealt(docs: np.ndarray, keys: np.ndarray, buckets: int) -> list[tuple]:
    """(bucket of documents, packed) for keys of documents."""
    to = ((docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(to, kind="stable")
    edges = _runs(to[order])
    return [(int(to[order[a]]), *_packed(docs[order[a:b]], keys[order[a:b]])) for a, b in zip(edges, np.append(edges[1:], len(order)))]


def _table(out: list[tuple], schema: str):
    """Record batch of rows in the order of the columns of a schema."""
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _low(keys: np.ndarray) -> np.ndarray:
    """The bits of a hash that a bucket does not use."""
    return keys.astype(np.uint32)


def tell(length: int, anchor: int, buckets: int, flush: int):
    """Function for ``mapInArrow``: id and text to anchors by bucket, each with the smallest id of those gathered.

    Anchors that several ids of them hold are settled and pass on by document.
    """

    def rows(held):
        docs, keys, at, owner = _by_key(np.concatenate([d for d, _ in held]), np.concatenate([k for _, k in held]))
        held.clear()
        d, k = _reported(docs, keys, at, owner, True)
        out = [(b, True, *x) for b, *x in _dealt(d, _low(k), buckets)]
        keys = keys[at]
        bucket = bucket_of(keys, buckets)  # ascends with the key
        edges = _runs(bucket)
        out.extend((int(bucket[a]), False, *_packed(owner[a:b], _low(keys[a:b]))) for a, b in zip(edges, np.append(edges[1:], len(bucket))))
        return _table(out, TOLD)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in slices(batch.column(1), BLOCK_BYTES):
                _, _, names, owner = anchor_runs(data, offsets, length, anchor)
                if len(names):
                    held.append((ids[row + owner], names))
                    size += len(names)
                if size >= flush:
                    yield rows(held)
                    size = 0
        if held:
            yield rows(held)

    return run


def shared_anchors(buckets: int):
    """Function for ``applyInArrow`` on a bucket of anchors: those of several documents, by bucket of documents."""

    def run(group: pa.Table) -> pa.Table:
        done, docs, keys = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for bucket, final, *packed in zip(*(group.column(c) for c in ("bucket", "final", "rows", "keys", "body"))):
            if final.as_py():
                done.append((bucket.as_py(), *(x.as_py() for x in packed)))
            else:
                d, k = _unpacked(*packed, np.uint32)
                docs.append(d)
                keys.append(k)
        done.extend(_dealt(*_reported(*_by_key(np.concatenate(docs), np.concatenate(keys)), True), buckets))
        return pa.Table.from_batches([_table(done, SHARED)])

    return run


def wanted_by_document(group: pa.Table) -> pa.Table:
    """Function for ``applyInArrow`` on a bucket of documents: (id, distinct anchors), one row per document."""
    opened = [_unpacked(*x, np.uint32) for x in zip(*(group.column(c) for c in ("rows", "keys", "body")))]
    d, n, k = _grouped(np.concatenate([x[0] for x in opened]), np.concatenate([x[1] for x in opened]))
    ends = np.cumsum(n)
    return pa.table({"id": pa.array(d, pa.int64()), "keys": pa.array([np.unique(k[e - c:e]).tobytes() for e, c in zip(ends, n)], pa.binary())})


def runs_by_document(group: pa.Table) -> pa.Table:
    """Function for ``applyInArrow`` on a bucket of documents: (id, maximal runs of removed windows as starts and ends)."""
    opened = [_unpacked(*x, np.uint64) for x in zip(*(group.column(c) for c in ("rows", "keys", "body")))]
    doc, span = (np.concatenate([x[i] for x in opened]) for i in (0, 1))
    doc, start, count = joined(doc, (span >> np.uint64(16)).astype(np.int64), (span & np.uint64(0xFFFF)).astype(np.int64))
    at = _runs(doc)
    runs = np.stack([start, start + count], axis=1)
    return pa.table({"id": pa.array(doc[at], pa.int64()), "runs": pa.array([runs[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(doc)))], pa.binary())})


def ship(length: int, anchor: int, buckets: int, flush: int):
    """Function for ``mapInArrow``: (id, text, shared anchors, base) to strings by bucket of their anchor; places count from the base."""

    def rows(held):
        strings = Strings(held)
        held.clear()
        first, later = strings.distinct()
        out = [(b, True, *x) for b, *x in _dealt(*spans_of(*joined(*strings.spans(later))), buckets)]
        bucket = bucket_of(strings.anchor[first], buckets)
        first = first[np.lexsort((strings.doc[first], bucket))]
        bucket = bucket_of(strings.anchor[first], buckets)
        edges = _runs(bucket)
        for a, b in zip(edges, np.append(edges[1:], len(bucket))):
            # Owners ascend and travel as differences; the sizes of strings follow from their windows.
            names, owners, windows, _, copies, starts, text = strings.take(first[a:b])
            # Part of an anchor is enough inside its bucket: strings of two anchors may then merge together, which finds nothing more.
            out.append((int(bucket[a]), False, len(names), len(starts), _pressed(np.diff(owners, prepend=0), copies.astype(np.uint32), _low(names), windows.astype(np.uint16), starts, text)))
        return _table(out, PACKED)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)  # null ids have no shared anchors
            base = batch.column(3).to_numpy(zero_copy_only=False)
            blobs, edges = utf8(batch.column(2))
            for row, data, offsets in slices(batch.column(1), BLOCK_BYTES):
                n = len(offsets) - 1
                edge = edges[row:row + n + 1]
                if edge[0] == edge[-1]:
                    continue
                shared = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), np.diff(edge) // 4) | blobs[edge[0]:edge[-1]].view(np.uint32)
                start, count, names, owner = anchor_runs(data, offsets, length, anchor)
                keep = among((owner.astype(np.uint64) << np.uint64(32)) | _low(names), np.sort(shared))
                start, count, names, owner = (x[keep] for x in (start, count, names, owner))
                # Long runs are cut; every window stays in one string.
                pieces = -(-count // RUN)
                order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, names, owner = np.repeat(start, pieces) + order * RUN, np.repeat(names, pieces), np.repeat(owner, pieces)
                count = np.minimum(np.repeat(count, pieces) - order * RUN, RUN)
                wide = count + length - 1
                # Some strings at a time: copying them takes eight bytes of places per byte.
                part = (np.cumsum(wide) - wide) // BLOCK_BYTES
                edge = _runs(part)
                for a, b in zip(edge, np.append(edge[1:], len(part))):
                    doc = owner[a:b]
                    held.append((names[a:b], ids[row + doc], count[a:b], wide[a:b], np.ones(b - a, np.int64), base[row + doc] + start[a:b] - offsets[doc], data[_ragged(start[a:b], wide[a:b])]))
                    size += int(wide[a:b].sum())
                    if size >= flush:
                        yield rows(held)
                        size = 0
        if held:
            yield rows(held)

    return run


def merged(length: int, anchor: int, buckets: int, symbols: int):
    """Function for ``applyInArrow`` on a bucket of strings: removed windows by bucket of documents."""

    def run(group: pa.Table) -> pa.Table:
        done, parts = [], []
        for bucket, final, rows, keys, body in zip(*(group.column(c) for c in ("bucket", "final", "rows", "keys", "body"))):
            if final.as_py():
                done.append((bucket.as_py(), rows.as_py(), keys.as_py(), body.as_py()))
                continue
            n = rows.as_py()
            owners, copies, names, windows, starts, text = _columns(body, *((n, t) for t in (np.int64, np.uint32, np.uint32, np.uint16)), (keys.as_py(), np.int64), (-1, np.uint8))
            windows = windows.astype(np.int64)
            parts.append((names.astype(np.uint64), np.cumsum(owners), windows, windows + length - 1, copies.astype(np.int64), starts, text))
        strings = Strings(parts)
        parts.clear()
        spans = [(np.zeros(0, np.int64),) * 3]
        if len(strings.size):
            first, later = strings.distinct()
            spans.append(joined(*strings.spans(later)))
            order = first[np.argsort(strings.anchor[first], kind="stable")]
            # Most strings have nothing to be merged with.
            order = order[may_meet(strings, order, length, anchor)]
            at = _runs(strings.anchor[order])
            group_of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            weight = np.cumsum(strings.size[order] + 1)
            # Whole groups up to so many symbols at a time; owners ascend, so that shards are ranges of them.
            portion = np.zeros(len(order), np.int64)
            if len(order):
                edge = _runs(group_of)
                portion = np.repeat(weight[np.append(edge[1:], len(order)) - 1] // symbols, np.diff(np.append(edge, len(order))))
            for lo, hi in zip(_runs(portion), np.append(_runs(portion)[1:], len(order))):
                rows = order[lo:hi]
                rows = rows[np.argsort(strings.doc[rows], kind="stable")]
                d, w = later_windows(Strings([strings.take(rows)]), length)
                spans.append(joined(d, w, np.ones(len(d), np.int64)))
        done.extend(_dealt(*spans_of(*joined(*(np.concatenate([s[i] for s in spans]) for i in range(3)))), buckets))
        return pa.Table.from_batches([_table(done, SHARED)])

    return run


def cut(length: int):
    """Function for ``mapInArrow``: (id, text, runs of removed windows, base) to what is removed and kept."""

    def run(batches):
        for batch in batches:
            blobs, edges = utf8(batch.column(2))
            base = batch.column(3).to_numpy(zero_copy_only=False)
            for row, data, offsets in slices(batch.column(1), BLOCK_BYTES):
                n = len(offsets) - 1
                edge = edges[row:row + n + 1]
                runs = np.frombuffer(blobs[edge[0]:edge[-1]].tobytes(), np.int64).reshape(-1, 2)
                doc = np.repeat(np.arange(n), np.diff(edge) // 16)
                # Runs outside the row belong to further rows of its id.
                size = np.diff(offsets)[doc]
                start = np.clip(runs[:, 0] - base[row + doc], 0, size)
                end = np.clip(runs[:, 1] - base[row + doc] + length - 1, 0, size)
                mine = (runs[:, 0] - base[row + doc] < size) & (runs[:, 1] > base[row + doc])
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, offsets[doc[mine]] + start[mine], 1)
                np.add.at(change, offsets[doc[mine]] + end[mine], -1)
                gone = np.cumsum(change)[:len(data)] > 0
                spans = runs_per_document(gone, offsets)
                lost = np.concatenate([[0], np.cumsum(gone)])[offsets]
                kept = offsets - lost
                text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(lost), pa.int64()), interval_lists(*spans, n), text],
                                                 names=["id", "n_bytes", "n_removed", "removed", "kept"])

    return run


def with_bases(source: DataFrame) -> DataFrame:
    """Rows (id, text) with a base: where the row's bytes begin among those of all different texts of its id.

    It is 0 unless an id has several texts.
    """
    texts = source.where("id is not null").select("id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    several = materialize(texts.groupBy("id").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1 and lo <> hi").select("id"), "several")
    if several.isEmpty():
        return source.withColumn("base", F.lit(0).cast("bigint"))
    distinct = texts.join(hint_if_small(several), "id", "left_semi").groupBy("id", "h").agg(F.max("size").alias("size"))
    summed = ordered(distinct, ["id"], "h", running_sums={"upto": "size"})
    bases = materialize(summed.select(F.col("id").alias("of"), "h", (F.col("upto") - F.col("size")).alias("base")), "bases")
    joined = source.join(hint_if_small(bases), (F.col("id") == F.col("of")) & (F.xxhash64("text") == F.col("h")), "left")
    return joined.select("id", "text", F.coalesce("base", F.lit(0).cast("bigint")).alias("base"))


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also begins in a smaller id.

    Returns id_col, n_bytes, n_removed, removed (maximal intervals of byte positions, end exclusive) and
    kept (the other bytes, which may cut a character), one row per input row.

    1. Every window of ``length`` bytes is named by its anchor, the ``anchor``-byte substring with the smallest
       hash; equal windows have equal anchors.  Anchors of more than one document are found in packed buckets, by 32 bits of
       their hash apart from the bucket: an anchor that is taken for shared is only looked at in vain.
    2. Runs of windows with such an anchor become strings and go to the anchor's bucket, copies only once
       per task.
    3. In a bucket equal strings have one first owner, which keeps all its places; all windows of the others repeat.  The distinct
       strings of an anchor form shards with one Burrows-Wheeler transform each, and the transforms are merged by
       refining their interleave symbol by symbol, which gives the common prefixes of neighbours.  Stretches of ``length`` common
       symbols are repeated intervals; windows whose owner is not the smallest in one are removed.
    4. Removed windows go back to their documents and become intervals.

    No suffix is sorted across shards.  Null or empty text: no bytes.  Rows that repeat an id are one
    document: what only they share stays, and each loses what it shares with smaller ids itself.  Null id: neither removes nor loses anything.
    Other columns are ignored; an empty table gives no rows; texts of any length are read whole, and hashed a block at a time.
    """
    spark = docs.sparkSession
    source = with_bases(renamed(docs, id_col, text_col, to=("id", "text")).withColumn("id", F.col("id").cast("bigint")))
    size = total_bytes(docs, text_col)
    keys = bucket_count(spark, 4 * size * 16 // (length - anchor + 2))  # their holders come back too
    told = source.where("id is not null").mapInArrow(tell(length, anchor, keys, FLUSH_KEYS), TOLD)
    shared = told.groupBy("bucket").applyInArrow(shared_anchors(keys), SHARED).groupBy("bucket").applyInArrow(wanted_by_document, "id bigint, keys binary")
    placed = source.join(shared, "id", "left").select("id", "text", "keys", "base")
    # A run of windows is shipped with length - 1 bytes more than it has windows, about half as many as an anchor can cover.
    buckets = bucket_count(spark, size * (1 + 2 * (length - 1) // (length - anchor + 1)))
    # No filter here: the texts are dealt once, for this join and for the last one.
    strings = placed.mapInArrow(ship(length, anchor, buckets, FLUSH_BYTES), PACKED)
    found = strings.groupBy("bucket").applyInArrow(merged(length, anchor, buckets, MERGE_SYMBOLS), SHARED).groupBy("bucket").applyInArrow(runs_by_document, "id bigint, runs binary")
    out = source.join(found, "id", "left").select("id", "text", "runs", "base").mapInArrow(cut(length), "id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
