"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import materialize, renamed
from varienne.llm.text import Words, slices

WORDS = 5
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 16
#: Benchmark items that one pass over the documents looks for.
ITEMS_PER_PASS = 20_000

#: ``size`` is the number of words of the items that a window may match, ``words`` that of its own.
WINDOW = "id bigint, start bigint, size int, words int, simhash bigint, shingles array<bigint>"


def simhash(shingles: np.ndarray) -> np.ndarray:
    """64-bit SimHash per row of shingle hashes; repeated shingles weigh as often as they occur."""
    out = np.zeros(len(shingles), np.uint64)
    for bit in range(64):
        ones = ((shingles >> np.uint64(bit)) & np.uint64(1)).sum(axis=1, dtype=np.int64)
        out |= (2 * ones > shingles.shape[1]).astype(np.uint64) << np.uint64(bit)
    return out


def item_windows(words: int):
    """Function for ``mapInArrow``: id and text to the one window that is the whole item."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for row, data, offsets in slices(batch.column(1)):
                tokens = Words(data, offsets, seed=3, fold_case=True)
                for d, n in enumerate(np.diff(tokens.bounds)):
                    if n:
                        k = min(words, int(n))
                        _, h, b = tokens.windows(k, seed=3)
                        h = h[b[d]:b[d + 1]]
                        rows.append((ids[row + d], 0, int(n), int(n), int(simhash(h[None])[0].astype(np.int64)), h.view(np.int64)))
            yield _windows(rows)

    return run


def _windows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "start", "size", "words", "simhash", "shingles"])


def document_windows(index: dict[int, tuple[np.ndarray, np.ndarray]], words: int, percent: int):
    """Function for ``mapInArrow``: id and text to windows of the size of an item, or the whole of a shorter document.

    ``index`` has, per number of words in a shingle, the shingles of items of every size.  A window
    of n shingles reaches the similarity only if ``percent`` of them belong to items of its own size,
    so only such windows get a SimHash.  A document of fewer words must hold ``percent`` of n such shingles too.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, data, offsets in slices(batch.column(1)):
                tokens = Words(data, offsets, seed=3, fold_case=True)
                rows = []
                for k, (keys, sizes) in index.items():
                    at, hashes, bounds = tokens.windows(k, seed=3)
                    low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
                    hit = np.flatnonzero(high > low)
                    if not len(hit):
                        continue
                    n = (high - low)[hit]
                    place = np.repeat(hit, n)
                    size = sizes[np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    last = np.repeat(bounds[1:], np.diff(bounds))
                    for length in np.unique(size):
                        m = int(length) - k + 1
                        flags = np.zeros(len(hashes) + m, np.int32)
                        flags[place[size == length]] = 1
                        sums = np.concatenate([[0], np.cumsum(flags)])
                        inside = sums[m:m + len(hashes)] - sums[:len(hashes)]
                        begin = np.flatnonzero((inside * 100 >= m * percent) & (np.arange(len(hashes)) + m <= last))
                        for lo in range(0, len(begin), 4096):
                            b = begin[lo:lo + 4096]
                            shingles = hashes[b[:, None] + np.arange(m)]
                            doc = np.searchsorted(bounds, b, "right") - 1
                            for x, d, s, f in zip(b, doc, shingles, simhash(shingles)):
                                rows.append((ids[row + d], int(at[x] - tokens.bounds[d]), int(length), int(length), int(f.astype(np.int64)), s.view(np.int64)))
                        have = np.diff(bounds)
                        for d in np.flatnonzero((have < m) & ((sums[bounds[1:]] - sums[bounds[:-1]]) * 100 >= m * percent)):
                            s = hashes[bounds[d]:bounds[d + 1]]
                            rows.append((ids[row + d], 0, int(length), int(have[d]) + k - 1, int(simhash(s[None])[0].astype(np.int64)), s.view(np.int64)))
                if rows:
                    yield _windows(rows)

    return run


def near_values(radius: int) -> list[int]:
    """Differences of a block within the radius."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BLOCK_BITS), n)]


def block(column, i: int):
    return F.shiftrightunsigned(column, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def weighted_similarity(batches):
    """Function for ``mapInArrow``: sum of minima over sum of maxima of two shingle multisets."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(4), batch.column(5)):
            a, n = np.unique(x.values.to_numpy(), return_counts=True)
            b, m = np.unique(y.values.to_numpy(), return_counts=True)
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            common = int(np.minimum(n[i], m[j]).sum())
            out.append((common, int(n.sum() + m.sum()) - common))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())],
                                         names=["id", "item", "start", "size", "common", "total"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 percent: int = 80, words: int = WORDS, radius: int = RADIUS, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Best window of every document for every benchmark item that it nearly contains.

    Returns id_col, item_col, start and size (in words), common and total: the window has as many words
    as the item, or is the whole document if that has fewer, and 100 * common >= percent * total for the sums of minima and maxima of their shingle
    counts.  Of equally similar windows the first counts.  Words fold A-Z and are split at ASCII white
    space; an item of fewer than ``words`` words is one shingle.

    Windows get a 64-bit SimHash and meet items of their size through four 16-bit blocks: fingerprints
    within ``radius`` agree in one block up to radius // 4 bits, and the index holds every item under all
    such values.  At similarity 0.8 about 1 in 3,000 windows differs in more than 19 bits; a passage
    usually offers several windows.  Candidates are compared exactly.

    Items are looked for in passes of about ``items_per_pass``, whose shingle hashes travel with the
    tasks.  Documents are never shuffled, only windows that already hold ``percent`` of one size's shingles.
    Null or empty texts and items match nothing.  Null ids are ignored.  Rows that repeat an id count as
    one document, the same for items.  An empty table on either side gives no rows.  Of equally good places the first counts.  Texts
    of any length are read whole, about a megabyte of them at a time or one longer text.  Other columns are ignored.
    """
    source = renamed(docs, id_col, text_col, to=("id", "text")).withColumn("id", F.col("id").cast("bigint")).where("id is not null")
    asked = renamed(benchmark, item_col, item_text, to=("id", "text")).withColumn("id", F.col("id").cast("bigint")).where("id is not null")
    items = materialize(asked.mapInArrow(item_windows(words), WINDOW), "items")
    passes = max(1, -(-items.count() // items_per_pass))
    found = None
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        pairs: dict[int, set] = {}
        for r in part.select("size", F.explode("shingles").alias("h")).distinct().collect():
            pairs.setdefault(min(words, r.size), set()).add((r.h & 0xFFFFFFFFFFFFFFFF, r.size))
        index = {k: tuple(np.array(c, t) for c, t in zip(zip(*sorted(v)), (np.uint64, np.int64))) for k, v in pairs.items()}
        windows = materialize(source.mapInArrow(document_windows(index, words, percent), WINDOW), "windows")
        keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), block(F.col("simhash"), i).alias("v")) for i in range(BLOCKS)])).alias("k")
        near = F.explode(F.array(*[F.lit(v) for v in near_values(radius // BLOCKS)])).alias("d")
        indexed = part.select(F.col("id").alias("item"), "size", F.col("simhash").alias("g"), keys).select("item", "size", "g", "k.i", "k.v", near)
        indexed = indexed.select("item", "size", "g", "i", F.col("v").bitwiseXOR(F.col("d")).alias("v"))
        probes = windows.select("id", "start", "size", F.col("simhash").alias("f"), keys).select("id", "start", "size", "f", "k.i", "k.v")
        # The index has thousands of rows per item, which no size estimate knows of: no broadcast.
        close = probes.join(indexed.hint("merge"), ["size", "i", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius).select("id", "start", "item").distinct()
        both = close.join(windows.select("id", "start", "size", "words", F.col("shingles").alias("x")), ["id", "start"]).join(
            part.select(F.col("id").alias("item"), F.col("size").alias("item_size"), F.col("shingles").alias("y")), "item").where("size = item_size")
        checked = both.select("id", "item", "start", F.col("words").alias("size"), "x", "y").mapInArrow(weighted_similarity, "id bigint, item bigint, start bigint, size int, common bigint, total bigint")
        checked = checked.where(F.col("common") * 100 >= F.col("total") * percent)
        found = checked if found is None else found.unionByName(checked)
    best = found.groupBy("id", "item").agg(F.max_by(F.struct("start", "size", "common", "total"), F.struct(F.col("common") / F.col("total"), -F.col("start"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.start", "b.size", "b.common", "b.total")
