"""Phrases that occur together more often than their parts suggest, counted on a prefix-free parse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varienne.llm.keys import among, bucket_count, bucket_of
from varienne.llm.store import materialize, renamed, total_bytes
from varienne.llm.text import SLICE_BYTES, byte_table, mix, powers, slices

LONGEST = 3
LEAST = 10
COVERED_PERCENT = 50
KEEP = 2000
#: One word pair in so many begins a chunk.
TRIGGER = 32
#: Bytes of text that one dictionary segment may stem from.
SEGMENT_BYTES = 8 << 20
#: Bytes of chunks that a task gathers before it adds equal ones up and sends them.
GATHERED_BYTES = 16 << 20
UNKNOWN = "und"

# ASCII characters that end a piece, and those that part words inside one.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b"\x20\x09"

_BREAK = np.zeros(256, bool)
_BREAK[list(PIECE_ENDS)] = True
_GAP = _BREAK.copy()
_GAP[list(WORD_ENDS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

CHUNKS = "segment bigint, lang string, tail boolean, chunk binary, words bigint, n bigint"
COUNTED = "bucket int, segment bigint, keys binary, counts binary"
ASKED = "segment bigint, keys binary, counts binary"
FOUND = "lang string, key bigint, size int, f bigint, phrase string, cuts array<struct<l:bigint,r:bigint>>, inside array<bigint>"


class Pieces:
    """Words of a slice of folded texts: byte ranges, hashes, and the piece that each word lies in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = _GAP[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begin, end = ~gap, ~gap
        if len(data):
            begin[1:] &= gap[:-1] | first[1:-1]
            end[:-1] &= gap[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.piece = (np.cumsum(_BREAK[data])[self.starts] if len(data) else self.starts) + self.text
        forward, back = powers(len(data) + 1)
        self._bytes = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_table(12, False)[data] * forward[:-1], out=self._bytes[1:])
        self._back = back
        self.hashes = self.span(self.starts, self.ends)
        forward, _ = powers(len(self.hashes) + 1)
        self._words = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * forward[:len(self.hashes)], out=self._words[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._bytes[end] - self._bytes[start]) * self._back[start] + (end - start).astype(np.uint64), 12)

    def run(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of k words from each place, apart from their language."""
        _, back = powers(len(self.hashes) + 1)
        return mix((self._words[at + k] - self._words[at]) * back[at], 12 + k)

    def inside(self, k: int, last: np.ndarray) -> np.ndarray:
        """Places below ``last`` (per text) from which k words lie in one piece."""
        at = np.arange(max(len(self.hashes) - k + 1, 0))
        return at[(self.piece[at + k - 1] == self.piece[at]) & (at < last[self.text[at]])] if len(at) else at


def _language_keys(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _codes(column) -> tuple[list[str], np.ndarray]:
    """Distinct languages of a column without nulls, and the number of each row's one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)


def parsed(overlap: int, trigger: int, segments: int):
    """Function for ``mapInArrow``: (lang, text) to chunks with counts.

    A chunk begins where the hash of ``overlap`` words falls into one class of ``trigger``, and reaches
    through the words that begin the next one; ``tail`` marks the last chunk of a text, which owns all its words.
    """

    def rows(held):
        keys, langs, tails, texts, owned = (np.concatenate(x) for x in zip(*held))
        _, one, count = np.unique(keys, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array(((keys[one] >> np.uint64(16)) % np.uint64(segments)).astype(np.int64)), pa.array(langs[one], pa.string()), pa.array(tails[one]), pa.array(texts[one], pa.binary()),
            pa.array(owned[one], pa.int64()), pa.array(count, pa.int64())], names=["segment", "lang", "tail", "chunk", "words", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            names, codes = _codes(batch.column(0))
            named, seeds = np.array(names, object), _language_keys(names)
            for row, data, offsets in slices(batch.column(1)):
                data = _FOLD[data]
                words = Pieces(data, offsets)
                n = len(words.starts)
                if not n:
                    continue
                begin = np.zeros(n + overlap, bool)
                at = np.arange(max(n - overlap + 1, 0))
                at = at[words.text[at + overlap - 1] == words.text[at]]
                begin[at[words.run(at, overlap) % np.uint64(trigger) == 0]] = True
                begin[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
                start = np.flatnonzero(begin[:n])
                text = words.text[start]
                tail = np.append(text[1:] != text[:-1], True)
                own_end = np.append(start[1:], n)
                lo, hi = words.starts[start], words.ends[np.where(tail, own_end, own_end + overlap) - 1]
                code = codes[row + text]
                key = mix(words.span(lo, hi) + (seeds[code] ^ mix(tail.astype(np.uint64), 5)), 5)
                raw = data.tobytes()
                chunks = np.empty(len(start), object)
                chunks[:] = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                held.append((key, named[code], tail, chunks, own_end - start))
                size += len(raw)
                if size >= GATHERED_BYTES:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return run


def _grams(group: pa.Table, longest: int):
    """Slice by slice: words, chunk numbers, languages, and per size the places and keys of the n-grams that begin in a chunk's own part."""
    names, codes = _codes(group.column("lang"))
    seeds = _language_keys(names)
    owned = group.column("words").to_numpy()
    row = 0
    for part in group.column("chunk").chunks:
        for first, data, offsets in slices(part, SLICE_BYTES):
            words = Pieces(data, offsets)
            rows = row + first + np.arange(len(offsets) - 1)
            last = words.bounds[:-1] + owned[rows]
            seed = seeds[codes[rows]]
            key = lambda at, k: mix(words.run(at, k) ^ seed[words.text[at]], 12)
            yield words, data, rows, names, codes, key, [(k, words.inside(k, last)) for k in range(1, longest + 1)]
        row += len(part)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, highest bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(">u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def counted(longest: int, buckets: int):
    """Function for ``mapInArrow`` on a dictionary sorted by segment: distinct n-grams of every segment with weighted counts, by bucket."""

    def packed(group: pa.Table) -> pa.RecordBatch:
        segment, weight = group.column("segment")[0].as_py(), group.column("n").to_numpy()
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for words, _, rows, _, _, key, sizes in _grams(group, longest):
            for k, at in sizes:
                keys.append(key(at, k))
                counts.append(weight[rows[words.text[at]]])
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        bucket = bucket_of(keys, buckets)  # rises with the key
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(at[1:], len(keys))
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), segment), pa.int64()), pa.array([_packed(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], names=["bucket", "segment", "keys", "counts"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            table, segment = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
            at = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
            for lo, hi in zip(at, at[1:]):
                if held and held[0].column("segment")[0].as_py() != segment[lo]:
                    yield packed(pa.concat_tables(held))
                    held = []
                held.append(table.slice(lo, hi - lo))
        if held:
            yield packed(pa.concat_tables(held))

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def frequent(least: int):
    """Function for ``applyInArrow`` on a bucket: n-grams with enough occurrences, to the smallest segment that holds them."""

    def run(group: pa.Table) -> pa.Table:
        keys = [_unpacked(b) for b in group.column("keys")]
        counts = [np.frombuffer(b.as_buffer(), np.int64) for b in group.column("counts")]
        segment = np.repeat(group.column("segment").to_numpy(), [len(k) for k in keys])
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts, segment = keys[order], counts[order], segment[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total, owner = np.add.reduceat(counts, at), np.minimum.reduceat(segment, at)
        many = total >= least
        keys, total, owner = keys[at][many], total[many], owner[many]
        order = np.argsort(owner, kind="stable")
        keys, total, owner = keys[order], total[order], owner[order]
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(at[1:], len(owner))
        return pa.table({"segment": pa.array(owner[at], pa.int64()),
                         "keys": pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                         "counts": pa.array([total[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})

    return run


def spelled(longest: int):
    """Function for a cogrouped ``applyInArrow`` (dictionary segment, what is asked of it): the words and parts of each n-gram asked for."""

    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        out = {name: [] for name in ("lang", "key", "size", "f", "phrase", "cuts", "inside")}
        if len(asked):
            wanted = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in asked.column("keys")])
            total = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in asked.column("counts")])
            order = np.argsort(wanted)
            wanted, total = wanted[order], total[order]
            missing = np.ones(len(wanted), bool)
            for words, data, rows, names, codes, key, sizes in _grams(group, longest):
                for k, at in sizes:
                    keys = key(at, k)
                    hit = np.flatnonzero(among(keys, wanted[missing]))
                    _, one = np.unique(keys[hit], return_index=True)
                    at, keys = at[hit[one]], keys[hit[one]]
                    place = np.searchsorted(wanted, keys)
                    missing[place] = False
                    part = lambda i, size: key(at + i, size).view(np.int64)
                    cuts = [(part(0, i), part(i, k - i)) for i in range(1, k)]
                    within = [part(i, size) for size in range(2, k) for i in range(k - size + 1)]
                    spans = [(words.starts[at + i].tolist(), words.ends[at + i].tolist()) for i in range(k)] if k > 1 else []
                    raw = data.tobytes() if k > 1 and len(at) else b""
                    out["lang"] += [names[c] for c in codes[rows[words.text[at]]]]
                    out["key"] += keys.view(np.int64).tolist()
                    out["size"] += [k] * len(at)
                    out["f"] += total[place].tolist()
                    out["phrase"] += [" ".join(raw[s[i]:e[i]].decode() for s, e in spans) if k > 1 else None for i in range(len(at))]
                    out["cuts"] += [[{"l": int(x[i]), "r": int(y[i])} for x, y in cuts] for i in range(len(at))]
                    out["inside"] += [[int(x[i]) for x in within] for i in range(len(at))]
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "key": pa.array(out["key"], pa.int64()), "size": pa.array(out["size"], pa.int32()),
                         "f": pa.array(out["f"], pa.int64()), "phrase": pa.array(out["phrase"], pa.string()),
                         "cuts": pa.array(out["cuts"], pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())]))), "inside": pa.array(out["inside"], pa.list_(pa.int64()))})

    return run


def frequent_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, longest: int = LONGEST, trigger: int = TRIGGER) -> tuple[DataFrame, DataFrame]:
    """N-grams of up to ``longest`` words with at least ``least`` occurrences, and the number of words per language.

    The first table has lang, key, size, f, phrase (null for single words), cuts (keys of both parts for every place to cut)
    and inside (keys of the shorter phrases in it); the second lang and n.  Both are written tables.
    """
    spark, overlap = docs.sparkSession, max(longest - 1, 1)
    source = renamed(docs, lang_col, text_col, to=("lang", "text")).select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    size = total_bytes(docs, text_col)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments, buckets = max(shuffled, size // SEGMENT_BYTES + 1), bucket_count(spark, 6 * size)
    chunks = source.where("text is not null").mapInArrow(parsed(overlap, trigger, segments), CHUNKS)
    # Equal chunks have equal segments, so one shuffle by segment serves both the counts and the order in which segments are written.
    dictionary = chunks.repartition("segment").groupBy("segment", "lang", "tail", "chunk").agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    dictionary = materialize(dictionary.sortWithinPartitions("segment"), "dictionary")
    words = materialize(dictionary.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")), "words")
    grams = dictionary.mapInArrow(counted(longest, buckets), COUNTED)
    asked = grams.groupBy("bucket").applyInArrow(frequent(least), ASKED)
    found = dictionary.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(spelled(longest), FOUND)
    return materialize(found, "ngrams"), words


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, longest: int = LONGEST,
    covered_percent: int = COVERED_PERCENT, keep: int | None = KEEP, trigger: int = TRIGGER,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language: lang, rank, phrase, a, l, r, n, score.

    Prefix-free parsing: a text is cut into chunks that begin where the hash of ``longest - 1`` words meets a trigger and overlap
    by those words, so equal passages give equal chunks wherever they stand.  Spark counts the chunks; their distinct texts are the
    dictionary.  N-grams are counted inside distinct chunks, weighted by the chunk's frequency; one that lies in an overlap belongs
    to the chunk that owns its first word, so every occurrence counts once.  Counts of a segment of the dictionary travel packed, about six
    bytes per distinct n-gram, to buckets of hashes; frequent ones are spelled out by one segment that holds them.

    a is the number of occurrences (overlaps included), l and r those of the parts at the cut with the lowest floor(1000000 a a / (l r)),
    the earliest among equals; n the words of the language.  A phrase inside a longer candidate with ``covered_percent`` of its
    occurrences is left out.  Arithmetic is decimal and exact up to 10**15 occurrences.  ``keep=None`` returns all.

    A to Z are folded; pieces end at . , ; : ! ? and line breaks, words at spaces and tabs.  Null, empty or blank text: no words.  Null
    lang: ``und``.  Rows are counted as they come, repeated ones too; ids and other columns are ignored.  A text of any length is read
    whole; a text without a trigger is one chunk.  Ties of score and a go by phrase in byte order.  An empty table gives no rows.  N-grams are told
    apart by 64-bit hashes.
    """
    ngrams, words = frequent_ngrams(docs, text_col, lang_col, least=least, longest=longest, trigger=trigger)
    phrases = ngrams.where("size > 1")
    count = ngrams.select("key", "f")
    cuts = phrases.select("key", F.col("f").alias("a"), F.posexplode("cuts").alias("k", "cut")).select("key", "a", "k", F.col("cut.l").alias("lkey"), F.col("cut.r").alias("rkey"))
    # Both parts of a frequent phrase are frequent; a hot first word is split by adaptive execution.
    parts = cuts.join(count.select(F.col("key").alias("lkey"), F.col("f").alias("l")), "lkey").join(count.select(F.col("key").alias("rkey"), F.col("f").alias("r")), "rkey")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("CAST(1000000 * aa AS DECIMAL(38,0)) div lr")
    parts = parts.select("*", (wide("a") * wide("a")).alias("aa"), (wide("l") * wide("r")).alias("lr")).withColumn("score", score.cast("bigint"))
    best = parts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = phrases.select(F.explode("inside").alias("key"), F.col("f").alias("cover")).groupBy("key").agg(F.max("cover").alias("cover"))
    kept = phrases.join(longer, "key", "left").where(F.col("cover").isNull() | (100 * F.col("cover") < covered_percent * F.col("f")))
    rows = kept.join(best, "key").select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
