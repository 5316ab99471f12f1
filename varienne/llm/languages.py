"""Language identification with bit-sliced Bloom filters of n-grams, one bit per language in every slot."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import materialize, renamed
from varienne.llm.text import mix, slices

#: Bytes per n-gram.
SIZES = (2, 3, 4, 5)
#: An n-gram belongs to a language if it makes up this share of the language's n-grams of its size; at most 1 / LEAST_SHARE can.
LEAST_SHARE = 5e-5
#: Labelled documents per language that a fit may use; more are thinned by a hash of their id.
MAX_LABELLED = 10_000
PROBES = 3
SLOTS_PER_KEY = 16
#: Keys that a task gathers before it adds equal ones up.
FLUSH_KEYS = 4_000_000
UNKNOWN = "und"

# ASCII letters are folded, other ASCII becomes a space, the rest stays.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, each between two spaces, runs of spaces as one: (bytes, text of every byte)."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.full(len(data) + 2 * n, 0x20, np.uint8)
    out[np.arange(len(data)) + 1 + 2 * text] = _FOLD[data]
    text = np.repeat(np.arange(n), np.diff(offsets) + 2)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20) | (text[1:] != text[:-1])
    return out[keep], text[keep]


def ngrams(data: np.ndarray, offsets: np.ndarray, sizes=SIZES):
    """(size, keys, text of each) of the n-grams of whole texts; a key is the n-gram itself with its size in the high byte."""
    out, text = normalised(data, offsets)
    wide = out.astype(np.uint64)
    for k in sizes:
        n = max(len(wide) - k + 1, 0)
        keys = np.full(n, k << 56, np.uint64)
        for i in range(k):
            keys |= wide[i:i + n] << np.uint64(8 * i)
        same = text[:n] == text[k - 1:k - 1 + n]
        yield k, keys[same], text[:n][same]


def counted(names: list[str], sizes):
    """Function for ``mapInArrow``: (lang, text) to (lang, key, n), n the texts of the language with the n-gram, as far as a task has seen."""
    number = {name: i for i, name in enumerate(names)}

    def rows(held):
        lang, keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((keys, lang))
        lang, keys, counts = lang[order], keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lang[1:] != lang[:-1])]))
        return lang[at], keys[at], np.add.reduceat(counts, at)

    def sent(lang, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "key", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            codes = np.array([number[x] for x in batch.column(0).to_pylist()], np.int32)
            for row, data, offsets in slices(batch.column(1)):
                for _, keys, text in ngrams(data, offsets, sizes):
                    if not len(keys):
                        continue
                    _, one = np.unique(mix(keys) + mix(text.astype(np.uint64), 1), return_index=True)
                    held.append((codes[row + text[one]], keys[one], np.ones(len(one), np.int64)))
                    size += len(one)
                if size >= FLUSH_KEYS:
                    held = [rows(held)]
                    size = len(held[0][0])
                    if size >= FLUSH_KEYS // 2:
                        yield sent(*held[0])
                        held, size = [], 0
        if held:
            yield sent(*rows(held))

    return run


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters: ``slots[word, slot]`` has one bit per language, 64 languages a word."""

    langs: list[str]
    slots: np.ndarray
    sizes: tuple[int, ...] = SIZES
    default: str = UNKNOWN

    def masks(self, keys: np.ndarray, word: int) -> np.ndarray:
        """The languages of 64 that contain each n-gram, or seem to."""
        h = mix(keys, 13)
        step = (h >> np.uint64(32)) | np.uint64(1)
        size = np.uint64(self.slots.shape[1] - 1)
        out = self.slots[word][(h & size).astype(np.int64)]
        for _ in range(PROBES - 1):
            h = h + step
            out = out & self.slots[word][(h & size).astype(np.int64)]
        return out

    def false_rates(self) -> np.ndarray:
        """Per language, the share of foreign n-grams that its filter lets through: the share of its bits that are set, to the power of probes."""
        words = np.arange(len(self.langs)) // 64
        set_bits = np.array([np.count_nonzero(self.slots[w] & np.uint64(1 << (i % 64))) for i, w in enumerate(words)], float)
        return (set_bits / self.slots.shape[1]) ** PROBES

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): n-grams of a text that the language contains, freed from expected false positives.

        n-grams that all languages contain tell nothing and are left out.
        """
        n, total = len(offsets) - 1, len(self.langs)
        found, tested = np.zeros((n, total)), np.zeros(n)
        for _, keys, text in ngrams(data, offsets, self.sizes):
            masks = [self.masks(keys, w) for w in range(len(self.slots))]
            every = np.ones(len(keys), bool)
            for w, mask in enumerate(masks):
                here = min(total - 64 * w, 64)
                every &= mask == np.uint64((1 << here) - 1)
            if total > 1:
                masks, text = [m[~every] for m in masks], text[~every]
            tested += np.bincount(text, minlength=n)
            for i in range(total):
                bit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                found[:, i] += np.bincount(text, weights=bit, minlength=n)
        false = self.false_rates()
        return np.maximum((found - tested[:, None] * false) / np.maximum(1 - false, 1e-9), 0)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and its share of the hits; ties go to the first language, texts without a hit to the default with score 1 / languages."""
        hits = self.hits(data, offsets)
        total = hits.sum(1)
        best = hits.argmax(1) if hits.shape[1] else np.zeros(len(hits), int)
        share = np.where(total > 0, hits[np.arange(len(hits)), best] / np.where(total > 0, total, 1), 1 / max(len(self.langs), 1)) if hits.shape[1] else np.zeros(len(hits))
        return [self.langs[b] if t > 0 else self.default for b, t in zip(best, total)], share


def filter_of(langs: list[str], members: list[tuple[int, int]], default: str, sizes=SIZES) -> LanguageFilter:
    """Filter of (language number, key) pairs, with ``SLOTS_PER_KEY`` slots for each distinct key."""
    lang = np.array([m[0] for m in members], np.int64)
    keys = np.array([m[1] for m in members], np.int64).view(np.uint64)
    size = 1 << max(int(np.ceil(np.log2(max(len(np.unique(keys)), 1) * SLOTS_PER_KEY))), 10)
    slots = np.zeros((max((len(langs) + 63) // 64, 1), size), np.uint64)
    h = mix(keys, 13)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        np.bitwise_or.at(slots, (lang // 64, (h & np.uint64(size - 1)).astype(np.int64)), np.uint64(1) << (lang % 64).astype(np.uint64))
        h = h + step
    return LanguageFilter(langs, slots, sizes, default)


def fit_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *,
    sizes: tuple[int, ...] = SIZES, least_share: float = LEAST_SHARE, max_labelled: int = MAX_LABELLED,
) -> LanguageFilter:
    """Learn the filters from rows with text and language.

    Of a language with more than ``max_labelled`` rows those with the smallest hashes of their id, in expectation as many, are used.
    Every n-gram counts once per text.  Those with at least ``least_share`` of their size's count enter the filter:
    at most 1 / least_share per size and language, whatever the corpus, so the filter that travels with tasks is bounded by
    the number of languages.  Rows without text or language teach nothing; without any row nothing is learned.
    """
    rows = renamed(docs, id_col, lang_col, text_col, to=("id", "lang", "text")).where("lang is not null and text is not null").withColumn("lang", F.col("lang").cast("string"))
    sizes_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes_of)
    if not langs:
        return filter_of([], [], UNKNOWN, sizes)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_labelled / sizes_of[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    counts = chosen.mapInArrow(counted(langs, sizes), "lang int, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "ngrams").withColumn("size", F.shiftright("key", 56))
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for (lang, size), n in totals.items() for x in (lang * 256 + size, n * least_share)]) if totals else None
    members = counts.where(F.col("n") >= least[(F.col("lang") * 256 + F.col("size")).cast("int")]).select("lang", "key").collect() if totals else []
    default = min(langs, key=lambda x: (-sizes_of[x], x))
    return filter_of(langs, members, default, sizes)


def identify_languages(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every row.

    The filters return all languages of an n-gram at once; per text and language the bits are counted and the expected false
    positives taken off.  The language with the most hits wins; score is its share of all hits.  Text that is null or has no letter: ``und``, score 0.  A text
    with letters but no hit gets the language with the most training rows, score 1 / languages.  Ties: the first language by name.  Repeated rows
    get equal results, null ids are kept, other columns are ignored, an empty table gives no rows.  Texts of any length are read whole,
    about a megabyte of them at a time or one longer text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for row, data, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                langs, score = model.decide(data, offsets)
                known = letters[row:row + n].astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array([x if k else UNKNOWN for x, k in zip(langs, known)], pa.string()),
                                                  pa.array(np.where(known, score, 0.0))], names=["id", "lang_pred", "score"])

    source = renamed(docs, id_col, text_col, to=("id", "text")).select(F.col("id").cast("bigint").alias("id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return source.mapInArrow(run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)
