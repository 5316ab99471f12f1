"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.components import components
from varienne.llm.keys import among
from varienne.llm.store import materialize, renamed
from varienne.llm.text import Words, mix, slices

WORDS = 5
BANDS = 24
ROWS = 4
#: 64-bit words in the print of a difference.
PRINT = 8

SKETCH = "id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per document; with fewer words the whole sequence is one."""
    tokens = Words(data, offsets, seed=9, fold_case=True)
    _, hashes, bounds = tokens.windows(words, seed=9)
    counts = np.diff(tokens.bounds)
    sets = []
    for d in range(len(offsets) - 1):
        if counts[d] >= words:
            sets.append(np.unique(hashes[bounds[d]:bounds[d + 1]]))
        else:
            sets.append(np.array([tokens.whole(d)] if counts[d] else [], np.uint64))
    return sets


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set.

    In round j every element draws its j-th place of a random permutation of the ``size`` places
    and offers j plus a random fraction there; each place keeps the smallest offer.  Ranks of one
    element thus differ between places, which lowers the variance against independent hashes.  A
    document stops as soon as no later round could lower any place.
    """
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    element = np.concatenate([*sets, np.zeros(0, np.uint64)])
    best = np.full((len(sets), size), np.inf)
    places = None
    for j in range(size):
        draw = mix(element, 2 * j + 1)
        fraction = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        k = j + (mix(element, 2 * j + 2) % np.uint64(size - j)).astype(np.int64)
        if places is None:
            slot = k
        else:
            rows = np.arange(len(k))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
        np.minimum.at(best.reshape(-1), owner * size + slot, fraction + j)
        going = (best.max(axis=1, initial=0.0) > j + 1)[owner] if len(owner) else np.zeros(0, bool)
        if not going.any():
            break
        if places is None:
            # The first round changed two places only: 0 and the drawn one.
            places = np.tile(np.arange(size, dtype=np.uint16), (int(going.sum()), 1))
            kept = k[going]
            places[np.arange(len(kept)), kept] = 0
        else:
            places = places[going]
        owner, element = owner[going], element[going]
    return best


def sketches(words: int = WORDS, bands: int = BANDS, rows: int = ROWS):
    """Function for ``mapInArrow``: id and text to set size, set digest and one hash per band."""

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for row, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                best = super_minhash(sets, bands * rows).view(np.uint64).reshape(len(sets), bands, rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ best[:, :, r], r + 1)
                filled = [len(s) > 0 for s in sets]
                parts.append((
                    ids.slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if f else None for k, f in zip(keys.view(np.int64), filled)], pa.list_(pa.int64())),
                ))
            for p in parts:
                yield pa.RecordBatch.from_arrays(list(p), names=["id", "n_shingles", "digest", "bands"])

    return run


def set_blobs(words: int = WORDS):
    """Function for ``mapInArrow``: id and text to the sorted shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def overlaps(batches):
    """Function for ``mapInArrow``: two blobs to the sizes of their sets' intersection and union."""
    for batch in batches:
        common, union = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            common.append(n)
            union.append(len(both) - n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"])


def differences(percent: int):
    """Function for ``mapInArrow``: (hub, member, component, two blobs) to prefix tokens of their difference.

    The difference of a member is what it adds to its hub and what it lacks, listed in one order for
    all members of a hub: additions by hash, then lacks by hash.  If i and j have differences of sizes
    di and dj and set sizes ni and nj, they verify only if their differences have at least
    (di + dj - (ni + nj)) / 2 + percent * (ni + nj) / (100 + percent) tokens in common.  From that follows
    how many of the first tokens suffice for any two such members, one of which does not verify with
    the hub, to share one.  The bits mark which hash places a whole difference touches: two differences
    differ in at least as many tokens as their bits differ in places.
    """
    alpha = (100 - percent) / (100 + percent)

    def run(batches):
        for batch in batches:
            out = []
            for hub, rep, component, x, y in zip(*(c for c in batch.columns)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                added, lacking = y[~among(y, x)], x[~among(x, y)]
                d, n, common = len(added) + len(lacking), len(y), len(y) - len(added)
                linked = common * 100 >= (len(x) + len(added)) * percent
                least = (1 - alpha) * d / 2 if linked else (d - alpha * (n + len(x))) / (1 + alpha)
                tokens = np.concatenate([added, lacking])[:max(d - int(np.ceil(least - 1e-9)) + 1, 0)].view(np.int64)
                bits = np.zeros(64 * PRINT, np.uint8)
                bits[(np.concatenate([added, lacking]) >> np.uint64(40)) % np.uint64(len(bits))] = 1
                out.append((hub.as_py(), rep.as_py(), component.as_py(), n, d, np.packbits(bits).view(np.int64), tokens))
            names = ["hub", "rep", "component", "n", "d", "bits", "tokens"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return run


DIFFERENCES = "hub bigint, rep bigint, component bigint, n bigint, d bigint, bits array<bigint>, tokens array<bigint>"


def _with_sets(pairs: DataFrame, blobs: DataFrame, *also: str) -> DataFrame:
    joined = pairs.join(blobs.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(blobs.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", *also, "x", "y")


def _verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Exact intersection and union of the full sets of every pair, written."""
    return materialize(_with_sets(pairs, blobs).mapInArrow(overlaps, "a bigint, b bigint, common bigint, total bigint"), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Returns id_col, n_shingles, component_id (smallest id reachable) and kept, one row per input row.
    Words are split at ASCII white space, A-Z fold to a-z, and a set holds the distinct runs of
    ``words`` words, or the whole sequence when there are fewer.

    1. One pass over the texts gives set size, set digest and the band hashes of the SuperMinHash signature.
    2. Documents with equal sets form a class, represented by its smallest id; only classes go on.
    3. In each band bucket the smallest class, its hub, meets every other one, and the full sets are
       compared.  Classes that verify are connected through the hub, so pairs among them need no look.
       For the others the differences to the hub are small sets, on which a prefix filter with positions
       finds every pair that can still verify, without listing the pairs of a bucket; these are compared too.
    4. Components of the links by star contraction.

    With 24 bands of 4 rows a pair at similarity 0.8 misses every bucket with probability 3e-6.
    Null or empty text: no shingles, linked with nothing.  Null id: linked with nothing, component null,
    kept.  Rows that repeat an id are one node, linked through any of their texts.  An empty table gives no rows.  Texts of any length
    are compared whole.  Other columns are ignored.
    """
    spark = docs.sparkSession
    source = renamed(docs, id_col, text_col, to=("id", "text"))
    source = source.withColumn("id", F.col("id").cast("bigint"))
    sketch = materialize(source.mapInArrow(sketches(words, bands, rows), SKETCH), "sketches")
    classes = materialize(sketch.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    entries = classes.select("rep", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "rep")
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("bucket", "centre")
    entries = entries.join(shared, "bucket")
    pairs = materialize(entries.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # The ids grow with the documents: no broadcast, at any size.
    blobs = materialize(source.join(ids.hint("merge"), "id", "left_semi").mapInArrow(set_blobs(words), "id bigint, shingles binary"), "shingles")
    tested = _verified(pairs, blobs)
    links = tested.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")
    grouped = components(links, "a", "b")

    # Hubs with a member that did not verify and at least one more: pairs across components are open.
    hubs = tested.groupBy("a").agg(F.count("*").alias("members"), F.min(F.col("common") * 100 >= F.col("total") * percent).alias("all")).where("members > 1 and not all").select("a")
    labelled = tested.join(hubs, "a", "left_semi").join(grouped, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    tokens = _with_sets(labelled, blobs, "component").mapInArrow(differences(percent), DIFFERENCES)
    tokens = materialize(tokens, "differences").select("hub", "rep", "component", "n", "d", *[F.get("bits", F.lit(i)).alias(f"p{i}") for i in range(PRINT)], F.posexplode("tokens").alias("pos", "token"))
    carried = ("rep", "component", "n", "d", "pos", *[f"p{i}" for i in range(PRINT)])
    left, right = (tokens.select("hub", "token", *[F.col(c).alias(f"{c}_{side}") for c in carried]) for side in "ab")
    sizes = F.col("n_a") + F.col("n_b")
    least = (F.col("d_a") + F.col("d_b") - sizes) / 2 + sizes * (percent / (100 + percent))
    reach = F.least(F.col("d_a") - F.col("pos_a"), F.col("d_b") - F.col("pos_b"))
    apart = sum(F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PRINT))
    found = left.join(right, (left["hub"] == right["hub"]) & (left["token"] == right["token"]) & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
                      & (reach >= least - 1e-6) & (apart <= sizes * ((100 - percent) / (100 + percent)) + 1e-6))
    more = materialize(found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), "pairs")
    if not more.isEmpty():
        checked = _verified(more, blobs).where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")
        grouped = components(links.unionByName(checked), "a", "b")
    named = classes.join(grouped, classes["rep"] == grouped["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # Rows that repeat an id belong to that id's component whichever text they carry.
    result = sketch.join(named, "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    return result.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
