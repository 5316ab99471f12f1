"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in DataFrame operations only.

A table is an array of its cells in use, (cell, n, k, c): how many digests lie in the cell, their exclusive or and that of their checks.
Building, subtracting, folding and peeling are expressions on such arrays, so a table never leaves its row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varienne.llm.store import materialize, renamed, total_bytes

#: A paragraph is a line; longer lines are cut after this many code points, in short texts after fewer.
PARAGRAPH = 256
SHORT_PARAGRAPH = 32
#: Code points below which a text is short.
SHORT_TEXT = 1024
HASHES = 3
LEAST_CELLS = 8
#: Peelings of a table before it counts as failed.
ROUNDS = 24
#: Tables tried for one difference, each twice as large as the one before.
TRIES = 10

CELLS = "array<struct<cell:bigint,n:bigint,k:bigint,c:bigint>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    cut = lambda n: F.regexp_extract_all(text, F.lit("[^\\n]{1,%d}" % n), F.lit(0))
    pieces = F.when(F.length(text) < SHORT_TEXT, cut(SHORT_PARAGRAPH)).otherwise(cut(PARAGRAPH))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def part_size(elements: Column) -> Column:
    """Cells in each of the three parts of a table: a power of two, at least one per element."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(elements, F.lit(LEAST_CELLS))))).cast("bigint")


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def entries(digest: Column, n: Column, size: Column) -> Column:
    """What a digest puts into its cell of every part."""
    return F.array(*[F.struct((size * p + F.pmod(F.xxhash64(digest, F.lit(p)), size)).alias("cell"), n.cast("bigint").alias("n"), digest.alias("k"), check(digest).alias("c")) for p in range(HASHES)])


def added_up(parts: Column) -> Column:
    """One entry per cell of entries in any order; cells that hold nothing are left out."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["cell"] != F.get(s, i - 1)["cell"]))
        return let(first, lambda at: F.transform(at, lambda start, j: F.aggregate(
            F.slice(s, start + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - start),
            F.struct(F.get(s, start)["cell"].alias("cell"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c")),
            lambda acc, e: F.struct(acc["cell"].alias("cell"), (acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["c"].bitwiseXOR(e["c"]).alias("c")))))

    whole = let(F.array_sort(parts), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast(CELLS)))
    return F.filter(whole, lambda e: (e["n"] != 0) | (e["k"] != 0) | (e["c"] != 0))


def table(digests: Column, size: Column) -> Column:
    """Table of distinct digests with ``size`` cells in each part."""
    return added_up(F.flatten(F.transform(digests, lambda d: entries(d, F.lit(1), size))))


def folded(cells: Column, size: Column, to: Column) -> Column:
    """Entries of a table at a smaller size, a power of two as well: cells that agree modulo that size meet."""
    return F.transform(cells, lambda e: F.struct((F.floor(e["cell"] / size) * to + e["cell"] % size % to).alias("cell"), e["n"], e["k"], e["c"]))


def negative(cells: Column) -> Column:
    return F.transform(cells, lambda e: F.struct(e["cell"], (-e["n"]).alias("n"), e["k"], e["c"]))


def peeled(difference: Column, size: Column, rounds: int = ROUNDS) -> Column:
    """Digests that a difference of two tables gives away: (left, plus, minus).

    A cell that holds one digest names it, with its side; the digest then leaves its cells in all parts, which may bare others.
    ``left`` is what could not be peeled: empty if the whole difference was recovered.
    """
    none = F.array().cast("array<bigint>")

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["left"], lambda e: (F.abs(e["n"]) == 1) & (e["c"] == check(e["k"])))
        found = F.array_distinct(F.transform(pure, lambda e: F.struct(e["k"], e["n"])))
        side = lambda got, n: F.transform(F.filter(got, lambda e: e["n"] == n), lambda e: e["k"])
        after = let(found, lambda got: F.when(F.size(got) > 0, F.struct(
            added_up(F.concat(state["left"], F.flatten(F.transform(got, lambda e: entries(e["k"], -e["n"], size))))).alias("left"),
            F.concat(state["plus"], side(got, 1)).alias("plus"), F.concat(state["minus"], side(got, -1)).alias("minus"), F.lit(True).alias("going")))
            .otherwise(F.struct(state["left"].alias("left"), state["plus"].alias("plus"), state["minus"].alias("minus"), F.lit(False).alias("going"))))
        return F.when(state["going"] & (F.size(state["left"]) > 0), after).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(difference.alias("left"), none.alias("plus"), none.alias("minus"), F.lit(True).alias("going")), step)


def difference(a: Column, b: Column, a_table: Column, b_table: Column, rounds: int = ROUNDS) -> Column:
    """Digests of one text that another lacks and the other way round: (done, plus, minus), from the tables of both.

    Both tables are folded to a small common size, subtracted and peeled; if that fails, to twice the size, and beyond the size of either table
    a larger one is built from the digests.  After ``TRIES`` sizes, with a probability that no corpus meets, the digests are compared as they are.
    """
    own, other = part_size(F.size(a)), part_size(F.size(b))
    # Room for half of what two texts without a common paragraph differ in.
    least = part_size((F.size(a) + F.size(b)) / 4)
    both = lambda x, y: added_up(F.concat(x, negative(y)))

    def attempt(tables: Column, state: Column, t: Column) -> Column:
        def at(size: Column) -> Column:
            fits = size <= F.least(own, other)
            cells = F.when(fits, both(folded(tables["a"], own, size), folded(tables["b"], other, size))).otherwise(both(table(a, size), table(b, size)))
            return let(peeled(cells, size, rounds), lambda p: F.struct((F.size(p["left"]) == 0).alias("done"), p["plus"].alias("plus"), p["minus"].alias("minus")))

        return F.when(state["done"], state).otherwise(let(least * F.pow(F.lit(2.0), t).cast("bigint"), at))

    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(False).alias("done"), none.alias("plus"), none.alias("minus"))
    tried = let(F.struct(a_table.alias("a"), b_table.alias("b")), lambda tables: F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, lambda state, t: attempt(tables, state, t)))
    return let(tried, lambda d: F.when(d["done"], d).otherwise(F.struct(F.lit(False).alias("done"), F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))))


def fingerprint(cells: Column, size: Column) -> Column:
    """A table as text: cells per part, then every cell in use as place, count, key and check, in hex."""
    return F.concat_ws(":", F.hex(size), F.concat_ws(",", F.transform(cells, lambda e: F.concat_ws(".", F.hex(e["cell"]), F.hex(e["n"]), F.hex(e["k"]), F.hex(e["c"])))))


def range_of(bounds: Column, key: Column, ranges: int) -> Column:
    """Number, from 1, of the range that a key lies in: how many of the sorted first keys are not above it, by bisection."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        above = F.get(bounds, middle) > key
        return F.when(state["lo"] < state["hi"], F.struct(F.when(above, state["lo"]).otherwise(middle + 1).alias("lo"), F.when(above, middle).otherwise(state["hi"]).alias("hi"))).otherwise(state)

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ranges.bit_length())), start, halve)["lo"]


def with_next(docs: DataFrame, order: list[str], text: str, ranges: int) -> DataFrame:
    """Distinct rows (order, text) with copies and the next row's text in ``following``, the first row following the last.

    Boundaries of ranges are drawn from the order columns alone; texts are dealt to ranges in one shuffle.  The first row of every range is
    sent to the range before too, as a guest, so that each row finds its successor where it is.
    """
    keys = materialize(docs.select(*order).distinct().repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    # One key per range, in order, as a constant of the plan.
    heads = sorted((r.head.asDict() for r in keys.groupBy("range").agg(F.min(F.struct(*order)).alias("head")).collect()), key=lambda h: [(h[c] is not None, h[c]) for c in order])
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*order).schema}
    bounds = F.from_json(F.lit(json.dumps(heads)), "array<struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in order) + ">>")
    here, count = F.struct(*order), F.lit(len(heads))
    dealt = docs.withColumn("at", range_of(bounds, here, ranges))
    places = F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("guest")))
    before = F.when(F.col("at") == 1, count).otherwise(F.col("at") - 1)
    guest = F.array(F.struct(before.alias("range"), F.lit(True).alias("guest")))
    places = F.when(F.get(bounds, F.col("at") - 1).eqNullSafe(here), F.concat(places, guest)).otherwise(places)
    placed = dealt.select(*order, text, F.inline(places)).repartition(ranges, "range")
    rows = placed.groupBy("range", "guest", *order).agg(F.count("*").alias("copies"), F.first(text).alias(text))
    following = F.lead(text).over(Window.partitionBy("range").orderBy("guest", *order))
    return rows.withColumn("following", following).where("not guest").select(*order, "copies", text, "following")


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Shared share of all elements of two sets of given sizes that differ in so many."""
    shared = (a + b - apart) / 2
    return F.when(a + b == 0, F.lit(1.0)).otherwise(shared / (a + b - shared))


KEY = ["r1", "r2"]
#: Bytes of texts in a range of the order.
RANGE_BYTES = 32 << 20


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Fingerprint every text and an edited form of it, and compare them with each other and the next text.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, lost and gained (digests of the
    paragraphs that only the text or only its edited form has), one row per input row.  The edited form has its last floor(n_chars / 2) code points replaced by the first as many
    of the next text in ascending order of id (after the last the first).

    A fingerprint is an invertible Bloom lookup table of the distinct paragraphs' 64-bit digests: three
    parts with at least one cell per paragraph each.  The tables of two fingerprints are folded to a small size and subtracted cell by cell, and peeling recovers the
    digests that only one side has; their number gives the likeness (shared share of all paragraphs).
    What does not peel is tried at twice the size, at last with larger tables.  Texts with the same paragraphs have equal fingerprints.  Paragraphs are
    lines, cut after 256 code points, or 32 in texts below 1024, so that short texts of one line have several.

    Texts move once, to their place in the order of ids; order is found by ranges, never in one partition.  After that
    nothing moves: tables are built, subtracted and peeled inside the row, in time n log n of its paragraphs.  Null ids come first; null or empty
    texts have no paragraphs, and two such are alike (1).  Rows of one id follow each other by hash of their text;
    repeated rows are one document and give equal results.  Other columns are ignored.
    """
    source = renamed(docs, id_col, text_col, to=("id", "text")).select("id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.select("id", F.xxhash64("id", "text").alias("r1"), F.xxhash64("text", "id", F.lit(1)).alias("r2"), "text")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total_bytes(docs, text_col) // RANGE_BYTES + 1)
    rows = with_next(source, ["id", *KEY], "text", ranges)
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("left(following, cast(floor(n_chars / 2) as int))"))
    rows = rows.withColumn("changed", edited).select("id", "copies", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"),
                                                     paragraphs(F.col("changed")).alias("edited"), paragraphs(F.col("following")).alias("next"))
    # From here on every row stays where it is.
    tables = rows.withColumns({f"{v}_cells": table(F.col(v), part_size(F.size(v))) for v in ("own", "edited", "next")})
    apart = tables.withColumns({f"to_{v}": difference(F.col("own"), F.col(v), F.col("own_cells"), F.col(f"{v}_cells"), rounds) for v in ("edited", "next")})
    near = lambda v: likeness(F.size("own"), F.size(v), F.size(f"to_{v}.plus") + F.size(f"to_{v}.minus"))
    out = apart.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", *[fingerprint(F.col(f"{v}_cells"), part_size(F.size(v))).alias(n) for v, n in (("own", "fingerprint"), ("edited", "edited_fingerprint"))],
        near("edited").alias("near_edited"), near("next").alias("near_next"), F.col("to_edited.plus").alias("lost"), F.col("to_edited.minus").alias("gained"), "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copies", "copy")
