"""Trie of conversation prefixes with subtree totals from a centroid decomposition."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import materialize
from varienne.operators.ordered import ordered
from varienne.session import hint_if_small

#: Turns up to which a component is finished inside one task; larger ones are split by Spark jobs.
PART_TURNS = 100_000
#: Bytes of joined ids that travel as one row.
JOINED_BYTES = 8192

FINISHED = "m bigint, depth bigint, leaves bigint, saved bigint"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn in hex; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, a, b, bytes): turns of every conversation in order from 1, each as 120 bits of its digest and the bytes of its text.

    Null turns come first, equal ones in order of their digest.  Null role or text is empty; rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        turn_digest(role, text).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).where("conv_id is not null")
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint")
    placed = ordered(rows, ["conv_id"], "turn", ties=["digest"], row_number="pos")
    return placed.select("conv_id", "pos", part(1).alias("a"), part(16).alias("b"), "bytes")


def prefix_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, bytes) for (conv_id, pos, a, b, bytes): equal keys are equal sequences of the first pos turns.

    The keys hash running sums of four 31-bit hashes of (place, turn), so that hot conversations are summed in chunks.
    """
    low, high = F.xxhash64("pos", "a", "b"), F.xxhash64("b", "pos", "a")
    mask = F.lit((1 << 31) - 1)
    parts = {"_x1": low.bitwiseAND(mask), "_x2": F.shiftrightunsigned(low, 33), "_x3": high.bitwiseAND(mask), "_x4": F.shiftrightunsigned(high, 33)}
    summed = ordered(turns.withColumns(parts), ["conv_id"], "pos", running_sums={f"_s{i}": f"_x{i}" for i in range(1, 5)})
    sums = [f"_s{i}" for i in range(1, 5)]
    return summed.select("conv_id", "pos", F.xxhash64("pos", *sums).alias("k1"), F.xxhash64(*reversed(sums), "pos").alias("k2"), "bytes")


class Forest:
    """Nodes of a trie and, for every turn of a conversation, the node of the prefix that ends there.

    A node is named by its smallest member and its depth.  ``nodes`` has m, depth, pm (the parent's m), n_convs, w (turns that
    the subtree stands for: n_convs of its nodes), leaf, save and the component to begin with; ``path`` has conv_id, pos, m; ``convs`` conv_id and len.
    """

    def __init__(self, turns: DataFrame, convs: DataFrame):
        """``turns``: (conv_id, pos, a, b, bytes) with places from 1; ``convs``: conv_id of every conversation, turnless ones too."""
        rows = materialize(prefix_rows(turns), "prefixes")
        lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("len"))
        self.convs = materialize(convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0).cast("bigint")).alias("len")), "conversations")
        long = rows.join(hint_if_small(self.convs), "conv_id")
        grouped = long.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("m"), F.max("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") - F.col("pos") + 1).alias("w"),
            F.max("bytes").alias("bytes"), (F.max("len") == F.max("pos")).cast("bigint").alias("leaf"))
        grouped = materialize(grouped, "nodes")
        # A prefix that very many conversations share is a hot key on one side only: adaptive execution splits it.
        self.path = materialize(rows.select("conv_id", "pos", "k1", "k2").join(grouped.select("k1", "k2", "m"), ["k1", "k2"]).select("conv_id", "pos", "m"), "paths")
        self.root = self.convs.agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("w"), F.max("len").alias("longest")).first()
        null, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
        root = self.convs.where(F.col("conv_id") == self.root.m).select(
            F.col("conv_id").alias("m"), zero.alias("depth"), null.alias("pm"), F.lit(self.root.n_convs).cast("bigint").alias("n_convs"), F.lit(self.root.w).cast("bigint").alias("w"),
            F.lit(self.root.longest == 0).cast("bigint").alias("leaf"), zero.alias("save"))
        above = self.path.select(F.col("conv_id").alias("m"), (F.col("pos") + 1).alias("depth"), F.col("m").alias("above"))
        named = grouped.join(above, ["m", "depth"], "left").select(
            "m", "depth", F.coalesce("above", F.lit(self.root.m)).alias("pm"), "n_convs", "w", "leaf", ((F.col("n_convs") - 1) * F.col("bytes")).alias("save"))
        # One component at first, named by its top; written, so that joins on it do not fold into products.
        whole = {"cm": F.lit(self.root.m).cast("bigint"), "cd": zero, "total": F.lit(self.root.w).cast("bigint"), "leaves": zero, "saved": zero}
        self.nodes = materialize(named.unionByName(root).withColumns(whole), "forest")

    def rolled(self, part_turns: int = PART_TURNS) -> DataFrame:
        """(m, depth, leaves, saved): sums of leaf and save over every subtree.

        Components are split at their weighted centroid, the deepest node whose part of the component holds half of its
        turns: no piece keeps more than half.  The nodes from the centroid up to the component's top are those that hold half; they alone take
        on the total of what is cut off below the centroid.  Components above ``part_turns`` are split by jobs over all of
        them at once; the others are finished inside tasks, many to one.
        """
        active = self.nodes.select("m", "depth", "pm", "w", "leaf", "save", "leaves", "saved", "cm", "cd", "total")
        small, done = [], []
        while True:
            small.append(active.where(F.col("total") <= part_turns))
            active = active.where(F.col("total") > part_turns)
            if active.isEmpty():
                break
            active, finished = self._split(active)
            done.append(finished)
        rest = small[0]
        for x in small[1:]:
            rest = rest.unionByName(x)
        rest = materialize(rest, "components")
        groups = max(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), rest.count() // part_turns + 1)
        out = rest.withColumn("part", F.pmod(F.xxhash64("cm", "cd"), F.lit(groups))).groupBy("part").applyInArrow(finish, FINISHED)
        for x in done:
            out = out.unionByName(x.select("m", "depth", "leaves", "saved"))
        return out

    def _split(self, active: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One step for every component: (nodes of the pieces, centroids with their final sums)."""
        held = F.col("w") * 2 >= F.col("total")
        # Components above the limit: at most all turns divided by it.
        centroid = materialize(active.where(held).groupBy("cm", "cd").agg(F.max_by(F.struct("m", "depth", "w"), "depth").alias("g")).select(
            "cm", "cd", F.col("g.m").alias("gm"), F.col("g.depth").alias("gd"), F.col("g.w").alias("gw")), "centroids")
        seen = active.join(hint_if_small(centroid), ["cm", "cd"])
        # Which child of the centroid lies above a node: the one on the path of the node's smallest member.
        lower = seen.where("depth > gd").select("cm", "cd", "gm", "gd", "m").distinct()
        path = self.path.select(F.col("conv_id").alias("m"), F.col("pos").alias("at"), F.col("m").alias("child"))
        on_path = lower.join(path.withColumn("gd", F.col("at") - 1), ["m", "gd"])
        tops = active.select(F.col("m").alias("child"), F.col("depth").alias("child_depth"), F.col("pm").alias("gm"), F.col("w").alias("child_w"))
        found = on_path.join(tops.withColumn("gd", F.col("child_depth") - 1), ["child", "gd", "gm"]).select("cm", "cd", "m", "child", "child_w")
        seen = materialize(seen.join(found, ["cm", "cd", "m"], "left").withColumns({
            "child": F.when(F.col("depth") > F.col("gd"), F.col("child")),
            "is_g": (F.col("depth") == F.col("gd")) & (F.col("m") == F.col("gm"))}), "split")
        cut = seen.where("is_g or child is not null").groupBy("cm", "cd").agg(F.sum("leaf").alias("cut_leaves"), F.sum("save").alias("cut_saved"))
        seen = seen.join(hint_if_small(materialize(cut, "cut")), ["cm", "cd"])
        seen = seen.withColumns({"leaves": F.when(held, F.col("leaves") + F.col("cut_leaves")).otherwise(F.col("leaves")),
                                 "saved": F.when(held, F.col("saved") + F.col("cut_saved")).otherwise(F.col("saved"))})
        below = F.col("child").isNotNull()
        pieces = seen.where("not is_g").select(
            "m", "depth", "pm", F.when(held, F.col("w") - F.col("gw")).otherwise(F.col("w")).alias("w"), "leaf", "save", "leaves", "saved",
            F.when(below, F.col("child")).otherwise(F.col("cm")).alias("cm"), F.when(below, F.col("gd") + 1).otherwise(F.col("cd")).alias("cd"),
            F.when(below, F.col("child_w")).otherwise(F.col("total") - F.col("gw")).alias("total"))
        return materialize(pieces, "pieces"), seen.where("is_g").select("m", "depth", "leaves", "saved")


def finish(group: pa.Table) -> pa.Table:
    """Function for ``applyInArrow``: whole components to the sums of their nodes, all components of a group at once."""
    column = lambda c: group.column(c).to_numpy().astype(np.int64)
    m, depth, w = column("m"), column("depth"), column("w").copy()
    value = np.stack([column("leaf"), column("save")], 1)
    out = np.stack([column("leaves"), column("saved")], 1)
    n, top = len(m), (m == column("cm")) & (depth == column("cd"))
    # Parents by place: (smallest member, depth) as one number.
    pm = np.where(top, m, group.column("pm").fill_null(0).to_numpy())
    names, code = np.unique(np.concatenate([m, pm]), return_inverse=True)
    width = int(depth.max()) + 2
    order = np.argsort(code[:n] * width + depth)
    key = (code[:n] * width + depth)[order]
    parent = order[np.minimum(np.searchsorted(key, code[n:] * width + depth - ~top), n - 1)] if n else order
    parent = np.where(top, np.arange(n), parent)
    alive, component = np.ones(n, bool), _tops(parent, top)
    while alive.any():
        total = w[component]
        held = alive & (2 * w >= total)
        deepest = np.full(n, -1)
        np.maximum.at(deepest, component[held], depth[held])
        centroid = held & (depth == deepest[component])
        at = np.full(n, -1)
        at[component[centroid]] = np.flatnonzero(centroid)
        # Children of a centroid become tops; the centroid is a piece of its own.
        new_top = centroid | (component == np.arange(n)) | centroid[parent]
        piece = _tops(parent, new_top)
        below = alive & ((piece != component) | centroid)
        cut = np.zeros((n, 2), np.int64)
        np.add.at(cut, component[below], value[below])
        out[held] += cut[component[held]]
        upper = held & ~centroid
        w[upper] -= w[at[component[upper]]]
        alive &= ~centroid
        component = piece
    return pa.table({"m": pa.array(m), "depth": pa.array(depth), "leaves": pa.array(out[:, 0]), "saved": pa.array(out[:, 1])})


def _tops(parent: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The nearest node at or above each one that is a top, by pointer doubling."""
    jump = np.where(top, np.arange(len(parent)), parent)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def joined_ids(batches):
    """Function for ``mapInArrow`` on sorted (m, depth, conv_id): ids of one node joined by commas, some kilobytes a row."""
    for batch in batches:
        m, depth, ids = (batch.column(i).to_numpy() for i in range(3))
        if not len(m):
            continue
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (depth[1:] != depth[:-1])])
        at = np.flatnonzero(new)
        step = JOINED_BYTES // 21
        at = np.unique(np.concatenate([np.arange(a, b, step) for a, b in zip(at, np.append(at[1:], len(m)))]))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, np.append(at[1:], len(m)))]
        yield pa.RecordBatch.from_arrays([pa.array(m[at]), pa.array(depth[at]), pa.array(ids[at]), pa.array(texts, pa.string())], names=["m", "depth", "first", "ids"])


def hashed_ids(batches):
    """Function for ``mapInArrow`` on sorted (m, depth, first, ids): SHA-256 of all ids of a node, read as a stream."""
    node, state = None, None
    for batch in batches:
        done = []
        for m, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (m, depth) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (m, depth), hashlib.sha256()
            state.update(ids.encode())
        yield _hashes(done)
    if node is not None:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                      names=["m", "depth", "ends_sha256"])


def end_hashes(forest: Forest) -> DataFrame:
    """(m, depth, ends_sha256) of nodes at which a conversation ends: SHA-256 of their ids, ascending and joined by commas.

    Ids are sorted by range, so a node at which very many conversations end is spread over tasks; only its joined text meets in one,
    as a stream, because the hash is sequential.
    """
    last = forest.path.join(hint_if_small(forest.convs.where("len > 0")), "conv_id").where("pos = len").select("m", F.col("pos").alias("depth"), "conv_id")
    none = forest.convs.where("len = 0").select(F.lit(forest.root.m).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("depth"), "conv_id")
    ends = materialize(last.unionByName(none), "ends")
    texts = ends.repartitionByRange("m", "depth", "conv_id").sortWithinPartitions("m", "depth", "conv_id").mapInArrow(joined_ids, "m bigint, depth bigint, first bigint, ids string")
    return texts.repartition("m", "depth").sortWithinPartitions("m", "depth", "first").mapInArrow(hashed_ids, "m bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` are as ``numbered_turns`` returns them, ``convs`` has the conv_id of every conversation, turnless ones too.  n_leaves and
    saved_tokens are sums over the node's subtree: leaves, and (n_convs - 1) times the bytes of the node's last text.  ends_sha256 is of the
    members that end at the node.  The sums come from a centroid decomposition of the parent edges (``Forest.rolled``).

    No conversation: no rows.  Conversations without turns are members of the root alone.  Equal conversations share all nodes.
    Depth and number of turns are not limited: a conversation with very many turns is numbered and hashed in chunks
    and its chain of nodes halves with every split.
    """
    forest = Forest(turns, convs)
    sums = forest.rolled(part_turns)
    children = forest.nodes.where("pm is not null").groupBy(F.col("pm").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    out = forest.nodes.drop("leaves", "saved").join(sums, ["m", "depth"]).join(children, ["m", "depth"], "left").join(end_hashes(forest), ["m", "depth"], "left")
    return out.select(F.col("m").alias("conv_id"), "depth", F.col("pm").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first one of their family: (turns, convs) for ``prefix_trie``.

    ``turns`` are numbered ones.  Conversation c begins with the first h turns of c - c % family and goes on with its own turns after its
    first h; h is the CRC-32 of its decimal id modulo ``heads``.  A missing or shorter first one gives what it has.
    """
    turns = materialize(turns, "turns")
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    first = F.col("conv_id") - F.col("conv_id") % family
    count = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(count, "sizes")
    convs = sizes.select("conv_id", head.alias("h"), first.alias("base")).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialize(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).cast("bigint").alias("taken")), "families")
    # Of a first conversation at most heads - 1 turns go to the members of its family.
    lead = turns.where(F.col("pos") < heads).where((F.col("conv_id") % family) == 0).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h").select("conv_id", "pos", "a", "b", "bytes")
    own = turns.where(F.col("pos") > head).join(hint_if_small(convs.select("conv_id", "h", "taken")), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "bytes")
    return lead.unionByName(own), convs.select("conv_id")
