"""Secret scan with linking of multipart credentials."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import materialize, renamed

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "weak")
BASE = KINDS[:3]
#: Code points around a part in which a complementary part counts as belonging to it.
SCOPE = 256

#: Patterns of the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Parts that mean little alone: names of accounts, addresses of services, strings that look random.
IDENTIFIER = r"""\b(user|user_?name|login|account|client_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""\b(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?)"""
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
MIN_ENTROPY = 3.5

_PATTERNS = {
    "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE), "access": re.compile(ACCESS),
    # Maximal runs: asking for the length at once finds the same ones.
    "hex": re.compile(r"[0-9a-f]{%d,}" % MIN_HEX),
    "identifier": re.compile(IDENTIFIER, re.ASCII | re.IGNORECASE), "endpoint": re.compile(ENDPOINT, re.ASCII | re.IGNORECASE), "weak": re.compile(RANDOM),
}
#: Cheap patterns that every text with a match of the kind also matches.
_HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]""", "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{16}",
    "identifier": r"""(?i:user|login|account|client_?id|tenant_?id)(?i:_?name)?["']? *[:=]""", "endpoint": r"""://|(?i:host|endpoint|server)["']? *[:=]""",
    "weak": r"[A-Za-z0-9+/_-]{20}",
}
FOUND = "id bigint, row bigint, spans array<struct<start:bigint,kind:int,end:bigint>>"


def entropy(s: str) -> float:
    """Bits per character of a string's own letter counts."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans of one kind, in code points, end exclusive."""
    out = []
    for m in _PATTERNS[kind].finditer(text):
        if kind == "assign" and len(m[2]) < MIN_VALUE or kind == "access" and len(m[0]) < MIN_ACCESS:
            continue
        if kind == "weak" and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= MIN_ENTROPY):
            continue
        out.append(m.span())
    return out


def parts(text: str, kinds=KINDS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all parts; random strings inside another part are left out."""
    spans = sorted((s, KINDS.index(k), e) for k in kinds for s, e in find(k, text))
    others, weak = [x for x in spans if KINDS[x[1]] != "weak"], [x for x in spans if KINDS[x[1]] == "weak"]
    return sorted(others + [w for w in weak if not any(o[0] < w[2] and w[0] < o[2] for o in others)]) if weak else spans


def text_key(text: Column) -> Column:
    """64 bits that stand for a text."""
    return F.xxhash64(text, F.lit(7))


def scan(batches):
    """Function for ``mapInArrow``: (id, text, text key) to parts."""
    for batch in batches:
        texts = batch.column(1)
        hints = {k: pc.fill_null(pc.match_substring_regex(texts, h), False).to_numpy(zero_copy_only=False) for k, h in _HINTS.items()}
        any_ = np.logical_or.reduce(list(hints.values())) if len(texts) else np.zeros(0, bool)
        spans = []
        for i in range(len(texts)):
            if any_[i]:
                text = texts[i].as_py()
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in parts(text, [k for k in KINDS if hints[k][i]])])
            else:
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kind)], names=["id", "row", "spans"])


def joined(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("bigint")


def linked_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, with_row: bool = False) -> DataFrame:
    """Secrets of every whole text; weak parts only where complementary ones are near.

    Returns id_col, base and spans, both arrays of (start, kind, end) with kind an index into
    ``KINDS`` and positions in code points, one row per input row.  ``base`` has the assignments, access
    keys and hex strings; ``spans`` adds names of accounts that have a secret in their scope, addresses
    that have a secret or access key, and random-looking strings that have an access key, a name or an
    address.  A scope reaches ``scope`` code points to either side of a part.

    Texts are searched inside tasks, after a linear-time hint has ruled most of them out; parts then
    become rows, and an interval join on (text, stretch of ``scope`` code points) keeps a weak part if
    the scope of any complementary part meets any of it.  It is a semi join, so no pairs are made; a long part
    is asked about in each of its stretches and kept once.

    Null or empty text: no spans.  Null ids and repeated rows: judged by their own text.  An empty table gives no rows.  Texts of any
    length are searched whole.  Other columns are ignored.
    """
    source = renamed(docs, id_col, text_col, to=("id", "text")).select(F.col("id").cast("bigint").alias("id"), "text", text_key(F.col("text")).alias("row"))
    found = materialize(source.mapInArrow(scan, FOUND), "parts")
    # Rows of one text have the same parts, whatever their ids.
    rows = found.where(F.exists("spans", lambda x: x["kind"] >= len(BASE)) & (F.size("spans") > 1)).select("row", "spans").dropDuplicates(["row"])
    rows = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    role = {k: i for i, k in enumerate(KINDS)}
    reach = rows.select("row", F.col("kind").alias("other"), (F.col("start") - scope).alias("lo"), (F.col("end") + scope).alias("hi"))
    reach = reach.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / scope), F.floor((F.col("hi") - 1) / scope))))
    weak = rows.where(F.col("kind") >= len(BASE)).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))).alias("w")
    secret = F.col("other").isin(role["assign"], role["hex"])
    complement = (
        ((F.col("w.kind") == role["identifier"]) & (secret | (F.col("other") == role["weak"])))
        | ((F.col("w.kind") == role["endpoint"]) & (secret | F.col("other").isin(role["access"], role["weak"])))
        | ((F.col("w.kind") == role["weak"]) & F.col("other").isin(role["access"], role["identifier"], role["endpoint"])))
    near = (F.col("w.end") > F.col("r.lo")) & (F.col("w.start") < F.col("r.hi"))
    kept = weak.join(reach.alias("r"), (F.col("w.row") == F.col("r.row")) & (F.col("w.bin") == F.col("r.bin")) & near & complement, "left_semi")
    linked = kept.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    out = found.join(linked, "row", "left").select("id", *["row"] * with_row, base.alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))).alias("spans"))
    return out.withColumnRenamed("id", id_col)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by its kind in brackets, other columns unchanged.

    Overlapping spans become one replacement, named after the first.  Rows of one id and one text are alike.
    """
    found = linked_secrets(docs, id_col, text_col, scope, with_row=True).where(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"])
    at = docs.columns.index(text_col)
    flat = docs.withColumn(" row", text_key(F.col(f"`{text_col}`")))
    both = flat.join(found.select(F.col("row").alias(" row"), F.col("spans").alias(" spans")), " row", "left")
    both = both.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("` spans`"))

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(at), batch.column(len(batch.columns) - 1)
            if spans.null_count < len(batch):
                out = texts.to_pylist()
                for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                    text, end, parts_ = out[i], 0, []
                    for s in spans[i].as_py():
                        if s["start"] >= end:
                            parts_ += [text[end:s["start"]], f"[{KINDS[s['kind']]}]"]
                        end = max(end, s["end"])
                    out[i] = "".join([*parts_, text[end:]])
                texts = pa.array(out, texts.type)
            columns = list(batch.columns[:-1])
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)
