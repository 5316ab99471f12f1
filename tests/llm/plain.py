"""Plain versions of the operators, and awkward documents, for comparison."""

import random
import re

from pyspark.sql import types as T

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like those that operators use inside.
EXTRA = ("id", "keys", "row", "bucket", "x", "digest", "removed", "spans", "component", "r1", "copies")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def frame(spark, rows):
    """(doc_id, text) rows with clashing extra columns, some of them null."""
    return spark.createDataFrame([(i, t, *[None if n % 3 else "x" for n in range(len(EXTRA))]) for i, t in rows], SCHEMA)


def awkward(seed=0, vocabulary=40):
    """Copies, near copies, shared passages, null, empty, one-word, accented and very long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    word = lambda: rng.choice([f"w{i}" for i in range(vocabulary)] + ["été", "日本", "A", "a", "W1"])
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(60)
    rows = [(i, text(rng.randrange(1, 60))) for i in range(20)]
    rows += [(100 + i, f"{text(10)} {passage}\n{text(5)}") for i in range(8)]
    for i in range(25):
        words = base.split()
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, base), (301, base.upper()), (302, base), (303, None), (304, ""), (305, "   \n\t"), (306, "one"), (307, "one two"), (308, "ONE  two"), (309, "\x00 \x00 b c")]
    rows += [(310, text(3000)), (311, "same " * 5000), (312, "same " * 4000), (2, rows[2][1]), (None, base), (None, None)]
    rng.shuffle(rows)
    return rows


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    words = SPACE.findall(folded(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def near_components(rows, percent):
    """(row, component) with the smallest reachable id; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, s in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i) if i is not None and s else i) for i, s in sets]
