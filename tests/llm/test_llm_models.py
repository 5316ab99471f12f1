"""Prefix trie, collocations and language filters against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from plain import awkward, folded, frame

from varienne.llm import languages, phrases, trie
from varienne.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, m long, depth long, pos long, k1 string, len string"


def dialogues(seed=0):
    """Shared openings, a very long conversation, copies, ties, nulls, negative ids, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 1000, 1003, 2001]:
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "hé", "", None, "go on"])))
    rows += [(50, t, "user", f"turn {t % 3}") for t in range(150)] + [(53, t, "user", f"turn {t % 3}") for t in range(140)]
    rows += [(60 + i, t, "user", "same") for i in range(20) for t in range(12)]
    rows += [(90, None, "user", "null turn"), (90, 1, "b", "tie"), (90, 1, "a", "tie"), (90, 1, "a", "tie"), (None, 1, "user", "lost"), (91, None, None, None)]
    rng.shuffle(rows)
    return rows


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    nodes = collections.defaultdict(list)
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        full[c] = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(full[c]) + 1):
            nodes[full[c][:d]].append(c)
    below = {k: [0, 0] for k in nodes}
    children = collections.Counter(k[:-1] for k in nodes if k)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += not children[k]
            below[k[:d]][1] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], *below[k],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items())


@pytest.mark.parametrize("part_turns,seed", [(100_000, 0), (400, 0), (25, 1), (1, 2)])
def test_prefix_trie(spark, part_turns, seed):
    rows = dialogues(seed)
    if part_turns == 1:
        rows = [r for r in rows if r[0] in (None, -3, 0, 1, 2, 3, 5, 8, 60, 61, 62, 90, 91)]
    df = spark.createDataFrame([(*r, 1, 2, 3, None, "x") for r in rows], TURNS)
    got = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(df)), part_turns=part_turns).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(df))).count() == 0


def test_centroids_halve_a_chain():
    import pyarrow as pa

    n = 20_000
    depth = np.arange(n)
    table = pa.table({"m": np.zeros(n, np.int64), "depth": depth, "pm": np.zeros(n, np.int64), "w": n - depth, "leaf": (depth == n - 1).astype(np.int64), "save": np.ones(n, np.int64),
                      "leaves": np.zeros(n, np.int64), "saved": np.zeros(n, np.int64), "cm": np.zeros(n, np.int64), "cd": np.zeros(n, np.int64), "total": np.full(n, n)})
    out = trie.finish(table)
    assert (out.column("leaves").to_numpy() == 1).all() and (out.column("saved").to_numpy() == n - depth).all()


def plain_phrases(rows, least, longest, keep, percent=50):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", folded(text)):
            words = tuple(re.findall(r"[^ \t]+", piece))
            for k in range(1, longest + 1):
                f[lang or "und"].update(words[i:i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(v for g, v in count.items() if len(g) == 1)
        chosen = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        hidden = {g[i:i + k] for g, a in chosen.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= percent * chosen[g[i:i + k]]}
        ranked = []
        for g, a in chosen.items():
            if g not in hidden:
                score, k, l, r = min((1000000 * a * a // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
                ranked.append((-score, -a, " ".join(g).encode(), l, r, n))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(sorted(ranked)[:keep], 1)]
    return sorted(out)


def talk(seed=0):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "the", "ümlaut", "日本", "x\x00y", "c-d"]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x1c"])
    text = lambda n: "".join(rng.choice(vocabulary) + gap() for _ in range(n))
    passage = text(40)
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randrange(60))) for _ in range(120)]
    rows += [("en", text(5) + passage + text(5)) for _ in range(30)] + [("fr", passage)] * 12
    rows += [("en", None), (None, None), ("de", ""), ("de", " .. \n"), ("de", "one"), ("xx", "same " * 3000), ("xx", text(4000))]
    return rows


@pytest.mark.parametrize("least,longest,trigger,keep", [(2, 3, 32, 2000), (5, 3, 1, 40), (3, 4, 2, None), (2, 2, 7, 3)])
def test_collocations(spark, least, longest, trigger, keep):
    rows = talk()
    df = spark.createDataFrame([(x, t, "k", 1, None) for x, t in rows], "lang string, text string, key string, n long, segment string")
    got = phrases.collocations(df, least=least, longest=longest, trigger=trigger, keep=keep).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, least, longest, keep)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_chunks_own_every_word_once():
    import pyarrow as pa

    texts = [t for _, t in talk(3) if t]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    words = sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", t)) for t in texts)
    for trigger in (1, 3, 32):
        chunks = [r for b in phrases.parsed(2, trigger, 3)([batch]) for r in b.to_pylist()]
        assert sum(c["n"] * c["words"] for c in chunks) == words
        assert sum(c["n"] for c in chunks if c["tail"]) == sum(bool(re.search(r"[^ \t.,;:!?\n-\r]", t)) for t in texts)


def test_filters_return_all_languages_of_an_ngram():
    rng = np.random.default_rng(0)
    members = [(lang, int(k)) for lang in range(70) for k in rng.integers(0, 2**40, 300)] + [(lang, 77) for lang in range(0, 70, 3)]
    model = languages.filter_of([f"l{i:02}" for i in range(70)], members, "l00")
    masks = [model.masks(np.array([k for _, k in members], np.uint64), w) for w in range(2)]
    for i, (lang, _) in enumerate(members):
        assert int(masks[lang // 64][i]) >> (lang % 64) & 1
    shared = [int(model.masks(np.array([77], np.uint64), w)[0]) for w in range(2)]
    assert {i for i in range(70) if shared[i // 64] >> (i % 64) & 1} >= set(range(0, 70, 3))
    foreign = rng.integers(2**41, 2**50, 200_000).astype(np.uint64)
    seen = np.array([np.mean(model.masks(foreign, i // 64) >> np.uint64(i % 64) & np.uint64(1)) for i in range(70)])
    assert np.allclose(seen, model.false_rates(), atol=2e-3)


def plain_ngrams(text, sizes):
    raw = re.sub(rb" +", b" ", b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + b" ")
    return [(k, raw[i:i + k]) for k in sizes for i in range(len(raw) - k + 1)]


def test_ngrams_and_members_are_those_of_a_plain_count(spark):
    rows = [(i, t, "ab"[i % 2]) for i, (_, t) in enumerate(awkward()) if t]
    model_rows = [(i, x, t) for i, t, x in rows] + [(900, None, "foreign"), (901, "a", None)]
    df = spark.createDataFrame([(*r, 1) for r in model_rows], "doc_id long, lang string, text string, key long")
    model = languages.fit_languages(df, least_share=2e-3)
    for i, lang in enumerate(("a", "b")):
        count = collections.Counter(g for _, t, x in rows if x == lang for g in set(plain_ngrams(t, languages.SIZES)))
        total = collections.Counter()
        for (k, _), n in count.items():
            total[k] += n
        for (k, g), n in count.items():
            key = np.array([int.from_bytes(g, "little") | k << 56], np.uint64)
            if n >= 2e-3 * total[k]:
                assert int(model.masks(key, 0)[0]) >> i & 1
    outside = [np.array([int.from_bytes(g, "little") | k << 56], np.uint64) for (k, g), n in count.items() if n < 2e-3 * total[k]]
    assert np.mean([int(model.masks(k, 0)[0]) >> 1 & 1 for k in outside]) < 0.05


def test_language_rules(spark):
    train = [(1, "the house and the garden and the street", "en"), (2, "das Haus und der Garten und die Straße", "de"), (3, "das Haus und die Katze", "de")]
    model = languages.fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"), least_share=1e-3)
    tests = [(1, None), (2, ""), (3, "12 %% 3"), (4, "und das"), (5, "and the"), (6, "ж"), (None, "the"), (5, "and the"), (8, "and the street " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 1.0, True) for i, t in tests], "doc_id long, text string, lang string, score double, letters boolean")
    got = sorted(((r.doc_id, r.lang_pred) for r in languages.identify_languages(df, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (6, "de"), (None, "en"), (5, "en"), (8, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in languages.identify_languages(df, model).collect())
    empty = languages.fit_languages(spark.createDataFrame([(1, None, "de"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in languages.identify_languages(df, empty).collect()} == {"und"}
    assert languages.identify_languages(df.limit(0), model).count() == 0


def test_thinning_leaves_a_bounded_sample_per_language(spark):
    rows = [(i, "das ist gut", "de") for i in range(4000)] + [(5000, "that is good", "en")]
    model = languages.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_labelled=50)
    assert model.langs == ["de", "en"] and model.default == "de"
    assert languages.identify_languages(spark.createDataFrame([(1, "that"), (2, "gut")], "doc_id long, text string"), model).orderBy("doc_id").collect()[0].lang_pred == "en"


def test_held_out_languages(spark):
    got = QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
