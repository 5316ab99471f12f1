"""Near duplicates, word windows and byte strings against plain versions."""

import random

import numpy as np
import pytest
from plain import SPACE, awkward, frame, near_components

from varienne.llm import keys, near, substrings, suffixes, text
from varienne.llm.components import components
from varienne.operators.ordered import ordered


@pytest.mark.parametrize("percent,seed", [(85, 0), (80, 1), (60, 2)])
def test_near_duplicates(spark, percent, seed):
    rows = awkward(seed)
    got = sorted((tuple(r) for r in near.near_duplicates(frame(spark, rows), percent=percent).collect()), key=str)
    want = sorted(((i, n, c, True if i is None else i == c) for i, n, c in near_components(rows, percent)), key=str)
    assert got == want


def test_many_near_copies_lose_no_link(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            # Some edits are shared, so that members link past the hub.
            p = rng.choice([10, 40, 80, 120, *range(150)])
            words[p] = f"e{p}" if rng.random() < 0.5 else f"r{rng.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == {i: c for i, _, c in near_components(rows, 85)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    s = near.super_minhash([a, b, a, np.zeros(0, np.uint64), pool[:3]], 512)
    assert (s[0] == s[2]).all() and np.isinf(s[3]).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08
    assert np.isfinite(s[4]).all() and len(np.unique(np.floor(s[4]))) > 10


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def word_windows(rows, k):
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for p in range(len(w) - k + 1 if i is not None else 0):
            g = tuple(w[p:p + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for p in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[p:p + k])] < i:
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [13, 3, 1])
def test_repeated_word_windows(spark, k):
    rows = awkward(3)
    df = substrings.remove_repeated_windows(frame(spark, rows), window=k)
    got = df.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == word_windows(rows, k)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_flushes_and_buckets_do_not_matter(spark):
    rows = awkward(4)
    source = frame(spark, rows).select("doc_id", "text").toDF("id", "text").repartition(5)
    results = []
    for buckets, flush in ((1, 10**9), (7, 50), (3, 400)):
        found = keys.repeated_keys(source, substrings.window_keys(5), buckets, flush=flush).collect()
        results.append({r.id: sorted(set(np.frombuffer(bytes(r["keys"]), np.uint64).tolist())) for r in found})
    assert results[0] == results[1] == results[2] and results[0]


def byte_strings(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            first[b[p:p + length]] = min(first.get(b[p:p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for n, g in enumerate(gone) if g and not (n and gone[n - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,anchor", [(50, 26), (12, 5)])
def test_repeated_byte_strings(spark, length, anchor):
    rows = awkward(6) + [(900, "ab" * 3000 + "tail"), (901, "x" + "ba" * 3000), (902, "\x00" * 70 + "q"), (903, "p" + "\x00" * 60)]
    got = suffixes.remove_repeated_strings(frame(spark, rows), length=length, anchor=anchor).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=str) == byte_strings(rows, length)


def test_small_merges_agree(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MERGE_SYMBOLS", 300)
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", 500)
    monkeypatch.setattr(suffixes, "RUN", 7)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 130)
    monkeypatch.setattr(suffixes, "MOST_WINDOWS", 3)
    rows = awkward(7)
    got = suffixes.remove_repeated_strings(frame(spark, rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=str) == byte_strings(rows, 50)


def test_repeats_inside_the_first_owner(spark, monkeypatch):
    # Every document is a flush of its own, so 5 is the first owner of what it holds several times.
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", 1)
    rng = random.Random(11)
    passage, other, own = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (150, 90, 120))
    twice = f"{passage}\n1{own}\n{passage}\n2{own}{other}!\n{passage}\n3"
    rows = [(5, twice), (3, f"x{passage}y"), (9, f"{passage}{passage}{other}"), (4, f"q{passage[20:130]}r"), (7, f"{other[:70]}?{other[:70]}!")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        got = suffixes.remove_repeated_strings(frame(spark, rows)).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=str) == byte_strings(rows, 50)


@pytest.mark.parametrize("target", [2_000_000, 3])
def test_rows_of_one_id_lose_only_their_own_bytes(spark, monkeypatch, target):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, second, own = text(80), text(70), text(90)
    hot = [(8, text(60) + (shared if i % 2 else second)[:55 + i] + text(10)) for i in range(9)]
    rows = [(3, text(10) + shared + text(5) + second), (5, text(10) + shared), (5, text(300)), (5, own + second), (5, own + second), (5, None), (5, ""), (6, own), *hot]
    monkeypatch.setattr(suffixes, "ordered", lambda *a, **k: ordered(*a, **k, target_rows=target))
    got = suffixes.remove_repeated_strings(frame(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=str) == byte_strings(rows, 50)


def test_many_contexts_of_one_anchor(spark):
    rng = random.Random(3)
    name = "anchor of 26 bytes, or so."
    context = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))
    rows = [(i, context() + name + context()) for i in range(10_000)]
    rows += [(20_000 + i, t[8:-8]) for i, t in rng.sample(rows, 300)]
    got = suffixes.remove_repeated_strings(frame(spark, rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=str) == byte_strings(rows, 50)


def test_strings_that_cannot_share_a_window():
    rng = np.random.default_rng(4)
    name = rng.integers(97, 123, 26).astype(np.uint8)
    context = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    before, after = context(24), context(24)
    texts = [np.concatenate(p) for p in ((context(24), name, context(24)), (before, name, after), (context(4), before[-12:], name, after[:12], context(9)), (before[:23], context(1), name, after),
                                         (context(24), name, after[:11], context(12)), (context(13), before[-11:], name, context(24)))]
    twice = np.concatenate([name, name, context(3)])
    (key,) = suffixes._smallest(name, 26, 26)
    strings = suffixes.Strings([(np.array([suffixes._low(key)], np.uint64), np.array([i]), np.array([len(t) - 49]), np.array([len(t)]), np.array([1]), np.array([0]), t) for i, t in enumerate(texts)])
    assert suffixes.may_meet(strings, np.arange(len(texts)), 50, 26).tolist() == [False, True, True, True, False, False]
    strings = suffixes.Strings([(np.array([suffixes._low(key)], np.uint64), np.array([i]), np.array([len(t) - 49]), np.array([len(t)]), np.array([1]), np.array([0]), t) for i, t in enumerate([*texts, twice])])
    assert suffixes.may_meet(strings, np.arange(len(texts) + 1), 50, 26).all()


def test_runs_of_windows():
    doc, start, count = (np.array(x) for x in ([4, 2, 4, 4, 2, 4], [10, 0, 0, 3, 200_000, 30], [5, 3, 4, 7, 70_000, 1]))
    runs = suffixes.joined(doc, start, count)
    assert [x.tolist() for x in runs] == [[2, 2, 4, 4], [0, 200_000, 0, 30], [3, 70_000, 15, 1]]
    d, packed = suffixes.spans_of(*runs)
    assert d.tolist() == [2, 2, 2, 4, 4] and ((packed >> np.uint64(16)) + (packed & np.uint64(0xFFFF))).tolist() == [3, 265_535, 270_000, 15, 31]


def test_blocks_name_the_same_windows(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 730, 2900, 4000])
    names = lambda runs: {(int(r), int(s) + i): int(k) for s, c, k, r in zip(*runs) for i in range(c)}
    whole = names(suffixes.anchor_runs(data, offsets, 50, 26))
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 97)
    assert names(suffixes.anchor_runs(data, offsets, 50, 26)) == whole
    assert len(whole) == sum(max(b - a - 49, 0) for a, b in zip(offsets, offsets[1:]))


def test_merge_orders_suffixes():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(1, 4, n), 0).astype(np.uint16) for n in (40, 25, 60)]
    shard, place, common = suffixes.merge_bwt(texts, 6)
    prefix = [tuple((texts[s].tolist() * 2)[p:p + 6]) for s, p in zip(shard, place)]
    inside = [p for p in prefix if 0 not in p[:-1]]
    assert inside == sorted(inside)
    assert common[0] == 0
    for x, y, n in zip(prefix, prefix[1:], common[1:]):
        if 0 not in x[:-1] and 0 not in y[:-1]:
            assert n == next((i for i in range(6) if x[i] != y[i]), 6)
    assert sorted(zip(shard.tolist(), place.tolist())) == [(s, p) for s, t in enumerate(texts) for p in range(len(t))]


def test_words_of_a_slice():
    data = "a bb\tccc".encode() + b"" + "d".encode() + "été x ".encode()
    offsets = np.array([0, 8, 8, 9, 17])
    words = text.Words(np.frombuffer(data, np.uint8), offsets)
    assert np.diff(words.bounds).tolist() == [3, 0, 1, 2]
    assert [data[a:b].decode() for a, b in zip(words.starts, words.ends)] == ["a", "bb", "ccc", "d", "été", "x"]


@pytest.mark.parametrize("operator", [near.near_duplicates, substrings.remove_repeated_windows, suffixes.remove_repeated_strings])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    assert operator(frame(spark, [(1, None), (None, "")])).count() == 2
