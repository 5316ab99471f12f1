"""Classifier, archives, decontamination, licenses, packing, secrets, fingerprints, pipeline."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from plain import SPACE, awkward, folded, frame
from pyspark.sql import functions as F

import corpus_pipeline
from varienne.llm import credentials, decontaminate, fingerprints, licenses, packing, quality, queries, warc
from varienne.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


# --- quality ---------------------------------------------------------------

def corpus(n=600, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, good = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 120))]
        if i % 5 == 0:
            kind = rng.randrange(3)
            text = " ".join([w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:6] for _ in range(20)])
        else:
            text = ". ".join(" ".join(words[k:k + 8]).capitalize() for k in range(0, len(words), 8)) + "."
            good.append(i)
        rows.append((i, text))
    return rows, good


def test_classifier_on_held_out_documents(spark):
    rows, good = corpus()
    trusted = spark.createDataFrame([(i,) for i in good if i % 3 == 0], "some_id long")
    docs = frame(spark, rows)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, trusted, unlabelled=F.col("doc_id") % 4 != 1).collect()}
    held = [i for i, _ in rows if i % 4 == 1]
    assert np.mean([(scores[i] >= 0.5) == (i in set(good)) for i in held]) > 0.97
    model, _ = quality.fit_quality(docs, trusted)
    assert abs(model.prior - 0.8) < 0.08
    again = {r.doc_id: r.score for r in quality.add_score(docs, model).collect()}
    direct = {r.doc_id: r.score for r in quality.quality_scores(docs, trusted).collect()}
    assert all(abs(again[i] - direct[i]) < 1e-9 for i in again)


def test_too_large_a_prior_does_no_harm(spark):
    rows, good = corpus(300, 1)
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in good], "id long")
    model, features = quality.fit_quality(docs, trusted, prior=0.95)
    d = len(model.mean) + 1

    def risk(w):
        (p_loss, z, *_), (u_loss, *_) = quality.Moments(quality._totals(features, model.mean, model.scale, w), d).parts
        return 0.95 * (p_loss - z @ w) + max(0.0, u_loss - 0.95 * p_loss)

    assert risk(model.weights) < risk(np.zeros(d))
    scores = quality.add_score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id in set(good)) for r in scores]) > 0.9


def test_weights_are_those_of_a_plain_descent(spark):
    rows, good = corpus(400, 2)
    docs, chosen, prior = frame(spark, rows), {i for i in good if i % 2 == 0}, 0.5
    model, features = quality.fit_quality(docs, spark.createDataFrame([(i,) for i in chosen], "id long"), prior=prior, steps=100)
    x = {r.id: np.array(r.x) for r in features.collect()}
    every = np.array([x[i] for i, _ in rows])
    scale = every.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(every - every.mean(0)) / scale, np.ones((len(rows), 1))])
    p = z[[i in chosen for i, _ in rows]]
    loss = lambda f: np.logaddexp(0, -f)
    slope = lambda f: -1 / (1 + np.exp(f))

    def rest(w):
        return loss(-(z @ w)).mean() - prior * loss(-(p @ w)).mean()

    def gradient(w):
        assert rest(w) > 0  # so the risk is convex here and has one least point
        return prior * (slope(p @ w) @ p) / len(p) - (slope(-(z @ w)) @ z) / len(z) + prior * (slope(-(p @ w)) @ p) / len(p) + quality.RIDGE * w

    step = 1 / (np.linalg.eigvalsh(z.T @ z / len(z)).max() / 4 + quality.RIDGE)
    w = ahead = np.zeros(z.shape[1])
    for k in range(20_000):
        to = ahead - step * gradient(ahead)
        w, ahead = to, to + k / (k + 3) * (to - w)
    risk = lambda v: prior * loss(p @ v).mean() + max(0.0, rest(v)) + quality.RIDGE / 2 * v @ v
    assert abs(risk(model.weights) - risk(w)) < 1e-6
    plain = 1 / (1 + np.exp(-(z @ w)))
    scores = {r.doc_id: r.score for r in quality.add_score(docs, model).collect()}
    assert max(abs(scores[i] - s) for (i, _), s in zip(rows, plain)) < 0.01


def test_awkward_scores(spark):
    rows = awkward(8)
    trusted = spark.createDataFrame([(1,), (1,), (None,), (200,)], "doc_id long")
    got = quality.quality_scores(frame(spark, rows), trusted).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(frame(spark, rows), trusted.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(frame(spark, []), trusted).count() == 0
    few, _ = quality.fit_quality(frame(spark, rows), spark.range(400), max_labelled=10)
    assert np.isfinite(few.weights).all()


# --- archives --------------------------------------------------------------

def digest(b):
    import base64

    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_pages_survive_a_round_trip(spark):
    pages = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", "same"), (9, "u", "same"), (7, "v", "same"), (None, "w", "same"), (5, "z" * 5000, "long " * 40000)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, id string, payload string")
    got = {}
    for r in warc.round_trip(df, scratch_path(spark, "warc"), captures_per_file=3).select(
            warc.field(F.col("metadata"), "id").alias("id"), "payload_bytes", "payload_digest", "type", "target_uri", warc.field(F.col("refers"), "id").alias("refers"), F.size("requests").alias("n")).collect():
        got[r.id] = tuple(r)[1:]
    for i, url, html in pages:
        b = (html or "").encode()
        twins = [p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None]
        own = max(twins) == i
        assert got["" if i is None else str(i)] == (len(b), digest(b), "response" if own else "revisit", url.replace("\r", "%0D").replace("\n", "%0A") if url else None, None if own else str(max(twins)), 1)
    assert len(got) == len(pages)


def record(kind, id_, block=b"", **headers):
    head = {"WARC-Type": kind, "WARC-Record-ID": id_, **{k.replace("_", "-"): v for k, v in headers.items()}}
    lines = [f"{k}: {x}" for k, v in head.items() for x in (v if isinstance(v, list) else [v])]
    return ("WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_transactions_of_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n\x00\xffbody\r\n\r\n"
    records = [
        record("warcinfo", "<i>", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("response", "<a>", http, Content_Type="application/http; msgtype=response", WARC_Concurrent_To="<aq>"),
        record("request", "<aq>", b"GET /"), record("metadata", "<am>", b"k: v\r\n w\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To="<aq>"),
        record("request", "<bq>", b"GET /", WARC_Concurrent_To=["<b>", "<bm>"]), record("response", "<b>", http, Content_Type="application/http"), record("metadata", "<bm>", b""),
        record("request", "<lost>", b"GET /", WARC_Concurrent_To="<nowhere>"), record("resource", "<r>", b"plain"), record("revisit", "<v>", b"", WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:ABC"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:4]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[4:]))
    read = warc.read_archives(spark, str(tmp_path), with_payload=True)
    assert read.count() == len(records)
    assert {bytes(r.payload) for r in read.where("record_id in ('<a>', '<b>')").collect()} == {b"\x00\xffbody\r\n\r\n"}
    got = {r.record_id: ([x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []]) for r in warc.transactions(read).collect()}
    assert got == {"<a>": (["<aq>"], ["<am>"]), "<b>": (["<bq>"], ["<bm>"]), "<r>": ([], []), "<v>": ([], []), None: (["<lost>"], [])}
    left = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.resolved(warc.transactions(read)).where("type is not null").collect()}
    assert left["<v>"] == (None, "ABC") and left["<r>"] == (5, digest(b"plain"))
    (tmp_path / "b.warc").write_bytes(b"".join(records[4:])[:-8])
    with pytest.raises(Exception, match="cut off|no record header"):
        warc.read_archives(spark, str(tmp_path)).count()


def test_archives_that_are_read_twice(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    records = [record("response", "<a>", http, Content_Type="application/http; msgtype=response"), record("request", "<aq>", b"GET /", WARC_Concurrent_To="<a>"),
               *[record("revisit", f"<v{i}>", b"", WARC_Refers_To="<a>", WARC_Payload_Digest="sha1:X") for i in range(3)], record("metadata", "<m>", b"k: 1\r\n", Content_Type="application/warc-fields", WARC_Concurrent_To="<v1>"),
               record("request", "<lost>", b"GET /"), record("resource", "<a>", b"another record of the same id")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    unnamed = record("resource", "x", b"one").replace(b"WARC-Record-ID: x\r\n", b"")
    (tmp_path / "b.warc").write_bytes(b"".join(records[:-1]) + 2 * unnamed)
    got = warc.resolved(warc.transactions(warc.read_archives(spark, str(tmp_path)))).collect()
    assert Counter((r.type, r.record_id, r.payload_bytes, len(r.requests or []), len(r.metadata or [])) for r in got) == Counter(
        [("response", "<a>", 4, 1, 0), *[("revisit", f"<v{i}>", 4, 0, int(i == 1)) for i in range(3)], (None, None, None, 1, 0), *2 * [("resource", None, 3, 0, 0)]])
    assert all(r.file.endswith("a.warc") for r in got if r.record_id)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "warc")).count() == 0


# --- decontamination -------------------------------------------------------

def contamination(docs, items, percent, k=5):
    out = []
    for i, t in docs:
        w = SPACE.findall(folded(t))
        for j, u in items:
            v = SPACE.findall(folded(u))
            if i is None or j is None or not v or len(w) < len(v):
                continue
            m = min(k, len(v))
            grams = lambda x, m=m: [tuple(x[p:p + m]) for p in range(len(x) - m + 1)]
            want, best = Counter(grams(v)), None
            all_ = grams(w)
            for s in range(len(w) - len(v) + 1):
                have = Counter(all_[s:s + len(v) - m + 1])
                common = sum((want & have).values())
                total = sum((want | have).values())
                if 100 * common >= percent * total and (best is None or common / total > best[2] / best[3]):
                    best = (s, len(v), common, total)
            if best:
                out.append((i, j, *best))
    return sorted(out)


@pytest.mark.parametrize("passes", [1, 3])
def test_decontamination(spark, passes):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((15, 15, 22, 40, 60, 60))] + [(10, "tiny item"), (11, None), (12, ""), (None, text(9)), (13, "a a a a a a a a a a")]
    docs = awkward(9)
    for i, t in items[:6]:
        docs.append((1000 + i, f"{text(20)} {t.upper()}\n{text(9)}"))
        words = t.split()
        words[-1] = "changed"
        docs.append((1100 + i, f"{' '.join(words)} {t} {text(300)}"))
        words[len(words) // 2] = "other"
        docs.append((1200 + i, " ".join(words)))
    docs += [(1300, "x Tiny ITEM y"), (1301, "b a a a a a a a a a a a a b"), (1000, items[2][1])]
    df = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(frame(spark, docs), df, items_per_pass=100 if passes == 1 else 4)
    seen = sorted(tuple(r) for r in got.collect())
    want = contamination([d for d in docs if d[0] != 1000], items, 80)
    assert [x for x in seen if x[0] != 1000] == want and {x[1] for x in seen if x[0] == 1000} == {0, 2}
    assert decontaminate.contaminated(frame(spark, []), df).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), df.where("false")).count() == 0


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate((50, 50, 44, 30, 59))]
    docs, want = [], []
    for i, t in items:
        w = t.split()
        h = len(w) // 2
        cut = [w[1:], w[:-2], w[:h] + w[h + 1:], w[:h] + w[h + 2:], w[2:h] + w[h + 1:], w[:-len(w) // 4], w[1:] + ["other"]]
        for j, c in enumerate(cut):
            docs.append((10 * i + j, " ".join(c)))
            have, asked = (Counter(tuple(x[p:p + 5]) for p in range(len(x) - 4)) for x in (c, w))
            common, total = sum((have & asked).values()), sum((have | asked).values())
            if 100 * common >= 80 * total:
                want.append((10 * i + j, i, 0, len(c), common, total))
    assert (2, 0, 0, 49, 41, 50) in want and not any(x[0] % 10 == 5 for x in want)
    df = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.contaminated(frame(spark, docs), df).collect()) == sorted(want)


def test_the_query_and_its_sql_list_short_documents(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((50, 44, 30))]
    docs = []
    for i, t in items:
        w = t.split()
        docs += [(10 * i, t), (10 * i + 1, " ".join(w[1:])), (10 * i + 2, " ".join(w[:9] + w[10:])), (10 * i + 3, " ".join(w[:12])), (10 * i + 4, f"{text(40)} {t} {text(5)}")]
    docs += [(100, None), (101, ""), (102, "w1 w2")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op3_decontamination"](spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = db.sql(queries.OP3_SQL)
    seen = sorted(tuple(r) for r in got.select(want.columns).collect())
    assert seen == sorted(want.fetchall()) and {r[0] for r in seen} == {0, 1, 2, 4, 10, 11, 14, 20, 21, 24}


def test_blocks_reach_the_radius():
    values = np.array(decontaminate.near_values(4))
    rng = np.random.default_rng(0)
    for _ in range(300):
        f = int(rng.integers(0, 2**63))
        g = f
        for b in rng.choice(64, decontaminate.RADIUS, replace=False):
            g ^= 1 << int(b)
        assert any(((f >> 16 * i) & 0xFFFF) ^ ((g >> 16 * i) & 0xFFFF) in values for i in range(4))


# --- licenses --------------------------------------------------------------

def test_licenses_and_their_wording(spark):
    t = licenses.TEMPLATES
    filler = "lorem ipsum dolor sit amet " * 30
    mit = t["MIT"].replace("free of charge", "at no cost")
    docs = [(1, f"{filler}{t['GPL-3.0-notice']} {filler}{t['MIT-notice']}"), (2, filler), (3, None), (4, ""), (5, f"x {mit} y"), (6, "é" * 500 + " " + t["CC-BY-NC-4.0-notice"] + " " + t["CC-BY-NC-4.0-notice"]),
            (7, "licensed under cc by 4.0"), (8, "a driving license is needed here and nothing else"), (None, t["Apache-2.0-notice"]), (1, t["Apache-2.0"])]
    got = licenses.find_licenses(frame(spark, docs)).collect()
    key = sorted((str(r.doc_id), r.template, r.differences) for r in got)
    assert key == sorted([("1", "GPL-3.0-notice", 0), ("1", "MIT-notice", 0), ("5", "MIT", 3), ("6", "CC-BY-NC-4.0-notice", 0), ("6", "CC-BY-NC-4.0-notice", 0), ("7", "CC-BY-4.0-notice", 0), ("None", "Apache-2.0-notice", 0), ("1", "Apache-2.0", 0)])
    changed = next(r for r in got if r.doc_id == 5)
    assert changed.missing == ["free", "of", "charge"] and changed.added == ["at", "no", "cost"]
    texts = {i: x for i, x in docs if i in (5, 6, 7)}
    for r in got:
        if r.doc_id in texts:
            assert texts[r.doc_id][r.start:r.end].lower().split()[0] in ("permission", "licensed")
    assert licenses.find_licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [500, 5_000, 20_000, 100_000])
def test_notices_in_blocks_of_any_length(size):
    # Cue words all along keep the stretches together.
    rng = random.Random(size)
    words = ["license", *("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10))) for _ in range(400))]
    half = lambda: " ".join(w for i in range(size // 14) for w in [rng.choice(words), *["copyright"] * (i % 30 == 0)])[:size // 2]
    scanner, reach = licenses.Scanner(licenses.TEMPLATES), licenses.reach_of(licenses.TEMPLATES)
    for name, t in licenses.TEMPLATES.items():
        before = half()
        text = f"{before} . {t} . {half()}"
        got = [(x[0], x[1], x[5]) for x in scanner.scan(text, reach, licenses.MOST_DIFFERENCES)]
        assert (name, len(before) + 3, 0) in got, name


@pytest.mark.parametrize("name,text", [
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products"), ("GPL-2.0-or-later", "either version 2 of the License"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public\nLicense"), ("AGPL-3.0-or-later", "GNU Affero General Public License"), ("CC0-1.0-notice", "waived all copyright"), ("Unlicense", "free and unencumbered software"),
    ("BSL-1.0", "machine-executable object code"), ("EPL-2.0", "Eclipse Public License 2.0")])
def test_usual_licenses_have_templates(name, text):
    t = licenses.TEMPLATES[name]
    assert " ".join(text.split()) in t
    got = licenses.Scanner(licenses.TEMPLATES).scan(f"some text before\n{t}\nand after", licenses.reach_of(licenses.TEMPLATES), licenses.MOST_DIFFERENCES)
    assert [(x[0], x[5]) for x in got] == [(name, 0)]


def noticed(rng):
    """Texts of notices and whole licenses, some with edits, between other words."""
    filler = lambda: " ".join(rng.choice(["the", "license", "of", "work", "under", "copyright", "lorem", "ipsum", "software"]) for _ in range(rng.randrange(4, 40)))
    out = []
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        for _ in range(rng.randrange(len(words) // 25 + 1)):
            words[rng.randrange(len(words))] = "edited"
        out.append((name, f"{filler()} . {' '.join(words)} . {filler()}"))
    return out


def test_compression_decides_and_loses_nothing():
    """Every notice wins with the right dictionaries; with dictionaries in another order the ranking, and with it results, go wrong."""
    reach, most = licenses.reach_of(licenses.TEMPLATES), licenses.MOST_DIFFERENCES
    scanner, swapped = licenses.Scanner(licenses.TEMPLATES), licenses.Scanner(licenses.TEMPLATES)
    swapped.with_template = swapped.with_template[::-1]
    rng = random.Random(4)
    right = wrong = 0
    for name, text in noticed(rng):
        got, other = ([x[0] for x in s.scan(text, reach, most)] for s in (scanner, swapped))
        assert name in got, (name, got)
        right, wrong = right + 1, wrong + (name not in other)
        # Every passage that the alignment of any template finds is taken by some notice.
        spans = [(m.start(), m.end(), m[0].lower()) for m in licenses._WORD.finditer(text)]
        places = [(x[1], x[2]) for x in scanner.scan(text, reach, most)]
        for wanted in scanner.words:
            n, a, b = licenses.align(wanted, [s[2] for s in spans])
            if n <= most * len(wanted) and b > a:
                assert any(lo < spans[b - 1][1] and hi > spans[a][0] for lo, hi in places)
    assert right == len(licenses.TEMPLATES) and wrong >= 3


def test_stretches_lose_no_passage():
    rng = random.Random(1)
    for _ in range(300):
        wanted, found = [[rng.choice("uvwxyz") for _ in range(n)] for n in (rng.randrange(1, 7), rng.randrange(1, 30))]
        held = licenses.stretches(np.array([w in wanted for w in found]), len(wanted), 0.4)
        n, a, b = licenses.align(wanted, found)
        if n <= 0.4 * len(wanted) and b > a:
            assert any(x <= a and b <= y and licenses.align(wanted, found[x:y])[0] == n for x, y in held)


def test_alignment():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [[rng.choice("xyz") for _ in range(rng.randrange(n))] for n in (6, 12)]
        best = min(((levenshtein(a, b[i:j])), i, j) for i in range(len(b) + 1) for j in range(i, len(b) + 1))[0]
        n, i, j = licenses.align(a, b)
        assert n == best and levenshtein(a, b[i:j]) == n


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


# --- packing ---------------------------------------------------------------

def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [{}, {"length": 64, "segments": 3, "group": 16}, {"length": 128, "loss_tokens": 40, "prompt_col": "id"}])
def test_packing(spark, limits):
    rows = awkward(10) + [(950, "<|endoftext|> it's İstanbul ΑΣ 12 3x y"), (951, "é ́ ñ")]
    docs = frame(spark, rows).repartition(3)
    got = packing.pack_sequences(docs, queries.tokenizer_path(), **limits).collect()
    length = limits.get("length", 4096)
    sequences, documents = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:n]) for n in range(len(parts))]
        fill = sum(r.length for r in parts)
        assert fill <= length and (fill == length or fill & (fill - 1) == 0)
        assert len(parts) <= limits.get("segments", 512) and sum(r.loss_tokens for r in parts) <= limits.get("loss_tokens", length)
    prompt = encoded("x") if "prompt_col" in limits else []
    unique = {i: t for i, t in rows if i is not None and i != 2}
    for i, t in unique.items():
        for option in ([], prompt):
            ids = np.array(option + encoded(t) + [2], "<u4")
            if len(ids) == documents[i][0].doc_tokens:
                break
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in documents[i])
        assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:n]) for n in range(len(pieces))] and sum(p[1] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in pieces)
    assert packing.pack_sequences(frame(spark, []), queries.tokenizer_path()).count() == 0


# --- secrets ---------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def secret_texts():
    access, long_, gap = "AKIA" + "Q7" * 8, "Zx9Qp2Lm7Rt4Vb8Nc3Kd5W", "lorem ipsum " * 60
    return [
        (1, f"été token = \"{'ab12' * 5}\" and PassWord:\"short\" secret: token=abcdefghijkl"), (2, f"{access} {long_}"), (3, f"{long_} alone"), (4, f"{access} {gap} {long_}"),
        (5, f"user=alice password = correcthorsebattery https://db.example.com/x"), (6, "user=alice only https://db.example.com/x"), (7, f"host: db.local:5432 {long_}"), (8, None), (9, ""),
        (10, "AKIASHORT AKIA" + "A" * 40 + "AKIA0"), (11, "0123456789abcdef" * 40 + " 𝔘 " + "f" * 15), (12, "tokenſ = kkkkkkkkkkkkkkk api_key='abc.def-ghi=jkl' apikey : x"), (1, f"{access} {long_}"), (None, f"{access} {long_}")]


def test_base_secrets(spark):
    rows = secret_texts() + awkward(11)
    got = credentials.linked_secrets(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in got), key=str) == sorted(((i, base_spans(t)) for i, t in rows), key=str)
    for r in got:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_weak_parts_need_complements(spark):
    got = credentials.linked_secrets(frame(spark, secret_texts()[:12]))
    added = {r.doc_id: {credentials.KINDS[s.kind] for s in r.spans if s.kind >= 3} for r in got.collect()}
    assert added == {1: set(), 2: {"weak"}, 3: set(), 4: set(), 5: {"identifier", "endpoint"}, 6: set(), 7: {"endpoint", "weak"}, 8: set(), 9: set(), 10: set(), 11: set(), 12: set()}
    line = {r.doc_id: r.t for r in got.select("doc_id", credentials.joined(F.col("spans")).alias("t")).collect()}
    assert re.fullmatch(r"access:0:20,weak:21:43", line[2]) and line[8] == ""


def test_long_weak_parts_on_either_side(spark):
    rng = random.Random(2)
    random_ = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(900))
    url, account, secret, access, gap = f"https://db.example.com/x?sig={random_}", "user: alice", "password=correcthorsebattery", "AKIA" + "Q7" * 8, " lorem ipsum" * 15
    pairs = [(url, secret, "endpoint"), (random_, account, "weak"), (random_, access, "weak"), (f"user: {random_}", secret, "identifier"), (url, access, "endpoint")]
    docs, want = [], {}
    for i, (a, b, kind) in enumerate(pairs):
        for j, (space, linked) in enumerate(((" ", True), (f"{gap} ", True), (f"{gap}{gap} ", False))):
            for k, t in enumerate((f"é {a}{space}{b}", f"é {b}{space}{a}")):
                docs.append((100 * i + 10 * j + k, t))
                want[docs[-1][0]] = [(kind, t.index(a), t.index(a) + len(a))] if linked else []
    got = {r.doc_id: [(credentials.KINDS[s.kind], s.start, s.end) for s in r.spans if s.end - s.start > 500] for r in credentials.linked_secrets(frame(spark, docs)).collect()}
    assert got == want
    assert not any(random_ in r.text for r in credentials.masked(frame(spark, docs)).collect() if want[r.doc_id])


def test_masking(spark):
    docs = frame(spark, secret_texts())
    out = credentials.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.where("doc_id > 1").collect()}
    assert texts[2] == "[access] [weak]" and texts[3].endswith("alone") and texts[8] is None and texts[9] == ""
    assert credentials.masked(frame(spark, [])).count() == 0


# --- fingerprints ----------------------------------------------------------

def paragraph_set(t):
    return set(re.findall(r"[^\n]{1,%d}" % (32 if len(t or "") < 1024 else 256), t or ""))


def paragraph_digest(paragraph):
    return int(np.uint64(xxhash.xxh64(paragraph.encode(), seed=42).intdigest()).astype(np.int64))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rounds", [24, 1])
def test_fingerprints(spark, rounds):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"line {rng.randrange(60)}" for _ in range(rng.randrange(0, 40)))) for i in range(0, 90, 3)]
    rows += [(200, "𝔘é" * 700), (201, None), (202, ""), (203, rows[4][1]), (204, "one"), (205, "\n".join(f"{i}" for i in range(3000)))]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows).repartition(4), rounds=rounds).collect()}
    rows.sort()
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(paragraph_set(t), paragraph_set(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraph_set(t), paragraph_set(after)))
        mine, other = ({paragraph_digest(p) for p in paragraph_set(x)} for x in (t, edited))
        assert set(r.lost) == mine - other and set(r.gained) == other - mine and len(r.lost) + len(r.gained) == len(mine ^ other)
    assert got[203].fingerprint == got[12].fingerprint and got[201].fingerprint == got[202].fingerprint
    assert len({r.fingerprint for r in got.values()}) > 25


def test_tables_fold_and_subtract(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 40])], "a array<bigint>, b array<bigint>")
    size = lambda n: F.lit(n).cast("bigint")
    small, large = (fingerprints.table(F.col("a"), size(n)) for n in (8, 64))
    row = df.select(small.alias("small"), fingerprints.added_up(fingerprints.folded(large, size(64), size(8))).alias("folded"),
                    fingerprints.peeled(fingerprints.added_up(F.concat(large, fingerprints.negative(fingerprints.table(F.col("b"), size(64))))), size(64)).alias("p")).first()
    assert row.small == row.folded and sum(c.n for c in row.small) == 27
    assert row.p.left == [] and sorted(row.p.plus) == [4, 5, 6, 7, 8, 9] and row.p.minus == [40]


def test_short_texts_of_one_line_stay_near(spark):
    rng = random.Random(0)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))) for i, n in enumerate((16, 20, 40, 100, 140))]
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    assert all(0.1 < r.near_edited < 0.7 and r.near_next < 0.1 for r in got)


def test_fingerprints_of_awkward_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)]
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 1), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    one = fingerprints.fingerprints(frame(spark, [(5, "only\ntext")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0


def test_fingerprints_are_native(spark):
    plan = fingerprints.fingerprints(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns and docs.dtypes == before.dtypes
        kept = {r.doc_id: r.text for r in docs.collect()}
        given = {r.doc_id: r.text for r in before.collect()}
        if name == "near duplicates":
            from plain import near_components

            assert set(kept) == {i for i, _, c in near_components(list(given.items()), 80) if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            assert set(given) - set(kept) == {x[0] for x in contamination(list(given.items()), items, 80)}
        if name == "secret scan":
            assert set(kept) == set(given) and not any(base_spans(t) for t in kept.values())
            assert all(kept[i] == given[i] for i in given if not base_spans(given[i]) and "[" not in kept[i])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(kept) and all(r.n == r.m for r in pieces)


def test_pipeline_stages_take_awkward_documents(spark):
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(i, t, None, None if (i or 0) % 2 else "s", None, "x") for i, t in awkward(12) + secret_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for empty in (False, True):
        left = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.materialize(stage(spark, left, SF_DIR), "stage")
            assert name == "packing" or left.columns == docs.columns
    assert base.count() > 0
