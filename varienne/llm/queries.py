"""One query per operator over the provided tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varienne.llm.credentials import count_of, joined, linked_secrets
from varienne.llm.decontaminate import contaminated
from varienne.llm.fingerprints import fingerprints
from varienne.llm.languages import fit_languages, identify_languages
from varienne.llm.licenses import find_licenses
from varienne.llm.near import near_duplicates
from varienne.llm.packing import pack_sequences
from varienne.llm.phrases import collocations
from varienne.llm.quality import quality_scores
from varienne.llm.substrings import remove_repeated_windows
from varienne.llm.suffixes import remove_repeated_strings
from varienne.llm.trie import numbered_turns, prefix_trie, rebuilt
from varienne.llm.warc import field, round_trip
from varienne.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame``."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


@query("op9_near_duplicates", OP9_SQL)
def _op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""


@query("op6_substring_dedup", OP6_SQL)
def _op6(spark, sf_dir):
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_secret_links")
def _op7(spark, sf_dir):
    out = linked_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def tokenizer_path() -> str:
    """The word tokenizer among the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_vector_packing")
def _op5(spark, sf_dir):
    return pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path()).drop("loss_tokens")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, translate(concat(""" + ", ".join(
    f"lpad(to_base(CAST('0x' || substr(h, {10 * i + 1}, 10) AS BIGINT), 32), 8, '0')" for i in range(4)) + """),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""


@query("op2_warc_transactions", OP2_SQL)
def _op2(spark, sf_dir):
    captures = round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return captures.select(field(F.col("metadata"), "id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                           F.when(F.col("type") == "revisit", field(F.col("refers"), "id").cast("bigint")).alias("refers_to"))


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are kept for checking."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Good documents whose labels may be learned from."""
    return labels.where(~held_out() & (F.col("quality") == 1)).select("doc_id")


@query("op1_quality_classifier")
def _op1(spark, sf_dir):
    scores = quality_scores(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")), unlabelled=~held_out())
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents), i AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS words, unnest(range(0, len(ws) - 4)) AS pos, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM d WHERE len(ws) >= 5),
si AS (SELECT item_id, len(ws) AS size, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM i WHERE len(ws) >= 5),
ic AS (SELECT item_id, size, sh, count(*) AS c FROM si GROUP BY ALL),
pair AS (SELECT doc_id, item_id, size, least(size, words) AS wide, pos, words FROM ds JOIN ic USING (sh)),
cand AS (SELECT DISTINCT doc_id, item_id, size, wide, unnest(range(greatest(0, pos - wide + 5), least(pos, words - wide) + 1)) AS start FROM pair),
w AS (SELECT c.doc_id, item_id, size, wide, start, ds.sh, count(*) AS n FROM cand c JOIN ds ON ds.doc_id = c.doc_id AND ds.pos BETWEEN start AND start + wide - 5 GROUP BY ALL),
sim AS (SELECT w.doc_id, w.item_id, w.wide AS size, w.start, CAST(sum(least(n, c)) AS BIGINT) AS common, CAST(w.wide + w.size - 8 - sum(least(n, c)) AS BIGINT) AS total
  FROM w JOIN ic ON ic.item_id = w.item_id AND ic.sh = w.sh GROUP BY w.doc_id, w.item_id, w.wide, w.size, w.start)
SELECT doc_id, item_id, start, CAST(size AS INTEGER) AS size, common, total FROM sim WHERE common * 100 >= total * 80
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common * 1.0 / total DESC, start) = 1"""


@query("op3_decontamination", OP3_SQL)
def _op3(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_fingerprints")
def _op10(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents")).drop("lost", "gained")


@query("op4_license_scan")
def _op4(spark, sf_dir):
    return find_licenses(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def _op8(spark, sf_dir):
    out = remove_repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# CRC-32 of a decimal id, bit by bit, and the turns of every rebuilt conversation as a list of digests.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, turn, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM p)),
r AS (SELECT h.conv_id, pos, 0 AS own, digest, bytes FROM h JOIN p ON p.conv_id = h.base WHERE pos <= h UNION ALL SELECT conv_id, pos, 1, digest, bytes FROM h JOIN p USING (conv_id) WHERE pos > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, bytes, string_agg(digest, ' ') OVER (PARTITION BY conv_id ORDER BY own, pos) AS key FROM r),
m AS (SELECT conv_id, d, key, bytes FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM h),
n AS (SELECT key, CAST(max(d) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY key),
u AS (SELECT n.*, x.conv_id AS parent_conv_id FROM n LEFT JOIN m y ON y.conv_id = n.conv_id AND y.d = n.depth - 1 LEFT JOIN n x ON x.key = y.key),
c AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
s AS (SELECT m.key, CAST(sum((n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves
  FROM u LEFT JOIN c ON c.conv_id = u.conv_id AND c.depth = u.depth JOIN m ON m.conv_id = u.conv_id AND m.d <= u.depth GROUP BY m.key),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM m JOIN l USING (conv_id, d) GROUP BY key)
SELECT u.conv_id, u.depth, u.parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u JOIN s USING (key) LEFT JOIN c ON c.conv_id = u.conv_id AND c.depth = u.depth LEFT JOIN e ON e.key = u.key"""


@query("op11_prefix_trie", OP11_SQL)
def _op11(spark, sf_dir):
    return prefix_trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, str_split(g, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
t AS (SELECT lang, k, g, a, i, array_to_string(ws[1:i], ' ') AS x, array_to_string(ws[i + 1:k], ' ') AS y FROM c, (VALUES (1), (2)) v(i) WHERE i < k),
s AS (SELECT t.*, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM t JOIN f l ON l.lang = t.lang AND l.k = i AND l.g = x JOIN f r ON r.lang = t.lang AND r.k = t.k - i AND r.g = y QUALIFY row_number() OVER (PARTITION BY t.lang, t.g ORDER BY score, i) = 1),
o AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS g, a FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, s.a DESC, g) AS rank, g AS phrase, s.a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN o USING (lang, g) WHERE o.a IS NULL OR 100 * o.a < 50 * s.a QUALIFY rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def _op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_language_id")
def _op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_languages(docs.where(~held))
    return identify_languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
