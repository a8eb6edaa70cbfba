"""Registered queries opN_*: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM
  (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (SELECT p.doc_id, p.i, p.size, win.item_id FROM
  (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM
    (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)) p JOIN win ON win.size = p.size AND win.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op8_decontamination", OP8_SQL)
def op8(spark, sf_dir):
    from .decontam import contaminated, find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op10_url_filter")
def op10(spark, sf_dir):
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


@query("op2_token_ids")
def op2(spark, sf_dir):
    import public_tokenizers

    from .huffman import read_ids, tokenize, write_ids
    from .store import folder, written

    docs = table(spark, sf_dir, "documents")
    tokens = tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), 2, keep=["doc_id"], width=2).select("doc_id", "ids")
    path = folder(spark, "huffman")
    write_ids(written(tokens, "ids"), path, width=2)
    return read_ids(spark, path, ids=False)


@query("op4_packing")
def op4(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, keep=["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM win JOIN least USING (s) WHERE first < doc_id),
gone AS (SELECT doc_id, list(place) AS places FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND place = i WHERE place IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark, sf_dir):
    from .substring import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT r.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = r.doc_id AS kept
FROM (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r LEFT JOIN n USING (doc_id)"""


@query("op3_near_duplicates", OP3_SQL)
def op3(spark, sf_dir):
    from .neardup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80, keep=["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def fold(column: str, folds: int = 5):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


@query("op1_toxicity")
def op1(spark, sf_dir):
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id") != 0)
    return score(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_nearest_neighbours")
def op5(spark, sf_dir):
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op6_html_text")
def op6(spark, sf_dir):
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "title", "text")


@query("op9_language_model")
def op9(spark, sf_dir):
    from .lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), learn=fold("doc_id") != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP13_SQL = r"""
WITH RECURSIVE
crc_step AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS step FROM range(256) t(i)),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS body, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
k AS MATERIALIZED (SELECT doc_id, body, size, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS key, CAST('0x' || substr(md5(concat_ws(':', digest, CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS place FROM d),
g AS MATERIALIZED (SELECT key, sum(size) AS bytes FROM k GROUP BY key),
big AS MATERIALIZED (SELECT key, CAST(i - 1 AS INTEGER) AS shard FROM (SELECT *, bool_and(bytes * (25 - i) > left_over) OVER (ORDER BY i) AS alone FROM
  (SELECT key, bytes, row_number() OVER (ORDER BY bytes DESC, key) AS i, sum(bytes) OVER (ORDER BY bytes, key DESC) AS left_over FROM g)) WHERE alone AND i < 24),
c AS MATERIALIZED (SELECT key, bytes, sum(bytes) OVER (ORDER BY key) AS upto FROM g WHERE key NOT IN (SELECT key FROM big)),
all_sizes AS MATERIALIZED (SELECT list(CAST(bytes AS HUGEINT) ORDER BY key) AS sizes, 24 - (SELECT count(*) FROM big) AS shards, max(bytes) AS largest, sum(bytes) AS whole FROM c),
search(low, high, shards, sizes) AS (SELECT CAST(largest AS HUGEINT), CAST(whole AS HUGEINT), shards, sizes FROM all_sizes
  UNION ALL SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END, shards, sizes FROM
  (SELECT low, high, shards, sizes, middle, (list_reduce(list_prepend(CAST(0 AS HUGEINT), sizes), lambda a, b: CASE WHEN a % 1000000000000000 + b <= middle THEN a + b ELSE a - a % 1000000000000000 + 1000000000000000 + b END) // 1000000000000000) + 1 <= shards AS fits FROM
  (SELECT low, high, shards, sizes, (low + high) // 2 AS middle FROM search WHERE low < high))),
cap AS MATERIALIZED (SELECT low AS capacity FROM search WHERE low = high),
cut(n, upto) AS (SELECT 0, CAST(0 AS HUGEINT) UNION ALL SELECT n + 1, best FROM (SELECT cut.n, max(c.upto) AS best FROM cut, cap, c WHERE c.upto <= cut.upto + capacity AND cut.n < 24 GROUP BY cut.n, cut.upto)),
placed AS (SELECT c.key, CAST((SELECT count(*) FROM big) + min(cut.n) - 1 AS INTEGER) AS shard FROM c JOIN cut ON c.upto <= cut.upto GROUP BY c.key UNION ALL SELECT key, shard FROM big)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 8), lambda i: CAST('0x' || substr(hex(encode(body)), 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM k JOIN placed USING (key), crc_step"""


@query("op13_sharding", OP13_SQL)
def op13(spark, sf_dir):
    from .sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), 24, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP11_SQL = r"""
WITH crc_step AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS step FROM range(256) t(i)),
own AS (SELECT conv_id AS c, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS m, length(coalesce(text, '')) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(c AS VARCHAR))), lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), k + 1, 1)) AS BIGINT))),
  lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM own), crc_step),
built AS (SELECT ids.c, 0 AS whose, own.i, m, n FROM ids JOIN own ON own.c = base AND own.i <= h UNION ALL SELECT ids.c, 1, own.i, m, n FROM ids JOIN own ON own.c = ids.c AND own.i > h),
path AS MATERIALIZED (SELECT c, n, row_number() OVER w AS d, string_agg(m, ',') OVER w AS key FROM built WINDOW w AS (PARTITION BY c ORDER BY whose, i) UNION ALL SELECT c, 0, 0, '' FROM ids),
ends AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS members FROM (SELECT c, arg_max(key, d) AS key FROM path GROUP BY c) GROUP BY key),
node AS MATERIALIZED (SELECT key, d, min(c) AS c, count(*) AS n_convs, max(n) AS n, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN left(key, length(key) - 33) END AS up FROM path GROUP BY key, d),
kids AS (SELECT up, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
below AS (SELECT p.key, sum(CASE WHEN kids.up IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved FROM node u LEFT JOIN kids ON kids.up = u.key JOIN path p ON p.c = u.c AND p.d <= u.d GROUP BY p.key)
SELECT node.c AS conv_id, node.d AS depth, top.c AS parent_conv_id, node.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(members, '')) AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids ON kids.up = node.key LEFT JOIN ends ON ends.key = node.key LEFT JOIN node top ON top.key = node.up AND top.d = node.d - 1"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    from .trie import prefix_trie

    conv = F.col("conv")
    return prefix_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 100, head=fold("conv", 6), head_limit=5)


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, array_to_string(g, ' ') AS s, g, count(*) AS f FROM
  (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) t(k) WHERE len(w) >= k)) GROUP BY lang, k, g HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.s, c.k, c.f AS a, x.k AS j, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.f) // (x.f + y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.s = array_to_string(c.g[1:x.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.s = array_to_string(c.g[x.k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, s, k ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(g[i:i + t - 1], ' ') AS s, max(f) AS longer FROM (SELECT *, unnest(range(1, k - t + 2)) AS i FROM c, range(2, 4) u(t) WHERE t < k) GROUP BY 1, 2)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM low LEFT JOIN sub USING (lang, s) JOIN n ON n.lang = low.lang WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""


@query("op12_phrases", OP12_SQL)
def op12(spark, sf_dir):
    from .phrases import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))
