"""Queries opN_<name> over the ``documents`` table, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import documents
from .exact import exact_groups
from .media import text_media
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .quality import score_quality, train as train_quality
from .sharding import shard
from .substring import remove_repeats
from .toxicity import score_toxicity, train as train_toxicity


def op1_minimax_shards(spark, sf_dir):
    return shard(documents(spark, sf_dir), shards=24)


def op2_disclosure_pii(spark, sf_dir):
    return find_pii(documents(spark, sf_dir))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op4_netpbm_media(spark, sf_dir):
    return text_media(documents(spark, sf_dir))


def op5_toxicity_gru(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity(docs, documents(spark, sf_dir, "labels")))


def op6_suffix_tree_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir), window=35)


def op7_tier_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op8_sainte_lague_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir))


def op9_quality_trees(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score_quality(docs, train_quality(docs, documents(spark, sf_dir, "labels")))


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')".replace("\\\\", "\\")

_OP3_SQL = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM docs),
    sized AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sets),
    nodes AS (SELECT s, any_value(n) AS n, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY s),
    grams AS (SELECT rep, n, unnest(s) AS g FROM nodes),
    links AS (SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    walk AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a),
    labels AS (SELECT a AS rep, min(b) AS low FROM walk GROUP BY a)
    SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(l.low, d.doc_id) AS component_id, coalesce(l.low, d.doc_id) = d.doc_id AS kept
    FROM sized d LEFT JOIN nodes o ON d.s = o.s AND d.n > 0 LEFT JOIN labels l ON l.rep = o.rep"""

_OP6_SQL = f"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS t FROM docs, unnest(range(1, len(w) - 33)) u(i)),
    hits AS (SELECT doc_id, i FROM windows WHERE t IN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(35) r(j)),
    lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS t FROM (SELECT d.doc_id, p, d.w[p] AS word FROM docs d SEMI JOIN lists USING (doc_id), unnest(range(1, len(d.w) + 1)) u(p)) k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
    FROM docs d LEFT JOIN lists USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_OP8_SQL = f"""
    WITH rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE concat('a', source) END AS skey, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat('mix-1|', doc_id)) AS key FROM documents),
    placed AS (SELECT *, CAST(concat('0x', substr(key, 1, 8)) AS BIGINT) % (SELECT 1 + count(*) // 65536 FROM documents) AS shard FROM rows),
    sizes AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] AS weight FROM placed GROUP BY skey),
    levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM sizes
      WINDOW o AS (ORDER BY 2.0 * source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT skey, source_size, CAST(CASE WHEN level * weight >= 2 * source_size THEN 2.0 * source_size ELSE weight * max(level) FILTER (level * weight < 2 * source_size) OVER () END AS DOUBLE) AS target FROM levels),
    seats AS (SELECT CAST(round(1.5 * sum(source_size) / 16) AS BIGINT) AS m FROM sizes),
    won AS (SELECT skey, count(*) AS quota FROM (SELECT skey FROM targets, seats, unnest(range(m)) u(k) WHERE target > 0 ORDER BY target / (2 * k + 1) DESC, skey LIMIT (SELECT m FROM seats)) GROUP BY skey),
    shards AS (SELECT p.skey, p.shard, sum(p.size) AS words, any_value(coalesce(w.quota, 0)) AS m FROM placed p LEFT JOIN won w USING (skey) GROUP BY p.skey, p.shard),
    dealt AS (SELECT skey, shard, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY words / (2 * k + 1) DESC, shard) AS n FROM shards, unnest(range(m)) u(k) WHERE words > 0) WHERE n <= m GROUP BY skey, shard),
    quotas AS (SELECT s.skey, s.shard, s.words, CAST(greatest(1, ceil(s.words / 16)) AS BIGINT) AS have, CAST(least(coalesce(q, 0), 2 * greatest(1, ceil(s.words / 16))) AS BIGINT) AS q FROM shards s LEFT JOIN dealt USING (skey, shard)),
    runs AS (SELECT *, q // have AS passes, q % have AS run, CAST(concat('0x', substr(md5(concat('mix-1|', skey, '|', shard)), 1, 8)) AS BIGINT) % have AS first FROM quotas),
    ends AS (SELECT *, sum(size) OVER (PARTITION BY skey, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM placed)
    SELECT e.doc_id, e.size, t.source_size, t.target, CAST(r.passes * e.size + greatest(0, least(e.e, least(r.words, (r.first + r.run) * 16)) - greatest(e.e - e.size, r.first * 16)) + greatest(0, least(e.e, greatest(0, (r.first + r.run - r.have) * 16)) - greatest(e.e - e.size, 0)) AS BIGINT) AS taken
    FROM ends e JOIN runs r USING (skey, shard) JOIN targets t USING (skey)"""


def oracle_sql():
    return {
        "op3_minhash_near_dedup": _OP3_SQL,
        "op6_suffix_tree_dedup": _OP6_SQL,
        "op8_sainte_lague_mix": _OP8_SQL,
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
    }
