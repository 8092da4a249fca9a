"""The registered queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm import bit_mixing, bloom_dedup, byte_bpe, decontaminate, hilbert_shards, importance, secret_scan, simhash_dedup, spelling_variants, suffix_dedup, toxicity, url_filter, warc

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_RANKS = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id is in fold 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(4))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the labels outside of fold 0."""
    labels = _table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0)
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(_table(spark, sf_dir, "documents"), 24)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "n_sentences", "worst_start", "worst_end")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list derived from the pages: four dated entries for each host and each parent domain."""
    keys = pages.select(F.explode(url_filter.suffixes(url_filter.host_of(F.coalesce(F.col("url"), F.lit(""))))).alias("key")).distinct()
    entries = keys.select("key", F.explode(F.array(*map(F.lit, range(4)))).alias("j"))
    entries = entries.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("#", "key", "j").cast("binary")), 1, 7), 16, 10).cast("long"))
    action = F.element_at(F.array(*map(F.lit, url_filter.ACTIONS)), (F.expr("(h div 365) % 3") + 1).cast("int"))
    return entries.select("key", action.alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 365).cast("int")).alias("since"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    fetched = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 365).cast("int")))
    judged = url_filter.judge_captures(fetched, dated_entries(pages))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetch_date", "listed_since")})


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bit_mixing.score(_table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 1)
    return scored.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents"), WORD_RANKS)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_hilbert_shards, op2_byte_bpe, op3_toxicity, op4_url_filter, op5_suffix_dedup, op6_decontaminate, op7_simhash_dedup, op8_warc, op9_context_mixing, op10_bloom_dedup, op11_secret_scan, op12_spelling_variants, op13_importance_resampling)}

#: CRC-32 in SQL: a table of 256 steps (t.tbl), and the fold over the bytes of a text.
_CRC_TABLE = """
        t AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(text: str) -> str:
    each = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"


ORACLES = {
    "op4_url_filter": """
        WITH p AS (SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:\\[]+)', 1) AS host,
                          DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INTEGER) AS fetch_date FROM pages),
        k AS (SELECT page_id, host, fetch_date, array_to_string(l[i:], '.') AS key
              FROM (SELECT *, unnest(range(1, CASE WHEN host[1] = '[' OR regexp_matches(host, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$') THEN 2 ELSE len(l) END)) AS i FROM (SELECT *, string_split(host, '.') AS l FROM p))),
        e AS (SELECT key, j, CAST('0x' || substr(md5(key || '#' || j), 1, 7) AS BIGINT) AS h FROM (SELECT DISTINCT key FROM k), (SELECT unnest(range(0, 4)) AS j)),
        d AS (SELECT key, DATE '2024-01-01' + CAST(h % 365 AS INTEGER) AS since, min((h // 365) % 3) AS a FROM e GROUP BY 1, 2),
        v AS (SELECT key, since, a, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM d),
        m AS (SELECT k.page_id, v.key, v.a, v.since, row_number() OVER (PARTITION BY k.page_id ORDER BY length(v.key) DESC) AS r
              FROM k JOIN v ON k.key = v.key AND v.a < 2 AND k.fetch_date >= v.since AND (v.until IS NULL OR k.fetch_date < v.until))
        SELECT p.page_id, p.host, p.fetch_date::VARCHAR AS fetch_date, m.key AS list_key, CASE m.a WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS list_action,
               m.since::VARCHAR AS listed_since, coalesce(m.a = 0, false) AS blocked
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1""",
    "op8_warc": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM t)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f < page_id THEN f END AS refers_to FROM g""",
    "op6_decontaminate": """
        WITH w AS (
            SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') FROM benchmark),
        s AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS shingle
              FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT id AS item_id, count(*) AS item_shingles FROM s WHERE kind = 1 GROUP BY id)
        SELECT d.id AS doc_id, n.item_id, item_shingles, count(*) AS shared_shingles, count(*)::DOUBLE / item_shingles AS containment
        FROM s b JOIN s d ON d.kind = 0 AND b.kind = 1 AND b.shingle = d.shingle JOIN n ON n.item_id = b.id
        GROUP BY d.id, n.item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles""",
    "op10_bloom_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        o AS (SELECT id, run, count(*) AS c FROM (SELECT doc_id AS id, unnest(regexp_extract_all({_LOWERED}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
        h AS (SELECT run, c, {_crc("(id || ':' || run)")} AS h FROM o, t),
        w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
              WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        v AS (SELECT word, n, unnest(list_distinct(list_transform(range(0, length(word) + 1), lambda i: CASE WHEN i = 0 THEN word ELSE word[:i - 1] || word[i + 1:] END))) AS part FROM w),
        p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM v a JOIN v b ON a.part = b.part AND a.word <> b.word),
        q AS (SELECT * FROM p WHERE abs(length(word) - length(near)) = 1
              OR (length(word) = length(near) AND len(list_filter(range(1, length(word) + 1), lambda i: word[i] <> near[i])) = 1)),
        g AS (SELECT word, count(*) AS n_near, max(m) AS top FROM q GROUP BY word),
        b AS (SELECT q.word, g.n_near, min(near) FILTER (WHERE m = top) AS best, any_value(top) AS top FROM q JOIN g USING (word) GROUP BY q.word, g.n_near),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
        z AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.next)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word) WHERE z.next IS NULL""",
    "op13_importance_resampling": f"""
        WITH {_CRC_TABLE},
        w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
              UNION ALL SELECT 1, NULL, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
        f AS (SELECT kind, id, feature, count(*) AS c FROM (SELECT kind, id, unnest(w) AS feature FROM w
              UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
        b AS MATERIALIZED (SELECT feature, {_crc("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), t),
        n AS (SELECT kind, id, bucket, sum(c) AS c FROM f JOIN b USING (feature) GROUP BY ALL),
        k AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE kind = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (WHERE kind = 1), 0)::DOUBLE AS t FROM n GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000)))) AS gain FROM k),
        d AS (SELECT id, sum(c * gain) AS total FROM n JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
        x AS (SELECT id AS doc_id, coalesce(len(w), 0) AS words, greatest(2 * words - 1, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
              weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (id) WHERE kind = 0),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)""",
}
