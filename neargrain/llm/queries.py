"""The registered queries of the subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrain.llm import alignment, embedding, exact, licenses, minhash, mixing, packing, quality, ranking, sharding, substring, suffix, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicate_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "place")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("bigint").alias("n_spans"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("row.text"), F.lit(""))
    columns = [F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return sharding.shard(table(spark, sf_dir, "documents")).select("row.doc_id", "size", *columns)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignment_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_sharding": op11_sharding,
    "op12_ranking": op12_ranking,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             windows AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
             later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) > 1),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM later),
             each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
             kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_minhash_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             u AS (SELECT min(doc_id) AS node, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d GROUP BY text),
             s AS (SELECT node, copies, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM u),
             t AS (SELECT node, copies, shingle, count(*) AS tf FROM s GROUP BY ALL),
             df AS (SELECT shingle, sum(copies) AS df FROM t GROUP BY 1),
             x AS (SELECT node, shingle, tf * (1 + ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df))) AS w FROM t JOIN df USING (shingle)),
             total AS (SELECT node, sum(w) AS total FROM x GROUP BY 1),
             shared AS (SELECT a.node AS a, b.node AS b, sum(least(a.w, b.w)) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
             links AS (SELECT a, b FROM shared JOIN total p ON p.node = a JOIN total q ON q.node = b WHERE shared >= 0.8::DOUBLE * (p.total + q.total - shared)),
             two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
             reach AS (SELECT node, node AS other FROM u UNION SELECT reach.node, two_way.b FROM reach JOIN two_way ON two_way.a = reach.other),
             classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY 1)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of, class_id, doc_id = class_id AS kept
        FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS node FROM d) JOIN classes USING (node)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings),
             usable AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
             links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.n = b.n AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
             reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
             classes AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM classes LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1) USING (vec_id)""",
    "op9_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
             windows AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS i, x FROM h WHERE len(x) >= 200),
             keyed AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS key FROM windows),
             later AS (SELECT doc_id, i FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
             steps AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 100, true) AS new FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             runs AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
             spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY 1, 2),
             before AS (SELECT s.doc_id, s.run, s.b, s.a, substr(x, 2 * coalesce(lag(s.b) OVER o, 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER o, 0))) AS piece
                        FROM spans s JOIN h USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.run)),
             cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(piece, '' ORDER BY run) AS head FROM before GROUP BY 1)
        SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
        FROM h LEFT JOIN cut USING (doc_id)""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_sharding": r"""
        WITH crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
             d AS (SELECT doc_id, md5(coalesce(text, '')) AS g, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
             c AS (SELECT doc_id, g, size::BIGINT AS size, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32 FROM d, crc),
             o AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total,
                          (sum(size) OVER (ORDER BY g) - sum(size) OVER (PARTITION BY g))::BIGINT AS low, (sum(size) OVER (ORDER BY g))::BIGINT AS high
                   FROM c WINDOW w AS (ORDER BY g, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
             edges AS (SELECT i, CASE WHEN 100 * (i * total - 8 * low) <= total THEN 8 * low WHEN 100 * (8 * high - i * total) <= total THEN 8 * high ELSE 8 * (before + size) END AS edge
                       FROM o, range(1, 8) r(i) WHERE 8 * before < i * total AND i * total <= 8 * (before + size)),
             s AS (SELECT *, (SELECT count(*) FROM edges WHERE edge <= 8 * before)::INTEGER AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
        FROM s""",
    "op12_ranking": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
             d AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
             all_ AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM d),
             p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
             w AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), all_),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             m AS (SELECT row, doc_id, 50 + ((50 * n * n_all) // l_all) AS m FROM d, all_),
             s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
