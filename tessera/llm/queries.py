"""The registered queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 8)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.audio import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.partenum import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.maxent import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.pieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_embed import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_pii_surrogates, op3_audio_features, op4_mixing, op5_ngram_jaccard_join, op6_maxent_scores, op7_sentencepiece, op8_warc_revisits, op9_quality_rules, op10_embedding_near_dedup, op11_tokenizer_alignment, op12_prefix_trie, op13_packing)}


#: Compared with DuckDB. The others search, iterate, write files or train; their tests hold them against brute force,
#: exact round trips or held-out data.
_OP4 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM per
), filled AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before, sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM weighed
  WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((total - cap_before) / (ws - w_before)) AS level FROM filled
), rated AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM (SELECT source, source_size, least(cap, w * level) AS target FROM weighed, level)
), drawn AS (
  SELECT sized.*, source_size, target, rate, rate - floor(rate) AS part, size * 50 > source_size AS large FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
), large AS (
  SELECT source, part, size, u, row_number() OVER (PARTITION BY source ORDER BY size DESC, u DESC) AS k FROM drawn WHERE large AND size > 0 AND part > 0
), decided AS (
  SELECT source, part, size, u, k, u < part + 0.0::DOUBLE / size AS takes, part * size - CASE WHEN u < part + 0.0::DOUBLE / size THEN CAST(size AS DOUBLE) ELSE 0 END AS owed FROM large WHERE k = 1
  UNION ALL
  SELECT n.source, n.part, n.size, n.u, n.k, n.u < n.part + d.owed / n.size, d.owed + n.part * n.size - CASE WHEN n.u < n.part + d.owed / n.size THEN CAST(n.size AS DOUBLE) ELSE 0 END
  FROM decided d JOIN large n ON n.source IS NOT DISTINCT FROM d.source AND n.k = d.k + 1
), owed AS (
  SELECT source, arg_max(owed, k) AS owed FROM decided GROUP BY source
), steps AS (
  SELECT source, part, CAST(floor(u * 4096) AS BIGINT) AS step, sum(size) AS words FROM drawn WHERE NOT large AND size > 0 AND part > 0 GROUP BY ALL
), walked AS (
  SELECT steps.source, step, sum(words) OVER (PARTITION BY steps.source ORDER BY step) AS upto, part * sum(words) OVER (PARTITION BY steps.source) + coalesce(owed, 0) AS goal
  FROM steps LEFT JOIN owed ON steps.source IS NOT DISTINCT FROM owed.source
), limits AS (
  SELECT source, CASE WHEN min(abs(goal)) <= min(abs(upto - goal)) THEN 0 ELSE (arg_min(step, (abs(upto - goal), step)) + 1) / 4096.0::DOUBLE END AS lim FROM walked GROUP BY source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN large THEN CASE WHEN EXISTS (SELECT 1 FROM decided d WHERE d.takes AND d.source IS NOT DISTINCT FROM drawn.source AND d.u = drawn.u) THEN 1 ELSE 0 END WHEN u < coalesce(lim, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn LEFT JOIN limits ON drawn.source IS NOT DISTINCT FROM limits.source
"""


_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i : array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a
)
SELECT reach.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach JOIN n ON n.doc_id = reach.doc_id GROUP BY 1
"""

_OP8 = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM k
"""

#: CRC-32 of a decimal number by its eight shifts for each digit, then prefixes as lists; a node's ancestors are its own prefixes.
_OP12 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(concat(strlen(role), ':', role, text))) AS own,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d : [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x : CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) AS path FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20
), nodes AS (
  SELECT path[1 : d] AS prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends_sha256
  FROM rebuilt, unnest(generate_series(0, len(path))) AS g(d) GROUP BY 1, 2
), grown AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1 : n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
), below AS (
  SELECT prefix[1 : d] AS top, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM grown, unnest(generate_series(0, depth)) AS g(d)
), sums AS (
  SELECT top, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM below GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM grown JOIN sums ON top = prefix
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _OP4, "op5_ngram_jaccard_join": _OP5, "op8_warc_revisits": _OP8, "op12_prefix_trie": _OP12}
