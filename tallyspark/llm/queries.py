"""The registered queries of the corpus operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_text

    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt into eight arrivals by id, appended, compacted and read back from the last version, each row with what the manifests say:
    versions by appending, rows before and after compaction, the most small shards that one tier still has, at most (it is settled), and whether there are fewer shards and bytes or as many."""
    import uuid

    from ..session import owned
    from .common import shared_dir
    from .sharding import ShardStore

    store = ShardStore(spark, owned(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"))
    docs = table(spark, sf_dir, "documents")
    appended = store.append(docs, F.pmod("doc_id", F.lit(8)))
    last = store.compact()
    of = {r["version"]: r for r in store.history().where(F.col("version").isin(appended, last)).collect()}
    before, after = of[appended], of[last]
    rows = store.read().select("doc_id", "lang", "source", "n_chars", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    told = {"arrivals": F.lit(appended).cast("long"), "rows_appended": F.lit(before["rows"]).cast("long"), "rows_compacted": F.lit(after["rows"]).cast("long")}
    told |= {"settled": F.lit(after["fullest"] < store.fanout), "not_more": F.lit(after["shards"] <= before["shards"])}
    return rows.withColumns(told)


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256,
  (SELECT count(DISTINCT coalesce((doc_id % 8 + 8) % 8, -1)) FROM documents)::BIGINT AS arrivals, (SELECT count(*) FROM documents) AS rows_appended, (SELECT count(*) FROM documents) AS rows_compacted, true AS settled, true AS not_more
FROM documents
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM starts
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_ways AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM both_ways JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.x = w.doc_id
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, o.k IS NOT NULL AND l.doc_id <> o.keeper AS gone FROM keyed l LEFT JOIN often o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def vocabulary() -> str:
    """The public tokenizer file of the production parameters; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM words WHERE len(ws) >= 13
), keyed AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM windows
), least AS (
  SELECT k, min(doc_id) AS d FROM keyed GROUP BY k
), covered AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + 13)) AS p FROM keyed w JOIN least l ON w.k = l.k WHERE l.d < w.doc_id
), each AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM words
), kept AS (
  SELECT e.doc_id, count(*) AS n, count(*) FILTER (WHERE c.p IS NOT NULL) AS gone,
         string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL) AS rest
  FROM each e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_cascade import url_cascade

    return url_cascade(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules (verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT s.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .frequency_filter import frequency_scores

    return frequency_scores(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The crc32 table, from its polynomial, and the crc32 of a string's UTF-8 bytes.
_CRC_TABLE = """tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
)"""


def _crc32(text: str) -> str:
    digit = "strpos('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1"
    octets = f"list_transform(range(1, length(hex({text})) // 2 + 1), lambda i: ({digit.format(text, '2 * i - 1')}) * 16 + {digit.format(text, '2 * i')})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"


OP12_SQL = rf"""
WITH {_CRC_TABLE}, texts AS (
  SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark
), words AS (
  SELECT target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), runs AS MATERIALIZED (
  SELECT target, doc_id, f, count(*) AS n FROM (
    SELECT target, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM words
  ) GROUP BY ALL
), bucket AS MATERIALIZED (
  SELECT f, {_crc32("f")} % 10000 AS k FROM (SELECT DISTINCT f FROM runs), tab
), counts AS (
  SELECT k, coalesce(sum(n) FILTER (WHERE NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target), 0)::DOUBLE AS t FROM runs JOIN bucket USING (f) GROUP BY k
), totals AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts
), gain AS MATERIALIZED (
  SELECT k, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM counts, totals
), summed AS (
  SELECT doc_id, sum(n * g)::BIGINT AS total, sum(n)::BIGINT AS n FROM runs JOIN bucket USING (f) JOIN gain USING (k) WHERE NOT target GROUP BY doc_id
), weighed AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features,
         CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight
  FROM words w LEFT JOIN summed s ON s.doc_id = w.doc_id WHERE NOT target
), hashed AS (
  SELECT *, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || doc_id), i, 1)) - 1)), lambda a, b: a * 16 + b) AS h FROM weighed
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM hashed
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS draw FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT conv_id, list(turn ORDER BY pos) AS seq FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, seq, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM own, tab
), rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.seq, [])[1:h], a.seq[h + 1:]) AS seq FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), members AS (
  SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt
), nodes AS MATERIALIZED (
  SELECT seq[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), saving AS (
  SELECT prefix, depth, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM nodes
), children AS MATERIALIZED (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), above AS (
  SELECT s.prefix[1:d] AS prefix, d AS depth, saved, c.n IS NULL AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM saving) s LEFT JOIN children c ON c.prefix = s.prefix AND c.depth = s.depth
), sums AS (
  SELECT prefix, depth, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix AND s.depth = n.depth LEFT JOIN children c ON c.prefix = n.prefix AND c.depth = n.depth
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_html_extraction": op1_html_extraction, "op2_sharding": op2_sharding, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op4_quality_classifier": op4_quality_classifier, "op5_line_dedup": op5_line_dedup, "op6_best_fit_packing": op6_best_fit_packing, "op7_benchmark_decontamination": op7_benchmark_decontamination, "op8_substring_dedup": op8_substring_dedup, "op9_url_filters": op9_url_filters, "op10_media_columns": op10_media_columns, "op11_lm_scoring": op11_lm_scoring, "op12_importance_resampling": op12_importance_resampling, "op13_prefix_trie": op13_prefix_trie}
SQL: dict[str, str] = {"op2_sharding": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op9_url_filters": OP9_SQL, "op12_importance_resampling": OP12_SQL, "op13_prefix_trie": OP13_SQL}
