"""Queries of scalar functions, evaluation, texts and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import labels as L
from ..functions import numbers as N
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import points as P
from ..operators import texts as T
from ..operators.aggregates import count_where
from ..sources.tables import table
from .registry import query, rate_sql
from .results import lines, orders
from .sequences import events


@query(
    """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  CASE WHEN l_quantity >= 49 THEN 'winner' WHEN l_quantity >= 47 THEN 'runnerup' WHEN l_quantity >= 43 THEN 'best4' WHEN l_quantity >= 37 THEN 'best8' WHEN l_quantity >= 10 THEN 'round' WHEN l_quantity >= 5 THEN 'group' ELSE 'unknown' END AS kind,
  CASE l_returnflag WHEN 'R' THEN 'major' WHEN 'A' THEN 'national' ELSE 'local' END AS tier, l_linenumber::BIGINT AS rnd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, kind, tier,
  (CASE kind WHEN 'winner' THEN 1000 WHEN 'runnerup' THEN 900 WHEN 'best4' THEN 800 WHEN 'best8' THEN 700 WHEN 'round' THEN 100 + rnd WHEN 'group' THEN 10 ELSE 0 END)::BIGINT AS strength,
  (CASE tier WHEN 'major' THEN 100.0 WHEN 'national' THEN 60.0 ELSE 20.0 END * CASE kind WHEN 'winner' THEN 1.0 WHEN 'runnerup' THEN 0.7 WHEN 'best4' THEN 0.5 WHEN 'best8' THEN 0.3 ELSE 0.1 END)::DOUBLE AS score FROM k
"""
)
def placement_case(spark, d):
    q = F.col("l_quantity")
    raw = F.when(q >= 49, "winner").when(q >= 47, "runnerup").when(q >= 37, "best").when(q >= 10, "round").when(q >= 5, "group")
    kind = L.placement_kind(raw, F.when(q >= 43, 4).otherwise(16))
    tier = L.resolve_tier(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), tier.alias("tier"))
    return x.withColumn("strength", L.placement_strength(F.col("kind"), F.col("l_linenumber")).cast("long")).withColumn("score", F.round(L.entry_score(F.col("tier"), F.col("kind")), 6))


@query(
    """
WITH c AS (SELECT p_partkey, lower(p_type) || '-' || p_size || '-' || CASE p_partkey % 3 WHEN 0 THEN 'boys' WHEN 1 THEN 'girls' ELSE 'mixed' END AS cat FROM part),
s AS (SELECT *, string_split(cat, '-') AS p FROM c)
SELECT p_partkey, p[1] AS discipline, p[2] AS age, p[3] AS gender, CASE WHEN p[3] = 'mixed' THEN 'mixed' ELSE p[1] END AS kind FROM s
"""
)
def category_parse(spark, d):
    gender = F.when(F.col("p_partkey") % 3 == 0, "boys").when(F.col("p_partkey") % 3 == 1, "girls").otherwise("mixed")
    x = table(spark, d, "part").select("p_partkey", F.concat_ws("-", F.lower("p_type"), F.col("p_size").cast("string"), gender).alias("cat"))
    return x.select("p_partkey", L.category_parts(F.col("cat")).alias("c")).select("p_partkey", "c.*")


@query(
    """
SELECT p_partkey, unnest(CASE WHEN p_type = 'PROMO' THEN ['boys', 'girls'] WHEN p_size % 2 = 0 THEN ['boys'] ELSE ['girls'] END) AS gender FROM part
"""
)
def fanout_mixed(spark, d):
    gender = F.when(F.col("p_type") == "PROMO", "mixed").when(F.col("p_size") % 2 == 0, "boys").otherwise("girls")
    return table(spark, d, "part").select("p_partkey", F.explode(L.fan_out(gender, "mixed", ["boys", "girls"])).alias("gender"))


@query(
    f"""
WITH b AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_quantity <= 2 THEN '1-2' WHEN l_quantity <= 4 THEN '3-4' WHEN l_quantity <= 8 THEN '5-8' ELSE '9+' END AS band, l_returnflag = 'A' AS won FROM lineitem)
SELECT l_suppkey, band, count(*) AS n, {rate_sql("count(*) FILTER (WHERE won)", "count(*)")} AS win_rate, CASE WHEN count(*) < 20 THEN 'low' ELSE 'ok' END AS reliability FROM b GROUP BY 1, 2
"""
)
def bucket_rates(spark, d):
    x = lines(spark, d).withColumn("band", L.rally_band(F.col("l_quantity"), F.col("l_linenumber") == 7))
    out = x.groupBy("l_suppkey", "band").agg(F.count("*").alias("n"), N.exact_rate(count_where(F.col("l_returnflag") == "A"), F.count("*")).alias("win_rate"))
    return out.withColumn("reliability", N.reliability(F.col("n"), 20))


@query(
    f"""
WITH x AS (SELECT abs(l_extendedprice - 50000) / 100 AS gap, l_returnflag = 'A' AS won FROM lineitem)
SELECT least(floor(gap / 50) * 50, 300)::BIGINT AS gap_from, count(*) AS n, {rate_sql("count(*) FILTER (WHERE won)", "count(*)")} AS observed, round(avg(1 / (1 + pow(10, -gap / 400))), 6) AS expected FROM x GROUP BY 1
"""
)
def calibration_brier(spark, d):
    return E.calibration(lines(spark, d), F.abs(F.col("l_extendedprice") - 50000) / 100, F.col("l_returnflag") == "A")


@query(
    f"""
WITH x AS (SELECT year(l_shipdate)::BIGINT AS yr, 1 / (1 + pow(10, (25 - l_quantity) / 20)) AS p, l_returnflag <> 'N' AS won FROM lineitem)
SELECT CASE WHEN yr >= 2000 THEN 'holdout' ELSE 'fit' END AS part, count(*) AS n, {rate_sql("count(*) FILTER (WHERE (p > 0.5) = won)", "count(*)")} AS accuracy, round(avg(pow(p - won::INT, 2)), 6) AS brier FROM x GROUP BY 1
"""
)
def brier_holdout(spark, d):
    x = E.holdout(lines(spark, d), F.col("yr"), 2000)
    return E.metrics(x, ["part"], N.expected_score(F.col("l_quantity"), F.lit(25.0), 20.0), F.col("l_returnflag") != "N")


@query(
    """
WITH p AS (SELECT k, s FROM (VALUES (16), (32), (64)) a(k), (VALUES (200), (400)) b(s))
SELECT k::INT AS k, s::INT AS s, round(avg(pow(1 / (1 + pow(10, (k - l_quantity) / s)) - (l_returnflag = 'A')::INT, 2)), 6) AS score, count(*) AS n FROM lineitem, p GROUP BY 1, 2
"""
)
def grid_search(spark, d):
    grid = [{"k": k, "s": s} for k in (16, 32, 64) for s in (200, 400)]
    chance = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("k") - F.col("l_quantity")) / F.col("s")))
    return E.sweep(lines(spark, d).select("l_quantity", "l_returnflag"), grid, F.pow(chance - (F.col("l_returnflag") == "A").cast("int"), F.lit(2.0)))


@query(
    """
SELECT p_partkey, p_size::BIGINT AS slot, (p_partkey % 64)::BIGINT AS other, CASE WHEN p_size <> p_partkey % 64 THEN floor(log2(xor(p_size::BIGINT, (p_partkey % 64)::BIGINT)))::BIGINT END AS meets,
  (xor(p_size::BIGINT >> 2, 1) << 2)::BIGINT AS first_slot, ((xor(p_size::BIGINT >> 2, 1) << 2) + 3)::BIGINT AS last_slot, CASE WHEN p_size <= 1 THEN 1 ELSE pow(2, ceil(log2(p_size)))::BIGINT END AS draw FROM part
"""
)
def bracket_bits(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("slot"), (F.col("p_partkey") % 64).alias("other"))
    first, last = N.sibling_range(F.col("slot"), F.lit(2))
    return x.select("*", N.meeting_round(F.col("slot"), F.col("other")).cast("long").alias("meets"), first.alias("first_slot"), last.alias("last_slot"), N.next_power_of_two(F.col("slot")).alias("draw"))


@query(
    """
SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY 1
"""
)
def props_json(spark, d):
    x = events(spark, d).withColumn("k", F.from_json("props", "k long")["k"])
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query(
    r"""
WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS s FROM pages),
b AS (SELECT page_id, lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(s, '\?(.*)$', 1) AS q FROM a),
c AS (SELECT page_id, head, path, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^utm_')) AS ps FROM b)
SELECT page_id, head || CASE WHEN path = '' THEN '/' WHEN regexp_matches(path, '(?i)\.(pdf|xlsx?|xlsm|csv)/+$') THEN rtrim(path, '/') ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url,
       CASE WHEN regexp_matches(path, '(?i)\.(html?|php|aspx?|jsp)$') THEN 'html' WHEN regexp_matches(path, '(?i)\.pdf$') THEN 'pdf' ELSE 'unknown' END AS kind FROM c
"""
)
def url_normalise(spark, d):
    x = table(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))
    return x.withColumn("kind", X.link_kind(F.col("url")))


@query(
    r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>')) AS a FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1), '\s+', ' ', 'g'), ' ') AS href,
  trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ') AS title FROM a)
SELECT DISTINCT page_id, href, title FROM b WHERE href <> '' AND NOT regexp_matches(lower(href), '^(javascript|mailto):')
"""
)
def links_extract(spark, d):
    return T.links(table(spark, d, "pages"), ["page_id"]).select("page_id", "href", "title").distinct()


@query(
    r"""
WITH y AS (SELECT doc_id, regexp_extract_all(text, '\b(20[0-9]{2})\b', 1) AS v FROM documents), m AS (SELECT doc_id, regexp_extract_all(text, '([0-9A-Za-z._-]+@[0-9A-Za-z.-]+)', 1) AS v FROM documents)
SELECT doc_id, 'year' AS claim, unnest(v) AS value, unnest(range(0, len(v)))::BIGINT AS place FROM y UNION ALL SELECT doc_id, 'address', unnest(v), unnest(range(0, len(v)))::BIGINT FROM m
"""
)
def claims_extract(spark, d):
    x = T.claims(table(spark, d, "documents"), "doc_id", "text", {"year": r"\b(20[0-9]{2})\b", "address": r"([0-9A-Za-z._-]+@[0-9A-Za-z.-]+)"})
    return x.withColumn("place", F.col("place").cast("long"))


@query(
    r"""
WITH r AS (SELECT doc_id, 'license' AS rule, len(regexp_extract_all(text, '(?i)license|copyright')) AS n FROM documents
 UNION ALL SELECT doc_id, 'digits', len(regexp_extract_all(text, '[0-9]{6,}')) FROM documents UNION ALL SELECT doc_id, 'shouting', len(regexp_extract_all(text, '!{2,}')) FROM documents)
SELECT * FROM r WHERE n > 0
"""
)
def text_lint(spark, d):
    return T.lint(table(spark, d, "documents"), "doc_id", "text", {"license": "(?i)license|copyright", "digits": "[0-9]{6,}", "shouting": "!{2,}"})


@query(
    """
SELECT p_brand, sha1(string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey::VARCHAR)) AS signature, substr(sha1(p_brand), 1, 16) AS brand_hash FROM part GROUP BY 1
"""
)
def hash_signature(spark, d):
    x = table(spark, d, "part").groupBy("p_brand").agg(K.group_signature(F.col("p_partkey")).alias("signature"))
    return x.withColumn("brand_hash", K.short_hash(F.col("p_brand")))


@query()
def compatibility_keys(spark, d):
    """NFKC keys, FNV hashes and longest common substrings of distinct names, which SQL has no functions for."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", K.person_key(F.col("s_name"), F.col("n_name")).alias("person"), K.fnv1a_base36(F.col("s_name")).alias("fnv"), K.longest_common_substring(F.col("s_name"), F.col("n_name")).alias("shared"))


@query(
    """
WITH s AS (SELECT c_custkey, (c_custkey % 7) * 1000 AS a, (c_custkey % 7) * 1000 + 1500 + (c_custkey % 5) * 500 AS b FROM customer),
g AS (SELECT *, unnest(range(a, b, 1000)) AS pos FROM s)
SELECT c_custkey, ((pos - a) // 1000)::BIGINT AS number, greatest(pos - 300, a) AS from_ms, least(pos + 300, b) AS to_ms FROM g
"""
)
def generate_candidates(spark, d):
    s = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 7) * 1000).alias("a")).withColumn("b", F.col("a") + 1500 + (F.col("c_custkey") % 5) * 500)
    x = P.boundary_candidates(s, ["c_custkey"], "a", "b", 1000, 300)
    return x.withColumn("number", F.col("number").cast("long"))


@query(
    """
SELECT o_orderkey, year(o_orderdate)::BIGINT - (month(o_orderdate) < 4)::INT AS fiscal_year, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'medium' ELSE 'high' END AS confidence,
       floor(o_totalprice / 1000 * 10 + 0.5) / 10.0 AS thousands, least(o_custkey, o_orderkey) || '-' || greatest(o_custkey, o_orderkey) AS pair FROM orders
"""
)
def scalar_bands(spark, d):
    o = orders(spark, d)
    return o.select("o_orderkey", N.fiscal_year(F.col("o_orderdate")).cast("long").alias("fiscal_year"), N.band(F.col("o_totalprice"), [(100000, "low"), (300000, "medium")], "high").alias("confidence"), N.half_up(F.col("o_totalprice") / 1000, 1).alias("thousands"), K.pair_key(F.col("o_custkey"), F.col("o_orderkey")).alias("pair"))
