"""Queries of JSON documents: one for each order, with members that not all have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources.tables import table
from .registry import query


def _orders(spark, d):
    """(o_orderkey, text): nested documents; members that begin with an underscore are internal."""
    k = F.col("o_orderkey")
    lines = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda n: F.struct(n.alias("n"), F.when(n > 0, n * 2).alias("_seen")))
    head = F.struct(F.col("o_orderstatus").alias("status"), F.when(k % 5 == 0, F.struct((k % 7).alias("by"), F.lit("x").alias("_at"))).alias("check"), F.lit(1).alias("_trace"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(k.alias("id"), head.alias("head"), lines.alias("lines"), F.struct(k.alias("raw")).alias("_source"))).alias("text"))


@query(
    """
SELECT o_orderkey, '{"head":{' || CASE WHEN o_orderkey % 5 = 0 THEN '"check":{"by":' || o_orderkey % 7 || '},' ELSE '' END || '"status":"' || o_orderstatus || '"},"id":' || o_orderkey || ',"lines":[' ||
  array_to_string(list_transform(generate_series(0, o_orderkey % 3), lambda n: '{"n":' || n || '}'), ',') || ']}' AS text FROM orders
"""
)
def stripped_documents(spark, d):
    """Documents without internal members, at any depth."""
    x = D.json_documents(D.without_members(D.json_nodes(_orders(spark, d), "o_orderkey", "text"), prefix="_"))
    return x.select(F.col("id").alias("o_orderkey"), "text")


@query(
    """
SELECT o_orderkey, '{"_source":{"raw":' || o_orderkey || '},"head":{"_trace":' || CASE WHEN o_orderkey % 2 = 0 THEN '{"level":2}' ELSE '1' END ||
  CASE WHEN o_orderkey % 5 = 0 THEN ',"check":{"_at":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'x' END || '","by":' || o_orderkey % 7 || '}' ELSE '' END || ',"status":"' || o_orderstatus || '"},"id":' || o_orderkey || ',"lines":' ||
  CASE WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(generate_series(0, o_orderkey % 3), lambda n: '{' || CASE WHEN n > 0 THEN '"_seen":' || n * 2 || ',' ELSE '' END || '"n":' || n || '}'), ',') || ']' END || '}' AS text FROM orders
"""
)
def merged_documents(spark, d):
    """Documents of even orders take what an override sets: an object for a number, a nested member, an empty array; nulls and unknown members change nothing."""
    base = _orders(spark, d)
    change = base.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit('{"head":{"_trace":{"level":2},"check":{"_at":"y"},"status":null},"lines":[],"other":{"a":1}}').alias("text"))
    x = D.json_documents(D.merged(D.json_nodes(base, "o_orderkey", "text"), D.json_nodes(change, "o_orderkey", "text")))
    return x.select(F.col("id").alias("o_orderkey"), "text")
