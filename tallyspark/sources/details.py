"""Nested detail documents: one JSON document for each category of an edition, under <root>/<tournament>/<year>/<category>.json.

Those that Spark's partitioned writer makes may come in parts, in folders part=<number>: each part is a document of its own with some of the matches, in order of parts, and the
entries of these. So a row never holds more than a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
participants array<struct<id:string, lastName:string, firstName:string, team:string, prefecture:string>>,
entries array<struct<entryNo:int, playerIds:array<string>, type:string>>,
matches array<struct<matchId:string, entries:array<int>, scores:map<string,int>, round:string, winnerEntryNo:int, retired:boolean, stage:string, `group`:string, nextMatchId:string, prevMatchIds:array<string>>>,
results array<struct<entryNo:int, tournament:struct<label:string, rank:struct<kind:string, bestLevel:int, round:int>>, roundrobin:struct<`group`:string, rank:int>>>,
knockoutDraw struct<slots:array<struct<`group`:string, rank:int>>>,
_corrupt string
"""
PATH = r"([^/]+)/(\d{4})/([^/]+)\.json$"
#: The same keys in the folders that Spark's partitioned writer makes.
PARTITIONED = r"tournament=([^/]+)/year=(\d{4})/category=([^/]+)/(?:part=\d+/)?[^/]+\.json(?:\.gz)?$"
PART = r"/part=(\d+)/[^/]+$"
KEYS = ["tournament", "year", "category"]


def read_details(spark: SparkSession, root: str, layout: str = PATH) -> DataFrame:
    """One row a document, or a part of one: tournament, year, category and part (0 without parts) by its path, its arrays, and variant (standard, matches_only, round_robin_only, mixed or unknown). Documents by other paths are left out."""
    x = spark.read.schema(SCHEMA).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.{json,json.gz}", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    path = F.col("_metadata.file_path")
    x = x.select(F.regexp_extract(path, layout, 1).alias("tournament"), F.regexp_extract(path, layout, 2).try_cast("int").alias("year"), F.regexp_extract(path, layout, 3).alias("category"), F.coalesce(F.regexp_extract(path, PART, 1).try_cast("int"), F.lit(0)).alias("part"), "*").where("tournament <> ''")
    return x.withColumn("variant", variant())


def variant() -> F.Column:
    has = lambda c: F.col(c).isNotNull()
    robin = F.exists("matches", lambda m: m["stage"] == "roundrobin") & ~F.exists("matches", lambda m: m["stage"] != "roundrobin")
    return (
        F.when(has("_corrupt"), "unknown")
        .when(has("participants") & has("entries") & has("matches") & has("results"), "standard")
        .when(has("matches") & ~has("entries") & ~has("results") & robin, "round_robin_only")
        .when(has("matches") & ~has("entries") & ~has("results"), "matches_only")
        .when(has("matches") | has("entries") | has("results"), "mixed")
        .otherwise("unknown")
    )


def standard(details: DataFrame) -> DataFrame:
    return details.where("variant = 'standard'")


def quarantined(details: DataFrame) -> DataFrame:
    """Documents that aren't standard, with why."""
    return details.where("variant <> 'standard'").select(*KEYS, "variant").distinct()


def participants(details: DataFrame) -> DataFrame:
    return details.select(*KEYS, F.explode("participants").alias("p")).select(*KEYS, "p.*")


def entries(details: DataFrame) -> DataFrame:
    return details.select(*KEYS, F.explode("entries").alias("e")).select(*KEYS, F.col("e.entryNo").alias("entry"), F.col("e.playerIds").alias("ids"), F.col("e.type").alias("type"))


def _placed(details: DataFrame, array: str, name: str) -> DataFrame:
    """The elements of an array with their position in the document, over all of its parts."""
    x = details.select(*KEYS, "part", F.posexplode(array).alias("__n", name))
    return x.withColumn("position", F.col("part").cast("long") * (1 << 32) + F.col("__n"))


def matches(details: DataFrame) -> DataFrame:
    """Matches with their two entries and scores; a winner of 0, less or null is undecided (null)."""
    x = _placed(details, "matches", "m").select(*KEYS, "position", "m.*")
    a, b = F.try_element_at("entries", F.lit(1)), F.try_element_at("entries", F.lit(2))
    score = lambda e: F.try_element_at("scores", e.cast("string"))
    return x.select(*KEYS, "position", F.col("matchId").alias("match"), a.alias("entry_a"), b.alias("entry_b"), score(a).alias("score_a"), score(b).alias("score_b"), "round", F.when(F.col("winnerEntryNo") > 0, F.col("winnerEntryNo")).alias("winner"), F.coalesce("retired", F.lit(False)).alias("retired"), F.coalesce("stage", F.lit("knockout")).alias("stage"), F.col("group").alias("grp"), "prevMatchIds")


def results(details: DataFrame) -> DataFrame:
    """One row an entry; of several the first."""
    x = _placed(details, "results", "r").select(*KEYS, "position", F.col("r.entryNo").alias("entry"), F.col("r.tournament.rank").alias("rank"), F.col("r.roundrobin").alias("robin"))
    return x.groupBy(*KEYS, "entry").agg(F.min_by(F.struct("rank", "robin"), "position").alias("r")).select(*KEYS, "entry", "r.*")
