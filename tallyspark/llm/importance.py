"""Importance resampling towards a target distribution, over hashed n-gram counts with overlap chunking.

A text's features are all runs of 1 to ``max_n`` consecutive words, repeats counted; each falls in one of ``buckets`` by the
crc32 of its UTF-8 bytes. Bucket counts over all documents and over all target texts give each bucket a gain, a whole number
of thousandths of a log ratio. A document's weight is the floored mean of its features' gains; with Gumbel noise from a hash of
its id added, the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Long texts are cut at word boundaries into chunks of about ``chunk_bytes``. A chunk owns the features that start in it, and
carries the max_n - 1 words that follow, so that runs over a cut are counted once. Chunks of long texts are dealt to all
tasks; counts are summed by bucket, and gains by document.

Edge cases: a null text has no words; a document without features has weight 0. Rows that share an id are documents of
their own, and equal rows have equal results, in neighbouring ranks. A row without an id counts in the bucket counts, gets
n_features and weight, but no score or rank. Ties on score go to the smaller id. An empty target (T = 0) or an empty table is
defined by the same formula. Columns other than id and text aren't looked at.

Scale: two passes over the texts; the first shuffles at most ``buckets`` rows a task, the second one row a document. Only the
gains (``buckets`` numbers) and a row for each score are broadcast. Ranks need no global sort: scores are whole numbers, under 10^5 in absolute
value for any counts of 64 bits, so counts by score (200,000 rows at most) say where each score's ranks begin; the documents of one score are
ordered by id in blocks whose starts come from counts as well.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

#: What separates words: ASCII but digits and small letters (A-Z are lower-cased before).
_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """The words of a stretch of UTF-8."""
    return raw.translate(_TO_SPACE).split()


def chunks(raw: bytes, chunk_bytes: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of words: (bytes, how many of its words start in it). Each but the last has `carry` words of the next ones added."""
    flat, at = raw.translate(_TO_SPACE), 0
    while at < len(flat):
        end = len(flat) if at + chunk_bytes >= len(flat) else flat.find(b" ", at + chunk_bytes)
        end = len(flat) if end < 0 else end
        own = flat[at:end].split()
        after: list[bytes] = []
        look = end
        while len(after) < carry and look < len(flat):
            # One more word: from the next byte that isn't a space up to the one that is.
            while look < len(flat) and flat[look] == 32:
                look += 1
            stop = flat.find(b" ", look)
            stop = len(flat) if stop < 0 else stop
            if stop > look:
                after.append(flat[look:stop])
            look = stop
        if own:
            yield b" ".join(own + after), len(own)
        at = end


def features(found: list[bytes], own: int, max_n: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to max_n words that starts at one of the first `own` words."""
    crc = zlib.crc32
    at = list(map(crc, found))
    out = [at[:own]]
    for n in range(1, max_n):
        # crc32 goes on from the shorter run's value, so each word is read once for each length.
        at = [crc(w, crc(b" ", c)) for c, w in zip(at, found[n:])]
        out.append(at[:own])
    return np.fromiter((c for part in out for c in part), np.int64, sum(map(len, out))) % buckets


def _pieces(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, carry: int) -> DataFrame:
    """(id, a, b, first, own, piece): short texts as one piece, where they are read; long ones in chunks dealt to all tasks. own is -1 where all words are the piece's own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), F.encode(text, "utf-8").alias("piece"))
    short = rows.where(F.octet_length("piece") <= chunk_bytes).select("id", "a", "b", F.lit(True).alias("first"), F.lit(-1).alias("own"), "piece")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[object, int, int, bool, int, bytes]] = []
        size = 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(held, columns=["id", "a", "b", "first", "own", "piece"])
            return out.assign(id=pd.array([None if pd.isna(i) else int(i) for i in out["id"]], "Int64"))

        for x in batches:
            for i, a, b, raw in zip(x["id"].astype(object), x["a"], x["b"], x["piece"]):
                pieces = chunks(raw, chunk_bytes, carry)
                for k, (piece, own) in enumerate(itertools.chain(pieces, [(b"", 0)])):  # the empty one stands for a text of white space
                    held.append((i, a, b, k == 0, own, piece))
                    size += len(piece)
                    if size > 1 << 24:
                        yield frame()
                        held, size = [], 0
        if held:
            yield frame()

    long = rows.where(F.octet_length("piece") > chunk_bytes).withColumn("id", F.col("id").cast("long"))
    dealt = long.mapInPandas(cut, "id long, a long, b long, first boolean, own int, piece binary").repartition(F.xxhash64("a", "b", "piece"))
    return short.withColumn("id", F.col("id").cast("long")).unionByName(dealt)


def _owned(piece: bytes, own: int) -> tuple[list[bytes], int]:
    found = words(piece)
    return found, len(found) if own < 0 else own


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2, buckets: int = 10_000, chunk_bytes: int = 1 << 16) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for x in batches:
            for piece, own in zip(x["piece"], x["own"]):
                total += np.bincount(features(*_owned(piece, own), max_n, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = _pieces(docs, id_col, text_col, chunk_bytes, max_n - 1).select("piece", "own").mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, floor(1000 * ln) of its smoothed share in the target over that in the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _floored(total: Column, n: Column) -> Column:
    """total / n, rounded down, in whole numbers."""
    n = F.greatest(n, F.lit(1).cast("long"))
    return ((total - F.pmod(total, n)) / n).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2, chunk_bytes: int = 1 << 16) -> DataFrame:
    """(id, n_words, n_features, weight), a row for each document."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = sent.value
        for x in batches:
            each = []
            for piece, own in zip(x["piece"], x["own"]):
                found, own = _owned(piece, own)
                at = features(found, own, max_n, len(of))
                each.append((own, len(at), int(of[at].sum())))
            out = x[["id", "a", "b", "first"]].copy()
            out[["n_words", "n_features", "total"]] = np.array(each, np.int64).reshape(-1, 3)
            out["id"] = out["id"].astype("Int64")
            yield out

    parts = _pieces(docs, id_col, text_col, chunk_bytes, max_n - 1).mapInPandas(weigh, "id long, a long, b long, first boolean, n_words long, n_features long, total long")
    # Equal rows are summed as one, divided by their number, and are that many rows again.
    summed = parts.groupBy("id", "a", "b").agg(F.sum(F.col("first").cast("long")).alias("rows"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    whole = lambda c: F.expr(f"{c} div rows")
    each = summed.select("id", "rows", whole("n_words").alias("n_words"), whole("n_features").alias("n_features"), whole("total").alias("total"))
    return each.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"), "n_words", "n_features", _floored(F.col("total"), F.col("n_features")).alias("weight")).drop("copy")


def gumbel(ident: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the id's hash, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, draw: int, block: int = 4096) -> DataFrame:
    """scored (id, score, eligible) with rank: 1, 2, ... by score from the top, then id, for the first `draw` of the eligible; null for others."""
    able = scored.where("eligible")
    by_score = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # At most 200,000 rows, whatever the input.
    above = by_score.select("score", "n", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"))
    taking = above.where(F.col("above") < draw)
    # Documents of one score in blocks of ids; a block's ranks begin after those of smaller blocks.
    near = able.join(F.broadcast(taking.select("score", "above")), "score").withColumn("block", F.floor(F.col("id") / block))
    blocks = near.groupBy("score", "block").agg(F.count(F.lit(1)).alias("m"))
    starts = blocks.select(F.col("score").alias("s"), F.col("block").alias("k"), (F.sum("m").over(Window.partitionBy("score").orderBy("block")) - F.col("m")).alias("before"))
    placed = near.join(starts, (F.col("score") == F.col("s")) & (F.col("block") == F.col("k")))
    rank = F.col("above") + F.col("before") + F.row_number().over(Window.partitionBy("score", "block").orderBy("id"))
    drawn = placed.withColumn("rank", rank.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*scored.columns, "rank")
    rest = scored.where("eligible is not true").withColumn("rank", F.lit(None).cast("long"))
    low = able.join(F.broadcast(taking.select(F.col("score").alias("s"))), F.col("score") == F.col("s"), "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(low).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = 25, min_words: int = 20, seed: int = 7, max_n: int = 2, buckets: int = 10_000, chunk_bytes: int = 1 << 16,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: `percent` % of those with min_words or more are drawn, and have a rank."""
    source = bucket_counts(docs, id_col, text_col, max_n, buckets, chunk_bytes)
    wanted = bucket_counts(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text, max_n, buckets, chunk_bytes)
    found = weights(docs, gains(source, wanted), id_col, text_col, max_n, chunk_bytes)
    scored = found.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("eligible", (F.col("n_words") >= min_words) & F.col("id").isNotNull())
    scored = written(scored, "scored")
    n = scored.where("eligible").count()
    return ranked(scored, n * percent // 100).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
