"""HTML extraction by site template removal.

Every page is read into elements; each element's subtree is hashed (name, class, id, text and children). Spark counts
on how many pages a subtree occurs, for each host and each section of it (the first step of the path); those on at least
``min_pages`` pages and ``min_share`` of the pages of the host or section (``prose_share`` where they hold paragraphs) are template and are
deleted. Copies of an article count as one page: pages of a host and section whose paragraphs are equal are counted once, so however
often an article is printed it is no template. Paragraphs and inline elements by themselves go only where they stand on ``steady_pages`` pages and ``steady_share`` of
them, like a call to subscribe. A page of which nothing would be left stays whole.

Of what is left the text is that of main where it has paragraphs besides its articles, else of the articles, else of main, else all of it:
never menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, which element, role or name tell whether
they recur or not. Of an article's own header its headings stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Edge cases: null or empty html has an empty text. A null url's host is empty. Broken markup is read as far as it goes:
unclosed elements end with the page, a cut last tag is dropped. Rows that repeat get equal texts. An empty table
gives an empty result; columns of the result that the pages have too are replaced.

Scale: the first pass shuffles a row of hashes for each distinct page, then (host, section, hash) counts, pre-aggregated, and a host in a third of the rows is spread
by page and by hash; the share is judged by a join that AQE splits. A template has at most subtrees-a-page / min_share entries. Up to
``broadcast_rows`` entries in all are broadcast, once for each executor; beyond that, pages join their section's entries under a salt, so
that no host is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written
from .url_cascade import host_of, path_of

SALTS = 64


def section_of(url: Column) -> Column:
    """The first step of a url's path, if it isn't the last."""
    return F.regexp_extract(path_of(url), r"^/([^/]+)/", 1)


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2, steady_pages: int = 20, steady_share: float = 0.9, prose_share: float = 0.5) -> DataFrame:
    """pages: host, section, html. (host, section, h, steady): hashes of recurring subtrees; a null section stands for the whole host."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .html_tree import fingerprint, read, subtrees

        for batch in batches:
            seen: dict[tuple[str, str, int], list[int]] = {}
            for host, section, page in zip(*(batch.column(c).to_pylist() for c in ("host", "section", "html")), strict=True):
                events = read(page or "")
                key = (host, section, fingerprint(events))
                if key not in seen:
                    seen[key] = sorted(subtrees(events))
            cols = list(zip(*seen, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["host", "section", "page", "h"])

    # Copies of one article count as one page, so that they make no template of it: of several the one with the least hashes.
    read = pages.select("host", "section", "html").mapInArrow(hashes, "host string, section string, page long, h array<long>").groupBy("host", "section", "page").agg(F.min("h").alias("h"))
    read = written(read, "subtrees")
    # Host and sections in one go.
    key = ["host", "whole", "section"]
    both = F.explode(F.array(F.struct(F.lit(False).alias("whole"), F.col("section").alias("section")), F.struct(F.lit(True).alias("whole"), F.lit("").alias("section"))))
    own = read.select("host", both.alias("x"), "h").select("host", "x.whole", "x.section", "h")
    counts = own.select(*key, F.explode("h").alias("h")).groupBy(*key, "h").agg(F.count("*").alias("n"))
    totals = own.groupBy(*key).agg(F.count("*").alias("pages"))
    # What is rare goes before the shares are judged.
    least = F.when(F.col("h").bitwiseAND(1) == 1, prose_share).otherwise(min_share)
    often = counts.where(F.col("n") >= min_pages).join(totals, key).where(F.col("n") >= F.col("pages") * least)
    steady = (F.col("n") >= steady_pages) & (F.col("n") >= F.col("pages") * steady_share)
    return often.select("host", F.when(~F.col("whole"), F.col("section")).alias("section"), "h", steady.alias("steady"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.2, steady_pages: int = 20, steady_share: float = 0.9, prose_share: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """pages' other columns, with text and n_chars instead of html_col."""
    spark = pages.sparkSession
    ship_package(spark)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    x = pages.select(F.struct(*others).alias("row"), host_of(F.col(url_col)).alias("host"), section_of(F.coalesce(F.col(url_col), F.lit(""))).alias("section"), F.col(html_col).alias("html"))
    templates = written(site_templates(x, min_pages, min_share, steady_pages, steady_share, prose_share), "templates")
    none: frozenset[int] = frozenset()
    row = x.schema["row"].dataType.simpleString()

    def result(batch: pa.RecordBatch, templates: Iterator[tuple[frozenset[int], frozenset[int]]]) -> pa.RecordBatch:
        from .html_tree import main_text, read

        out = [main_text(read(page), *t) if page else "" for page, t in zip(batch.column("html").to_pylist(), templates, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["row", "text", "n_chars"])

    if templates.count() <= broadcast_rows:
        sets: dict[tuple[str, str | None], tuple[set[int], set[int]]] = {}
        for r in templates.collect():
            both, steady = sets.setdefault((r["host"], r["section"]), (set(), set()))
            both.add(r["h"])
            if r["steady"]:
                steady.add(r["h"])
        shared = spark.sparkContext.broadcast({k: (frozenset(a), frozenset(b)) for k, (a, b) in sets.items()})

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            union: dict[tuple[str, str], tuple[frozenset[int], frozenset[int]]] = {}

            def of(key: tuple[str, str]) -> tuple[frozenset[int], frozenset[int]]:
                if key not in union:
                    (a, b), (c, d) = known.get((key[0], None), (none, none)), known.get(key, (none, none))
                    union[key] = a | c, b | d
                return union[key]

            for batch in batches:
                yield result(batch, map(of, zip(batch.column("host").to_pylist(), batch.column("section").to_pylist(), strict=True)))

        joined = x
    else:
        listed = templates.groupBy("host", "section").agg(F.collect_list("h").alias("h"), F.collect_list(F.when(F.col("steady"), F.col("h"))).alias("steady"))
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = x.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = joined.join(listed.where("section is null").select("host", "salt", F.col("h").alias("h0"), F.col("steady").alias("s0")), ["host", "salt"], "left")
        joined = joined.join(listed.select("host", "section", "salt", F.col("h").alias("h1"), F.col("steady").alias("s1")), ["host", "section", "salt"], "left")

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, c, d = ((frozenset(t or ()) for t in batch.column(n).to_pylist()) for n in ("h0", "h1", "s0", "s1"))
                yield result(batch, ((x | y, z | w) for x, y, z, w in zip(a, b, c, d, strict=True)))

    return joined.mapInArrow(texts, f"row {row}, text string, n_chars long").select("row.*", "text", "n_chars")
