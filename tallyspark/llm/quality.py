"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Two naive Bayes heads, each fitted on a bounded sample of the labelled rows: "junk" (label quality = 0) from bucketed
shape statistics of the text, and "toxic" (label toxic = 1) from how many words of a lexicon its worst stretch has: words that toxic documents
hold in many different contexts and others hardly do (contexts, so that copies of one document don't make a word). Their log
likelihood ratios are the evidence. A word enters the lexicon if toxic documents hold it in at least ``min_contexts``
contexts and that is over ``min_surprise`` nats from what its whole count makes likely. How much a number of such words tells
is counted on each half of the sample by the words of the other half (equal texts are in one half). Every document of the corpus, labelled or not, then counts towards its host and path
with its probability under the global rate: a host's rate is shrunk towards the global one, a path's towards its host's,
each by a strength fitted from how much the rates differ between hosts. A document's own count is left out of its prior.
It is rejected if the chance that it is junk or toxic reaches ``reject``.

Bound of the sample: ``train_rows`` labelled rows, those with the smallest hashes of their ids; everything else covers all rows.

Edge cases: a null text counts as empty. A null host or path is a host or path of its own. Null labels count as good and
not toxic; labels without a document are unused; of several labels of an id the worst holds. Without labels
the evidence is 0 and everything is kept. Rows that repeat are scored one by one. An empty table gives an empty result.

Scale: one pass over the texts; what is aggregated is two sums and a count for each (host, path), pre-aggregated,
joined back by an AQE-split join. Model and sample are bounded; the lexicon holds at most ``lexicon_words`` words.
"""

from __future__ import annotations

import math
import string
from bisect import bisect_right
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

#: Bucket borders of each statistic.
BORDERS = {
    "words": (1, 5, 20),
    "upper": (0.02, 0.04, 0.08, 0.2, 0.4),
    "signs": (0.005, 0.02, 0.05, 0.1, 0.2),
    "repeats": (0.03, 0.1, 0.2, 0.3, 0.5),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6),
    "length": (3.0, 4.0, 5.0, 7.0, 8.5, 10.0),
}
#: Bucket borders of the number of lexicon words in a stretch.
HIT_BORDERS = (1, 2, 3, 4, 5, 6, 9, 13)
#: Words in a stretch. Long texts are measured stretch by stretch, all of them, so that a statistic doesn't depend on the length.
STRETCH = 400
_UPPER = string.ascii_uppercase.encode()
_SIGNS = b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"
_STRIP = string.punctuation.encode()


def stretches(words: list[bytes]) -> list[list[bytes]]:
    """The words in stretches of equal length, the last of which overlaps the one before where it has to; a shorter text is one."""
    n = len(words)
    if n <= STRETCH:
        return [words]
    return [words[i : i + STRETCH] for i in range(0, n - STRETCH + 1, STRETCH)] + ([words[n - STRETCH :]] if n % STRETCH else [])


def statistics(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    n, size = len(words), max(1, len(raw))
    upper, signs = (size - len(raw.translate(None, x)) if raw else 0 for x in (_UPPER, _SIGNS))
    parts = stretches(words)
    distinct = sum(len(set(p)) for p in parts) / max(1, len(parts) * len(parts[0]))
    return (n, upper / size, signs / size, sum(map(eq, words, words[1:])) / max(1, n), distinct, len(raw) / max(1, n))


def buckets(stats: tuple[float, ...]) -> list[int]:
    return [int(np.searchsorted(b, v, "right")) for b, v in zip(BORDERS.values(), stats, strict=True)]


def plain_words(words: list[bytes]) -> list[bytes]:
    return [w.lower().strip(_STRIP) for w in words]


def lexicon_hits(words: list[bytes], lexicon: frozenset[bytes]) -> int:
    """The bucket of how many distinct words of the lexicon that stretch of a text holds that has most of them."""
    hits = len(lexicon.intersection(plain_words(list(set(words)))))
    if hits > 1 and len(words) > STRETCH:
        hits = max(len(lexicon.intersection(plain_words(list(set(p))))) for p in stretches(words))
    return bisect_right(HIT_BORDERS, hits)


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(id, text, junk, toxic, half) of the labelled documents with the smallest hashes; at most train_rows labels, so the join can broadcast them."""
    own = labels.select("id", (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("junk"), (F.coalesce("toxic", F.lit(0)) == 1).cast("int").alias("toxic"))
    own = own.where("id is not null").groupBy("id").agg(F.max("junk").alias("junk"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    return docs.select("id", "text").join(F.broadcast(own), "id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int, lexicon_words: int, min_contexts: int, min_surprise: float) -> dict:
    """The bounded model: log likelihood ratios by statistic and bucket, by lexicon word, and the rates."""
    sample = written(_sample(docs, labels, train_rows), "sample")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for text, junk in zip(batch.column("text").to_pylist(), batch.column("junk").to_pylist(), strict=True):
                raw = (text or "").encode()
                for f, b in enumerate(buckets(statistics(raw, raw.split()))):
                    out[f, b, junk] = out.get((f, b, junk), 0) + 1
            if out:
                cols = zip(*((*k, v) for k, v in out.items()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["f", "b", "junk", "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, word before it) of toxic documents, and of each word how many toxic and other documents hold it, by half of the sample."""
        types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            # A few documents at a time: what they have is small, and Spark adds it up before it shuffles.
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                near: set[tuple[int, bytes, bytes]] = set()
                held: dict[tuple[int, int], dict[bytes, int]] = {(h, x): {} for h in (0, 1) for x in (0, 1)}
                for text, toxic, half in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                    ws = plain_words((text or "").encode().split())
                    if toxic:
                        near |= {(half, w, b) for w, b in zip(ws, [b"", *ws], strict=False)}
                    own = held[half, toxic]
                    for w in set(ws):
                        own[w] = own.get(w, 0) + 1
                rows = [(h, w, b, 0, 0) for h, w, b in near] + [(h, w, None, 0, n) if x else (h, w, None, n, 0) for (h, x), own in held.items() for w, n in own.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["half", "w", "before", "clean", "bad"])

    totals = sample.agg(F.count("*"), F.sum("junk"), F.sum("toxic")).first()
    n, junk, toxic = totals[0], totals[1] or 0, totals[2] or 0

    def told(bad: int, good: int, all_bad: int) -> float:
        """Log likelihood ratio of what so many bad and good rows have. One row more, split as the classes are: what nobody has tells nothing."""
        share = all_bad / n
        return math.log((bad + share) / share) - math.log((good + 1 - share) / (1 - share))

    counts = {}
    for r in sample.mapInArrow(shape, "f int, b int, junk int, n int").groupBy("f", "b", "junk").agg(F.sum("n").alias("n")).collect():
        counts[r["f"], r["b"], r["junk"]] = r["n"]
    shapes = []
    for f, borders in enumerate(BORDERS.values()):
        k = len(borders) + 1
        shapes.append([told(counts.get((f, b, 1), 0), counts.get((f, b, 0), 0), junk) for b in range(k)] if junk and junk < n else [0.0] * k)
    lexicon: frozenset[bytes] = frozenset()
    hits = [0.0] * (len(HIT_BORDERS) + 1)
    if toxic and toxic < n:
        halves = {r["half"]: (r["n"], r["toxic"]) for r in sample.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
        of = lambda c, h: F.when(F.col("half") == h, F.col(c))
        found = sample.mapInArrow(words, "half int, w binary, before binary, clean long, bad long").groupBy("w").agg(
            *(F.count_distinct(of("before", h)).cast("double").alias(f"contexts{h}") for h in (0, 1)),
            F.count_distinct("before").cast("double").alias("contexts"),
            *(F.coalesce(F.sum(of(c, h)), F.lit(0)).alias(f"{c}{h}") for c in ("clean", "bad") for h in (0, 1)),
        )
        found = written(found.where((F.octet_length("w") > 0) & (F.least("contexts", F.col("bad0") + F.col("bad1")) >= min_contexts / 2)), "words")

        def most_telling(contexts: str, bad, clean, rows: int, bad_rows: int, share: float) -> frozenset[bytes]:
            """Words that are telling in so many rows; what is asked of a word goes with its share of the sample."""
            x = found.select("w", F.least(F.col(contexts), bad).alias("k"), clean.alias("clean")).where(F.col("k") >= max(2.0, min_contexts * share))
            by_chance = (F.col("k") + F.col("clean")) * bad_rows / rows
            ratio = F.log((F.col("k") + 0.5) / (bad_rows + 1)) - F.log((F.col("clean") + 0.5) / (rows - bad_rows + 1))
            x = x.withColumn("surprise", F.col("k") * F.log(F.col("k") / by_chance) - F.col("k") + by_chance)
            return frozenset(bytes(r["w"]) for r in x.where((F.col("surprise") >= min_surprise * share) & (ratio > 1.5)).orderBy(F.desc("surprise"), "w").limit(lexicon_words).collect())

        lexicon = most_telling("contexts", F.col("bad0") + F.col("bad1"), F.col("clean0") + F.col("clean1"), n, toxic, 1.0)
        other = {1 - h: most_telling(f"contexts{h}", F.col(f"bad{h}"), F.col(f"clean{h}"), *halves[h], 0.5) if h in halves and halves[h][1] else frozenset() for h in (0, 1)}

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = [lexicon_hits((t or "").encode().split(), other[h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(k, pa.int32())], ["toxic", "k"])

        # How much a number of hits tells is counted in each half by the other half's words.
        seen = {(r["toxic"], r["k"]): r["count"] for r in sample.mapInArrow(held, "toxic int, k int").groupBy("toxic", "k").count().collect()}
        hits = [told(seen.get((1, k), 0), seen.get((0, k), 0), toxic) for k in range(len(hits))]
        # More hits never tell less.
        for k in range(1, len(hits)):
            hits[k] = max(hits[k], hits[k - 1])
    smooth = lambda k: (k + 0.5) / (n + 1)
    return {"shapes": shapes, "lexicon": lexicon, "hits": hits, "junk": smooth(junk), "toxic": smooth(toxic), "rows": n}


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns but text, with junk and toxic: the log likelihood ratios of each document."""
    lexicon, shapes, hits = model["lexicon"], model["shapes"], model["hits"]
    kept = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            junk, toxic = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                ws = raw.split()
                junk.append(sum(s[b] for s, b in zip(shapes, buckets(statistics(raw, ws)), strict=True)))
                toxic.append(hits[lexicon_hits(ws, lexicon)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(junk, pa.float64()), pa.array(toxic, pa.float64())], [*kept, "junk", "toxic"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.mapInArrow(score, f"{schema}, junk double, toxic double")


def _chance(ratio, rate):
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), ratio + F.log(rate / (1 - rate))))))


def _strength(rates: DataFrame, head: str, rate: float) -> float:
    """Prior strength of the global rate, by moments: how many documents it counts for, from how far hosts' rates spread beyond chance."""
    r = rates.where("n >= 2").agg(F.sum((F.col(head) / F.col("n") - rate) ** 2 * F.col("n")).alias("v"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r["n"] or r["k"] < 2:
        return 50.0
    between = r["v"] / r["n"] - rate * (1 - rate) * r["k"] / r["n"]
    return float(min(1000.0, max(5.0, rate * (1 - rate) / between - 1 if between > 1e-9 else 1000.0)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", train_rows: int = 20_000, lexicon_words: int = 2_000, min_contexts: int = 5, min_surprise: float = 8.0, reject: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, host, path, p_junk, p_toxic, keep, and the columns of docs named by `carry`) for each row of docs; labels has id_col, quality and toxic."""
    ship_package(docs.sparkSession)
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), *carry)
    model = fit(x, labels.withColumnRenamed(id_col, "id"), train_rows, lexicon_words, min_contexts, min_surprise)
    if not model["rows"]:
        return x.select(F.col("id").alias(id_col), "host", "path", F.lit(0.5).alias("p_junk"), F.lit(0.5).alias("p_toxic"), F.lit(True).alias("keep"), *carry)
    heads = ("junk", "toxic")
    scored = evidence(x, model)
    for h in heads:
        scored = scored.withColumn(f"c_{h}", _chance(F.col(h), F.lit(model[h])))
    scored = written(scored, "evidence")
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"c_{h}").alias(h) for h in heads)), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in heads))
    strength = {h: _strength(hosts, h, model[h]) for h in heads}
    rates = paths.select("host", "path", F.col("n").alias("pn"), *(F.col(h).alias(f"p_{h}") for h in heads)).join(hosts.select("host", F.col("n").alias("hn"), *(F.col(h).alias(f"h_{h}") for h in heads)), "host")
    # A table, so that AQE can broadcast it or split a hot host.
    out = scored.join(written(rates, "rates"), ["host", "path"])
    for h in heads:
        m, own = strength[h], F.col(f"c_{h}")
        host = (m * model[h] + F.col(f"h_{h}") - own) / (m + F.col("hn") - 1)
        path = (m * host + F.col(f"p_{h}") - own) / (m + F.col("pn") - 1)
        out = out.withColumn(f"p_{h}", F.round(_chance(F.col(h), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))), 4))
    bad = 1 - (1 - F.col("p_junk")) * (1 - F.col("p_toxic"))
    return out.select(F.col("id").alias(id_col), "host", "path", "p_junk", "p_toxic", (bad < reject).alias("keep"), *carry)
