"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest-hashed gram of ``gram`` words
in it, very common grams last. Consecutive windows that share a minimiser travel as one packed string to the bucket of
that minimiser, where sorting finds for each distinct window the smallest id that holds it. Where all grams of a window are
very common, it is its own minimiser, so that no hot gram fills a bucket. A word goes if a window over
it also starts in a document with a smaller id; windows are judged on the input.

How it runs: documents are dealt to batches of about ``batch_bytes`` by a hash of their id. A batch sends each distinct
string once, with the smallest of its ids, so a passage that a third of the documents hold reaches its bucket once for
each batch. The bucket sends back, for the batch's string, the windows that some smaller id holds. The batch cuts
its documents into the same strings again and drops the words.

Edge cases: a null, empty or short text has no window and stays whole. A null id takes part in nothing: its words stay,
and it makes no other document lose any. Rows that share an id don't dedupe each other. An empty table gives an
empty result. Words are bytes between white space, unchanged; kept words are joined by one space.

Scale: texts are shuffled once by batch; the packed strings, about three times the text, are compressed for each batch
and bucket before they are shuffled. There are as many batches, buckets and shuffle partitions as the input has ``batch_bytes``,
so a task's memory doesn't grow. The list of
common grams holds those with over a 16th of a bucket's share of all grams, so it has at most 16 entries a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import batches_for, dealing_key
from .words import gram_hashes, measured, ordering_hashes


class Cutter:
    """Cuts a document's words into super-k-mers."""

    def __init__(self, window: int, gram: int, buckets: int, common: np.ndarray):
        self.window, self.gram, self.buckets, self.common = window, gram, buckets, common

    def cut(self, whole: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For each super-k-mer of a text's words: first window, number of windows, bucket, begin and end of its minimiser in its bytes; and those bytes."""
        n, span = len(start), self.window - self.gram + 1
        g = gram_hashes(ordering_hashes(whole, start, stop), self.gram)
        order = g >> np.uint64(1)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, g), len(self.common) - 1)
            order |= (self.common[at] == g).astype(np.uint64) << np.uint64(63)
        pos = np.lib.stride_tricks.sliding_window_view(order, span).argmin(axis=1) + np.arange(n - self.window + 1)
        alone = (order[pos] >> np.uint64(63)).astype(bool)
        first = np.flatnonzero((np.diff(pos, prepend=-1) != 0) | alone)
        count = np.diff(first, append=len(pos))
        begin, end, p, alone = start[first], stop[first + count + self.window - 2], pos[first], alone[first]
        key, a, b = g[p], start[p] - begin, stop[p + self.gram - 1] - begin
        if alone.any():
            key = np.where(alone, gram_hashes(g, span)[first], key)
            a, b = np.where(alone, 0, a), np.where(alone, end - begin, b)
        strings = [whole[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        return first, count, (key % np.uint64(self.buckets)).astype(np.int64), a, b, strings


class Batch:
    """The distinct strings of one batch of documents, numbered within their buckets, and where they occur."""

    def __init__(self, cutter: Cutter, ids: np.ndarray, texts: list[str | None]):
        numbers: dict[bytes, int] = {}
        least: list[int] = []
        bucket, begin, end, self.seen = [], [], [], []
        self.words = [measured(t) for t in texts]
        # By text where ids are equal: rows come in any order, and the numbers of strings must not depend on it.
        for k in sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] or "")):
            whole, start, stop = self.words[k]
            if len(start) < cutter.window:
                continue
            first, count, b, ga, gb, strings = cutter.cut(whole, start, stop)
            known = len(numbers)
            own = [numbers.setdefault(s, len(numbers)) for s in strings]
            # The first of each new string: numbers only rise where one is new.
            at = np.array(own)
            top = np.maximum.accumulate(np.append(known - 1, at))
            fresh = np.flatnonzero(at > top[:-1])
            least += [ids[k]] * len(fresh)
            bucket.append(b[fresh])
            begin.append(ga[fresh])
            end.append(gb[fresh])
            self.seen.append((k, first, count, at))
        self.strings = list(numbers)
        self.least = np.array(least, np.int64)
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        self.bucket, self.begin, self.end = cat(bucket), cat(begin), cat(end)
        self.order = np.argsort(self.bucket, kind="stable")
        self.names, at = np.unique(self.bucket[self.order], return_index=True)
        self.at = np.append(at, len(self.order))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, numbers of its strings)."""
        for i, b in enumerate(self.names.tolist()):
            yield b, self.order[self.at[i] : self.at[i + 1]]


def _packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.array([len(arrays[0])], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays) + tail)


def _unpacked(raw: bytes, *types: str) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += out[-1].nbytes
    return out, raw[at:]


def common_grams(docs: DataFrame, window: int, gram: int, batch_bytes: int) -> tuple[int, np.ndarray]:
    """(number of batches, sorted hashes of grams with over a 16th of a bucket's share), from every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, parts = 0, []
            col = batch.column(0)
            for i in range(batch.num_rows):
                whole, start, stop = measured(col[i].as_py())
                size += len(whole)
                if len(start) >= window:
                    parts.append(gram_hashes(ordering_hashes(whole, start, stop), gram))
                if (i + 1 == batch.num_rows or sum(map(len, parts)) > 1_000_000) and (parts or size):
                    g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                    often = n >= max(8, n.sum() >> 17)
                    h, c = g[often].view(np.int64), n[often]
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(h, 0)), pa.array(np.append(c, n.sum())), pa.array(np.append(np.zeros(len(h), np.int64), size))], ["h", "n", "bytes"])
                    size, parts = 0, []

    found = docs.select("text").mapInArrow(count, "h long, n long, bytes long").groupBy("h", (F.col("bytes") > 0).alias("total")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    found = found.persist()
    total = found.where("total").agg(F.sum("n"), F.sum("bytes")).first()
    grams, size = total[0] or 0, total[1] or 0
    batches = batches_for(size, batch_bytes)
    common = [r["h"] for r in found.where(~F.col("total") & (F.col("n") > grams / (16 * batches))).select("h").collect()]
    found.unpersist()
    return batches, np.sort(np.array(common, np.int64).view(np.uint64))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 3, batch_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, text, n_words, n_removed): the words that stay, joined by one space, and how many there were and went."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    batches, common = common_grams(docs, window, gram, batch_bytes)
    cutter = Cutter(window, gram, batches, common)
    dealt = docs.withColumn("batch", F.pmod(dealing_key(), F.lit(batches)).cast("int")).repartition(batches, "batch")

    def send(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x[x["id"].notna()]
        b = Batch(cutter, x["id"].to_numpy(np.int64), x["text"].tolist())
        out = []
        for bucket, own in b.parts():
            strings = [b.strings[j] for j in own.tolist()]
            sizes = np.fromiter(map(len, strings), "<u4", len(strings))
            out.append((key[0], bucket, _packed(b.least[own], b.begin[own].astype("<u4"), b.end[own].astype("<u4"), sizes, tail=b"".join(strings))))
        return pd.DataFrame(out, columns=["batch", "bucket", "data"])

    def judge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        held: dict[bytes, list[tuple[int, int, bytes, int, int]]] = {}
        for row, data in enumerate(x["data"]):
            (least, ga, gb, sizes), tail = _unpacked(data, "<i8", "<u4", "<u4", "<u4")
            at = 0
            for j, (d, a, b, n) in enumerate(zip(least.tolist(), ga.tolist(), gb.tolist(), sizes.tolist(), strict=True)):
                held.setdefault(tail[at + a : at + b], []).append((row, j, tail[at : at + n], d, a))
                at += n
        back: dict[int, list[tuple[int, int, int, int]]] = {}
        for strings in held.values():
            if len(strings) < 2:
                continue
            found = []
            for k, (_, _, s, d, _) in enumerate(strings):
                words = s.split(b" ")
                found += [(b" ".join(words[i : i + window]), d, k, i) for i in range(len(words) - window + 1)]
            found.sort()
            late: dict[int, list[tuple[int, int]]] = {}
            for _, same in groupby(found, key=lambda f: f[0]):
                low = None
                for _, d, k, i in same:
                    low = d if low is None else low
                    if d > low:
                        late.setdefault(k, []).append((i, low))
            for k, windows in late.items():
                row, j = strings[k][:2]
                windows.sort()
                for low, run in groupby(enumerate(windows), key=lambda e: (e[1][1], e[1][0] - e[0])):
                    run = list(run)
                    back.setdefault(row, []).append((j, run[0][1][0], len(run), low[0]))
        out = []
        for row, runs in back.items():
            runs.sort()
            j, i, n, low = (np.array(c, t) for c, t in zip(zip(*runs, strict=True), ("<u4", "<u4", "<u4", "<i8"), strict=True))
            out.append((x["batch"].iat[row], key[0], _packed(j, i, n, low)))
        return pd.DataFrame(out, columns=["batch", "bucket", "data"])

    def drop(_: tuple, x: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        known = x["id"].notna().to_numpy()
        rows = np.flatnonzero(known)
        ids, texts = x["id"].to_numpy()[known].astype(np.int64), x["text"].to_numpy()
        b = Batch(cutter, ids, texts[rows].tolist())
        numbers = dict(b.parts())
        more: dict[int, list[tuple[int, int, int]]] = {}
        for bucket, data in zip(runs["bucket"], runs["data"], strict=True):
            (j, i, n, low), _ = _unpacked(data, "<u4", "<u4", "<u4", "<i8")
            for own, *run in zip(numbers[bucket][j].tolist(), i.tolist(), n.tolist(), low.tolist(), strict=True):
                more.setdefault(own, []).append(tuple(run))
        known_more = np.zeros(len(b.least), bool)
        known_more[list(more)] = True
        gone: dict[int, list[tuple[int, int]]] = {}
        for k, first, count, own in b.seen:
            doc, late = ids[k], b.least[own] < ids[k]
            spans = [(f, f + c) for f, c in zip(first[late].tolist(), count[late].tolist(), strict=True)]
            for at in np.flatnonzero(known_more[own] & ~late).tolist():
                f = int(first[at])
                spans += [(f + i, f + i + n) for i, n, low in more[int(own[at])] if low < doc]
            if spans:
                gone[int(rows[k])] = spans
        out = []
        own = iter(b.words)
        for r in range(len(x)):
            whole, start, stop = next(own) if known[r] else measured(texts[r])
            kept, n = whole, len(start)
            if r in gone:
                stays = np.zeros(n + 2, bool)
                stays[1:-1] = True
                for f, e in gone[r]:
                    stays[f + 1 : e + window] = False
                edges = np.flatnonzero(stays[1:] != stays[:-1])
                kept = b" ".join([whole[i:j] for i, j in zip(start[edges[0::2]].tolist(), stop[edges[1::2] - 1].tolist(), strict=True)])
                n = int(stays.sum())
            out.append((kept.decode(), len(start), len(start) - n))
        text, n_words, n_removed = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"id": x["id"], "text": list(text), "n_words": np.array(n_words, np.int64), "n_removed": np.array(n_removed, np.int64)})

    sent = dealt.groupBy("batch").applyInPandas(send, "batch int, bucket int, data binary")
    runs = sent.repartition(batches, "bucket").groupBy("bucket").applyInPandas(judge, "batch int, bucket int, data binary")
    out = dealt.groupBy("batch").cogroup(runs.repartition(batches, "batch").groupBy("batch")).applyInPandas(drop, "id long, text string, n_words long, n_removed long")
    return out.withColumnRenamed("id", id_col)
