"""Media columns by content-defined payload chunking.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the 8-bit samples of a mono WAV (44 bytes of header,
one sample a byte, lossless). A rolling gear hash cuts the payload into chunks. A first pass lists every document's
chunk digests; a grouped count finds digests that occur again. A second pass writes the media table: each
row holds its ordered chunk list and, inline, the chunks that no other place holds; chunks that may be shared
go to the chunk table, once for each digest. Reading back, rows without shared chunks are rebuilt where they lie;
the others, once for each distinct medium, join the chunk table by digest and are put together in list order. Every
rebuilt payload is verified by its digest before its features are computed, so a wrong or missing chunk is an error.

Edge cases: a null or empty text is 64 zero bytes. Rows that repeat, or share a text, get equal values. A null id
stays null. An empty table gives an empty result. A text of any length is chunked whole.

Scale: which digests are shared reaches the writer as a Bloom filter of at most ``max_bits`` bits, whatever the corpus;
beyond its capacity more chunks take the chunk table's way, which is exact for all. Payloads are shuffled only for
those chunks: once to keep one copy, once to rebuild each distinct medium that refers to them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bloom import bloom_bits, bloom_hit
from .common import written

GEAR = np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], np.uint32)
LEAST, MOST, CUT_BITS = 512, 8192, 11
ENTRY = np.dtype([("digest", "S16"), ("size", "<u4"), ("inline", "u1")])
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def wav_header(n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n)


def chunks_of(payload: bytes) -> list[bytes]:
    """Cuts after bytes at which the top bits of the gear hash of the last 32 bytes are 0, within the least and most sizes."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint32(k)
    cuts = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, at, n = [], 0, len(payload)
    while at < n:
        i = int(np.searchsorted(cuts, at + LEAST))
        to = min(int(cuts[i]) if i < len(cuts) else n, at + MOST, n)
        out.append(payload[at:to])
        at = to
    return out


def digest_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def describe(payload: bytes, header: bytes) -> tuple[int, str, int, int, str, str]:
    """The values of FEATURES, from the stored bytes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x >= 128
    feature = f"sum={x.sum()};energy={(x * x).sum()};peak={x.max()};crossings={int((above[1:] != above[:-1]).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(header) + len(payload), hashlib.sha256(header + payload).hexdigest(), feature


def _described(rows: list[tuple], lead: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    fields = [*lead, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(a, b): the digest of every chunk of every document, as two longs."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_of(c) for t in batch.column("text").to_pylist() for c in chunks_of(payload_of(t)[0])]
            a, b = _halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return docs.select("text").mapInArrow(lists, "a long, b long")


def store_media(docs: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Writes and returns the media table (id, medium, n_bytes, header, chunks, inline) and the chunk table (digest, bytes)."""
    spark = docs.sparkSession
    again = written(chunk_lists(docs).groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "shared")
    shared = spark.sparkContext.broadcast(bloom_bits(again, max_bits))

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    chunks = chunks_of(payload)
                    names = [digest_of(c) for c in chunks]
                    out = bloom_hit(shared.value, *_halves(names))
                    entries = np.zeros(len(chunks), ENTRY)
                    entries["digest"], entries["size"], entries["inline"] = names, [len(c) for c in chunks], ~out
                    rows.append((doc, digest_of(payload), n, wav_header(len(payload)), entries.tobytes(), b"".join(c for c, o in zip(chunks, out.tolist(), strict=True) if not o), bool(out.any())))
                types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "medium", "n_bytes", "header", "chunks", "inline", "refers"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found: dict[bytes, bytes] = {}
                for text in batch.slice(at, 1000).column("text").to_pylist():
                    chunks = chunks_of(payload_of(text)[0])
                    names = [digest_of(c) for c in chunks]
                    found |= {d: c for d, c, o in zip(names, chunks, bloom_hit(shared.value, *_halves(names)).tolist(), strict=True) if o}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "bytes"])

    table = written(docs.mapInArrow(media, "id long, medium binary, n_bytes long, header binary, chunks binary, inline binary, refers boolean"), "media")
    chunks = written(docs.select("text").mapInArrow(common, "digest binary, bytes binary").dropDuplicates(["digest"]), "chunks")
    return table, chunks


def _rebuild(medium: bytes, chunks: bytes, inline: bytes, found: dict[bytes, bytes]) -> bytes:
    parts, at = [], 0
    for i in range(0, len(chunks), ENTRY.itemsize):
        size, own = int.from_bytes(chunks[i + 16 : i + 20], "little"), chunks[i + 20]
        parts.append(inline[at : at + size] if own else found[chunks[i : i + 16]])
        at += size if own else 0
    payload = b"".join(parts)
    if digest_of(payload) != medium:
        raise ValueError("a stored medium differs from what was written")
    return payload


def read_media(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, n_bytes, FEATURES) of every row, from the stored bytes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *describe(_rebuild(m, c, x, {}), h)) for i, n, m, h, c, x in zip(*(batch.column(k).to_pylist() for k in ("id", "n_bytes", "medium", "header", "chunks", "inline")), strict=True)]
            yield _described(rows, [("id", pa.int64()), ("n_bytes", pa.int64())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m, h, c, x, found in zip(*(batch.column(k).to_pylist() for k in ("medium", "header", "chunks", "inline", "found")), strict=True):
                rows.append((m, *describe(_rebuild(m, c, x, {f["digest"]: f["bytes"] for f in found or []}), h)))
            yield _described(rows, [("medium", pa.binary())])

    own = table.where(~F.col("refers")).mapInArrow(whole, f"id long, n_bytes long, {FEATURES}")
    refers = table.where("refers")
    # One row for each distinct medium: its inline parts are the same wherever it occurs.
    distinct = refers.select("medium", "header", "chunks", "inline").dropDuplicates(["medium"])
    width = ENTRY.itemsize
    starts = F.sequence(F.lit(0), (F.octet_length("chunks") / width).cast("int") - 1)
    entry = F.substring(F.col("chunks"), F.col("k") * width + 1, F.lit(width))
    asked = distinct.select("medium", "chunks", F.explode(starts).alias("k")).select("medium", entry.alias("e"))
    asked = asked.where(F.substring("e", width, 1) == F.lit(b"\0")).select("medium", F.substring("e", 1, 16).alias("digest")).distinct()
    found = asked.join(chunks, "digest").groupBy("medium").agg(F.collect_list(F.struct("digest", "bytes")).alias("found"))
    values = distinct.join(found, "medium", "left").mapInArrow(joined, f"medium binary, {FEATURES}")
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return own.unionByName(refers.select("id", "n_bytes", "medium").join(values, "medium").select("id", "n_bytes", *names))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 25) -> DataFrame:
    """Stores every text as a medium, reads it back: id_col, n_bytes and FEATURES for each row."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read_media(*store_media(docs, max_bits)).withColumnRenamed("id", id_col)
