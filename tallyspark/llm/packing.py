"""Best-fit packing by hierarchical residual packing.

Texts become ids by a byte-level BPE, each closed by an end id; documents over ``max_tokens`` are cut into pieces of
that length, the first of which may be shorter. Every partition packs its own pieces best-fit, longest first, and
emits its nearly full bins. What is underfull goes up a tree: bins are items of the next round, in which fewer
partitions pack them best-fit again; the last round emits the rest. A round that closes under 1 % of its bins is the
last one, as then the rest doesn't fit together (say, every document takes over half a sequence).

Edge cases: a null or empty text is one piece, its end id. Rows that share an id are packed as documents of their
own. A null id stays null. Ids must be integers. An empty table gives an empty result. Long texts are encoded whole.

Scale: texts are read once and never shuffled. What moves is 37 bytes for each piece of an underfull bin. A task
holds at most ``block`` items at a time, at any size of the input, and nothing is collected. Every round is a table in
the shared folder, so a lost executor costs tasks, not rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

MEMBER = np.dtype([("id", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i8")])
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every piece of every document."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_ids import encoder

        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, out = part.column(0).to_pylist(), []
                for doc, raw in zip(ids, enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    start, cut = 0, (n - 1) % max_tokens + 1
                    k = 0
                    while start < n:
                        out.append((doc, k, start, cut - start, zlib.crc32(raw[4 * start : 4 * cut])))
                        start, cut, k = cut, cut + max_tokens, k + 1
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit, longest first: for each bin the indexes of its items, in the order in which they were laid."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = open_rooms >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins


def _packer(capacity: int, near: int, block: int, rnd: int, last: bool, first: bool):
    """mapInPandas function of one round: packs its items; bins with room for `near` or less, or all in the last round, get a sequence id."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (rnd << 56) + (TaskContext.get().partitionId() << 32)
        made = 0

        def close(members: list[bytes], used: list[int]) -> pd.DataFrame:
            nonlocal made
            out = []
            for b in best_fit(used, capacity):
                parts, at = [], 0
                for i in b:
                    m = np.frombuffer(members[i], MEMBER).copy()
                    m["offset"] += at
                    parts.append(m.tobytes())
                    at += used[i]
                full = last or capacity - at <= near
                out.append((base + made if full else None, at, b"".join(parts)))
                made += full
            return pd.DataFrame({"sequence_id": pd.array([x[0] for x in out], "Int64"), "used": [x[1] for x in out], "members": [x[2] for x in out]})

        members: list[bytes] = []
        used: list[int] = []
        for x in batches:
            if first:
                m = np.zeros(len(x), MEMBER)
                m["id"], m["known"] = x["id"].fillna(0), x["id"].notna()
                m["piece"], m["start"], m["length"], m["crc"] = x["piece"], x["start"], x["length"], x["ids_crc32"]
                raw, w = m.tobytes(), MEMBER.itemsize
                members += [raw[i * w : (i + 1) * w] for i in range(len(x))]
                used += x["length"].tolist()
            else:
                members += x["members"].tolist()
                used += x["used"].tolist()
            while len(used) >= block:
                yield close(members[:block], used[:block])
                del members[:block], used[:block]
        if used:
            yield close(members, used)

    return pack


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        m = np.frombuffer(b"".join(x["members"]), MEMBER)
        n = [len(b) // MEMBER.itemsize for b in x["members"]]
        ids = pd.array(m["id"].astype(np.int64), "Int64")
        ids[m["known"] == 0] = pd.NA
        yield pd.DataFrame({"id": ids, "piece": m["piece"].astype(np.int32), "start": m["start"].astype(np.int64), "length": m["length"].astype(np.int64), "ids_crc32": m["crc"].astype(np.int64), "sequence_id": np.repeat(x["sequence_id"].to_numpy(np.int64), n), "offset": m["offset"].astype(np.int64)})


def pack_pieces(pieces: DataFrame, capacity: int = 2048, near: int = 8, block: int = 50_000) -> DataFrame:
    """pieces (columns of PIECES) with sequence_id and offset: no sequence over capacity, its pieces gapless from 0."""
    spark = pieces.sparkSession
    ship_package(spark)
    schema = "sequence_id long, used int, members binary"
    done: list[DataFrame] = []
    items, rnd, first, n = written(pieces, "pieces"), 0, True, -1
    while True:
        last = not first and (n <= block or rnd > 60 or not done or stuck)
        out = written(items.mapInPandas(_packer(capacity, near, block, rnd, last, first), schema), f"bins{rnd}")
        done.append(out.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left = out.where(F.col("sequence_id").isNull())
        before, n = n, left.count()
        if not n:
            break
        stuck = before >= 0 and n > 0.99 * before
        items, rnd, first = left.repartition(max(1, -(-n // block))), rnd + 1, False
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.mapInPandas(_unpacked, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack_pieces(token_pieces(docs, vocabulary, id_col, text_col, max_tokens, end_id), max_tokens)
    return packed.withColumnRenamed("id", id_col)
