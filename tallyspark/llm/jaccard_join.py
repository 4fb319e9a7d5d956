"""N-gram Jaccard join by a token-group matrix; exact.

A document's set holds its distinct word shingles; two documents link when 100 * |A & B| >= threshold * |A | B|.
Tokens get a global order, rare ones first, by how many documents hold them. As a document shares at least
threshold % of its set with whatever it links to, the tokens that no other document holds may fill its prefix
(the first size - need + 1 tokens); it then links to nothing and goes no further. The rest runs in two steps:

1. Groups. Equal sets are one class. Classes that share a prefix token are measured against that one of them which
   has fewest rarer tokens, as it is the nearest to all; links make groups, so a family of near copies costs one
   comparison each, not all pairs.
2. Token-group matrix. Each group, in chunks of members with about ``chunk_bytes`` of tokens, stores its token union and
   meets its queries in chunks of 8 * ``chunk_bytes``. A class is
   a query to the groups of other components that share a prefix token and have members of a fitting size. Where two
   linked sets first meet in the global order, both have as many tokens left as the link needs, so a token at which
   either has fewer left asks nothing. Where
   |query & union| is under what any link needs, the group stays shut; only qualifying groups are opened and measured.

Components are those of all links: a pair that either step skips is in one component already, or can't link.

Edge cases: with fewer than ``shingle`` words the whole sequence is the one shingle; without words, or with null
text, the set is empty and links to nothing. Rows that share an id are one document to links; each keeps its own
n_shingles. A null id links to nothing and has a null component. An empty table gives an empty result.

Scale: texts move once, to batches sized by input. Token counts travel as sorted, delta-coded 48-bit arrays that a
batch has pre-aggregated, about 4 bytes a token, to buckets that grow with input; two tokens that share those bits only
weaken the pruning. There are as many batches, buckets and shuffle partitions as the input has ``batch_bytes``. Everything after
that handles only documents of which most tokens are shared. Hot tokens are joined
as (token, least class) rows, hot groups are cut in chunks, chunks are dealt to tasks of about ``task_bytes`` of tokens, so that
neither many nor long sets fill one, and nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import ship_package
from .common import batches_for, dealing_key, written
from .words import gram_hashes, word_hashes

DROPPED_BITS = 16


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()  # on bytes, lower() changes A-Z only
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def need(size: int, threshold: int) -> int:
    """How much of a set of this size any link shares with it, at least."""
    return -(-threshold * size // 100)


def _pack(sorted_tokens: np.ndarray, counts: np.ndarray) -> bytes:
    deltas = np.diff(sorted_tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6]
    return zstandard.ZstdCompressor(1).compress(np.array([len(counts)], "<u4").tobytes() + deltas.T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _planes(raw: bytes, n: int, width: int, at: int, to: int) -> np.ndarray:
    out = np.zeros((n, to), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(f"<u{to}").ravel()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    return np.cumsum(_planes(raw, n, 6, 4, 8), dtype=np.uint64), _planes(raw, n, 4, 4 + 6 * n, 4)


def token_profiles(docs: DataFrame, shingle: int, threshold: int, batch_bytes: int) -> DataFrame:
    """(id, n, a, b, prefix, tokens): size and 128-bit digest of each set; where the document may have a partner, its prefix tokens that others hold, and all tokens that others hold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches_for(size, batch_bytes)
    dealt = docs.withColumn("batch", F.pmod(dealing_key(), F.lit(batches)).cast("int")).repartition(batches, "batch")
    edges = np.array([(i << (64 - DROPPED_BITS)) // batches for i in range(batches + 1)], np.uint64)

    def sets(x: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        own = [shingle_set(t, shingle) for t in x["text"]]
        counted = [s for s, known in zip(own, x["id"].notna(), strict=True) if known]
        tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *counted]) >> np.uint64(DROPPED_BITS), return_counts=True)
        return own, tokens, counts

    def send(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        _, tokens, counts = sets(x)
        at = np.searchsorted(tokens, edges)
        return pd.DataFrame([(key[0], i, _pack(tokens[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a], columns=["batch", "bucket", "data"])

    def count(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d) for d in x["data"]]
        tokens = np.concatenate([t for t, _ in parts])
        order = np.argsort(tokens, kind="stable")
        new = np.diff(tokens[order], prepend=np.uint64(2**63)) != 0
        group = np.cumsum(new) - 1
        total = np.zeros(len(tokens), np.uint32)
        total[order] = np.minimum(np.bincount(group, np.concatenate([c for _, c in parts])[order])[group], 2**32 - 1).astype(np.uint32)
        cuts = np.cumsum([len(t) for t, _ in parts])[:-1]
        return pd.DataFrame({"batch": x["batch"], "bucket": key[0], "data": [zstandard.ZstdCompressor(1).compress(t.view(np.uint8).reshape(-1, 4).T.tobytes()) for t in np.split(total, cuts)]})

    def profile(_: tuple, x: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        own, tokens, _ = sets(x)
        held = np.zeros(0, np.uint32)
        if len(back):
            raws = [zstandard.ZstdDecompressor().decompress(d) for d in back.sort_values("bucket")["data"]]
            held = np.concatenate([_planes(r, len(r) // 4, 4, 0, 4) for r in raws])
        out = []
        for s, known in zip(own, x["id"].notna(), strict=True):
            n, digest = len(s), xxhash.xxh3_128_digest(s.tobytes())
            a, b = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
            prefix = rest = None
            if known and n:
                df = held[np.searchsorted(tokens, s >> np.uint64(DROPPED_BITS))]
                shared, length = s[df > 1], n - need(n, threshold) + 1
                if n - len(shared) < length:
                    prefix = shared[np.lexsort((shared, df[df > 1]))][: length - (n - len(shared))].view(np.int64)
                    rest = shared.tobytes()
            out.append((n, a, b, prefix, rest))
        n, a, b, prefix, rest = zip(*out, strict=True)
        return pd.DataFrame({"id": x["id"], "n": n, "a": a, "b": b, "prefix": list(prefix), "tokens": list(rest)})

    sent = dealt.groupBy("batch").applyInPandas(send, "batch int, bucket int, data binary")
    back = sent.repartition(batches, "bucket").groupBy("bucket").applyInPandas(count, "batch int, bucket int, data binary")
    return dealt.groupBy("batch").cogroup(back.repartition(batches, "batch").groupBy("batch")).applyInPandas(profile, "id long, n long, a long, b long, prefix array<long>, tokens binary")


def open_groups(queries: DataFrame, members: DataFrame, threshold: int, shards: int) -> DataFrame:
    """Links (a, b) between queries (g, q, n, tokens) and members (g, q, n, tokens) of the same group g; for each query and group one link at most, as more join nothing else."""

    def measure(_: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        groups = {g: (m["q"].tolist(), m["n"].tolist(), [np.frombuffer(t, np.uint64) for t in m["tokens"]]) for g, m in held.groupby("g")}
        links = []
        for g, rows in asked.groupby("g"):
            if g not in groups:
                continue
            ids, sizes, sets = groups[g]
            union = np.unique(np.concatenate(sets))
            for q, n, raw in zip(rows["q"].tolist(), rows["n"].tolist(), rows["tokens"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                bound = s[union[at] == s]
                if len(bound) < need(n, threshold):
                    continue
                for m, k, t in zip(ids, sizes, sets, strict=True):
                    if 100 * min(n, k) < threshold * max(n, k):
                        continue
                    at = np.minimum(np.searchsorted(t, bound), len(t) - 1)
                    i = int((t[at] == bound).sum())
                    if 100 * i >= threshold * (n + k - i):
                        links.append((q, m))
                        break
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    dealt = lambda x: x.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard")
    return dealt(queries).cogroup(dealt(members)).applyInPandas(measure, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 75, chunk_bytes: int = 1 << 20, task_bytes: int = 16 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of docs; component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = written(token_profiles(docs, shingle, threshold, batch_bytes), "profiles")
    able = every.where(F.col("prefix").isNotNull())
    class_of = written(able.groupBy("a", "b").agg(F.min("id").alias("q")), "classes")
    classes = written(able.join(class_of.select(F.col("q").alias("id"), "a", "b"), ["id", "a", "b"], "left_semi").dropDuplicates(["id", "a", "b"]).select(F.col("id").alias("q"), "n", "prefix", "tokens"), "sets")
    # left: how many tokens that others hold a class has from t on. A pair's first common token leaves both enough for a link.
    tokens = classes.select("q", "n", (F.octet_length("tokens") / 8).cast("long").alias("shared"), F.posexplode("prefix").alias("k", "t")).select("q", "n", "t", (F.col("shared") - F.col("k")).alias("left"))
    tokens = tokens.withColumn("slack", (100 + threshold) * F.col("left") - threshold * F.col("n")).withColumn("before", F.col("n") - F.col("left"))
    fits = lambda x, y: 100 * F.least(x, y) >= threshold * F.greatest(x, y)

    sizes = classes.select("q", F.octet_length("tokens").cast("long").alias("bytes"))
    chunks = lambda size, of: F.greatest(F.lit(1), F.ceil(F.col(size) / of)).cast("long")

    def opened(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """pairs (g, q), members (g, q): their links."""
        pairs, members = written(pairs, f"{name}-pairs"), written(members, f"{name}-members")
        size = sum(x.join(sizes, "q").agg(F.sum("bytes")).first()[0] or 0 for x in (pairs, members))
        asked, held = (x.join(classes.select("q", "n", "tokens"), "q").select(*(F.col(c).alias(c) for c in ("g", "q", "n", "tokens"))) for x in (pairs, members))
        return written(open_groups(asked, held, threshold, max(1, -(-size // task_bytes))), f"{name}-links")

    # 1: of each token's classes the one that has fewest tokens before it; the smallest of equals
    first = tokens.groupBy("t").agg(F.min(F.struct("before", "q", "n")).alias("first"), F.count("*").alias("k")).where("k > 1").select("t", F.col("first.q").alias("m"), F.col("first.n").alias("mn"))
    star = written(tokens.join(first, "t").where((F.col("q") != F.col("m")) & fits(F.col("n"), F.col("mn"))).select("m", "q").distinct(), "star")
    star = star.join(star.join(sizes, "q").groupBy("m").agg(F.sum("bytes").alias("size")), "m").withColumn("g", F.struct("m", F.pmod(F.xxhash64("q"), chunks("size", 8 * chunk_bytes)).alias("part")))
    g = lambda a, b: F.concat_ws(":", a, b).alias("g")
    star = star.select("m", "q", g(F.col("g.m"), F.col("g.part")))
    links = opened(star.select("g", "q"), star.select("g", F.col("m").alias("q")).distinct(), "star")
    group_of = connected_components(links)

    # 2: other components' groups
    grouped = tokens.join(group_of, tokens["q"] == group_of["node"], "left").select("t", "q", "n", "slack", F.coalesce("component", "q").alias("c"))
    grouped = written(grouped, "grouped")
    matrix = grouped.groupBy("t", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("slack").alias("most"))
    several = matrix.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
    matrix = matrix.join(several, "t").select("t", F.col("c").alias("to"), "lo", "hi", "most")
    asked = grouped.join(several, "t", "left_semi").join(matrix, "t").where((F.col("to") < F.col("c")) & (100 * F.col("hi") >= threshold * F.col("n")) & (threshold * F.col("lo") <= 100 * F.col("n")) & (F.col("most") >= threshold * F.col("n")) & (F.col("slack") >= threshold * F.col("lo"))).select("to", "q").distinct()
    asked = written(asked, "asked")
    members = classes.select("q").join(group_of, classes["q"] == group_of["node"], "left").select("q", F.coalesce("component", "q").alias("to")).join(asked.select("to").distinct(), "to", "left_semi")
    # Cells of the matrix: chunks of a group's members by chunks of its queries, so that neither is bound to one task.
    held_bytes, asked_bytes = (x.join(sizes, "q").groupBy("to").agg(F.sum("bytes").alias(name)) for x, name in ((members, "held"), (asked, "asking")))
    sized = written(held_bytes.join(asked_bytes, "to").select("to", chunks("held", chunk_bytes).alias("parts"), chunks("asking", 8 * chunk_bytes).alias("asks")), "sized")
    every_part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("q"), F.col(n))
    members = members.join(sized, "to").select("to", "q", mine("parts").alias("part"), every_part("asks").alias("ask")).select(F.concat_ws(":", "to", "part", "ask").alias("g"), "q")
    asked = asked.join(sized, "to").select("to", "q", every_part("parts").alias("part"), mine("asks").alias("ask")).select(F.concat_ws(":", "to", "part", "ask").alias("g"), "q")
    more = opened(asked, members, "matrix")
    reach = connected_components(links.union(more))

    named = class_of.join(reach, class_of["q"] == reach["node"], "left").select("a", "b", F.coalesce("component", "q").alias("c"))
    # Rows that share an id are one document: its component is the smallest of its rows'.
    linked = able.select("id", "a", "b").join(named, ["a", "b"]).groupBy("id").agg(F.min("c").alias("component_id"))
    return every.select("id", F.col("n").alias("n_shingles")).join(linked, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
