"""Scores of texts by an n-gram model held in a log-frequency Bloom filter.

Counts of n-grams are quantised: count c has level 1 + floor(log(c) / log(base)). The filter holds each n-gram once for each level up
to its own, so a count is read by asking for level 1, 2, ... until one isn't there. A Bloom filter never misses, so a level is never
read too low; ``BITS`` bits an entry let about 0.7 % of the next levels pass wrongly.

Probabilities are smoothed step by step from the shorter history (hierarchical Dirichlet): P(w) = (c(w) + 1) / (N + V + 1), and
P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu), with h' the history h without its first word. The numerator takes the least count
of a level, the denominator the largest, so the probabilities of all words after a history add up to at most one. A text begins with a start mark, which is
only history, and ends with an end mark, which is a token.

The base score is exact: counts of single tokens are kept in a table besides. The most frequent words (``resident_words`` at most) are broadcast,
the occurrences of others are joined.

Edge cases: a null text is empty, and is one token, the end. Lower case is that of A-Z. A row without an id is judged by the empty id's
hash, so it's for training. Repeated rows are texts of their own. Without training texts every token is unknown, N = V = 0 and all
scores are 0 at base 1 / 1. An empty table has an empty result. Columns other than id and text aren't looked at.

Scale: a task counts n-grams in bounded buffers and sends sorted, packed hashes, so a frequent n-gram is one entry for each buffer.
They meet in ``slots``, ranges of hashes for ``slot_bytes`` of text each. A slot counts exactly and writes its own blocks of the filter. The filter
grows with the corpus; what is broadcast doesn't: slots are taken together up to ``resident_bytes``, and where more are needed the texts are
read once for each such part, their levels so far (a byte for each n-gram) kept in a table. Which slots go together changes no score.
Words are hashes of 64 bits, other n-grams of 48.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import batches_for, written
from .words import gram_hashes, word_hashes

#: A block is so many 64-bit words; an entry has so many bits and probes in its block.
WORDS, BITS, PROBES = 512, 12, 4
#: Hashes of strings with white space, which no word has.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(mark)) for mark in (b"\r", b"\n"))
#: Buffered n-grams of a task before they are sent on.
BUFFER = 1 << 21
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFFFFFF0000)


def stretches(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, about `size` bytes of them at a time."""
    raw = (text or "").encode().lower()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].split()
        at = end


def token_hashes(text: str | None) -> np.ndarray:
    """Start, words and end."""
    return np.concatenate([[START], *[word_hashes(found) for found in stretches(text)], [END]]).astype(np.uint64)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """48-bit hashes of runs of n tokens; single tokens keep 64."""
    return h if n == 1 else gram_hashes(h, n) & _LOW


def _mixed(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (np.uint64(level) if isinstance(level, int) else level.astype(np.uint64)) * _B) * _A
        x ^= x >> np.uint64(31)
        x *= _B
        return x ^ (x >> np.uint64(30))


def _bits(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Places in a block, a row for each key."""
    x = _mixed(keys, level)
    return np.stack([(x >> np.uint64(15 * i)) & np.uint64(WORDS * 64 - 1) for i in range(PROBES)], axis=1)


def _block(keys: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """The block of a key among its slot's, by bits that don't choose the slot."""
    with np.errstate(over="ignore"):
        x = keys * _A
    return ((x >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32)


class Levels:
    """Quantised counts: the level of a count, and a level's least and largest count."""

    def __init__(self, base: float, most: int = 1 << 46):
        least = [1]
        while least[-1] < most:
            least.append(max(least[-1] + 1, math.ceil(base ** len(least))))
        self.first = np.array([0, *least], np.float64)
        self.last = np.array([0, *[x - 1 for x in least[1:]], most], np.float64)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, counts, "right") - 1


def slot_filter(keys: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """A slot's number of blocks, and their words."""
    blocks = max(1, -(-int(levels.sum()) * BITS // (WORDS * 64)))
    out = np.zeros(blocks * WORDS * 64, bool)
    where = _block(keys, blocks) * np.uint64(WORDS * 64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = levels >= level
        out[(_bits(keys[held], level) + where[held][:, None]).ravel().astype(np.int64)] = True
    return blocks, np.packbits(out, bitorder="little")


class Filter:
    """Some slots of the filter: for each the number of its blocks and where they begin, -1 for slots not held."""

    def __init__(self, slot_bits: int, blocks: dict[int, int]):
        self.slot_bits = slot_bits
        self.blocks, self.begin = np.zeros(1 << slot_bits, np.uint64), np.full(1 << slot_bits, -1, np.int64)
        slots = sorted(blocks)
        each = [blocks[k] for k in slots]
        self.blocks[slots], self.begin[slots] = each, np.cumsum([0, *each])[:-1]
        self.bits = np.zeros(sum(each) * WORDS * 8, np.uint8)

    def put(self, slot: int, bits: bytes) -> None:
        at = int(self.begin[slot]) * WORDS * 8
        self.bits[at : at + len(bits)] = np.frombuffer(bits, np.uint8)

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The level of each key, as int16; -1 for keys of slots not held."""
        slot = (keys >> np.uint64(64 - self.slot_bits)).astype(np.int64) if self.slot_bits else np.zeros(len(keys), np.int64)
        out = np.where(self.begin[slot] < 0, -1, 0).astype(np.int16)
        asking = np.flatnonzero(out == 0)
        base = (self.begin[slot[asking]] + _block(keys[asking], self.blocks[slot[asking]]).astype(np.int64)) * (WORDS * 64)
        for level in range(1, most + 1):
            at = _bits(keys[asking], level).astype(np.int64) + base[:, None]
            there = ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            asking, base = asking[there], base[there]
            if not len(asking):
                break
            out[asking] = level
        return out


def _slot_bits(size: int, slot_bytes: int) -> int:
    return max(3, math.ceil(math.log2(batches_for(size, slot_bytes))))


def _packed(docs: DataFrame, text_col: str, order: int, slot_bits: int) -> DataFrame:
    """(n, slot, keys, counts): what a buffer of a task has counted of n-grams of the slot, sorted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for n in range(1, order + 1):
                if not held[n - 1]:
                    continue
                keys, counts = np.unique(np.concatenate(held[n - 1]), return_counts=True)
                held[n - 1] = []
                cut = np.searchsorted(keys, np.arange(1 << slot_bits, dtype=np.uint64) << np.uint64(64 - slot_bits))
                bounds = [*cut.tolist(), len(keys)]
                wide = 8 if n == 1 else 6
                raw, rows = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :wide], []
                for slot, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if b > a:
                        rows.append((n, slot, raw[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()))
                yield pd.DataFrame(rows, columns=["n", "slot", "keys", "counts"])

        for x in batches:
            for text in x["text"]:
                h = token_hashes(text)
                held[0].append(h[1:])
                for n in range(2, order + 1):
                    held[n - 1].append(_grams(h, n))
                size += len(h) * order
                if size > BUFFER:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "n int, slot int, keys binary, counts binary")


def _summed(packed: DataFrame, levels: Levels) -> DataFrame:
    """Rows of two kinds for each n and slot: the slot's filter (blocks, bits), and, for single tokens, their exact counts (h, c) as packed arrays."""

    def merge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        n, slot = key
        wide = 8 if n == 1 else 6
        parts = []
        for raw in x["keys"]:
            full = np.zeros((len(raw) // wide, 8), np.uint8)
            full[:, :wide] = np.frombuffer(raw, np.uint8).reshape(-1, wide)
            parts.append(full.view(">u8").ravel())
        keys = np.concatenate(parts).astype(np.uint64)
        counts = np.concatenate([np.frombuffer(raw, "<u4") for raw in x["counts"]]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        blocks, bits = slot_filter(keys, levels.of(counts))
        exact = (keys.astype("<u8").tobytes(), counts.astype("<i8").tobytes()) if n == 1 else (None, None)
        return pd.DataFrame([(n, slot, blocks, bits.tobytes(), *exact)], columns=["n", "slot", "blocks", "bits", "keys", "counts"])

    return packed.groupBy("n", "slot").applyInPandas(merge, "n int, slot int, blocks int, bits binary, keys binary, counts binary")


class Model:
    """The filter's table, exact counts of single tokens, and what of both is resident."""

    def __init__(self, docs: DataFrame, text_col: str, order: int = 2, base: float = 1.5, mu: float = 20.0, slot_bytes: int = 1 << 24, resident_bytes: int = 1 << 27, resident_words: int = 1 << 20):
        self.spark: SparkSession = docs.sparkSession
        ship_package(self.spark)
        self.order, self.mu, self.scale = order, mu, Levels(base)
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.slot_bits = _slot_bits(size, slot_bytes)
        self.table = written(_summed(_packed(docs, text_col, order, self.slot_bits), self.scale), "filter")
        self.words = written(self._exact(), "words")
        self.tokens, self.types = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.parts = self._parts(resident_bytes)
        self.frequent, self.least = self._frequent(resident_words)

    def _exact(self) -> DataFrame:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for keys, counts in zip(x["keys"], x["counts"]):
                    yield pd.DataFrame({"h": np.frombuffer(keys, "<u8").view(np.int64), "c": np.frombuffer(counts, "<i8")})

        return self.table.where("n = 1").select("keys", "counts").mapInPandas(rows, "h long, c long")

    def _parts(self, resident_bytes: int) -> list[list[tuple[int, int, int]]]:
        """(n, slot, blocks) of each part, in order, none with more than resident_bytes unless it is one slot. Only sizes come to the driver."""
        parts: list[list[tuple[int, int, int]]] = [[]]
        held = 0
        for n, slot, blocks in self.table.select("n", "slot", "blocks").orderBy("n", "slot").toLocalIterator():
            size = blocks * WORDS * 8
            if parts[-1] and held + size > resident_bytes:
                parts.append([])
                held = 0
            parts[-1].append((n, slot, blocks))
            held += size
        return parts

    def _frequent(self, most: int) -> tuple[Broadcast, int]:
        """Hashes (sorted) and counts of the words of at least `least` occurrences: as many powers of two down as fit `most`."""
        bands = {r["k"]: r["m"] for r in self.words.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}  # at most 64
        band, taken = max(bands, default=0) + 1, 0
        while band > 0 and taken + bands.get(band - 1, 0) <= most:
            band -= 1
            taken += bands.get(band, 0)
        least = 2**band

        def often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for keys, counts in zip(x["keys"], x["counts"]):
                    c = np.frombuffer(counts, "<i8")
                    yield pd.DataFrame({"keys": [np.frombuffer(keys, "<u8")[c >= least].tobytes()], "counts": [c[c >= least].tobytes()]})

        h, c = np.zeros(taken, np.uint64), np.zeros(taken, np.int64)
        at = 0
        for keys, counts in self.table.where("n = 1").select("keys", "counts").mapInPandas(often, "keys binary, counts binary").toLocalIterator():
            end = at + len(keys) // 8
            h[at:end], c[at:end] = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")
            at = end
        by = np.argsort(h)
        return self.spark.sparkContext.broadcast((h[by], c[by])), least

    def part(self, slots: list[tuple[int, int, int]]) -> Broadcast:
        """The filters of a part, one for each n. Rows come one partition at a time into arrays of their final size."""
        filters = {n: Filter(self.slot_bits, {s: k for m, s, k in slots if m == n}) for n in range(1, self.order + 1)}
        wanted = F.broadcast(self.spark.createDataFrame([x[:2] for x in slots] or [(0, 0)], "n int, slot int"))
        for n, slot, bits in self.table.join(wanted, ["n", "slot"]).select("n", "slot", "bits").toLocalIterator():
            filters[n].put(slot, bits)
        return self.spark.sparkContext.broadcast(filters)


def text_score(levels: np.ndarray, tokens: int, order: int, scale: Levels, mu: float, n_all: int, types: int, starts: int) -> float:
    """log10 of a text's probability, from the levels of its n-grams."""
    size = [tokens] + [max(0, tokens + 2 - n) for n in range(2, order + 1)]
    by = np.split(np.maximum(levels, 0), np.cumsum(size)[:-1])
    p = (scale.first[by[0]] + 1) / (n_all + types + 1)
    # The history of a token of order n is the (n - 1)-gram that ends before it; the first token's is the start mark.
    history = np.concatenate([[float(starts)], scale.last[by[0]][:-1]])
    for n in range(2, order + 1):
        skip = n - 2  # tokens with too short a history
        p[skip:] = (scale.first[by[n - 1]] + mu * p[skip:]) / (history + mu)
        history = scale.last[by[n - 1]][:-1]
    return float(np.log10(p).sum())


def score_texts(docs: DataFrame, model: Model, starts: int, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry columns with n_tokens, n_known, train_tokens, base_score and score."""
    spark, order, mu, scale = model.spark, model.order, model.mu, model.scale
    n_all, types, frequent, least = int(model.tokens), int(model.types), model.frequent, model.least
    per = math.log10(n_all + types + 1)
    most = len(scale.first) - 1
    at = docs.select(*carry, F.col(text_col).alias("text"))
    fields = {f.name: f for f in at.schema.fields}
    kept = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in carry)

    def grouped(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows whose texts are together about 4 MB, or one longer text."""
        sizes = np.cumsum([len(t) if t is not None else 0 for t in x["text"]])
        for _, g in x.groupby(sizes // (1 << 22), sort=False):
            yield g

    def levels_of(g: pd.DataFrame, filters: dict[int, Filter]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hashes = [token_hashes(t) for t in g["text"]]
        # All texts of a group are asked at once: one array of n-grams for each order, cut again by text.
        found = [[] for _ in hashes]
        for n in range(1, order + 1):
            each = [_grams(h[1:] if n == 1 else h, n) for h in hashes]
            keys, back = np.unique(np.concatenate(each), return_inverse=True)
            for i, part in enumerate(np.split(filters[n].levels(keys, most)[back], np.cumsum([len(k) for k in each])[:-1])):
                found[i].append(part)
        return hashes, [np.concatenate(f) for f in found]

    def with_before(found: list[np.ndarray], before: pd.Series | None) -> list[np.ndarray]:
        if before is None:
            return found
        return [np.maximum(f, np.frombuffer(b, np.int8)) for f, b in zip(found, before)]

    first, last = True, len(model.parts) - 1
    for k, slots in enumerate(model.parts):
        sent = model.part(slots)

        if k < last:

            def fill(batches: Iterator[pd.DataFrame], sent: Broadcast = sent, first: bool = first) -> Iterator[pd.DataFrame]:
                for x in batches:
                    for g in grouped(x):
                        _, found = levels_of(g, sent.value)
                        yield g.assign(levels=[f.astype(np.int8).tobytes() for f in with_before(found, None if first else g["levels"])])

            at = written(at.mapInPandas(fill, f"{kept}, text string, levels binary"), "levels")
            sent.unpersist()
            first = False
            continue

        def finish(batches: Iterator[pd.DataFrame], sent: Broadcast = sent, first: bool = first) -> Iterator[pd.DataFrame]:
            known_h, known_c = frequent.value
            for x in batches:
                for g in grouped(x):
                    hashes, found = levels_of(g, sent.value)
                    found = with_before(found, None if first else g["levels"])
                    rows = []
                    for h, levels in zip(hashes, found):
                        own = h[1:]
                        place = np.minimum(np.searchsorted(known_h, own), max(0, len(known_h) - 1))
                        hit = known_h[place] == own if len(known_h) else np.zeros(len(own), bool)
                        part = float(np.log10(known_c[place[hit]] + 1.0).sum()) if hit.any() else 0.0
                        score = text_score(levels, len(own), order, scale, mu, n_all, types, starts)
                        rows.append((len(own), int(hit.sum()), part, score, own[~hit].view(np.int64)))
                    out = g[carry].copy()
                    for name, values in zip(("n_tokens", "n_known", "part", "score", "rest"), zip(*rows)):
                        out[name] = list(values)
                    yield out

        at = at.mapInPandas(finish, f"{kept}, n_tokens long, n_known long, part double, score double, rest array<long>")
    scored = written(at.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words that aren't resident: each has fewer than `least` training occurrences.
    rare = model.words.where(F.col("c") < least)
    asked = scored.select("row", F.explode("rest").alias("h")).join(rare, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count(F.lit(1)).alias("k"))
    whole = scored.join(asked.hint("shuffle_hash"), "row", "left")
    total = F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(per)
    return whole.select(*carry, "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), total.alias("base_score"), "score")


def held_out(ident: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == fold


def frequency_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, **model: object) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by a model of those that aren't held out."""
    marked = docs.select(F.col(id_col), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    training = marked.where(~F.col("held_out"))
    learnt = Model(training, "text", **model)
    return score_texts(marked, learnt, training.count(), [id_col, "held_out"])
