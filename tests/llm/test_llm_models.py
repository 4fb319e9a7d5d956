"""Scoring, resampling and the prefix trie against plain Python versions of their contracts; dealing of rows without ids; leaks among numbers."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import corpus, frame, lower  # noqa: E402

# n-gram scores


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")) + ["\n"]


def scores(spark, rows, **options):
    from tallyspark.llm.frequency_filter import frequency_scores

    return [tuple(r) for r in frequency_scores(frame(spark, rows), **options).collect()]


@pytest.mark.parametrize("options", [{}, {"resident_bytes": 10_000, "resident_words": 20, "slot_bytes": 2_000}, {"order": 3}, {"order": 1}])
def test_base_scores_are_exact(spark, options):
    rows = corpus(31, 120) + [(7, "the same id"), (7, "again"), (None, "no id here"), (None, None)]
    kept = [(i, t, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for i, t, out in kept if not out for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, out in kept:
        w = tokens_of(t)
        want.append((i, out, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = scores(spark, rows, **options)
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r[6] <= 0 for r in got) and any(r[1] for r in got)


def test_parts_of_the_filter_change_no_score(spark):
    rows = corpus(32, 80)
    one, many = (sorted(scores(spark, rows, slot_bytes=1_000, **o), key=repr) for o in ({}, {"resident_bytes": 20_000}))
    assert [(r[0], round(r[6], 9)) for r in one] == [(r[0], round(r[6], 9)) for r in many]


def test_scores_against_the_formula(spark):
    """Levels are read as they were counted, but for the filter's few false ones; so the score is the formula's, up to these."""
    from tallyspark.llm.frequency_filter import Levels

    rows = corpus(33, 100)
    scale, mu = Levels(1.5), 20.0
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for t in training:
        w = ["\r", *tokens_of(t)]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    level = lambda c: int(scale.of([c])[0])
    off = 0
    for i, _, k, *_, score in scores(spark, rows):
        w = ["\r", *tokens_of(dict(rows)[i])]
        want = 0.0
        for a, b in zip(w, w[1:]):
            p = (scale.first[level(one[b])] + 1) / (n + v + 1)
            h = len(training) if a == "\r" else scale.last[level(one[a])]
            want += math.log10((scale.first[level(two[a, b])] + mu * p) / (h + mu))
        off += abs(score - want) > 0.02 * k
    assert off <= len(rows) // 10


def test_real_texts_score_above_shuffled_ones(spark):
    r = random.Random(34)
    base = [" ".join(f"{a}{b}" for a in "xyz" for b in r.sample(range(30), 30)) for _ in range(40)]
    chain = lambda: " ".join(f"t{(k * 7 + s) % 50}" for s in [r.randrange(50)] for k in range(40))
    rows = [(i, chain()) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(base)]
    held = [i for i in range(2000, 2400) if zlib.crc32(str(i).encode()) % 7 == 2][:20]
    real = {i: chain() for i in held[:10]}
    mixed = {i: " ".join(r.sample(t.split(" "), 40)) for i, t in zip(held[10:], real.values())}
    got = {x[0]: x for x in scores(spark, [*rows, *real.items(), *mixed.items()])}
    assert min(got[i][6] for i in real) > max(got[i][6] for i in mixed) and all(got[i][6] > got[i][5] for i in real)


def test_counts_are_never_read_too_low(spark):
    import numpy as np

    from tallyspark.llm.frequency_filter import Filter, Levels, slot_filter

    r = np.random.default_rng(3)
    keys = r.integers(0, 2**61, 20_000, dtype=np.uint64)
    counts = r.integers(1, 5_000, 20_000)
    scale = Levels(1.5)
    levels = scale.of(counts)
    blocks, bits = slot_filter(keys, levels)
    f = Filter(3, {0: blocks})
    f.put(0, bits.tobytes())
    read = f.levels(keys, 40)
    assert (read >= levels).all() and (read > levels).mean() < 0.02
    other = r.integers(0, 2**61, 20_000, dtype=np.uint64)
    assert (f.levels(other, 40) > 0).mean() < 0.02 and (f.levels(other | np.uint64(7 << 61), 40) == -1).all()
    assert all(scale.first[k] <= c <= scale.last[k] for k, c in zip(levels.tolist(), counts.tolist()))


def test_no_texts_no_scores(spark):
    assert scores(spark, []) == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert scores(spark, [(only, "a b")]) == [(only, True, 3, 0, 0, 0.0, pytest.approx(0.0, abs=2.0))]


# importance resampling


def plain_resample(docs, target, percent=25, least=20, buckets=10_000):
    def read(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = [(i, *read(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(read(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        rows.append((i, n, len(f), weight, score))
    able = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    drawn = Counter((r[0], *r[2:]) for r in able[: len(able) * percent // 100])
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault((r[0], *r[2:]), []).append(k)
    out = []
    for r in rows:
        key = (r[0], *r[2:])
        out.append((*key, ranks[key].pop(0) if drawn[key] and ranks[key] and r[1] >= least else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 16])
def test_resampling_against_a_plain_version(spark, chunk_bytes):
    from tallyspark.llm.importance import resample

    docs = corpus(41, 100) + [(2000, " \t\n" * 50), (2001, "É2é a\x7fb\x00C"), (2002, "x" * 500), (None, " ".join(["word"] * 30)), (2003, "same " * 25), (2003, "same " * 25)]
    target = [t for _, t in corpus(42, 10)]
    x = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample(frame(spark, docs), x, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target)


def test_chunks_own_their_words(spark):
    from tallyspark.llm.importance import chunks, features, words

    r = random.Random(43)
    for _ in range(50):
        text = "".join(r.choice(["ab", "c", " ", "  ", "é", "Q", ".", "1"]) for _ in range(r.randrange(200))).encode()
        whole = words(text)
        for n in (1, 2, 3):
            parts = list(chunks(text, r.randrange(1, 40), n - 1))
            assert sum(own for _, own in parts) == len(whole)
            found = sorted(k for piece, own in parts for k in features(words(piece), own, n, 997).tolist())
            assert found == sorted(features(whole, len(whole), n, 997).tolist())


def test_resampling_of_empty_tables(spark):
    from tallyspark.llm.importance import resample

    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(frame(spark, []), none).count() == 0
    assert [r["rank"] for r in resample(frame(spark, [(k, "w " * 20) for k in range(8)]), none).orderBy("rank").collect()] == [None] * 6 + [1, 2]


# prefix trie


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    for turns in own.values():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1]))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(z[1:] for z in own.get(c - int(math.fmod(c, 20)), [])[:h]) + tuple(z[1:] for z in turns[h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[c] for c in below) if below else 1
        saved[k] = sum(saved[c] for c in below) + ((len(members[k]) - 1) * (len(tokens_of(k[-1][1])) - 1) if k else 0)
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(full[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -40, 10**12, 10**12 + 3]:
        if r.random() < 0.15:
            continue
        for i in range(r.choice([1, 1, 2, 3, 4, 5, 8, 30])):
            rows.append((c, None if i == 0 and r.random() < 0.1 else i, r.choice(["u", "a", None]) if r.random() < 0.1 else "ua"[i % 2], r.choice(["x y", "x", "", None, "z  w\n"]) if i < 2 else r.choice(["p", "q r"])))
    r.shuffle(rows)
    return rows + [*rows[:5], (None, 1, "u", "x")]


@pytest.mark.parametrize(("seed", "block"), [(51, 4), (52, 1024)])
def test_trie_against_a_plain_version(spark, seed, block):
    from tallyspark.llm.prefix_trie import prefix_trie

    rows = talks(seed) + [(77, 100 + i, "u", f"w{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS path", "2L AS c", "3 AS part")
    got = prefix_trie(df, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_small_tries(spark):
    from tallyspark.llm.prefix_trie import prefix_trie

    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], kind)).count() == 0
    # Conversations of which nothing is left are members of the root.
    gone = [(c, 0, "u", "hi") for c in range(1000, 1400) if zlib.crc32(str(c).encode()) % 4 and zlib.crc32(str(c - c % 20).encode()) % 1 == 0 and c % 20][:5]
    for rows in (gone, [(0, 0, "u", None)], [(20 * k, i, "u", "same") for k in range(50) for i in range(3)]):
        assert sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, kind)).collect()), key=repr) == plain_trie(rows)


# dealing, and leaks among numbers


def test_rows_without_ids_are_dealt_to_many_batches(spark):
    from tallyspark.llm.common import dealing_key

    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("text "), "id").alias("text"))
    n = rows.groupBy(F.pmod(dealing_key(), F.lit(100))).count()
    assert n.count() == 100 and n.agg(F.max("count")).first()[0] < 200


def leaked(spark, docs, items):
    from tallyspark.llm.decontamination import leaks

    return {tuple(r)[:2] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_numbers_meet_by_their_values(spark):
    r = random.Random(61)
    numbers = lambda n: " ".join(str(r.randrange(1000)) for _ in range(n))
    items = [(k, numbers(12)) for k in range(1000)] + [(2000, "7 8 9")]
    docs = [(0, numbers(20_000)), (1, f"{numbers(100)} {items[5][1]} {numbers(50)}"), (2, f"some words {items[9][1]} and more"), (3, "7, 8 and 9"), (4, "so 7, 8, 9 it is")]
    assert leaked(spark, docs, items) == {(1, 5), (2, 9), (4, 2000)}


def test_arithmetic_in_other_numbers_is_found(spark):
    r = random.Random(62)
    sums = lambda n: " ".join(f"{r.randrange(99)} plus {r.randrange(99)} is {r.randrange(99)}" for _ in range(n))
    items = [(k, f"what do we get if {sums(2)}") for k in range(40)]
    docs = [(0, sums(400)), (1, f"tell me what do we get if {sums(2)} at last")]
    got = leaked(spark, docs, items)
    assert {k for k in got if k[0] == 1} and all(k[0] in (0, 1) for k in got)


def test_many_equal_windows_and_items(spark):
    items = [(k, "the 5 red boxes of Anna hold 20 kg each and are sold") for k in range(3)]
    docs = [(k, "x " + "the 7 red boxes of Omar hold 30 kg each and are sold " * 20) for k in range(3)]
    assert leaked(spark, docs, items) == {(d, i) for d in range(3) for i in range(3)}
