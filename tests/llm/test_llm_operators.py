"""Each corpus operator against a plain Python version of its contract, on random and edge-case inputs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
EXTRA = ", id string, batch int, n long, h string, keep string, shard string, host string, path string, lang string, source string, n_chars long"
NAMES = "id batch n h keep shard host path lang source n_chars".split()


def frame(spark, rows, text="text"):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "h", "k", "s", "o", "p", "en", "src", 0) for i, t in rows], f"doc_id long, {text} string{EXTRA}")


def corpus(seed, n=60):
    """Random small texts with copies, near copies, shared passages and lines, nulls, empties, white space, and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ß", "İ", "K", "日本", "Aa", "a" * 300]
    passage = [r.choice(words) for _ in range(30)]
    line = "The same Long line that many documents hold, up to its case"
    out = []
    for i in range(n):
        kind = r.randrange(8)
        body = [r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 12, 13, 14, 40, 90]))]
        if kind == 0 and out:
            body = (out[r.randrange(len(out))][1] or "").split(" ")
        if kind == 1 and out:
            body = (out[r.randrange(len(out))][1] or "").split(" ")
            if len(body) > 3:
                body[r.randrange(len(body))] = "changed"
        if kind == 2:
            at = r.randrange(len(body) + 1)
            body[at:at] = passage
        text = r.choice([" ", " ", "\n", "\t "]).join(body)
        if kind in (3, 4):
            text += r.choice(["\n", "\n\n", "\n \t"]) + (line.upper() if kind == 3 else f"  {line}\x0b")
        out.append((i * 3 % (2 * n), None if r.random() < 0.05 else text))
    return out + [(1000, ""), (1001, " \n\t "), (1002, " ".join(words[i % 400] for i in range(5000)))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words_of(t):
    for c in SPACE[1:]:
        t = (t or "").replace(c, " ")
    return [w for w in t.split(" ") if w]


# line dedup


def plain_lines(rows, least=40, docs=5):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    key = lambda x: lower(x.strip(SPACE))
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, lines in split:
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    from tallyspark.llm.line_dedup import line_dedup

    rows = corpus(seed)
    got = line_dedup(frame(spark, rows)).select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == plain_lines(rows)
    assert sum(r[2] for r in plain_lines(rows)) > 0


def test_line_dedup_keeps_rows_without_an_id(spark):
    from tallyspark.llm.line_dedup import line_dedup

    line = "x" * 50
    out = line_dedup(spark.createDataFrame([(None, line)] * 3 + [(i, line) for i in range(5)], "doc_id long, text string"))
    assert [r["text"] for r in out.where("doc_id is null").collect()] == [line] * 3
    assert [r["text"] for r in out.where("doc_id is not null").orderBy("doc_id").collect()] == [""] * 4 + [line]


# n-gram Jaccard join


def test_line_dedup_of_a_text_of_very_many_lines(spark):
    import time

    from tallyspark.llm.line_dedup import line_dedup

    many = "\n".join(f"{k:06d} a line of forty code points or a few more" for k in range(200_000))
    rows = [(i, f"{many}\nown {i}") for i in range(5)]
    start = time.time()
    got = sorted(map(tuple, line_dedup(frame(spark, rows)).select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.length("text")).collect()))
    assert time.time() - start < 60
    assert got == [(i, 200_001, 200_000 if i < 4 else 0, 5 if i < 4 else len(rows[4][1])) for i in range(5)]


def test_line_dedup_of_rows_that_share_an_id(spark):
    from tallyspark.llm.line_dedup import line_dedup

    line = "a line that is long enough to be looked at by the operator"
    rows = [(1, f"{line}\nx"), (1, f"y\n{line}\n{line}"), (1, f"y\n{line}\n{line}"), *[(k, line) for k in range(2, 6)]]
    got = line_dedup(frame(spark, rows)).select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == sorted(plain_lines(rows))


def plain_components(rows):
    sets = {}
    each = []
    for i, t in rows:
        w = [lower(x) for x in words_of(t)]
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        each.append((i, len(s)))
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return sorted((i, n, root(i)) for i, n in each)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    from tallyspark.llm.jaccard_join import jaccard_components

    rows = [(k, t) for k, (_, t) in enumerate(corpus(seed))]
    r = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    for k in range(40):  # a family of near copies, with edits that do and don't break the link
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"e{r.randrange(6)}"
        rows.append((2000 + k, " ".join(w)))
    got = jaccard_components(frame(spark, rows), chunk_bytes=1_000, task_bytes=8_000, batch_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_tasks_are_sized_by_bytes(spark):
    """Few pairs of very long texts are dealt to as many tasks as their tokens fill."""
    from tallyspark.llm import jaccard_join

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    rows = []
    for k in range(6):
        w = list(base)
        w[r.randrange(len(w))] = f"own{k}"
        rows.append((k, " ".join(w)))
    shards = []
    plain = jaccard_join.open_groups

    def watched(queries, members, threshold, n):
        shards.append(n)
        return plain(queries, members, threshold, n)

    jaccard_join.open_groups = watched
    try:
        got = jaccard_join.jaccard_components(frame(spark, rows), task_bytes=1 << 20)
        assert sorted(map(tuple, got.collect())) == [(k, 39_996, 0) for k in range(6)]
    finally:
        jaccard_join.open_groups = plain
    assert shards[0] >= 2  # 5 pairs, 320 KB of tokens in each set


def test_jaccard_at_the_threshold(spark):
    from tallyspark.llm.jaccard_join import jaccard_components

    a = [f"a{i}" for i in range(18)]  # 14 shingles
    near = a[:16]  # 12 of them: 12 / 14 links
    far = a[:13] + ["x"]  # 9 of 13 and 9 of 15: doesn't
    got = jaccard_components(spark.createDataFrame([(3, " ".join(a)), (2, " ".join(near)), (1, " ".join(far)), (None, " ".join(a)), (5, "one"), (4, "ONE")], "doc_id long, text string"))
    assert sorted(map(tuple, got.where("doc_id is not null").collect())) == [(1, 10, 1), (2, 12, 2), (3, 14, 2), (4, 1, 4), (5, 1, 4)]
    assert got.where("doc_id is null").first()["component_id"] is None


# substring dedup


def plain_windows(rows, size=13):
    least = {}
    words = [(i, words_of(t)) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            least[x] = min(i, least.get(x, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    from tallyspark.llm.substring_dedup import substring_dedup

    rows = corpus(seed) + [(7, "a " * 60), (8, "a " * 100), (9, "x " + "a " * 20)]
    got = substring_dedup(frame(spark, rows), batch_bytes=8_000).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == plain_windows(rows)
    assert sum(r[2] for r in plain_windows(rows)) > 100


def test_strings_are_numbered_alike_whatever_the_order_of_rows():
    import numpy as np

    from tallyspark.llm.substring_dedup import Batch, Cutter

    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefghij") for _ in range(40))
    rows = [(r.randrange(5), text()) for _ in range(30)] + [(2, None), (2, "")]
    cutter = Cutter(13, 3, 7, np.zeros(0, np.uint64))
    first = Batch(cutter, np.array([i for i, _ in rows]), [t for _, t in rows])
    for _ in range(5):
        r.shuffle(rows)
        b = Batch(cutter, np.array([i for i, _ in rows]), [t for _, t in rows])
        assert b.strings == first.strings and b.least.tolist() == first.least.tolist()
        assert [(k, v.tolist()) for k, v in b.parts()] == [(k, v.tolist()) for k, v in first.parts()]


def test_rows_that_share_an_id_lose_their_own_words(spark):
    from tallyspark.llm.substring_dedup import substring_dedup

    r = random.Random(6)
    shared = " ".join(f"s{k}" for k in range(20))
    rows = [(0, shared)] + [(5, " ".join(f"u{r.random()}" for _ in range(20)) + (f" {shared}" if k % 2 else "")) for k in range(20)]
    got = substring_dedup(frame(spark, rows), batch_bytes=500).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == plain_windows(rows)


def test_windows_of_common_grams_are_spread():
    import numpy as np

    from tallyspark.llm.substring_dedup import Cutter
    from tallyspark.llm.words import gram_hashes, measured, ordering_hashes

    r = random.Random(2)
    words = measured(" ".join(r.choice("ab") for _ in range(500)))
    common = np.unique(gram_hashes(ordering_hashes(*words), 3))
    first, count, bucket, a, b, strings = Cutter(13, 3, 8, common).cut(*words)
    assert first.tolist() == list(range(488)) and set(count.tolist()) == {1}
    assert np.bincount(bucket, minlength=8).max() < 488 / 8 * 2
    assert all((x, y) == (0, len(s)) for x, y, s in zip(a, b, strings, strict=True))


def test_substring_dedup_of_words_longer_than_a_stretch(spark):
    from tallyspark.llm import words

    text = " ".join(["y" * 10, "z" * (words.STRETCH + 5), "q"] * 3)
    whole, begin, end = words.measured(f"  {text}\n")
    assert whole.decode() == text and [int(e - b) for b, e in zip(begin, end)] == [10, words.STRETCH + 5, 1] * 3
    h = words.ordering_hashes(whole, begin, end)
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[8] and len(set(h.tolist())) == 3


# packing


@pytest.fixture(scope="module")
def vocabulary():
    from tallyspark.llm.queries import vocabulary

    return vocabulary()


@pytest.mark.parametrize("limit, block", [(64, 16), (2048, 50_000)])
def test_packing(spark, vocabulary, limit, block):
    from tokenizers import Tokenizer

    from tallyspark.llm.packing import pack_pieces, token_pieces

    t = Tokenizer.from_file(vocabulary)
    rows = [(k, x) for k, (_, x) in enumerate(corpus(5))] + [(500, "<|endoftext|> ’s don't   \u00a0 🙂 १२ 𝒳"), (501, None)]
    out = [r.asDict() for r in pack_pieces(token_pieces(frame(spark, rows), vocabulary, max_tokens=limit), limit, 2, block).collect()]
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in out if r["id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // limit)))
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids) and all(r["length"] == limit for r in own[1:])
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r["length"] for r in out)
    assert len(sequences) <= total / limit * 1.12 + 2


def test_encoder_equals_the_tokenizers_library(vocabulary):
    from tokenizers import Tokenizer

    from tallyspark.llm.token_ids import encoder

    t = Tokenizer.from_file(vocabulary)
    r = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x460), *range(0x2000, 0x2070), 0x3041, 0x4E00, 0xAC00, 0x1F600, 0x1D4B3, 0xFEFF, 0x600]] + [" ", "\n", "'s", "'ll", "\u00a0", "<|endoftext|>"] * 30
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(80))) for _ in range(1500)] + ["", "a" * 50_000]
    want = [b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert encoder(vocabulary).encode(texts) == want


@pytest.mark.parametrize("unit", [" ", "\n", "\r\n", "\t", "a", "\u00e9", "7", "-", "\u4e00", "a <|endoftext|> "])
def test_encoder_takes_runs_of_any_length(vocabulary, unit):
    from tokenizers import Tokenizer

    from tallyspark.llm.token_ids import encoder

    text = unit * (2_000_000 // len(unit))
    assert encoder(vocabulary).ids(text) == Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids


def test_packing_of_long_runs(spark, vocabulary):
    from tallyspark.llm.packing import pack_documents

    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, " \n" * 500_000), (4, "x" * 1_000_000), (5, "two words")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5} and all(r["m"] <= 2048 for r in got)


def test_best_fit_takes_the_fullest_bin():
    from tallyspark.llm.packing import best_fit

    assert [sorted(b) for b in best_fit([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]
    assert best_fit([], 10) == []


# url filters

URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/?q", "http://example.com/de/", "http://x.net/es/1#f", "http://net/fr/", "http://notexample.com/en/", "https://x.org/", "http://example.com", "://net/es/", "http://ex.com?x=/en/", "a://b://net/es/", "http://example.com/en", "http://example.com:80/en/"]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = lower(rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_cascade(spark):
    from tallyspark.llm.queries import URL_RULES
    from tallyspark.llm.url_cascade import url_cascade

    r = random.Random(2)
    urls = URLS + [f"http://{r.choice(['', 'a.', 'www.'])}{r.choice(['example.com', 'com', 'net', 'b.net', 'c.org'])}{r.choice(['/', '/en/', '/es/x', '/fr/', ''])}{r.choice(['', '?a', '#b'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_cascade(pages, URL_RULES).collect()}
    assert got == {i: plain_verdict(u, URL_RULES) for i, u in enumerate(urls)}
    assert url_cascade(pages.limit(0), URL_RULES).count() == 0
    assert {x["verdict"] for x in url_cascade(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_cascade(pages, [("allow", "a", "/"), ("block", "a", "/")])


def test_cascade_is_exact_where_one_filter_errs(spark):
    from tallyspark.llm.url_cascade import build_cascade

    keys = spark.range(30_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), "id")
    cascade = build_cascade(keys.where("id < 9000"), keys)
    x = keys.toPandas()
    assert len(cascade.levels) >= 2
    assert (cascade.holds(x["a"].to_numpy(), x["b"].to_numpy()) == (x["id"] < 9000)).all()


def test_lists_too_long_for_one_filter_are_split(spark):
    from tallyspark.llm.url_cascade import split_count, url_cascade

    r = random.Random(7)
    rules = [(r.choice(["allow", "block"]), f"h{k}.com", r.choice(["/", "/en/"])) for k in range(200)]
    urls = [f"http://{r.choice(['', 'a.'])}h{r.randrange(400)}.com{r.choice(['/', '/en/x', '/de/'])}" for _ in range(300)] + [None, ""]
    assert split_count(100, 1000, 1 << 8) > 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_cascade(pages, rules, max_bits=1 << 9, resident=2).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_a_cascade_is_sized_by_list_and_universe():
    from tallyspark.llm.bloom import error_rate
    from tallyspark.llm.url_cascade import _width, split_count

    assert 1e12 * error_rate(_width(3, 1e12, 1 << 26)) <= 1000  # three rules, any corpus: still one small filter
    assert split_count(3, 10**12, 1 << 26) == 1
    for listed, universe in ((10**7, 10**9), (10**9, 10**12), (10**5, 10**13)):
        parts = split_count(listed, universe, 1 << 26)
        n, u = listed / parts, universe / parts
        assert n * 10 <= 1 << 26 and u * error_rate(_width(n, u, 1 << 26)) * 10 <= 1 << 26


# media


def test_media(spark):
    from tallyspark.llm.media import chunks_of, media_features, payload_of, wav_header

    r = random.Random(3)
    long = "".join(r.choice("abcdefghij ") for _ in range(60_000))
    rows = corpus(4) + [(600, long), (601, "front " + long), (602, long), (None, long), (603, "€" * 30_000)]
    got = sorted(map(tuple, media_features(frame(spark, rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect()), key=repr)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        m = wav_header(len(p)) + p
        feature = f"sum={sum(p)};energy={sum(x * x for x in p)};peak={max(p)};crossings={sum((x >= 128) != (y >= 128) for x, y in zip(p, p[1:]))}"
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
    assert got == sorted(want, key=repr)
    a, b = (chunks_of(payload_of(x)[0]) for x in (long, "front " + long))
    assert b"".join(a) == payload_of(long)[0] and len(set(a) & set(b)) > 0.8 * len(a)


def test_media_is_readable_as_sound(spark, tmp_path):
    import wave

    from tallyspark.llm.media import payload_of, wav_header

    p = payload_of("some text")[0]
    (tmp_path / "x.wav").write_bytes(wav_header(len(p)) + p)
    with wave.open(str(tmp_path / "x.wav")) as w:
        assert w.readframes(w.getnframes()) == p and w.getsampwidth() == 1


def test_a_changed_chunk_is_an_error(spark):
    from tallyspark.llm.media import read_media, store_media

    docs = spark.createDataFrame([(1, "x" * 5000), (2, "x" * 5000)], "id long, text string")
    table, chunks = store_media(docs, 1 << 16)
    with pytest.raises(Exception, match="differs"):
        read_media(table, chunks.withColumn("bytes", F.lit(b"y" * 10))).collect()


# sharding


def test_sharding(spark, tmp_path):
    from tallyspark.llm.sharding import ShardStore

    rows = frame(spark, corpus(6) + [(None, None), (None, None)])
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    assert store.append(rows.repartition(3), F.col("doc_id") % 4) == 5  # 4 arrivals and the null one
    whole = lambda v=None: sorted(map(tuple, store.read(v).select("doc_id", "text").collect()), key=repr)
    before, shards = whole(), store.manifest().count()
    assert before == sorted(map(tuple, rows.select("doc_id", "text").collect()), key=repr) and shards > 4
    last = store.compact()
    assert last > 5 and store.manifest().count() < shards and whole() == before == whole(5)
    assert store.compact() == last
    assert store.append(rows.limit(0)) == last + 1 and whole() == before
    assert sum(r["rows"] for r in store.manifest().collect()) == rows.count()
    with pytest.raises(ValueError):
        store.append(rows.drop("n"))
    with pytest.raises(ValueError):
        store.read(99)


def test_merged_shards_are_of_the_target_size_and_nothing_is_left_behind(spark, tmp_path):
    from tallyspark.llm.sharding import ShardStore

    r = random.Random(3)
    rows = spark.createDataFrame([(k, "".join(r.choices("abcdefghijklmnop", k=2000))) for k in range(1200)], "doc_id long, text string")
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, least_bytes=1 << 12)
    store.append(rows.repartition(2), F.col("doc_id") % 12)
    store.compact()
    sizes = [x["bytes"] for x in store.manifest().collect()]
    assert max(sizes) <= 1.3 * 200_000 and sum(x >= 100_000 for x in sizes) >= len(sizes) - 3
    # Shards over half the target stay as they are, at every call.
    folders = lambda: sorted(p.name for p in (tmp_path / "s/data").iterdir())
    before = folders()
    last = store.versions()[-1]
    assert store.compact() == last and folders() == before and store.read().count() == 1200


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    from tallyspark.llm.sharding import ShardStore

    store = ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(4):
        store.append(spark.range(k, k + 1))
    for step in ("_listed", "_commit"):  # after the data, and after the manifest but before the pointer

        def crash(*a, plain=getattr(ShardStore, step), step=step):
            if step == "_commit":
                monkeypatch.setattr(store, "_files", None)
                return plain(store, *a)
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(store, step, crash)
            with pytest.raises((OSError, AttributeError)):
                store.append(spark.range(50, 60))
        assert store.versions() == [1, 2, 3, 4] and store.read().count() == 4
    monkeypatch.undo()
    again = ShardStore(spark, f"file://{tmp_path}/s")
    assert again.append(spark.range(4, 5)) == 5 and again.compact() == 6
    assert sorted(x["id"] for x in again.read().collect()) == [0, 1, 2, 3, 4] and again.manifest().count() == 1


def test_a_version_is_committed_once(spark, tmp_path):
    from tallyspark.llm.sharding import MANIFEST, ShardStore

    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(3))
    base = store._pointer(None)
    none = spark.createDataFrame([], MANIFEST).drop("version")
    assert store._commit(base, none, [], base["schema"])
    assert not store._commit(base, none, [], base["schema"])
    assert store.versions() == [1, 2] and store.read().count() == 3


def test_a_compaction_goes_on_after_another_writer(spark, tmp_path, monkeypatch):
    from tallyspark.llm.sharding import ShardStore

    store = ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(4):
        store.append(spark.range(k, k + 1))
    plain = ShardStore._commit

    def late(self, base, added, removed, schema, first=[True]):  # noqa: B006
        if removed and first:
            first.clear()
            ShardStore(spark, store.root).append(spark.range(70, 71))
        return plain(self, base, added, removed, schema)

    with monkeypatch.context() as m:
        m.setattr(ShardStore, "_commit", late)
        assert store.compact() == 6  # the append came fifth
    assert sorted(r["id"] for r in store.read().collect()) == [0, 1, 2, 3, 70] and store.manifest().count() == 2
    # Another writer that merges the same shards: one of both merges stays.
    for k in range(10, 14):
        store.append(spark.range(k, k + 1))

    def lost(self, base, added, removed, schema, first=[True]):  # noqa: B006
        if removed and first:
            first.clear()
            ShardStore(spark, store.root).compact()
        return plain(self, base, added, removed, schema)

    with monkeypatch.context() as m:
        m.setattr(ShardStore, "_commit", lost)
        store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == [0, 1, 2, 3, 10, 11, 12, 13, 70]
    assert sum(r["rows"] for r in store.manifest().collect()) == 9


def test_folders_that_lost_some_shards_and_columns_with_clashing_names(spark, tmp_path):
    from tallyspark.llm.sharding import ShardStore

    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    rows = spark.createDataFrame([(k, text(200_000 if k % 5 == 0 else 50), k, -k) for k in range(20)], "doc_id long, text string, __arrival long, __shard long")
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, least_bytes=1 << 12, merge_files=5)
    assert store.append(rows.repartition(20, "doc_id")) == 1  # large and small shards in one folder
    whole = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, store.read().collect())) == whole
    last = store.compact()
    left = [x["path"] for x in store.manifest().collect()]
    assert any("__arrival_=0" in p for p in left) and any("__arrival_=0" not in p for p in left)
    assert store.read().columns == rows.columns and sorted(map(tuple, store.read().collect())) == whole
    told = {x["version"]: x for x in store.history().collect()}
    assert sorted(told) == list(range(1, last + 1)) and {x["rows"] for x in told.values()} == {20}
    assert told[last]["shards"] == len(left) < told[1]["shards"] and told[last]["fullest"] < store.fanout <= told[1]["fullest"]
    assert told[1]["bytes"] == sum(x["bytes"] for x in store.manifest(1).collect())


# empty tables


def test_empty_tables(spark, vocabulary):
    from tallyspark.llm.decontamination import leaks
    from tallyspark.llm.html_extraction import extract_text
    from tallyspark.llm.jaccard_join import jaccard_components
    from tallyspark.llm.line_dedup import line_dedup
    from tallyspark.llm.media import media_features
    from tallyspark.llm.packing import pack_documents
    from tallyspark.llm.quality import quality
    from tallyspark.llm.substring_dedup import substring_dedup

    none = frame(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some item text here")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (line_dedup(none), jaccard_components(none), substring_dedup(none), pack_documents(none, vocabulary), media_features(none), quality(none, labels), leaks(none, items), extract_text(pages)):
        assert df.count() == 0
    some = frame(spark, [(1, "a text"), (2, None)])
    assert leaks(some, items.limit(0)).count() == 0
    assert quality(some, labels.limit(0)).where("keep").count() == 2
