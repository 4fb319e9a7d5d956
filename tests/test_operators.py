"""Operators on hand-made edge cases, and against brute force where that is short."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators import graph as G
from tallyspark.operators import incremental as I
from tallyspark.operators import joins as J
from tallyspark.operators import mining as M
from tallyspark.operators import points as P
from tallyspark.operators import quality as Q
from tallyspark.operators import ranking as R
from tallyspark.operators import rating as E
from tallyspark.operators import sequences as S


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_retired_and_drawn_matches_dont_count(spark):
    m = spark.createDataFrame([("p", "win", True), ("p", "lose", True), ("p", "win", False), ("p", "draw", True), ("q", "draw", True)], "p string, r string, c boolean")
    assert rows(A.fold_results(m, ["p"], F.col("r"), F.col("c"))) == [("p", 1, 1, 2, 0.5), ("q", 0, 0, 0, 0.0)]


def test_years_with_entries_only_are_kept(spark):
    a = spark.createDataFrame([("p", 2020, 3)], "p string, y int, wins long")
    b = spark.createDataFrame([("p", 2021, 1)], "p string, y int, entries long")
    assert rows(A.merge_groups(a, b, ["p", "y"], ["wins", "entries"])) == [("p", 2020, 3, 0), ("p", 2021, 0, 1)]


def test_mode_ties_and_shares(spark):
    x = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("g", None)], "g string, v string")
    assert rows(A.modal_value(x, ["g"], "v")) == [("g", "a", 2, 0.4)]


def test_perfect_is_three_valued(spark):
    x = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 9, True), ("c", 1, False)], "g string, v int, counts boolean")
    assert rows(A.all_hold(x, ["g"], F.col("v") < 5, F.col("counts"))) == [("a", True), ("b", False), ("c", None)]


def test_ranks_with_ties(spark):
    x = spark.createDataFrame([("a", 10.04), ("b", 10.01), ("c", 9.0)], "n string, v double")
    assert rows(R.rank_of_rounded(x.withColumn("g", F.lit(1)), ["g"], "v"), "n", "rnk") == [("a", 1), ("b", 1), ("c", 3)]


def test_three_way_tie_in_a_league(spark):
    m = [("l", "a", "b", 3, 0), ("l", "b", "c", 2, 0), ("l", "c", "a", 1, 0), ("l", "a", "d", 1, 0), ("l", "b", "d", 1, 0), ("l", "c", "d", 1, 0)]
    t = R.league_table(spark.createDataFrame(m, "l string, x string, y string, p long, q long"), ["l"], "x", "y", "p", "q")
    assert [r[0] for r in sorted(rows(t, "team", "place"), key=lambda r: r[1])] == ["a", "b", "c", "d"]


def test_lookups(spark):
    people = spark.createDataFrame([("x", "m"), ("y", "n"), ("z", None)], "alias string, name string")
    aliases = spark.createDataFrame([("x", 1)], "alias string, id int")
    names = spark.createDataFrame([("m", 2), ("n", 3)], "name string, id int")
    assert rows(J.coalesce_lookup(people, [(aliases, "alias", "id"), (names, "name", "id")], "found"), "alias", "found") == [("x", 1), ("y", 3), ("z", None)]
    field = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2"), (3, "b", "k3")], "no int, name string, key string")
    want = spark.createDataFrame([("k2", "b"), ("?", "a"), ("?", "b"), (None, None)], "key string, name string")
    assert rows(J.unique_fallback(want, field, "key", "name", "no", "found"), "name", "found") == [("a", 1), ("b", 2), ("b", None), (None, None)]


def test_month_windows_are_half_open_and_clamped(spark):
    now = spark.createDataFrame([("p", "2024-05-31")], "p string, d string").select("p", F.to_timestamp("d").alias("d"))
    past = spark.createDataFrame([("p", x) for x in ("2024-02-29", "2024-02-28", "2024-05-31", "2024-05-30", "2023-05-31")], "p string, e string").select("p", F.to_timestamp("e").alias("e"))
    days = lambda **k: [str(r[0])[:10] for r in rows(J.within_months(now, past, ["p"], "d", "e", 3, **k), "e")]
    assert days() == ["2024-02-29", "2024-05-30"]
    assert days(include_start=False) == ["2024-05-30"]


@pytest.mark.parametrize("months", [1, 3, 12])
def test_month_windows_against_all_pairs(spark, months):
    r = random.Random(months)
    days = [f"20{r.randint(20, 23)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" for _ in range(60)]
    x = spark.createDataFrame([(i % 3, d) for i, d in enumerate(days)], "p int, d string").select("p", F.to_timestamp("d").alias("d"))
    y = x.withColumnRenamed("d", "e")
    plain = x.join(y, "p").where((F.col("e") >= F.add_months(F.to_date("d"), -months)) & (F.col("e") < F.col("d")))
    assert rows(J.within_months(x, y, ["p"], "d", "e", months), "p", "d", "e") == rows(plain, "p", "d", "e")


def test_as_of_is_strictly_earlier(spark):
    a = spark.createDataFrame([(1, 5), (2, 3), (2, 1)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "same"), (1, 4, "before"), (2, 2, "x")], "k int, t int, v string")
    assert rows(J.as_of(a, b, ["k"], "t", "t", ["v"])) == [(1, 5, 4, "before"), (2, 1, None, None), (2, 3, 2, "x")]


def test_partners_and_scoped_aliases(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "e int, p string")
    assert rows(J.partners(e, ["e"], "p")) == [(1, "a", "b"), (1, "b", "a")]
    alias = spark.createDataFrame([("T", "plain", None), ("T", "scoped", "g1")], "alias string, canonical string, gen string")
    t = spark.createDataFrame([("T", "g1"), ("T", "g2"), ("U", "g1")], "name string, gen string")
    assert rows(J.scoped_alias(t, alias, "name", ["gen"], "team")) == [("T", "g1", "scoped"), ("T", "g2", "plain"), ("U", "g1", "U")]


def test_missing_year_breaks_a_streak_but_not_edition_runs(spark):
    x = spark.createDataFrame([("k", y, "A") for y in (2018, 2019, 2021, 2022, 2023)], "k string, y int, h string")
    assert rows(S.year_islands(x, ["k"], "y")) == [("k", 2018, 2019, 2), ("k", 2021, 2023, 3)]
    assert rows(S.streak_stopped(x.where("y < 2020"), ["k"], "y", 2020, 2)) == [("k", 2018, 2019, 2)]
    assert rows(S.edition_runs(x, ["k"], "y", "h"), "h", "length") == [("A", 5)]


def streak(results, target):
    best = now = 0
    for r in results:
        if r == "retired":
            continue
        now = now + 1 if r == target else 0
        best = max(best, now)
    return best


def test_streaks_against_a_loop(spark):
    r = random.Random(3)
    data = [(k, i, r.choice(["win", "win", "lose", "draw", "retired"])) for k in range(12) for i in range(40)]
    x = spark.createDataFrame(data, "k int, i int, r string")
    got = dict(rows(S.result_streaks(x, ["k"], ["i"], F.col("r"), "win", F.col("r") == "retired", "i"), "k", "length"))
    assert got == {k: streak([d[2] for d in data if d[0] == k], "win") for k in range(12)}


def test_lost_runs_against_a_loop(spark):
    r = random.Random(4)
    data = [(k, i, r.choice([True, False, False, None])) for k in range(10) for i in range(50)]
    want = {}
    for k in range(10):
        run = top = three = four = num = den = 0
        for _, _, w in (d for d in data if d[0] == k):
            if run >= 2:
                den += 1
                num += w is True
            if w:
                run = 0
            elif w is False:
                run += 1
                top, three, four = max(top, run), three + (run == 3), four + (run == 4)
        want[k] = (top, three, four, num, den)
    got = S.lost_runs(spark.createDataFrame(data, "k int, i int, w boolean"), ["k"], ["i"], F.col("w"))
    assert {x[0]: tuple(x[1:]) for x in rows(got)} == want


def test_extremes_are_dropped_beyond_the_tie_limit(spark):
    x = spark.createDataFrame([("a", 5)] * 4 + [("b", 7), ("b", 7), ("b", 1), ("c", None)], "g string, v int")
    assert rows(S.extremes(x, ["g"], F.col("v"), 3), "g", "ties") == [("b", 2), ("b", 2)]


def test_percentile_floor_needs_a_pool(spark):
    x = spark.createDataFrame([("a", float(i)) for i in range(60)] + [("b", 1.0)], "g string, v double")
    assert rows(S.percentile_floor(x, ["g"], "v", 0.05)) == [("a", 56.0)]


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_percentile_floor_against_sorting(spark, width):
    r = random.Random(1)
    data = [(g, float(r.randint(-20, 20))) for g in range(5) for _ in range(r.randint(50, 90))]
    got = dict(rows(S.percentile_floor(spark.createDataFrame(data, "g int, v double"), ["g"], "v", 0.3, width=width)))
    for g in range(5):
        v = sorted((x for k, x in data if k == g), reverse=True)
        assert got[g] == v[int(len(v) * 0.3)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)]
    got = dict(rows(G.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_conflicting_teams_are_not_merged(spark):
    groups = spark.createDataFrame([("n", t) for t in ("A", "B", "C")], "name string, team string")
    shared = spark.createDataFrame([("n", "A", "B"), ("n", "B", "C")], "name string, a string, b string")
    clash = spark.createDataFrame([("n", "C", "B")], "name string, a string, b string")
    assert rows(G.greedy_merge(groups, shared, "name", "team", clash)) == [("n", "A", "A"), ("n", "B", "A"), ("n", "C", "C")]


def test_clusters_are_placed_into_few_persons(spark):
    r = random.Random(17)
    clusters = [(n, f"c{k}", r.randrange(5)) for n in "pqr" for k in range(r.randrange(1, 8))]
    conflict = [(n, a, b) for n, a, _ in clusters for m, b, _ in clusters if n == m and a < b and r.random() < 0.5]
    want = []
    for n in "pqr":
        persons = []
        for _, c in sorted((-w, c) for m, c, w in clusters if m == n):
            fit = next((p for p in persons if not any((n, *sorted((c, o))) in conflict for o in p)), None)
            if fit is None:
                persons.append([c])
            else:
                fit.append(c)
        want += [(n, c, i) for i, p in enumerate(persons) for c in p]
    got = G.place_greedily(spark.createDataFrame(clusters, "n string, c string, w int"), spark.createDataFrame(conflict, "n string, a string, b string"), "n", "c", "w")
    assert rows(got, "n", "c", "person") == sorted(want, key=repr) and max(i for *_, i in want) >= 2


def test_opposites_spread_to_a_fixpoint(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    known = spark.createDataFrame([("a", "boys")], "node string, value string")
    assert rows(G.opposite_closure(pairs, known, ("boys", "girls"))) == [("a", "boys"), ("b", "girls"), ("c", "boys"), ("d", "girls")]


def test_depths_leave_cycles_out(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcdef"], "f int, node string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "e"), (1, "e", "d")], "f int, node string, previous string")
    assert rows(G.depths(edges, nodes, ["f"]), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None), ("f", 0)]


def test_depths_of_too_long_a_chain_are_an_error(spark):
    nodes = spark.createDataFrame([("x", i) for i in range(5)], "f string, node int")
    edges = nodes.where("node > 0").withColumn("previous", F.col("node") - 1)
    assert rows(G.depths(edges, nodes, ["f"], most=4), "node", "depth") == [(i, i) for i in range(5)]
    with pytest.raises(RuntimeError):
        G.depths(edges, nodes, ["f"], most=3)


def test_draw_with_a_seed_and_a_packed_pair(spark):
    e = spark.createDataFrame([(1, 1, "seed"), (1, 2, "packing"), (1, 3, "packing")], "d int, entry int, kind string")
    slots = G.draw_slots(e, ["d"], "entry", "kind")
    assert rows(slots, "entry", "slot") == [(1, 0), (2, 2), (3, 3)]
    results = spark.createDataFrame([(1, 3, 2), (1, 1, 3)], "d int, winner int, loser int")
    played = G.draw_winners(slots, results, ["d"], 2)
    assert rows(played.where("round > 0"), "round", "slot", "entry") == [(1, 0, 1), (1, 1, 3), (2, 0, 1)]


def brute_lifts(data, names, size):
    out = {}
    for s in itertools.combinations(sorted(names), size):
        u = [d for d in data if all(d[f] is not None for f in s)]
        for v in {tuple(d[f] for f in s) for d in u}:
            n = sum(all(d[f] == x for f, x in zip(s, v)) for d in u)
            e = float(len(u))
            for f, x in zip(s, v):
                e *= sum(d[f] == x for d in u) / len(u)
            out[" & ".join(f"{f}={x}" for f, x in zip(s, v))] = (n, len(u), round(e, 9))
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_lifts_against_brute_force(spark, size):
    r = random.Random(size)
    data = [{"a": r.choice("xy"), "b": r.choice(["p", "q", None]), "c": r.choice("uvw"), "d": r.choice(["1", None])} for _ in range(200)]
    df = spark.createDataFrame([tuple(d.values()) for d in data], "a string, b string, c string, d string")
    got = {r["pattern"]: (r["n"], r["universe"], round(r["expected"], 9)) for r in M.pattern_lifts(df, list("abcd"), size).collect()}
    assert got == brute_lifts(data, list("abcd"), size)


def test_rare_and_reducible_patterns(spark):
    data = [("x", "p", "u")] * 60 + [("y", "q", "u")] * 60 + [("x", "q", "v")] * 20 + [("y", "p", "v")] * 20 + [("x", "q", "u")]
    got = {r["pattern"]: r["verdict"] for r in M.rare_patterns(spark.createDataFrame(data, "a string, b string, c string"), list("abc"), 3, 3, 3.0, 0.9, 1.0).collect()}
    assert got == {"a=x & b=q & c=u": "rare"}


def test_validation_rules(spark):
    c = "cat string"
    people = spark.createDataFrame([("pair", "a"), ("pair", "b"), ("pair", "unused"), ("solo", "s"), ("solo", "t")], f"{c}, id string")
    entries = spark.createDataFrame([("pair", 1, ["a"]), ("pair", 2, ["b", "b"]), ("pair", 3, ["nobody", "a"]), ("solo", 1, ["s", "t"])], f"{c}, entry int, ids array<string>")
    matches = spark.createDataFrame([("pair", "m1", [1, 9])], f"{c}, match string, entries array<int>")
    results = spark.createDataFrame([("pair", 8)], f"{c}, entry int")
    slots = spark.createDataFrame([("pair", i, "G", 1, None if i == 2 else i) for i in range(3)], f"{c}, slot int, grp string, place int, entry int")
    found = Q.validate_entries(people, entries, matches, results, slots, ["cat"], F.col("cat") == "pair", F.col("cat") == "solo")
    assert sorted({r["rule"] for r in found.collect()}) == sorted("pair-single-player duplicate-player-id singles-multi-player unknown-participant orphan-participant match-entry-not-found result-entry-not-found knockout-draw-parity knockout-draw-unresolved".split())


def test_homonym_detectors(spark):
    x = spark.createDataFrame([("n", 2020, 1, 10, 12), ("n", 2020, 3, 14, 16), ("m", 2020, 1, 10, 12), ("m", 2020, 2, 11, 13)], "name string, y int, stage int, lo int, hi int")
    assert rows(Q.stage_conflicts(x, "name", "y", "stage"), "name") == [("n",)]
    assert rows(Q.empty_intersections(x, ["name"], "lo", "hi"), "name") == [("n",)]


def test_manifest_differences_fan_out(spark):
    old = spark.createDataFrame([("t/2020/a", "1"), ("t/2021/b", "1"), ("u/2020/c", "1"), ("info:t", "1"), ("v/2020/d", "1")], "key string, hash string")
    new = spark.createDataFrame([("t/2020/a", "1"), ("t/2021/b", "1"), ("u/2020/c", "2"), ("info:t", "2"), ("w/2022/e", "1")], "key string, hash string")
    d = I.difference(old, new)
    assert rows(d) == [("info:t", "changed"), ("u/2020/c", "changed"), ("v/2020/d", "removed"), ("w/2022/e", "added")]
    keys = I.affected_keys(d, old, new)
    assert rows(keys) == [("t/2020/a",), ("t/2021/b",), ("u/2020/c",), ("v/2020/d",), ("w/2022/e",)]
    assert rows(I.seasons_of(keys)) == [(2020,), (2021,), (2022,)]


def test_incremental_equals_full(spark):
    bridge = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "cat_key string, player int")
    fresh = spark.createDataFrame([("k1", 2), ("k1", 4), ("k2", 3)], "cat_key string, player int")
    now, affected = I.apply_delta(bridge, fresh, spark.createDataFrame([("k1",)], "cat_key string"), "cat_key", "player")
    assert rows(now) == rows(fresh)
    assert rows(affected) == [(1,), (2,), (4,)]
    assert I.needs_full_run({"engine": "1", "config": "a"}, "1", "b") == (False, True)


def sequential(matches):
    rating, played, won = {}, {}, {}
    for _, a, b, w, _ in matches:
        ra, rb = (sum(rating.get(p, 1500.0) for p in s) / len(s) for s in (a, b))
        change = 32.0 * (w - 1 / (1 + 10 ** ((rb - ra) / 400)))
        for side, sign, hit in ((a, 1, w), (b, -1, not w)):
            for p in side:
                rating[p], played[p], won[p] = rating.get(p, 1500.0) + sign * change, played.get(p, 0) + 1, won.get(p, 0) + hit
    return {p: (round(rating[p], 6), played[p], won[p]) for p in rating}


def test_periods_without_repeats_are_the_sequential_rating(spark):
    r = random.Random(9)
    data, n = [], 0
    for period in range(5):
        people = [f"p{i}" for i in range(12)]
        r.shuffle(people)
        for i in range(0, 12, 4):
            data.append((n, people[i : i + 2], people[i + 2 : i + 4], r.random() < 0.5, period))
            n += 1
    m = spark.createDataFrame([(p, i, a, b, w, "national") for i, a, b, w, p in data], "period long, match long, side_a array<string>, side_b array<string>, a_won boolean, tier string")
    ratings, upsets = E.period_ratings(m)
    assert {x[0]: (round(x[1], 6), x[2], x[3]) for x in rows(ratings)} == sequential(data)
    assert upsets.count() == 0


def test_upsets_need_established_players(spark):
    data = [(p, p * 2 + i, ["s"] if i == 0 else ["w"], ["f%d" % (p * 2 + i)], i == 0, "major") for p in range(12) for i in range(2)]
    data.append((12, 99, ["w"], ["s"], True, "major"))
    m = spark.createDataFrame(data, "period long, match long, side_a array<string>, side_b array<string>, a_won boolean, tier string")
    _, upsets = E.period_ratings(m, established=10, upset_chance=0.4, least_pool=1, top_share=0.05)
    assert [r["match"] for r in upsets.collect()] == [99]


def test_point_log(spark):
    games = spark.createDataFrame([(1, 1, 3, "A"), (1, 2, 3, "B"), (1, 3, 3, None)], "match int, game int, best_of int, winner string")
    points = spark.createDataFrame([(1, g, i, w, 3, False, "A") for g in (1, 2, 3) for i, w in enumerate("AABBA", 1)], "match int, game int, point int, winner string, rally int, double_fault boolean, serving string")
    x = P.reconstruct(points, games)
    assert rows(x.where("point = 1"), "game", "games_A", "games_B", "target", "final") == [(1, 0, 0, 4, False), (2, 1, 0, 4, False), (3, 1, 1, 7, True)]
    assert rows(x.where("game = 1"), "point", "before_A", "before_B") == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 2, 1), (5, 2, 2)]
    m = P.side_metrics(P.by_side(x), ["match", "side"])
    assert rows(m.where("metric = 'points'"), "side", "part", "whole") == [("A", 9, 15), ("B", 6, 15)]
    assert rows(m.where("metric = 'deciding_game' AND side = 'A'"), "part", "whole") == [(3, 5)]


def test_manifest_ignores_order_but_not_repeats(spark):
    x = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "a")], "key string, v int, at string")
    hashes = lambda d: dict(rows(I.manifest(d, F.col("key"), ["at"])))
    assert hashes(x) == hashes(x.orderBy(F.desc("v")).withColumn("at", F.lit("later")))
    assert hashes(x)["k"] != hashes(x.union(x.where("v = 1")))["k"] and hashes(x)["k"] != hashes(x)["l"]


def test_files_that_hold_all(spark):
    files = spark.createDataFrame([(1, 10, ["a", "b", "b"]), (1, 9, ["b", "a"]), (1, 11, ["a", "b", "c"]), (1, 5, None), (2, 3, ["a", "c"]), (2, 4, [])], "k int, file int, held array<string>")
    asked = spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["c", "a"]), (3, 1, ["a", "d"]), (4, 1, []), (5, 1, None), (6, 2, ["a", "a"]), (7, 3, ["a"]), (8, 2, [])], "row int, k int, wanted array<string>")
    got = J.holds_all(asked, files, ["k"], "wanted", "held", "file")
    assert sorted((r["row"], r["file"]) for r in got.collect()) == [(1, 9), (2, 11), (4, 9), (6, 3), (8, 3)]


def test_rows_of_equal_sets_meet(spark):
    x = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["b", "a"]), (4, ["c"]), (5, [])], "k int, m array<string>")
    assert rows(J.set_meetings(x, "k", "m"), "k", "meetings", "first_other") == [(1, 2, 2), (2, 2, 1), (3, 2, 1), (4, 0, None), (5, 0, None)]
