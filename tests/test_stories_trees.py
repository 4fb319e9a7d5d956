"""Stories of draws, lift lattices, chains, draw trees, merging under constraints, committed candidates and stored meetings on small cases."""

import datetime
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tallyspark.operators import mining as M
from tallyspark.operators import review as R
from tallyspark.operators import stories as S
from tallyspark.operators import trees as T


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


MATCH = "cup long, yr long, round long, winner long, loser long, final long"
MEMBER = "cup long, yr long, entry long, player string, team string"


def played(order, yr, upto=9):
    """Matches of a draw of 8 in which the entry that comes first in `order` wins; rounds after `upto` are undecided."""
    out, now = [], list(range(8))
    for r in (1, 2, 3):
        pairs = [sorted(now[k : k + 2], key=order.index) for k in range(0, len(now), 2)]
        out += [(1, yr, r, w if r <= upto else None, lo, 3) for w, lo in pairs]
        now = [w for w, _ in pairs]
    return out


def test_a_half_played_draw(spark):
    # 2000: 0 wins, 4 loses the final, 2 and 6 come third. 2001: two rounds of three are decided, and 4 and 3 are left.
    matches = spark.createDataFrame(played([0, 4, 2, 6, 1, 3, 5, 7], 2000) + played([4, 3, 2, 0, 6, 1, 5, 7], 2001, 2), MATCH)
    members = spark.createDataFrame([(1, y, e, f"p{e}", f"t{e % 4}") for y in (2000, 2001) for e in range(8)] + [(1, 2001, 9, "p9", "t1")], MEMBER)
    front = {r["entry"]: (r["state"], r["won_at"], r["lost_at"], r["lost_to"], r["remaining"], r["guaranteed"], r["as_of"]) for r in S.frontier(members.where("yr = 2001"), matches.where("yr = 2001"), ["cup"]).collect()}
    # Entry 9 has no match, so three are left as far as one can tell.
    assert front[9] == ("unknown", None, None, None, 3, 80, 2)
    assert front[4] == ("alive", 2, None, None, 3, 80, 2) and front[0] == ("out", 1, 2, 3, 3, 80, 2)
    placed = S.placings(matches, ["cup", "yr"])
    assert rows(placed.where("yr = 2000"), "entry", "score") == [(0, 100), (1, 70), (2, 80), (3, 70), (4, 90), (5, 70), (6, 80), (7, 70)]
    players, teams = (S.history_of(placed, members, ["cup", "yr"], n) for n in ("player", "team"))
    got = rows(S.in_progress(members, matches, players, teams, 2001), *S.STORY[1:])
    kinds = Counter(g[0] for g in got)
    assert kinds == {"watched-eliminated": 6, "watched-advancing": 2, "watched-self-best": 1, "watched-title-watch": 1, "watched-school-peak": 2, "watched-school-progress": 4}
    assert ("watched-eliminated", "p0", 2, 1, None, 3) in got and ("watched-advancing", "p4", 2, None, None, None) in got
    # 4 had come second, so being among the last four is no best yet; for 3 it is.
    assert ("watched-self-best", "p3", 2, 80, 70, 0) in got
    assert ("watched-title-watch", "t0", None, 80, 2000, 1) in got
    assert {g[1] for g in got if g[0] == "watched-school-peak"} == {"t1", "t3"}
    assert ("watched-school-progress", "t1", None, 0, 2, 1) in got and ("watched-school-progress", "t3", None, 1, 1, 0) in got
    # A cup without an earlier edition has none.
    assert S.in_progress(members.where("yr = 2001"), matches.where("yr = 2001"), players.where("false"), teams.where("false"), 2001).count() == 0


def test_runs_and_rematches(spark):
    matches = spark.createDataFrame([m for y in range(1997, 2001) for m in played([0, 4, 2, 6, 1, 3, 5, 7] if y < 2000 else [4, 0, 2, 6, 1, 3, 5, 7], y)], MATCH)
    members = spark.createDataFrame([(1, y, e, f"p{e}", f"t{e % 4}") for y in range(1997, 2001) for e in range(8)], MEMBER)
    placed = S.placings(matches, ["cup", "yr"])
    players, teams = (S.history_of(placed, members, ["cup", "yr"], n) for n in ("player", "team"))
    got = rows(S.finished(matches, players, teams, 2000), *S.STORY[1:])
    assert Counter(g[0] for g in got) == {"best8-streak": 8, "school-best8-streak": 4, "pair-rematch": 7}
    assert ("pair-rematch", "0,4", 3, 1999, 3, 1) in got and ("pair-rematch", "0,1", 1, 1999, 1, 0) in got
    assert rows(S.both_events(teams.where("name <> 't1' or yr <> 1999"), teams, 2000), "subject", "value", "prior") == [("t0", 4, 1997), ("t2", 4, 1997), ("t3", 4, 1997)]


def test_lattices_against_counting(spark):
    r = random.Random(5)
    features = ["d", "a", "c", "b"]
    data = [(r.choice("xy"), *(r.choice([None, "0", "1", "1", "2"]) for _ in features)) for _ in range(400)]
    df = spark.createDataFrame(data, "scope string, d string, a string, c string, b string")
    want, stats = {}, {}
    for scope in "xy":
        mine = [dict(zip(features, row[1:])) for row in data if row[0] == scope]
        for k in (2, 3, 4):
            for s in combinations(sorted(features), k):
                universe = [x for x in mine if all(x[f] is not None for f in s)]
                marginal = Counter((f, x[f]) for x in universe for f in s)
                for values, n in Counter(tuple(x[f] for f in s) for x in universe).items():
                    product = 1
                    for f, v in zip(s, values):
                        product *= marginal[f, v]
                    power = len(universe) ** (k - 1)
                    stats[scope, tuple(zip(s, values))] = (n, len(universe), product / power, n * power / product)
    for (scope, atoms), (n, u, e, lift) in stats.items():
        if n > 6:
            continue
        k = len(atoms)
        rare = e >= 3 and lift <= 0.9 * 0.9 ** (k - 2)
        low = any((p := stats.get((scope, sub))) and p[0] <= 6 and p[3] <= 0.9 * 0.9 ** (k - 3) for sub in combinations(atoms, k - 1)) if k > 2 else False
        want[scope, " & ".join(f"{f}={v}" for f, v in atoms)] = (n, u, round(e, 9), round(lift, 9), "reducible" if rare and low else "rare" if rare else "complex")
    got = M.rare_patterns(df, features, 4, 6, 3.0, 0.9, 0.9, scope=["scope"])
    assert {(x["scope"], x["pattern"]): (x["n"], x["universe"], round(x["expected"], 9), round(x["lift"], 9), x["verdict"]) for x in got.collect()} == want
    assert {v[4] for v in want.values()} >= {"rare", "complex"} and any(p.count("&") == 3 for _, p in want)


def test_halves_are_rounded_from_whole_numbers(spark):
    x = spark.createDataFrame([(94395, 100000), (1, 2), (0, 7), (1, 20000), (10**12, 3)], "a long, b long")
    assert [r[0] for r in x.select(M.rounded_share(F.col("a"), F.col("b"), 4)).collect()] == [0.944, 0.5, 0.0, 0.0001, 333333333333.3333]


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(k, k - 1) for k in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (103, 101), (200, 200), (201, None), (202, 999)], "name long, target long")
    got = {r["name"]: tuple(r)[1:] for r in T.resolve_chains(links, "name", "target").collect()}
    assert all(got[k] == (0, k, False) for k in range(1, 70))
    assert all(got[k] == (None, None, True) for k in range(100, 104))
    assert got[200] == (200, 0, False) and got[201] == (201, 0, False) and got[202] == (999, 1, False)


def test_trees_from_next_matches(spark):
    # A draw of 4 with a bye, a match for third place, and two matches that lead to each other.
    m = [(1, 10, 12, 1, 2, 1, 1), (1, 11, 13, 3, 4, 4, 1), (1, 12, 13, 5, 1, 1, 2), (1, 13, None, 4, 1, 1, 3), (1, 14, None, 3, 5, 3, 2), (1, 20, 21, 7, 8, 7, 1), (1, 21, 20, 7, 9, 7, 2)]
    tree = T.match_tree(spark.createDataFrame(m, "draw long, match long, next long, a long, b long, winner long, round long"), ["draw"])
    assert rows(tree, "match", "depth", "prefix") == [(10, 2, 3), (11, 1, 0), (12, 1, 1), (13, 0, 0), (14, 0, None), (20, 0, None), (21, 0, None)]
    slots = T.tree_slots(tree, ["draw"])
    assert rows(slots, "entry", "slot", "height") == [(1, 6, 3), (2, 7, 3), (3, 0, 3), (4, 2, 3), (5, 4, 3)]
    # The match of 3 and 4 says round 1, but meets in what is round 2 of a draw of this height.
    assert rows(T.verify_slots(tree.where("prefix is not null"), slots, ["draw"])) == [(1, 3, 1)]


def test_merging_stops_at_conflicts(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 4), ("c", "d", 3), ("e", "f", 1)], "a string, b string, weight long")
    apart = spark.createDataFrame([("a", 1), ("d", 1)], "node string, conflict long")
    order = [-F.col("weight"), F.col("a"), F.col("b")]
    # Components would put a and d together; here the weakest link on the way gives.
    assert rows(T.merge_apart(nodes, edges, apart, order)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")]
    r = random.Random(8)
    for _ in range(3):
        names = [f"n{k:02}" for k in range(14)]
        links = {tuple(sorted(r.sample(names, 2))): r.randrange(3) for _ in range(25)}
        groups = [(r.choice(names), r.randrange(6)) for _ in range(12)]
        cluster = {n: n for n in names}
        for (a, b), _ in sorted(links.items(), key=lambda e: (-e[1], e[0])):
            x, y = cluster[a], cluster[b]
            held = lambda c: {g for n, g in groups if cluster[n] == c}
            if x != y and not held(x) & held(y):
                cluster = {n: min(x, y) if c in (x, y) else c for n, c in cluster.items()}
        got = T.merge_apart(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a string, b string, weight long"), spark.createDataFrame(groups, "node string, conflict long"), order)
        assert dict(rows(got)) == cluster



def test_evidence_is_read_once_however_many_rounds(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for x in batches:
            seen.add(len(x))
            yield x

    names = [f"n{k:03}" for k in range(8)]
    links = [(a, b, -k) for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    edges = spark.createDataFrame(links, "a string, b string, weight long").mapInPandas(told, "a string, b string, weight long")
    # A round joins one pair, as the best link is always the next one of the chain.
    got = T.merge_apart(spark.createDataFrame([(n,) for n in names], "node string"), edges, spark.createDataFrame([("n000", 1), ("n007", 1)], "node string, conflict long"), [-F.col("weight")])
    assert dict(rows(got)) == {n: "n000" if n < "n007" else n for n in names} and seen.value == len(links)


def test_alias_evidence(spark):
    data = [("kim", 1, "e1", "North High"), ("kim", 1, "e2", "North"), ("lee", 1, "e1", "North"), ("lee", 1, "e1", "South"), ("lee", 1, "e2", "North High"), ("ito", 1, "e1", "Ab"), ("ito", 1, "e2", "Cd")]
    edges, apart = T.alias_edges(spark.createDataFrame(data, "person string, yr long, event string, team string"), ["person", "yr"], "event", "team")
    assert rows(edges) == [("North", "North High", 1)]
    assert sorted(r[0] for r in rows(apart)) == ["North", "South"] and len({r[1] for r in rows(apart)}) == 1


def plain_commit(winners, best_of):
    game, a, b, wa, wb, out = 1, 0, 0, 0, 0, []
    for i, w in winners:
        if w not in ("A", "B"):
            continue
        if max(wa, wb) > best_of // 2:
            break
        out.append((i, game, a + b + 1, w))
        a, b = a + (w == "A"), b + (w == "B")
        if max(a, b) >= (7 if wa + wb == best_of - 1 else 4) and abs(a - b) > 1:
            game, wa, wb, a, b = game + 1, wa + (w == "A"), wb + (w == "B"), 0, 0
    return out


def test_batch_and_stream_commit_the_same(spark, tmp_path):
    r = random.Random(3)
    sessions = {s: [(i, r.choice(["A", "B", "A" if s % 2 else "B", None])) for i in range(r.choice([0, 3, 60, 200]))] for s in range(12)}
    data = [(s, i, w) for s, x in sessions.items() for i, w in x]
    want = sorted((s, *p) for s, x in sessions.items() for p in plain_commit(x, 5))
    df = spark.createDataFrame(data, "session long, id long, winner string")
    assert rows(R.commit_candidates(df, ["session"], ["id"], "id", "winner", 5)) == sorted(want, key=repr)
    for k, part in enumerate(("id < 40", "id >= 40")):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = R.commit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 5)
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(want, key=repr)


def test_stored_meetings_are_not_moved(spark):
    m = spark.createDataFrame([(1, 2, "2000-03-01", "y", "s"), (2, 1, "2000-09-01", None, "t"), (1, 2, "1998-01-01", "y", "s"), (1, 2, "2000-12-01", "o", "s"), (3, 3, "2000-01-01", "y", "s")], "a long, b long, day string, generation string, series string").withColumn("day", F.to_date("day"))
    index = R.store_meetings(m, "a", "b", "meetings_of_a_test", 8)
    asked = spark.createDataFrame([(1, 2, "2001-01-01", "y", "s", "1998-01-01", 7)], "low long, high long, day string, generation string, series string, previous string, k long").withColumn("day", F.to_date("day")).withColumn("previous", F.to_date("previous"))
    found = R.prior_meetings(asked, index, ["k"])
    assert [str(r["prior_day"]) for r in found.orderBy("prior_day").collect()] == ["1998-01-01", "2000-03-01", "2000-09-01"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("meetings_of_a_test") - 2500 :]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, side
    spark.sql("DROP TABLE meetings_of_a_test")


def test_meetings_are_counted_without_pairs(spark):
    r = random.Random(5)
    # Month ends, a leap day, ties on a day, unknown generations and series, days asked about on which the pair didn't meet.
    days = [datetime.date(y, m, x) for y in (2003, 2004, 2005) for m, x in ((2, 27), (2, 28), (3, 1), (3, 31), (9, 30), (10, 1))] + [datetime.date(2004, 2, 29)]
    met = [(r.randrange(3), r.randrange(3), r.choice(days), r.choice(["y", "o", None]), r.choice(["s", "t", None]), r.random() < 0.5) for _ in range(400)]
    asked = [(*sorted(r.sample(range(3), 2)), r.choice(days), r.choice(["y", "o", "x", None]), r.choice(["s", "t", None]), r.choice([*days, None]), k) for k in range(300)]
    m = spark.createDataFrame(met, "a long, b long, day date, generation string, series string, won boolean").where("a <> b").withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).drop("a", "b")
    q = spark.createDataFrame(asked, "low long, high long, day date, generation string, series string, previous date, k long")
    want = R.prior_meetings(q, m, ["k"]).groupBy("k").agg(F.count("*").alias("meetings"), F.max("prior_day").alias("last_day"), F.count_if("prior_won").alias("won"))
    index = m.groupBy("low", "high", "day", "generation", "series").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))
    assert rows(R.count_prior_meetings(q, index, ["k"])) == rows(want)
