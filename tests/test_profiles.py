"""Dictionaries, labels of titles and rounds, turns on court and side profiles, against loops."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.functions import labels as L
from tallyspark.functions import text as X
from tallyspark.operators import points as P
from tallyspark.operators import terms as T


def looked_up(text, terms):
    """Hits that lie in no longer hit, by trying every run of words."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    hits = {(i, n): terms[" ".join(w[i : i + n])] for n in {len(t.split()) for t in terms} for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in terms}
    return {(i, n, " ".join(w[i : i + n]), v) for (i, n), v in hits.items() if not any((j, m) != (i, n) and j <= i and i + n <= j + m for j, m in hits)}


def test_dictionary_hits_against_a_loop(spark):
    r = random.Random(11)
    texts = [(k, " ".join(r.choices(["Red", "red,", "ball", "Court", "a-b", "Ö", "x"], k=r.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "red ball " * 3000)]
    rows = [("red ball", 1), ("red", 2), ("RED", 3), ("ball court a", 4), ("a b", 5), ("b", 6), ("ö x red ball red", 7), ("ball red", 8), ("--", 9), (None, 10), ("x", None)]
    args = spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(rows, "t string, v int"), "t", "v"
    got = T.dictionary_hits(*args)
    large = T.dictionary_hits(*args, broadcast_bytes=0)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, got.collect()))
    found = defaultdict(set)
    for x in got.collect():
        assert tuple(x[1:]) not in found[x["id"]]
        found[x["id"]].add(tuple(x[1:]))
    terms = {"red ball": 1, "red": 2, "ball court a": 4, "a b": 5, "b": 6, "ö x red ball red": 7, "ball red": 8}
    for k, text in texts:
        assert found[k] == looked_up(text, terms), text


def test_a_dictionary_without_terms_and_texts_that_lack_words(spark):
    texts = spark.createDataFrame([(1, "red ball"), (2, None)], "id long, text string")
    none = T.dictionary_hits(texts, "id", "text", spark.createDataFrame([("...", 1), (None, 2)], "t string, v int"), "t", "v")
    assert none.count() == 0 and none.columns == ["id", "place", "n_words", "phrase", "label"]
    assert T.dictionary_hits(texts.limit(0), "id", "text", spark.createDataFrame([("red", 1)], "t string, v int"), "t", "v").count() == 0


def test_terms_are_joined_by_equality(spark):
    texts, terms = spark.createDataFrame([(1, "red ball")], "id long, text string"), spark.createDataFrame([("red", 1), ("red ball", 2)], "t string, v int")
    plan = T.dictionary_hits(texts, "id", "text", terms, "t", "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_orders_of_rounds(spark):
    orders = dict(zip(L.LATE_NAMES, L.LATE_ROUNDS["coverage"], strict=True))
    rows = [("final", 10000, 0), ("semifinal", 9000, 1), ("quarterfinal", 8000, 2), ("A semifinal B", 9000, 1000), ("round 3", 3, 97), ("block 2 final", 2, 1000), ("", -1, 1000), (None, -1, 1000), ("group", 0, 1000), ("round " + "9" * 30, None, 1000)]
    got = spark.createDataFrame([r[:1] for r in rows], "x string").select("x", L.contained_order(F.col("x"), orders), L.list_rank(F.col("x"))).collect()
    assert [tuple(r) for r in got] == rows


def test_title_labels(spark):
    rows = [("令和5年 インハイ 女子シングルス", (2023, "singles", "women", "interhigh")), ("2021 MIXED Doubles", (2021, "doubles", "mixed", None)), ("団体 ミックス", (None, "team", "mixed", None)), ("women", (None, "unknown", "men", None)), ("", (None, "unknown", "unknown", None)), (None, (None, "unknown", "unknown", None))]
    got = spark.createDataFrame([r[:1] for r in rows], "x string").select(X.title_labels(F.col("x")).alias("t")).collect()
    assert [tuple(r["t"]) for r in got] == [r[1] for r in rows]  # "women" has "men" in it: patterns in order, as the rule says


def test_turns_against_a_count_of_points(spark):
    cases = [(n, first, final, a, b, s, r) for n in range(1, 18) for first in "AB" for final in (True, False) for a, b in ((1, 1), (2, 2), (1, 2)) for s in (0, 1, None) for r in (0, 1, None)]
    schema = "n long, first string, final boolean, a int, b int, s int, r int"
    got = spark.createDataFrame(cases, schema).select("*", L.court_turn(*map(F.col, ("n", "first", "final", "a", "b", "s", "r"))).alias("t")).collect()
    assert len(got) == len(cases)
    other = {"A": "B", "B": "A"}
    for row in got:
        n, first, final, a, b, s, r, t = row
        serves = lambda k: other[first] if final and (k - 1) // 2 % 2 else first  # noqa: B023, E731
        size = {"A": a, "B": b}
        served = sum(serves(k) == serves(n) for k in range(1, n))
        received = sum(serves(k) == serves(n) for k in range(1, n))
        server = 0 if size[serves(n)] == 1 else ((s or 0 if serves(n) == first else 0) + served // 2) % 2
        receiver = 0 if size[other[serves(n)]] == 1 else ((r or 0 if serves(n) == first else 0) + received) % 2
        assert tuple(t) == (serves(n), server, other[serves(n)], receiver), row


def profile(points, winners, best_of, side):
    """One side's metrics by walking its points in order."""
    part, whole = defaultdict(int), defaultdict(int)
    won_games, streak = {"A": 0, "B": 0}, 0
    you = "B" if side == "A" else "A"
    for game in sorted(winners):
        last = won_games["A"] == won_games["B"] == best_of // 2
        target, score, led = 7 if last else 4, {"A": 0, "B": 0}, False
        for p in sorted((p for p in points if p[0] == game), key=lambda p: p[1]):
            _, _, w, serving, rally, fault, double = p
            own, opp = score[side], score[you]
            at = {
                "on_serve": serving == side, "first_serve": serving == side and not fault, "second_serve": serving == side and fault, "on_return": serving == you,
                "two_all": own == opp == 2, "deuce": own == opp >= target - 1, "game_point": own + 1 >= target and own + 1 - opp >= 2, "game_point_saved": opp + 1 >= target and opp + 1 - own >= 2,
                "deciding_game": last, "after_two_lost": streak >= 2, "short_rally": not double and 1 <= rally <= 2, "middle_rally": not double and 3 <= rally <= 5, "long_rally": not double and rally > 5,
            }
            for m, yes in at.items():
                whole[m] += yes
                part[m] += yes and w == side
            whole["first_serve_in"] += serving == side
            whole["double_fault"] += serving == side
            part["first_serve_in"] += serving == side and not fault
            part["double_fault"] += serving == side and double
            if w == side:
                streak = 0
            elif w:
                streak += 1
                part["lost_longest"] = max(part["lost_longest"], streak)
                part["lost_three"] += streak == 3
                part["lost_four"] += streak == 4
            if w:
                score[w] += 1
            led = led or score[side] - score[you] >= 2
        whole["lead_held"] += led
        part["lead_held"] += led and winners[game] == side
        if winners[game]:
            won_games[winners[game]] += 1
    return part, whole


def test_side_profiles_against_a_walk(spark):
    r = random.Random(4)
    points, games, want, seen = [], [], {}, defaultdict(int)
    for match in range(25):
        mine, winners = [], {}
        for game in range(1, r.randint(2, 6)):
            mine += [(game, k, r.choice(["A", "B", "B", None] if match % 2 else ["A", "A", "B"]), r.choice("AB"), r.randint(0, 9), r.random() < 0.4, r.random() < 0.2) for k in range(1, r.randint(2, 16))]
            winners[game] = r.choice(["A", "B", None] if game > 2 else "AB")
        points += [(match, *p) for p in mine]
        games += [(match, g, 5 if match % 3 else 3, w) for g, w in winners.items()]
        for side in "AB":
            want[match, side] = profile(mine, winners, 5 if match % 3 else 3, side)
    df = spark.createDataFrame(points, "match int, game int, point int, winner string, serving string, rally int, first_serve_fault boolean, double_fault boolean")
    rows = P.side_profile(df, spark.createDataFrame(games, "match int, game int, best_of int, winner string"))
    got = rows.collect()
    assert len(got) == 25 * 2 * 19
    for x in got:
        part, whole = want[x["match"], x["side"]]
        assert (x["part"], x["whole"]) == (part[x["metric"]], None if x["metric"].startswith("lost_") else whole[x["metric"]]), x
        seen[x["metric"]] += x["part"]
    assert len(seen) == 19 and all(seen.values())
    one = {(x["match"], x["metric"]): x for x in P.both_sides(rows).collect()}
    assert len(one) == 25 * 19 and all((one[x["match"], x["metric"]]["part_" + x["side"].lower()], one[x["match"], x["metric"]]["whole_" + x["side"].lower()]) == (x["part"], x["whole"]) for x in got)
