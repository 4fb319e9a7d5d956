"""Hints, cards and review points against a plain Python reading of the same rules."""

import random
from collections import Counter, defaultdict

import pytest

from tallyspark.operators import guidance as U
from tallyspark.operators.points import ERRORS, WINNERS

POINTS = "match long, game long, point long, winner string, serving string, rally int, double_fault boolean, first_serve_fault boolean, result string, loser_player string"


def log(seed, matches=12):
    r = random.Random(seed)
    rows, games = [], []
    for m in range(matches):
        for g in range(1, r.randint(2, 6)):
            games.append((m, g, 5, r.choice("AB")))
            for p in range(1, r.randint(2, 14)):
                w = r.choices(["A", "B", None], [4 + m % 5, 5, 1])[0]
                loser = None if w is None or r.random() < 0.2 else ("B" if w == "A" else "A") + r.choice("xxy")
                rows.append((m, g, p, w, r.choice(["A", "B", None]), r.choice([None, *range(14)]), r.random() < 0.1, r.choice([True, False, None]), r.choice([None, "odd", *ERRORS[:4], *WINNERS[:2]]), loser))
    return rows, games


def plain(rows, games, players):
    """Facts, hints and longest lost runs, one match and side after the other."""
    best = {(m, g): (b, w) for m, g, b, w in games}
    by_match = defaultdict(list)
    for x in sorted(rows, key=lambda x: x[:3]):
        by_match[x[0]].append(x)
    hints, cards = {}, {}
    for m, points in by_match.items():
        won_games, state, seen = {"A": 0, "B": 0}, {}, []
        for g in sorted({x[1] for x in points}):
            b, gw = best[m, g]
            target = 7 if won_games["A"] == won_games["B"] == b // 2 else 4
            score = {"A": 0, "B": 0}
            for x in (x for x in points if x[1] == g):
                seen.append((x, dict(score), target))
                if x[3]:
                    score[x[3]] += 1
            won_games[gw] += 1
        for side, foe in ("AB", "BA"):
            n = Counter()
            run = longest = 0
            errors, losers = Counter(), Counter()
            members = {p for a, b, p in players if (a, b) == (m, side)}
            for (_, _, _, w, serving, rally, df, fault, result, loser), score, target in seen:
                gp = lambda s, o: score[s] + 1 >= target and score[s] + 1 - score[o] >= 2  # noqa: B023, E731
                rally = None if df else rally
                among = {
                    "points": True, "first_serve_points": serving == side and not fault, "second_serve_points": serving == side and bool(fault), "receive_points": serving == foe,
                    "rally_short": rally is not None and rally <= 4, "rally_medium": rally is not None and 5 <= rally <= 8, "rally_long": rally is not None and rally >= 9,
                    "game_points": gp(side, foe), "saved_game_points": gp(foe, side),
                }
                for k, hit in among.items():
                    n["w", k] += hit
                    n["p", k] += hit and w == side
                n["w", "first_serve_in"] += serving == side
                n["p", "first_serve_in"] += serving == side and not fault
                n["df"] += serving == side and df
                n["winners"] += result in WINNERS and w == side
                n["gifts"] += result in ERRORS and w == side
                run = run + 1 if w == foe else 0
                longest = max(longest, run)
                if w == foe and result in ERRORS:
                    errors[result] += 1
                    if loser in members and len(members) > 1:
                        losers[loser] += 1
            rate = lambda k: n["p", k] * 100.0 / n["w", k] if n["w", k] else None  # noqa: B023, E731
            found = []

            def add(rule, detail, part, whole, fires, strong, sample, least, priority):
                if fires and whole:
                    found.append((rule, detail, part, whole, "low" if sample < least else "high" if strong and sample >= 2 * least else "medium", round(priority, 6)))  # noqa: B023

            for k, limit, drop, least, strong, base, cap in (
                ("first_serve_in", 55, None, 5, 45, 48, 12), ("first_serve_points", 45, 12, 5, None, 52, 12), ("second_serve_points", 40, None, 3, 30, 56, 0), ("receive_points", 40, 12, 5, None, 44, 12),
                ("rally_short", 40, 12, 5, None, 42, 10), ("rally_medium", 40, 12, 5, None, 42, 10), ("rally_long", 40, 12, 5, None, 42, 10), ("game_points", 40, 12, 3, None, 50, 8), ("saved_game_points", 35, None, 3, 25, 45, 8),
            ):
                v, whole = rate(k), n["w", k]
                if not whole:
                    continue
                fall = rate("points") - v
                extra = n["df"] if k == "second_serve_points" else 0
                fires = v < limit or (drop is not None and fall >= drop) or extra >= 2
                if k == "first_serve_points" and (rate("first_serve_in") or 0) < 55:
                    fires = False
                strong = fall >= drop if drop is not None else v < strong or extra >= 3
                add(k, None, n["p", k], whole, fires, strong, whole + extra, least, base + max(fall if drop is not None else limit - v, 0) + 4 * extra + min(whole, cap))
            add("lost_streak", None, longest, len(seen), longest >= 5, longest >= 7, longest, 5, 54 + 3 * longest)
            for counts, rule, limit, strong, base, top in ((errors, "error_share", 40, 55, 40, 2), (losers, "player_share", 60, 70, 38, 1)):
                whole = sum(counts.values())
                for name, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]:
                    v = c * 100.0 / whole
                    add(rule, name, c, whole, c >= 3 and v >= limit, v >= strong, c, 3, base + v / 2 + 3 * c)
            hints[m, side] = sorted(found, key=lambda x: (-x[5], x[0], x[1] or ""))
            s, long = rate("rally_short"), rate("rally_long")
            low = min(n["w", "rally_short"], n["w", "rally_long"]) < 5
            cards[m, side] = {
                "rallies": None if low else "short ones" if s - long >= 10 else "long ones" if s - long <= -10 else "alike",
                "endings": "own winners" if n["winners"] - n["gifts"] >= 3 else "errors of the other" if n["winners"] - n["gifts"] <= -3 else "alike",
                "momentum": "long streak lost" if longest >= 5 else "look at pauses",
                "service": None if n["w", "first_serve_points"] < 5 else "wins points" if rate("first_serve_points") >= 60 else "look at what follows" if rate("first_serve_points") < 45 else "look at the start",
                "key_moments": None if n["w", "game_points"] < 3 else "takes them" if rate("game_points") >= 50 else "look at them",
            }
    return hints, cards


@pytest.fixture(scope="module")
def guided(spark):
    rows, games = log(5, 40)
    players = [(m, s, s + p) for m in range(40) for s in "AB" for p in ("xy" if m % 3 else "x")]
    points = spark.createDataFrame(rows, POINTS)
    g = spark.createDataFrame(games, "match long, game long, best_of long, winner string")
    sides, streaks = U.sides_of(points, g), U.lost_streaks(points)
    facts = U.side_facts(sides, streaks, spark.createDataFrame(players, "match long, side string, player string"))
    return rows, games, players, sides, streaks, facts


def test_all_hints_and_cards_follow_the_rules(guided):
    rows, games, players, _, _, facts = guided
    hints, cards = plain(rows, games, players)
    got = defaultdict(list)
    for r in U.improvement_hints(facts, most=None).collect():
        got[r.match, r.side].append((r.rule, r.detail, r.part, r.whole, r.confidence, r.priority))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in hints.items() if v}
    assert {x[0] for v in hints.values() for x in v} == {r.rule for r in U.RULES}
    top = defaultdict(list)
    for r in U.improvement_hints(facts).orderBy("place").collect():
        top[r.match, r.side].append(r.rule)
    assert dict(top) == {k: [x[0] for x in v[:3]] for k, v in hints.items() if v}
    verdicts = defaultdict(dict)
    for r in U.guide_cards(facts).collect():
        verdicts[r.match, r.side][r.card] = r.verdict
        assert (r.verdict is None) == (r.reliability != "ok")
    assert dict(verdicts) == cards


def test_review_points_belong_to_their_hints(guided):
    rows, _, _, sides, streaks, facts = guided
    hints = U.improvement_hints(facts)
    told = {(h.match, h.side, h.rule, h.detail) for h in hints.collect()}
    found = U.review_points(sides, streaks, hints).collect()
    assert {(r.match, r.side, r.rule, r.detail) for r in found} <= told
    assert len(found) == len({tuple(r) for r in found})
    at = {x[:3]: x for x in rows}
    order = {m: sorted(k for k in at if k[0] == m) for m in {x[0] for x in rows}}
    runs = {(r.match, r.side): r.length for r in streaks.collect()}
    by_group = defaultdict(set)
    for r in found:
        by_group[r.match, r.side, r.rule, r.detail, r.review].add((r.match, r.game, r.point))
    for m, side, rule, detail in told:
        foe = "B" if side == "A" else "A"
        if rule == "lost_streak":
            inside = sorted(by_group[m, side, rule, None, "in it"])
            first, last = order[m].index(inside[0]), order[m].index(inside[-1])
            assert last - first + 1 == len(inside) == runs[m, side] and all(at[k][3] == foe for k in inside)
            assert by_group[m, side, rule, None, "before"] == set(order[m][max(first - 1, 0) : first])
            assert by_group[m, side, rule, None, "after"] == set(order[m][last + 1 : last + 2])
        if rule == "error_share":
            ends = [i for i, k in enumerate(order[m]) if at[k][3] == foe and at[k][8] == detail]
            assert by_group[m, side, rule, detail, "before"] == {order[m][i - 1] for i in ends if i}
            assert by_group[m, side, rule, detail, "serving"] == {order[m][i] for i in ends if at[order[m][i]][4] == side}
        if rule == "player_share":
            assert by_group[m, side, rule, detail, "ended"] == {k for k in order[m] if at[k][3] == foe and at[k][8] in ERRORS and at[k][9] == detail}


def test_cards_need_no_nested_loop(guided):
    *_, facts = guided
    plan = U.guide_cards(facts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_empty_log(spark):
    points = spark.createDataFrame([], POINTS)
    games = spark.createDataFrame([], "match long, game long, best_of long, winner string")
    sides, streaks = U.sides_of(points, games), U.lost_streaks(points)
    facts = U.side_facts(sides, streaks, spark.createDataFrame([], "match long, side string, player string"))
    hints = U.improvement_hints(facts)
    assert not hints.take(1) and not U.guide_cards(facts).take(1) and not U.review_points(sides, streaks, hints).take(1)
