"""History operators on hand-made cases and against loops."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import history as H
from tallyspark.operators.points import ERRORS


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_fates_of_pairs(spark):
    before = spark.createDataFrame([(p, m) for p, ms in {"in": "ab", "half": "cd", "apart": "ef", "gone": "gh"}.items() for m in ms], "pair string, m string")
    field = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("e", 3), ("f", 4), ("x", 5)], "m string, entry int")
    assert rows(H.pair_fates(before, field, ["pair"], "m", "entry"), "pair", "fate") == [("apart", "split"), ("gone", "absent"), ("half", "partial"), ("in", "intact")]


def test_unknown_champions_keep_their_edition(spark):
    e = spark.createDataFrame([("c", y, w, n) for y, w, n in ((2020, True, "a"), (2021, False, "b"), (2022, True, "a"), (2023, True, "a"))], "cup string, y int, won boolean, n string")
    t = H.title_defence(H.champions(e, e, ["cup"], "y", F.col("won"), "n"), ["cup"], "y")
    assert rows(t, "y", "champion", "defended") == [(2020, "a", None), (2021, None, None), (2022, "a", None), (2023, "a", True)]


def loop_types(entries, pairs):
    frames, i = [], 0
    while i < len(entries):
        if i + 1 < len(entries) and (entries[i], entries[i + 1]) in pairs:
            frames.append(entries[i : i + 2])
            i += 2
        else:
            frames.append(entries[i : i + 1])
            i += 1
    if len(frames) & (len(frames) - 1):
        return dict.fromkeys(entries)
    out = {}
    for k, f in enumerate(frames):
        other = frames[k ^ 1] if k ^ 1 < len(frames) else []
        for e in f:
            out[e] = "packing" if len(f) == 2 else "seed" if len(other) == 2 else "extra"
    return out


def test_entry_types_against_a_loop(spark):
    r = random.Random(6)
    entries, pairs, want = [], [], {}
    for d in range(60):
        e = sorted(r.sample(range(100), r.randint(1, 12)))
        p = {(a, b) for a, b in zip(e, e[1:]) if r.random() < 0.5}
        entries += [(d, x) for x in e]
        pairs += [(d, *(x if r.random() < 0.5 else x[::-1])) for x in p]
        want |= {(d, x): t for x, t in loop_types(e, p).items()}
    got = H.entry_types(spark.createDataFrame(entries, "d int, e long"), spark.createDataFrame(pairs, "d int, p long, q long"), ["d"], "e")
    assert {(r["d"], r["e"]): r["type"] for r in got.collect()} == want
    assert {"packing", "seed", "extra", None} == set(want.values())


def test_points_are_inferred_rule_by_rule(spark):
    schema = "id int, serving_team string, winner_team string, winner_player string, loser_player string, rally_count int, first_serve_fault boolean, result string, ctx_serving_team string, ctx_server string, ctx_receiver string"
    data = [
        (1, None, None, None, None, None, None, "service_ace", "A", "A-0-x", "B-0-y"),
        (2, None, None, None, None, None, None, "double_fault", "A", "A-0-x", "B-0-y"),
        (3, None, None, None, None, None, None, "receive_error", "B", "B-0-y", "A-0-x"),
        (4, "B", None, None, "A-1-z", 7, None, "net", "A", None, None),
        (5, None, "A", None, None, None, None, "smash_winner", None, None, None),
        (6, None, None, "B-0-y", None, 3, False, "smash_winner", None, None, None),
    ]
    got = {r["id"]: tuple(r)[1:7] for r in H.infer_point(spark.createDataFrame(data, schema), ERRORS).collect()}
    assert got == {
        1: ("A", "A", "A-0-x", None, 1, None),
        2: ("A", "B", None, "A-0-x", 1, True),
        3: ("B", "B", None, "A-0-x", 2, None),
        4: ("B", "B", None, "A-1-z", 7, None),
        5: (None, "A", None, None, None, None),
        6: (None, "B", "B-0-y", None, 3, False),
    }


def test_abandoned_categories(spark):
    x = spark.createDataFrame([("four", "ongoing")] * 4 + [("four", "round"), ("odd", "ongoing"), ("odd", "winner")], "c string, k string")
    assert rows(H.abandoned(x, ["c"], "k", F.lit(3)), "c", "final_kind", "final_round") == [("four", "best4", None)] * 4 + [("four", "round", None), ("odd", "round", 3), ("odd", "winner", None)]


def test_pathways_need_a_plausible_gap(spark):
    j = spark.createDataFrame([("a", 2018, "J1"), ("a", 2017, "J0"), ("b", 2010, "J2"), ("c", 2018, None), ("d", 2018, "J3")], "n string, y int, t string")
    s = spark.createDataFrame([("a", 2019, "S1"), ("b", 2019, "S2"), ("c", 2019, "S3"), ("d", 2019, "S4")], "n string, y int, t string")
    twins = spark.createDataFrame([("d",)], "n string")
    assert rows(H.pathways(j, s, "n", "y", "t", twins), "n", "junior_team", "senior_team") == [("a", "J1", "S1")]
