"""Titles and major results by a list of tournaments, against loops over rows."""

import random
from collections import defaultdict
from datetime import date

import pytest

from tallyspark.operators import titles as T

SCHEMA = "person string, tournament string, category string, discipline string, year int, date date, placement string, entry long"
LIST = [("t1", "Open", "Opn", "school"), ("t2", "Cup", "Cup", None), ("t3", "Games", "Gms", "senior"), ("t4", "Trophy", "Try", "other")]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(8)
    rows = []
    for k in range(900):
        year = r.randint(2000, 2012)
        rows.append((r.choice("abcdefg"), f"t{r.randint(1, 6)}", r.choice(["x", "y"]), r.choice(["singles", "doubles", "", None]), year, r.choice([None, date(year, r.randint(1, 12), 1)]), r.choice(["winner", "winner", "runnerup", "best4", "best8", "round", None]), k))
    rows.append(("z", "t9", "x", "singles", 2001, None, "winner", 1000))
    return rows, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LIST, "tournament string, label string, short string, major string")


def test_listed_titles_against_a_loop(data):
    rows, entries, listed = data
    won = [r for r in rows if r[6] == "winner" and r[1] in dict((x[0], x) for x in LIST)]
    years = defaultdict(set)
    for r in won:
        years[r[:3]].add(r[4])
    got = {x["entry"]: x for x in T.listed_titles(entries, listed).collect()}
    assert set(got) == {r[7] for r in won}
    for r in won:
        x, mine = got[r[7]], [w for w in won if w[:3] == r[:3]]
        nth = 1 + sorted(mine, key=lambda w: (w[4], w[5] or date(1, 1, 1), w[7])).index(r)
        streak = next(n for n in range(1, 20) if r[4] - n not in years[r[:3]])
        assert (x["nth"], x["defended"], x["streak"]) == (nth, r[4] - 1 in years[r[:3]], streak)


def test_title_groups_against_a_loop(data):
    rows, entries, listed = data
    short = {x[0]: x[2] for x in LIST}
    groups, want = defaultdict(list), {}
    for r in rows:
        if r[6] == "winner" and r[1] in short:
            groups[r[0], r[1]].append(r)
    late = lambda r: (r[4], r[5] or date(1, 1, 1), r[7])
    for (person, t), mine in groups.items():
        mine.sort(key=late, reverse=True)
        kinds = list(dict.fromkeys(r[3] for r in mine if r[3]))
        badge = f"{short[t]} winner" + (f" {len(mine)} times" if len(mine) > 1 else "")
        want[person, t] = (len(mine), sorted({r[4] for r in mine}, reverse=True), kinds, badge)
    got = T.title_groups(T.listed_titles(entries, listed)).collect()
    assert {(x["person"], x["tournament"]): (x["count"], x["years"], x["disciplines"], x["badge"]) for x in got} == want
    for person in "abcdefg":
        order = [x["tournament"] for x in sorted((x for x in got if x["person"] == person), key=lambda x: x["place"])]
        assert order == sorted(order, key=lambda t: late(groups[person, t][0]), reverse=True)


def test_major_results_against_a_loop(data):
    rows, entries, listed = data
    major, rank = {x[0]: x[3] for x in LIST}, {p: i + 1 for i, p in enumerate(T.MAJOR_PLACEMENTS)}
    of = defaultdict(list)
    for r in rows:
        if major.get(r[1]) and r[6] in rank:
            of[r[0], major[r[1]]].append(r)
    got = defaultdict(list)
    for x in T.major_results(entries, listed, ["senior", "school"]).collect():
        assert x["group_place"] == 1 + [g for g in ("senior", "school", "other") if (x["person"], g) in of].index(x["major"])
        assert x["rank"] == rank[x["placement"]]
        got[x["person"], x["major"]].append((x["place"], x["entry"]))
    assert got.keys() == of.keys()
    for k, mine in of.items():
        mine.sort(key=lambda r: (rank[r[6]], -r[4], -(r[5].toordinal() if r[5] else 0), r[7]))
        assert [e for _, e in sorted(got[k])] == [r[7] for r in mine]


def test_firsts_against_a_loop(data):
    rows, entries, listed = data
    known, want = {x[0] for x in LIST}, {}
    for event, ok in (("first_listed", lambda r: True), ("first_listed_title", lambda r: r[6] == "winner")):
        for r in sorted((r for r in rows if r[1] in known and ok(r)), key=lambda r: (r[5] or date(1, 1, 1), r[7])):
            want.setdefault((r[0], event), (r[1], r[2], r[4], r[5]))
    got = {(x["person"], x["event"]): (x["tournament"], x["category"], x["year"], x["date"]) for x in T.firsts(entries, listed).collect()}
    assert got == want


def test_empty_entries_and_lists(data):
    _, entries, listed = data
    for e, k in ((entries.limit(0), listed), (entries, listed.limit(0))):
        assert T.title_groups(T.listed_titles(e, k)).count() == T.major_results(e, k, []).count() == T.firsts(e, k).count() == 0
