"""Tables from placed characters against a plain Python reading of the same rules, a page at a time."""

import random
from collections import Counter, defaultdict

import pytest

from tallyspark.operators import layout as Y

SCHEMA = "page long, x0 double, x1 double, top double, size double, text string"


def pages(seed, n=25):
    r = random.Random(seed)
    out = []
    for page in range(n):
        two = r.random() < 0.6
        bases = [10, 45, 80] + ([150, 190] if two else [])
        for line in range(r.choice([2, 4, 9, 20])):
            for base in bases:
                for i in range(r.randint(0, 3)):
                    x = base + i * r.choice([7, 8]) + r.choice([0, 0.25, 0.5])
                    small = r.random() < 0.15
                    out.append((page, float(x), float(x + r.choice([5, 6])), line * r.choice([7.0, 7.5]) + r.choice([0, 0.5, 1.25, 2.5, 3.5]), 5.0 if small else 10.0, r.choice("abc ()")))
        if r.random() < 0.5:
            out += [(page, 20 + 12.0 * i, 31 + 12.0 * i, 0.0, 18.0, "H") for i in range(r.randint(1, 14))]
        if r.random() < 0.3:
            out += out[-2:]
    return out


def body(chars):
    sizes = Counter(round(c[4], 1) for c in chars)
    usual = min(sizes, key=lambda s: (-sizes[s], s))
    drop = {s for s, n in sizes.items() if s > usual * 1.3 and n < len(chars) * 0.1}
    kept = [c for c in chars if round(c[4], 1) not in drop]
    return kept if len(kept) >= len(chars) * 0.5 else chars


def voted_columns(chars, brackets):
    lines = defaultdict(list)
    for c in chars:
        lines[round(c[3] / 3)].append(c)
    cut = {x for c in chars if brackets and c[5] in "()" for x in range(int(c[1]), int(c[2]) + 1)}
    used = [x for x in range(-5, 400) if x not in cut and sum(any(c[1] <= x <= c[2] for c in cs) for cs in lines.values()) >= max(2, len(lines) * 0.04)]
    out = []
    for x in used:
        if out and x - out[-1][1] <= 6 and not any(y in cut for y in range(out[-1][1], x)):
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(out)]


def folded_rows(chars):
    out, anchor, before = [], None, None
    for c in sorted(chars, key=lambda c: (c[3], c[1], c[2], c[5], c[4])):
        tolerance = 4 if c[4] < 6.5 or (before is not None and before[4] < 6.5) else 3
        if anchor is None or c[3] - anchor > tolerance:
            out.append([])
            anchor = c[3]
        out[-1].append(c)
        before = c
    return out


def cells(rows, columns, tolerance):
    out = set()
    for n, row in enumerate(rows, 1):
        found = defaultdict(list)
        for c in row:
            over = [(min(c[2], b) - max(c[1], a), -i) for i, a, b in columns]
            off = [(max(a - c[2], c[1] - b, 0.0), -i) for i, a, b in columns]
            if over and max(over)[0] > 0:
                found[-max(over)[1]].append(c)
            elif off and tolerance > 0 and min(off)[0] <= tolerance:
                found[-min(off)[1]].append(c)
        for i, cs in found.items():
            text = "".join(c[5] for c in sorted(cs, key=lambda c: (c[1], c[5]))).strip(" ")
            if text:
                out.add((n, row[0][3], i, text))
    return out


def divided(chars):
    lines = defaultdict(list)
    for c in chars:
        lines[round(c[3] / 3)].append(c)
    left, right = min(c[1] for c in chars), max(c[2] for c in chars)
    lo, hi = left + (right - left) * 0.3, left + (right - left) * 0.7
    if len(chars) >= 20 and len(lines) >= 5:
        free = [k for k in range(int(hi - lo) + 1) if sum(not any(c[1] <= lo + k <= c[2] for c in cs) for cs in lines.values()) >= len(lines) * 0.9]
        runs = []
        for k in free:
            if runs and k - runs[-1][1] == 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        wide = max(runs, key=lambda r: r[1] - r[0], default=None)
        if wide and wide[1] - wide[0] >= 8:
            return lo + (wide[0] + wide[1]) / 2
    inner = sorted((c[1], c[2]) for c in body(chars))
    left, right, reach, best = inner[0][0], max(b for _, b in inner), inner[0][1], None
    for a, b in inner[1:]:
        mid = (reach + a) / 2
        off = abs(mid - (left + right) / 2)
        if a - reach >= 15 and off <= (right - left) * 0.25 and (best is None or (off, mid) < best):
            best = (off, mid)
        reach = max(reach, b)
    return best and best[1]


@pytest.fixture(scope="module")
def placed(spark):
    rows = pages(3)
    by_page = defaultdict(list)
    for c in rows:
        by_page[c[0]].append(c)
    broken = [(99, None, 1.0, 1.0, 9.0, "a"), (99, 3.0, 1.0, 1.0, 9.0, "a"), (99, 1.0, 2.0, None, 9.0, "a")]
    return by_page, spark.createDataFrame(rows + broken, SCHEMA).repartition(3)


def test_headings_leave_the_body(placed):
    by_page, chars = placed
    got = Counter(tuple(r) for r in Y.body_characters(chars, ["page"]).select("page", "x0", "x1", "top", "size", "text").collect())
    assert got == Counter(c for cs in by_page.values() for c in body(cs))
    assert sum(got.values()) < sum(map(len, by_page.values()))


@pytest.mark.parametrize("brackets", [False, True])
def test_columns_are_voted_by_lines(placed, brackets):
    by_page, chars = placed
    got = sorted(tuple(r) for r in Y.table_columns(chars, ["page"], brackets=brackets).select("page", "column", "c0", "c1").collect())
    assert got == sorted((p, *c) for p, cs in by_page.items() for c in voted_columns(cs, brackets))


def test_sides_by_vote_or_gap(placed):
    by_page, chars = placed
    got = {r.page: r.split and round(r.split, 6) for r in Y.side_split(chars, ["page"]).collect()}
    want = {p: divided(cs) for p, cs in by_page.items()}
    assert got == {p: x and round(x, 6) for p, x in want.items()}
    assert None in got.values() and len(set(got.values())) > 3


@pytest.mark.parametrize("tolerance", [0, 5])
def test_rows_are_anchored_and_cells_read(placed, tolerance):
    by_page, chars = placed
    rows = Y.table_rows(chars, ["page"])
    got = {tuple(r) for r in Y.table_cells(rows, Y.table_columns(chars, ["page"]), ["page"], tolerance).select("page", "row", "top", "column", "text").collect()}
    assert got == {(p, *c) for p, cs in by_page.items() for c in cells(folded_rows(cs), voted_columns(cs, False), tolerance)}
    assert rows.count() == sum(map(len, by_page.values()))


def test_heights_that_creep_dont_become_one_row(spark):
    chars = spark.createDataFrame([(1, 0.0, 1.0, i * 2.0, 9.0, "x") for i in range(200)], SCHEMA)
    rows = Y.table_rows(chars, ["page"])
    assert rows.groupBy("row").count().where("count > 2").count() == 0 and rows.agg({"row": "max"}).first()[0] == 100


def test_no_characters(spark):
    none = spark.createDataFrame([], SCHEMA)
    columns = Y.table_columns(none, ["page"])
    assert not columns.take(1) and not Y.side_split(none, ["page"]).take(1) and not Y.table_cells(Y.table_rows(none, ["page"]), columns, ["page"]).take(1)
