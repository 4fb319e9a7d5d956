"""Scalar semantics: exact rates, halves, bands, labels, keys, urls."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import keys as K
from tallyspark.functions import labels as L
from tallyspark.functions import numbers as N
from tallyspark.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_exact_rate_rounds_halves_to_even(spark):
    pairs = [(1, 16), (3, 16), (1, 3), (2, 3), (0, 5), (5, 5), (1, 0), (3, -1), (7, 2000), (9, 2000)]
    want = [float(round(Fraction(n, d), 3)) if d > 0 else 0.0 for n, d in pairs]
    assert values(spark, pairs, "n long, d long", N.exact_rate(F.col("n"), F.col("d"))) == want
    assert value(spark, N.exact_rate(F.lit(1), F.lit(None).cast("long"))) == 0.0


@settings(max_examples=15, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**9)), min_size=1, max_size=40))
def test_exact_rate_for_any_integers(spark, pairs):
    assert values(spark, pairs, "n long, d long", N.exact_rate(F.col("n"), F.col("d"))) == [float(round(Fraction(n, d), 3)) for n, d in pairs]


def test_half_up_goes_towards_plus_infinity(spark):
    assert values(spark, [(0.5,), (1.5,), (-0.5,), (-1.5,)], "x double", N.half_up(F.col("x"), 0)) == [1, 2, 0, -1]


def test_percentage_trend_band(spark):
    assert value(spark, N.percentage(F.lit(1), F.lit(0))) is None
    assert values(spark, [(1.9,), (2.0,), (-2.0,), (None,)], "d double", N.trend(F.col("d"))) == ["stable", "improved", "declined", None]
    assert value(spark, N.trend(F.lit(3.0), False)) == "declined"
    assert values(spark, [(2,), (3,), (None,)], "x int", N.band(F.col("x"), [(2, "low")], "high", "?")) == ["low", "high", "?"]


def test_bracket_arithmetic(spark):
    assert values(spark, [(0,), (1,), (2,), (3,), (5,), (64,), (65,)], "n long", N.next_power_of_two(F.col("n"))) == [1, 1, 2, 4, 8, 64, 128]
    assert values(spark, [(0, 1), (0, 2), (5, 6), (3, 3)], "a long, b long", N.meeting_round(F.col("a"), F.col("b"))) == [0, 1, 1, None]
    first, last = N.sibling_range(F.col("s"), F.col("r"))
    assert [tuple(r) for r in spark.createDataFrame([(5, 0), (5, 1), (5, 2)], "s long, r int").select(first, last).collect()] == [(4, 4), (6, 7), (0, 3)]


def test_fiscal_year(spark):
    assert values(spark, [("2024-03-31",), ("2024-04-01",)], "d string", N.fiscal_year(F.to_date("d"))) == [2023, 2024]


def test_labels(spark):
    assert values(spark, [("Round 3",), ("final",), ("Quarterfinal",), ("x",), (None,)], "r string", L.round_order(F.col("r"))) == [3, 102, 100, 0, 0]
    assert value(spark, L.round_order(F.lit("final"), L.LATE_ROUNDS["coverage"])) == 10000
    assert values(spark, [("best", 4), ("best", 16), ("winner", None), ("odd", None)], "k string, b int", L.placement_kind(F.col("k"), F.col("b"))) == ["best4", "best8", "winner", "unknown"]
    assert value(spark, L.entry_score(F.lit("major"), F.lit("round"))) == 10.0
    c = value(spark, L.category_parts(F.lit("mixed-doubles-none-mixed")))
    assert (c["discipline"], c["age"], c["gender"], c["kind"]) == ("mixed-doubles", "none", "mixed", "mixed")
    assert value(spark, L.category_parts(F.lit("x")))["gender"] is None
    assert values(spark, [(2, False), (3, False), (None, False), (9, True)], "n int, f boolean", L.rally_band(F.col("n"), F.col("f"))) == ["1-2", "3-4", "unknown", "unknown"]
    assert values(spark, [(5, 2, 2), (5, 2, 1)], "b int, x int, y int", L.points_to_win(F.col("b"), F.col("x"), F.col("y"))) == [7, 4]
    assert [value(spark, L.serving_side(F.lit(n), F.lit("A"))) for n in (1, 2, 3, 4, 5)] == ["A", "A", "B", "B", "A"]


def test_keys(spark):
    assert value(spark, K.pair_key(F.lit(9), F.lit(4))) == "4-9"
    assert value(spark, K.compatibility_key(F.lit(" Ａb　ｃ "))) == "Abc"
    assert value(spark, K.longest_common_substring(F.lit("abcdef"), F.lit("xbcdz"))) == "bcd"
    assert [value(spark, K.group_label(F.lit(i))) for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]


def fnv(text):
    h = 2166136261
    for c in text.encode("utf-16-le")[::2]:
        h = (h ^ c) * 16777619 % 2**32
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits


@pytest.mark.parametrize("text", ["a", "match-1", "zzz"])
def test_fnv(spark, text):
    assert value(spark, K.fnv1a_base36(F.lit(text))) == fnv(text)


def test_urls(spark):
    urls = {
        "HTTPS://Ex.Com/A?utm_source=x&b=1#top": "https://ex.com/A?b=1",
        "http://ex.com/a.PDF/": "http://ex.com/a.PDF",
        "http://ex.com": "http://ex.com/",
        "http://ex.com/?UTM_x=1": "http://ex.com/",
        "a/b": "a/b",
    }
    assert values(spark, [(u,) for u in urls], "u string", X.normalize_url(F.col("u"))) == list(urls.values())
    assert values(spark, [("a.pdf?x",), ("b.XLSX",), ("c.jpeg",), ("d.php",), (None,)], "u string", X.link_kind(F.col("u"))) == ["pdf", "excel", "image", "html", "unknown"]


def test_texts(spark):
    assert value(spark, X.strip_suffixes(F.lit("northhighschool"), ["high", "school"])) == "north"
    assert value(spark, X.strip_suffixes(F.lit("abhighhigh"), ["high"])) == "ab"
    assert value(spark, X.strip_suffixes(F.lit("ahigh"), ["high"])) == "ahigh"
    assert value(spark, X.drop_repeats(F.lit("a__a_b_b_a"))) == "a_b_a"
    assert value(spark, X.half_width(F.lit("Ａ１　"))) == "A1 "
    assert values(spark, [("in 2024",), ("令和 5 年",), ("none",)], "t string", X.infer_year(F.col("t"))) == [2024, 2023, None]
    assert values(spark, [("1:02.5",), ("1:00:00",), ("x",)], "t string", X.clock_ms(F.col("t"))) == [62500, 3600000, None]
    assert value(spark, X.clock_text(F.lit(62500))) == "1:02.500"
    assert value(spark, X.video_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert value(spark, X.clamped_score([(F.lit(True), 0.9)], 0.2)) == 0.99
    assert str(value(spark, X.first_date(F.lit("2024/03/05"), ["yyyy-MM-dd", "yyyy/MM/dd"]))) == "2024-03-05"
