"""Text and url functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
DOCUMENTS = r"(?i)\.(pdf|xlsx?|xlsm|csv)/+$"
# File kinds by ending; the first that fits holds.
KINDS = (("pdf", r"(?i)\.pdf($|[?#])"), ("excel", r"(?i)\.(xlsx?|xlsm|csv)($|[?#])"), ("image", r"(?i)\.(jpe?g|png|gif|webp)($|[?#])"), ("html", r"(?i)\.(html?|php|aspx?|jsp)($|[?#])"))


def collapse(text: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def fold(text: Column, variants: str, plain: str) -> Column:
    """Replaces characters one for one."""
    return F.translate(text, variants, plain)


def strip_suffixes(text: Column, suffixes: Sequence[str], least: int = 2) -> Column:
    """Strips suffixes from the end again and again, leaving `least` characters at least."""
    endings = "|".join(sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(text, f"(?s)^(.{{{least},}}?)(?:{endings})+$", "$1")


def drop_repeats(text: Column, separator: str = "_") -> Column:
    """Empty and adjacent equal parts go."""
    parts = F.filter(F.split(text, separator), lambda x: x != "")
    kept = F.filter(F.arrays_zip(parts.alias("x"), F.concat(F.array(F.lit("")), parts).alias("y")), lambda p: p["x"].isNotNull() & (p["x"] != p["y"]))
    return F.array_join(F.transform(kept, lambda p: p["x"]), separator)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no utm_ parameters, no slash after a document's name; without a path the path is /."""
    s = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(s, F.length(head) + 1, F.length(s))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    path = F.when(path.rlike(DOCUMENTS), F.regexp_replace(path, "/+$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    query = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^utm_"))
    return F.when(head == "", s).otherwise(F.concat(head, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def link_kind(href: Column) -> Column:
    out = F.when(href.isNull(), "unknown")
    for kind, pattern in KINDS:
        out = out.when(href.rlike(pattern), kind)
    return out.otherwise("unknown")


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs, upper or lower case."""
    low = F.lower(collapse(text))
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w))), F.lit(False))


def infer_year(text: Column, era: str = r"令和\s*([0-9]{1,2})\s*年", era_base: int = 2018) -> Column:
    """A year from 2000 to 2099, else an era's year; null if neither is there."""
    western = F.regexp_extract(text, r"\b(20[0-9]{2})\b", 1)
    named = F.regexp_extract(text, era, 1)
    return F.when(western != "", western.cast("int")).when(named != "", named.cast("int") + era_base)


def first_match(text: Column, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that fits."""
    out = F.when(text.isNull(), F.lit(default))
    for label, pattern in patterns:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(default))


# What a title says of event, category and qualifier; the first pattern that occurs holds.
EVENT_TYPES = (("singles", r"(?i)シングルス|single"), ("doubles", r"(?i)ダブルス|double"), ("team", r"(?i)団体|team"))
CATEGORIES = (("men", r"(?i)男子|men|boys"), ("women", r"(?i)女子|women|girls"), ("mixed", r"(?i)混合|ミックス|mixed"))
QUALIFIERS = (("interhigh", r"(?i)高校総体|インターハイ|インハイ|全国高等学校総合体育大会|高等学校総合体育大会|ＩＨ予選|IH予選"),)


def title_labels(text: Column) -> Column:
    """struct(year, event, category, qualifier) of a title; unknown event and category, null year and qualifier where it names none."""
    return F.struct(infer_year(text).alias("year"), first_match(text, EVENT_TYPES, "unknown").alias("event"), first_match(text, CATEGORIES, "unknown").alias("category"), first_match(text, QUALIFIERS).alias("qualifier"))


def clamped_score(terms: Sequence[tuple[Column, float]], base: float, least: float = 0.0, most: float = 0.99) -> Column:
    """base and the weights of the conditions that hold, to two places, within limits."""
    total = F.lit(base)
    for condition, weight in terms:
        total = total + F.when(condition, F.lit(weight)).otherwise(0.0)
    return F.greatest(F.lit(least), F.least(F.floor(total * 100 + 0.5) / 100.0, F.lit(most)))


def clock_ms(text: Column) -> Column:
    """Milliseconds of [h:]m:ss[.mmm]; null if it is none."""
    part = lambda i: F.regexp_extract(text, r"^(?:(\d+):)?(\d+):(\d{2})(?:\.(\d{1,3}))?$", i)
    n = lambda i: F.when(part(i) == "", 0).otherwise(F.try_to_number(part(i), F.lit("999999999")).cast("long"))
    return F.when(part(2) != "", ((n(1) * 60 + n(2)) * 60 + n(3)) * 1000 + F.rpad(part(4), 3, "0").cast("long"))


def clock_text(ms: Column) -> Column:
    """m:ss.mmm."""
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def video_id(url: Column) -> Column:
    """The 11-character id of a video url in any of its usual forms; null if there is none."""
    found = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})(?:$|[?&#/])", 1)
    return F.when(found != "", found)


def first_date(text: Column, formats: Sequence[str]) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


def join_name(last: Column, first: Column) -> Column:
    """Last and first name: joined directly if either is written in kana or Han, else by a space; empty parts don't count."""
    parts = F.filter(F.array(*(F.btrim(F.coalesce(x, F.lit(""))) for x in (last, first))), lambda x: x != "")
    close = F.exists(parts, lambda x: x.rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"))
    return F.when(close, F.array_join(parts, "")).otherwise(F.array_join(parts, " "))


def recover_team(text: Column, regions: Mapping[str, str]) -> Column:
    """struct(team, region) of a team name that is a joined id (it begins with "_"): tokens without repeats, and the last one as region if it is one of `regions` (name: short name), together with its short name before it. Other names stay."""
    tokens = F.split(drop_repeats(text), "_", -1)
    n = F.size(tokens)
    last = F.when((n > 1) & F.element_at(tokens, -1).isin(*regions), F.element_at(tokens, -1))
    short = F.lit(None).cast("string")
    for name, brief in regions.items():
        short = F.when(last == name, brief).otherwise(short)
    cut = F.when(last.isNull(), 0).when((n > 2) & (F.try_element_at(tokens, F.lit(-2)) == short), 2).otherwise(1)
    team = F.array_join(F.slice(tokens, F.lit(1), n - cut), "_")
    joined = text.startswith("_")
    return F.struct(F.when(joined, team).otherwise(text).alias("team"), F.when(joined, last).alias("region"))


def clamped(date: Column, as_of: Column) -> Column:
    """The date, or as_of where it is later; null stays null."""
    return F.when(date.isNotNull(), F.least(date, as_of))


def collated(text: Column, locale: str = "ja") -> Column:
    """The text with a locale's order for comparing and sorting."""
    return F.collate(text, locale)
