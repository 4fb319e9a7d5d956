"""Keys and hashes. Python runs only where no built-in has the semantics: compatibility normalisation, FNV, substrings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def pair_key(a: Column, b: Column, separator: str = "-") -> Column:
    """One key for an unordered pair."""
    return F.concat_ws(separator, F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def short_hash(value: Column, digits: int = 16) -> Column:
    """The first hex digits of the sha1."""
    return F.substring(F.sha1(value.cast("string")), 1, digits)


def group_signature(value: Column, separator: str = "|") -> Column:
    """An aggregate: one hash of a group's values, whatever their order."""
    return F.sha1(F.array_join(F.array_sort(F.collect_list(value.cast("string"))), separator))


@F.pandas_udf(StringType())
def compatibility_key(text: pd.Series) -> pd.Series:
    """NFKC form without white space."""
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()))


def person_key(name: Column, team: Column) -> Column:
    return F.concat_ws("@", compatibility_key(name), compatibility_key(team))


@F.pandas_udf(StringType())
def fnv1a_base36(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over code units, in base 36."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        h, out = 2166136261, ""
        raw = t.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out or "0"

    return text.map(one)


@F.pandas_udf(StringType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first longest run of characters that two texts share."""

    def one(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        best, end, before = 0, 0, [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            now = [0] * (len(y) + 1)
            for j, d in enumerate(y, 1):
                if c == d:
                    now[j] = before[j - 1] + 1
                    if now[j] > best:
                        best, end = now[j], i
            before = now
        return x[end - best : end]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def group_label(index: Column) -> Column:
    """A..Z, AA.. for 0, 1, ...; up to two letters."""
    letter = lambda i: F.chr((F.lit(65) + i).cast("int"))
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))
