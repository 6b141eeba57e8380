"""Matching of rule packs and scores in whole ten-thousandths, so that no verdict hangs on a rounding."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAGS
from ..rules import Rule
from .literals import required

#: A match counts from this weight on, in hundredths.
ACTIVE = 30


def has(categories: Column, *names: str) -> Column:
    """Whether all of some categories are among an array."""
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains(categories, n)
    return out


def pattern(rule: Rule, dotall: bool = False) -> str:
    """The rule's regex for text in lower case. Flags cost time, so a pattern that has no capitals goes without."""
    plain = re.sub(r"\\.", "", rule.regex)
    return ("" if plain == plain.lower() else FLAGS) + ("(?s)" if dotall else "") + rule.regex


def matched(text: Column, rule: Rule, dotall: bool = False) -> Column:
    """Whether a rule matches a text in lower case. Texts without any of the literals that a match must hold are told
    by plain searches, which cost far less than the regex."""
    return said(text, pattern(rule, dotall), rule.regex)


def said(text: Column, regex: str, plain: str | None = None) -> Column:
    """Whether a text in lower case matches a regex. plain: the same without flags."""
    found = text.rlike(regex)
    needed = None if regex.startswith(FLAGS) else required(plain or regex)
    if not needed:
        return found
    return reduce(or_, (text.contains(n) for n in needed)) & found


def any_hit(text: Column, rules: Sequence[Rule], dotall: bool = False) -> Column:
    """Whether any rule matches a text in lower case."""
    return (text != "") & F.coalesce(reduce(or_, (matched(text, r, dotall) for r in rules), F.lit(False)), F.lit(False))


def fenced(df: DataFrame, condition: Column) -> DataFrame:
    """The rows of df that meet a condition, which is worked out above all that df does: not before its exchanges, and
    not with a copy of the expressions its columns are made of. A projection that isn't deterministic holds it there."""
    return df.withColumn("_fence", F.rand(0)).where((F.col("_fence") >= 0) & condition).drop("_fence")


def settled(df: DataFrame) -> DataFrame:
    """df with its columns worked out before any filter on them: pushed down, a filter would hold a copy of all that its
    columns are made of, which for nested ones grows without bound."""
    return fenced(df, F.lit(True))


def category_maxima(matches: Column, categories: Sequence[str], weight: str = "weight") -> Column:
    """Array of (category, weight): the greatest weight of each category that is met."""
    each = [F.struct(F.lit(c).alias("category"), F.array_max(F.transform(F.filter(matches, lambda m: m["category"] == c), lambda m: m[weight])).alias("weight")) for c in categories]
    return F.filter(F.array(*each), lambda c: c["weight"].isNotNull())


def met_maxima(matches: Column, weight: str = "weight") -> Column:
    """category_maxima() of the categories that are met, whatever they are, by name."""
    met = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"])))
    return F.transform(met, lambda c: F.struct(c.alias("category"), F.array_max(F.transform(F.filter(matches, lambda m: m["category"] == c), lambda m: m[weight])).alias("weight")))


def active(maxima: Column) -> Column:
    return F.transform(F.filter(maxima, lambda c: c["weight"] >= ACTIVE), lambda c: c["category"])


def points(maxima: Column, share: int, bonus: Column) -> Column:
    """Score in hundredths: the greatest weight, `share` percent of the others' sum, and bonuses in hundredths; at most 100."""
    total = F.aggregate(maxima, F.lit(0), lambda a, c: a + c["weight"])
    top = F.coalesce(F.array_max(F.transform(maxima, lambda c: c["weight"])), F.lit(0))
    raw = top * 100 + (total - top) * share + bonus * 100
    return F.least(F.lit(100), F.floor((raw + 50) / 100)).cast("int")


def bonuses(pairs: Sequence[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for condition, value in pairs:
        out = out + F.when(condition, value).otherwise(0)
    return out
