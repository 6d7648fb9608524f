"""Rule scores, decisions and states of postings as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import has_term, loose, terms


def title_score(title: Column, target: Column) -> Column:
    """45 equal, 40 contained, 32 all words, 24 by the share of words from a half on, else 0."""
    own, want = terms(title), terms(target)
    share = F.size(F.array_intersect(own, want)) / F.size(want)
    return F.when((loose(title) == "") | (loose(target) == ""), 0).when(loose(title) == loose(target), 45).when(has_term(title, target), 40).when(F.size(F.array_except(want, own)) == 0, 32).when(share >= 0.5, F.bround(24 * share)).otherwise(0).cast("int")


def keyword_score(text: Column, every: Column, some: Column) -> Column:
    """Up to 10 for the share of required words, 5 for each of the others up to 20."""
    hits = lambda words: F.size(F.filter(words, lambda w: has_term(text, w)))
    required = F.when(F.size(every) > 0, F.bround(10 * hits(every) / F.size(every))).otherwise(0)
    return (required + F.least(F.lit(20), 5 * hits(some))).cast("int")


def freshness_score(now: Column, then: Column) -> Column:
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86400e6)
    return F.when(then.isNull(), 0).when(days <= 1, 5).when(days <= 3, 4).when(days <= 7, 2).otherwise(0)


def location_score(location: Column, target: Column, remote: Column) -> Column:
    """Remote searches: 20 remote, 15 the country, 0; others: 10 without a target, 20 equal, 10 the state, 5 the country."""
    place, want = loose(location), loose(target)
    country = has_term(location, F.lit("United States")) | has_term(location, F.lit("US"))
    state = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), ",\\s*([A-Z]{2})\\b", 1)
    local = F.when(want == "", 10).when(place == want, 20).when((state(location) != "") & (state(location) == state(target)), 10).when(country, 5).otherwise(0)
    return F.when(remote, F.when(has_term(location, F.lit("remote")), 20).when(country, 15).otherwise(0)).otherwise(local)


def classify(text: Column, rules: list[tuple[str, str, int]], default: tuple[str, int]) -> Column:
    """The label and score of the first rule (pattern, label, score) that fits, in order."""
    made = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    return reduce(lambda rest, r: F.when(text.rlike(r[0]), made(r[1], r[2])).otherwise(rest), reversed(rules), made(*default))


def normal_title(title: Column) -> Column:
    """Small letters, signs as spaces, & as and, words that only name places left out."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), "&", " and ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[()\[\]{}|/,:;._]+", " "), r"\s+", " "))
    return F.array_join(F.filter(F.split(out, " "), lambda w: ~w.isin("remote", "usa", "us", "hybrid", "onsite")), " ")


def overall(parts: list[Column], weights: list[float]) -> Column:
    """A weighted sum, rounded half to even."""
    return F.bround(reduce(lambda a, b: a + b, (p * w for p, w in zip(parts, weights)))).cast("int")


def recommendation(score: Column, complete: Column) -> Column:
    return F.when((score >= 75) & complete, "apply").when(score >= 50, "review").otherwise("skip")


def points(rules: list[tuple[Column, int, str]]) -> Column:
    """The sum of the points of all rules that hold, capped at 100, and their reasons in order."""
    total = reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for c, p, _ in rules))
    reasons = F.concat_ws("; ", *(F.when(c, r) for c, _, r in rules))
    return F.struct(F.least(total, F.lit(100)).alias("points"), reasons.alias("reasons"))
