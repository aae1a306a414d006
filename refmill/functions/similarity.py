"""Similarity of titles, names and identifiers, and the match score, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normalized, tokens, trimmed

# Weights of the score and its thresholds.
WEIGHTS = {"title": 50, "author": 25, "year": 15, "journal": 10}
YEAR_TOLERANCE = 1
SURNAME_RATIO = 0.85
MATCH_MIN, FOUND_MIN, MEDIUM_MIN, HIGH_MIN = 30, 40, 60, 80


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Of the multisets of character pairs; equal texts score 1 unless empty."""
    x, y = _bigrams(a), _bigrams(b)
    count = lambda xs, g: F.size(F.filter(xs, lambda h: h == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(short, 0.0).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def comparable(c: Column) -> Column:
    """struct<plain, words>: what ``similarity`` compares, for computing once a text."""
    return bound(normalized(c), lambda n: F.struct(n.alias("plain"), tokens(n).alias("words")))


def similarity(a: Column, b: Column) -> Column:
    """Of two comparable texts: Jaccard of weighty words where both have two or more, else Dice of what there is."""
    ta, tb = a["words"], b["words"]
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    few = F.when((F.size(ta) > 0) & (F.size(tb) > 0), dice(F.array_join(ta, " "), F.array_join(tb, " "))).otherwise(dice(a["plain"], b["plain"]))
    return F.when((a["plain"] == "") | (b["plain"] == ""), 0.0).when(a["plain"] == b["plain"], 1.0).when((F.size(ta) >= 2) & (F.size(tb) >= 2), jaccard).otherwise(few)


def string_similarity(a: Column, b: Column) -> Column:
    return bound(F.struct(comparable(a).alias("a"), comparable(b).alias("b")), lambda p: similarity(p["a"], p["b"]))


def surname(name: Column) -> Column:
    """What is before a comma, else the last word."""
    return F.when(F.contains(name, F.lit(",")), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(trimmed(name), r"(\S*)$", 1))


def surnames_match(a: Column, b: Column) -> Column:
    fuzzy = (F.length(a) >= 3) & (F.length(b) >= 3) & (levenshtein_ratio(a, b) >= SURNAME_RATIO)
    return (a != "") & (b != "") & ((a == b) | fuzzy)


def surnames(authors: Column) -> Column:
    """Normalised surnames of a list of names."""
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda n: normalized(surname(n))), lambda n: n != "")


def author_score(own: Column, other: Column) -> Column:
    """Share of the reference's surnames that the candidate has."""
    hits = F.size(F.filter(own, lambda a: F.exists(other, lambda b: surnames_match(a, b))))
    return F.when((F.size(own) == 0) | (F.size(other) == 0), 0.0).otherwise(hits / F.size(own))


def doi(c: Column) -> Column:
    """Comparable form, empty for none."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"^doi:\s*", ""), r"[).,;]+$", ""))


def isbn(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9Xx]", ""))


def prepared(c: Column) -> Column:
    """What a match compares of a struct (title, authors, year, journal, doi, isbn), for computing once a record."""
    return F.struct(comparable(c["title"]).alias("title"), surnames(c["authors"]).alias("surnames"), c["year"].alias("year"), comparable(c["journal"]).alias("journal"), doi(c["doi"]).alias("doi"), isbn(c["isbn"]).alias("isbn"))


def prepared_score(ref: Column, cand: Column) -> Column:
    """0 to 100 of two prepared records; an equal identifier is 100."""
    same = lambda name: (ref[name] != "") & (ref[name] == cand[name])
    apart = F.abs(ref["year"] - cand["year"])
    year = F.when(apart == 0, float(WEIGHTS["year"])).when(apart <= YEAR_TOLERANCE, WEIGHTS["year"] * 0.5).otherwise(0.0)
    total = similarity(ref["title"], cand["title"]) * WEIGHTS["title"] + author_score(ref["surnames"], cand["surnames"]) * WEIGHTS["author"] + F.coalesce(year, F.lit(0.0)) + similarity(ref["journal"], cand["journal"]) * WEIGHTS["journal"]
    return F.when(same("doi") | same("isbn"), 100).otherwise(F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)) + 0.5).cast("int"))


def match_score(ref: Column, cand: Column) -> Column:
    """Of two structs (title, authors, year, journal, doi, isbn)."""
    return bound(F.struct(prepared(ref).alias("a"), prepared(cand).alias("b")), lambda p: prepared_score(p["a"], p["b"]))


def confidence(score: Column) -> Column:
    """high, medium or low for what counts as found, else null."""
    return F.when(score >= HIGH_MIN, "high").when(score >= MEDIUM_MIN, "medium").when(score >= FOUND_MIN, "low")
