"""Footnotes: parts, their resolution in order, and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import records as R
from ..functions import text as T
from .keeping import kept

#: What lies between semicolons that no quotation encloses.
PARTS = '((?:[^;“"«»”]|[“"«»”][^“"«»”]*(?:[“"«»”]|$))+)'
REPEAT = r"(?i)^(a\.g\.e\.|a\.g\.m\.|ibid|op\.\s*cit\.|loc\.\s*cit\.)"
QUOTED = "[“\"‘«']([^”\"’»']+)[”\"’»']"
ANY_QUOTE = "[“\"‘«'”’»]"
LEAST_OVERLAP = 0.3


def split_parts(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(1)), T.trimmed), lambda p: p != "")


def parts(footnotes: DataFrame) -> DataFrame:
    """(doc_id, foot_ord, foot_id, part_idx, part); a footnote without parts is one part as it stands."""
    each = F.transform(F.array(split_parts(F.col("text"))), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.coalesce(F.col("text"), F.lit("")))))[0]
    return footnotes.select("doc_id", "foot_ord", "foot_id", F.posexplode(each).alias("part_idx", "part"))


def inline_keys(part: Column) -> Column:
    """Keys of citations in a part without quotes, null for none."""
    keys = F.array_distinct(F.flatten(F.transform(C.found(part), lambda c: c["keys"])))
    return F.when(~part.rlike(ANY_QUOTE), T.bound(keys, lambda k: F.when(F.size(k) > 0, k)))


#: References of one family in a document that a part meets without postings; more are looked up by them.
FEW = 16
_PART = ("doc_id", "foot_ord", "part_idx")


def _grams(c: Column, n: int) -> Column:
    """Distinct substrings of ``n`` code points."""
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _long(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) > 2)


def _postings(titles: DataFrame) -> DataFrame:
    """(doc_id, family, key, ref_idx) of (doc_id, family, ref_idx, title): keys by which a part finds a title.

    A part that shares ``LEAST_OVERLAP`` of a title's long words has one of all but that many, the rarest of the
    family's titles first, so only these are posted, with the first word ("w"). A part that holds a title of three words
    or more has all words between its ends, so the rarest one is posted ("w"), else the first three letters ("g"). A
    title that holds a quotation has the quotation's key: a word ("q"), three letters ("t") or all of it ("s"), for
    which the first reference stands, as it wins.
    """
    at = titles.withColumn("words", F.split("title", " ")).select("*", F.posexplode("words").alias("at", "word"))
    at = at.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "family", "word"))).withColumn("rare", F.struct("n", "word"))
    inside = (F.col("at") > 0) & (F.col("at") < F.size("words") - 1)
    each = at.groupBy("doc_id", "family", "ref_idx").agg(
        F.first("title").alias("title"), F.first("words").alias("words"), F.array_sort(F.collect_list(F.when(F.length("word") > 2, F.col("rare")))).alias("long"), F.min(F.when(inside, F.col("rare")))["word"].alias("inner")
    )
    k, first = F.size("long"), F.col("words")[0]
    posted = F.when(k > 0, F.slice(F.col("long")["word"], F.lit(1), k - F.ceil(k * F.lit(LEAST_OVERLAP) - 1e-9).cast("int") + 1)).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("inner").isNotNull(), F.concat(F.lit("w"), "inner")).when(F.length("title") > 2, F.concat(F.lit("g"), F.left("title", F.lit(3)))).otherwise("every")
    keys = F.concat(_tagged("w", F.concat(posted, _long(F.array(first)))), F.array(whole), _tagged("q", F.col("words")), _tagged("t", _grams(F.col("title"), 3)))
    keys = each.select("doc_id", "family", "ref_idx", F.explode(F.array_distinct(keys)).alias("key"))
    short = F.concat(F.array(F.lit("")), _grams(F.col("title"), 1), _grams(F.col("title"), 2))
    firsts = titles.select("doc_id", "family", "ref_idx", F.explode(_tagged("s", short)).alias("key")).groupBy("doc_id", "family", "key").agg(F.min("ref_idx").alias("ref_idx"))
    return keys.unionByName(firsts)


def _sought(short_titles: Column) -> Column:
    """Keys under which a part looks for titles; all its three letters only where a title is that short."""
    quote = F.split("quoted", " ")
    inner = F.array_max(F.transform(F.slice(quote, F.lit(2), F.greatest(F.size(quote) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    quoted = F.when(inner.isNotNull(), F.concat(F.lit("q"), inner)).when(F.length("quoted") > 2, F.concat(F.lit("t"), F.left("quoted", F.lit(3)))).otherwise(F.concat(F.lit("s"), "quoted"))
    none = F.array().cast("array<string>")
    return F.concat(_tagged("w", F.array_distinct("words")), F.array(F.lit("every")), F.when(F.col("has_quote"), F.array(quoted)).otherwise(none), F.when(short_titles, _tagged("g", _grams(F.col("clean"), 3))).otherwise(none))


def shortened_candidates(words: DataFrame, titles: DataFrame, few: int = FEW) -> DataFrame:
    """(doc_id, foot_ord, part_idx, ref_idx): the references that a part may mean, ids only.

    The family is a word of the part. A family of more than ``few`` titles in its document is looked up by postings of
    their rarest words, so that a name which stands in every note doesn't pair each note with each of its titles.
    """
    sized = titles.withColumn("many", F.count("*").over(Window.partitionBy("doc_id", "family")) > few)
    families = sized.groupBy("doc_id", "family").agg(F.first("many").alias("many"), F.bool_or((F.size(F.split("title", " ")) < 3) & (F.length("title") > 2)).alias("short_titles"))
    met = words.select(*_PART, F.explode(F.array_distinct("words")).alias("family")).join(families, ["doc_id", "family"])
    direct = met.filter("not many").join(sized.filter("not many").select("doc_id", "family", "ref_idx"), ["doc_id", "family"])
    sought = met.filter("many").join(words, [*_PART]).select(*_PART, "family", F.explode(_sought(F.col("short_titles"))).alias("key"))
    posted = sought.join(_postings(sized.filter("many").drop("many")), ["doc_id", "family", "key"])
    return direct.select(*_PART, "ref_idx").unionByName(posted.select(*_PART, "ref_idx")).distinct()


def shortened(rows: DataFrame, references: DataFrame, few: int = FEW) -> DataFrame:
    """(doc_id, foot_ord, part_idx, ref_idx): the reference that a shortened citation means.

    References of the document whose author's family is a word of the part come in question. A title that the
    quotation or the part holds decides at once, in the references' order; else the largest share of the title's
    words, of at least ``LEAST_OVERLAP`` or with its first word, earliest first. Of equal titles of a family the first
    counts.
    """
    words = rows.withColumn("clean", T.spaced(F.col("part"))).withColumn("words", F.split("clean", " "))
    words = words.select(*_PART, "clean", "words", T.spaced(F.regexp_extract("part", QUOTED, 1)).alias("quoted"), F.col("part").rlike(QUOTED).alias("has_quote"))
    titles = references.filter("title <> ''").select("doc_id", "ref_idx", T.spaced(F.col("title")).alias("title"), F.explode(F.array_distinct(F.transform("families", T.spaced))).alias("family")).filter("family <> ''")
    titles = titles.groupBy("doc_id", "family", "title").agg(F.min("ref_idx").alias("ref_idx"))
    pair = shortened_candidates(words, titles, few).join(words, [*_PART]).join(titles.select("doc_id", "ref_idx", "title").distinct(), ["doc_id", "ref_idx"])
    holds = F.contains("clean", "title") | (F.col("has_quote") & (F.contains("title", "quoted") | F.contains("quoted", "title")))
    long_words = _long(F.split("title", " "))
    share = F.size(F.filter(long_words, lambda w: F.array_contains(F.col("words"), w))) / F.size(long_words)
    first = F.split("title", " ")[0]
    pair = pair.withColumn("share", F.when(F.size(long_words) > 0, share).otherwise(0.0))
    enough = (F.col("share") > 0) & ((F.col("share") >= LEAST_OVERLAP) | ((F.length(first) > 2) & F.array_contains(F.col("words"), first)))
    pair = pair.withColumn("tier", F.when(holds, 0).when(enough, 1)).filter("tier is not null")
    rank = F.struct("tier", F.when(F.col("tier") == 0, 0.0).otherwise(-F.col("share")), "ref_idx")
    return pair.groupBy(*_PART).agg(F.min_by("ref_idx", rank).alias("ref_idx"))


def resolved(footnotes: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, foot_ord, foot_id, part_idx, part, kind, keys, resolved_from).

    Inline citations come first, then those written out, then shortened ones, then repetitions of the last part of the document with keys.
    """
    rows = parts(footnotes).withColumn("inline", inline_keys(F.col("part")))
    # Several joins read the parts, whose keys are costly.
    rows = kept(rows.withColumn("full", F.when(F.col("inline").isNull(), R.full_text_keys(F.col("part")))))
    short = shortened(rows.filter("inline is null and full is null"), references).join(references.select("doc_id", "ref_idx", F.col("keys").alias("short_keys")), ["doc_id", "ref_idx"]).drop("ref_idx")
    rows = rows.join(short, ["doc_id", "foot_ord", "part_idx"], "left")
    rows = rows.withColumn("own", F.coalesce("inline", "full", "short_keys")).withColumn("repeat", F.col("own").isNull() & F.col("part").rlike(REPEAT))
    # The history of a document is read in its order; documents are apart.
    before = Window.partitionBy("doc_id").orderBy("foot_ord", "part_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("keys", F.coalesce("own", F.when(F.col("repeat"), F.last("own", ignorenulls=True).over(before))))
    rows = rows.withColumn("resolved_from", F.when(F.col("repeat"), F.last(F.when(F.col("keys").isNotNull(), F.col("foot_id")), ignorenulls=True).over(before)))
    kind = F.when(F.col("inline").isNotNull(), "footnote-inline").when(F.col("full").isNotNull(), "footnote-fulltext").when(F.col("short_keys").isNotNull(), "footnote-shortened").when(F.col("keys").isNotNull(), "footnote-repeat").otherwise("footnote-unresolved")
    return rows.select("doc_id", "foot_ord", "foot_id", "part_idx", "part", kind.alias("kind"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "resolved_from")


def rolled_up(rows: DataFrame) -> DataFrame:
    """(doc_id, foot_ord, foot_id, kind, keys, n_parts, resolved_from): the first kind that is resolved, and all keys once."""
    order = F.struct((F.col("kind") == "footnote-unresolved").cast("int"), "part_idx")
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "keys")))
    return rows.groupBy("doc_id", "foot_ord", "foot_id").agg(F.min_by("kind", order).alias("kind"), F.array_distinct(F.flatten(F.transform(ordered, lambda p: p["keys"]))).alias("keys"), F.count("*").alias("n_parts"), F.min_by("resolved_from", order).alias("resolved_from"))
