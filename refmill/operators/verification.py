"""References against catalogue candidates: scores, the best match, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import normalized, tokens
from .keeping import kept

TOP_HITS = 5
FIELDS = ("title", "authors", "year", "journal", "doi", "isbn")


class CatalogTableConnector:
    """Candidates from a table of works, ``TOP_HITS`` a reference: equal titles first, then most shared words, then
    the smallest work_id; a work shares ``least`` words (one or two) at least, or the title.

    Words are ordered by falling rarity. Titles that share k words have one in common before either's last k - 1
    words, so the more words must be shared, the fewer and rarer words need be looked up. Rounds ask for all but few of
    a title's words first, and then for fewer; a reference leaves once the titles found hold ``TOP_HITS`` works, as
    what shares fewer words can't beat them. What shares just ``least`` words is looked up by those words together: only
    the ``2 * TOP_HITS`` titles with the smallest works are kept for each, as less than ``TOP_HITS`` titles that share
    more were found before. So no frequent word pairs all its titles, and what a reference meets in the last round is
    bounded. A word of many titles is dealt out in parts of about ``part`` titles.
    """

    #: Rare words that the rounds look up: at most so many, the last all that may matter.
    ROUNDS = (1, 2, 4, None)

    def __init__(self, works: DataFrame, source: str, api_rank: int, least: int = 2, part: int = 1_000) -> None:
        if least not in (1, 2):
            raise ValueError("least must be one or two")
        self.works, self.source, self.api_rank, self.least, self.part = works, source, api_rank, least, part

    def _titles(self, works: DataFrame) -> DataFrame:
        """(name, first_work, n_works, words): the catalogue's titles, their smallest work, words by rarity."""
        names = works.select("work_id", normalized(F.col("title")).alias("name")).filter("name <> ''")
        return names.groupBy("name").agg(F.min("work_id").alias("first_work"), F.least(F.count("*"), F.lit(TOP_HITS)).alias("n_works"))

    def _by_rarity(self, titles: DataFrame, counts: DataFrame) -> DataFrame:
        """``titles`` with their words by rarity in the catalogue, and how many titles hold each."""
        word = titles.select("name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word")).join(counts, "word", "left")
        entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
        return titles.join(word.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("w")), "name").select(*titles.columns, F.col("w.word").alias("words"), F.col("w.n").alias("held"))

    def _sharing(self, asked: DataFrame, known: DataFrame, depth: int | None) -> DataFrame:
        """(asked, name, first_work, n_works, shared): all titles that share ``need`` words with those asked for."""
        n = F.size("words")
        need = F.lit(self.least + 1) if depth is None else F.greatest(F.lit(self.least + 1), n - depth + 1)
        parts = lambda held: F.greatest(F.lit(1), F.ceil(held / self.part)).cast("int")
        looked = asked.filter(n > self.least).withColumn("need", need)
        looked = looked.select(F.col("name").alias("asked"), F.col("words").alias("of_asked"), "need", F.explode(F.slice(F.arrays_zip("words", "held"), F.lit(1), n - F.col("need") + 1)).alias("k"))
        looked = looked.select("asked", "of_asked", "need", F.col("k.words").alias("key"), F.explode(F.sequence(F.lit(0), parts(F.col("k.held")) - 1)).alias("at"))
        held = known.filter(n > self.least).select("name", "first_work", "n_works", "words", F.posexplode(F.arrays_zip("words", "held")).alias("i", "k")).filter(n - F.col("i") > self.least)
        held = held.select("name", "first_work", "n_works", "words", (n - F.col("i")).alias("left"), F.col("k.words").alias("key"), F.pmod(F.xxhash64("name"), parts(F.col("k.held"))).cast("int").alias("at"))
        met = looked.join(held, ["key", "at"]).filter(F.col("left") >= F.col("need"))
        met = met.select("asked", "name", "first_work", "n_works", "need", F.size(F.array_intersect("of_asked", "words")).alias("shared"))
        return met.filter((F.col("shared") >= F.col("need")) & (F.col("asked") != F.col("name"))).drop("need").distinct()

    def _together(self, titles: DataFrame) -> DataFrame:
        """``titles`` exploded to what ``least`` of their words are, as ``key``."""
        w = F.col("words")
        each = F.transform(w, lambda x: F.array(x))
        pairs = F.flatten(F.transform(F.array_sort(w), lambda x, i: F.transform(F.slice(F.array_sort(w), i + 2, F.size(w)), lambda y: F.array(x, y))))
        return titles.withColumn("key", F.explode(each if self.least == 1 else pairs))

    def _sharing_least(self, asked: DataFrame, known: DataFrame) -> DataFrame:
        """(asked, name, first_work, n_works, shared) of the titles with the smallest works for each ``least`` words."""
        looked = self._together(asked).select(F.col("name").alias("asked"), F.col("words").alias("of_asked"), "key")
        held = self._together(known).select("key", "name", "first_work", "n_works", "words").join(looked.select("key").distinct(), "key", "left_semi")
        nth = F.row_number().over(Window.partitionBy("key").orderBy("first_work", "name"))
        held = held.withColumn("nth", nth).filter(F.col("nth") <= 2 * TOP_HITS).drop("nth")
        met = looked.join(held, "key").filter(F.col("asked") != F.col("name"))
        return met.select("asked", "name", "first_work", "n_works", F.size(F.array_intersect("of_asked", "words")).alias("shared")).distinct()

    def candidates(self, refs: DataFrame) -> DataFrame:
        """(ref_idx, api_rank, hit_rank, source, <fields>)."""
        asked = refs.select("ref_idx", normalized(F.col("title")).alias("name")).filter("name <> ''")
        titles = kept(self._titles(self.works))
        counts = kept(titles.select("name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
        known = kept(self._by_rarity(titles, counts))
        left = kept(self._by_rarity(asked.select("name").distinct(), counts))
        equal = asked.select(F.col("name").alias("asked")).distinct().join(titles, F.col("asked") == F.col("name")).select("asked", "name", "first_work", "n_works", F.lit(0).alias("shared"))
        found = [equal]
        for depth in self.ROUNDS:
            got = kept(self._sharing(left, known, depth))
            found.append(got)
            full = got.groupBy("asked").agg(F.sum("n_works").alias("n")).filter(F.col("n") >= TOP_HITS)
            left = kept(left.join(full, F.col("name") == F.col("asked"), "left_anti"))
            if left.isEmpty():
                break
        else:
            found.append(self._sharing_least(left, known))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        alike = F.col("asked") == F.col("name")
        best = Window.partitionBy("asked").orderBy(F.desc(alike), F.desc("shared"), "first_work")
        names = every.distinct().withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= TOP_HITS).select("asked", "name", "shared")
        works = self.works.withColumn("_name", normalized(F.col("title")))
        nth = F.row_number().over(Window.partitionBy("_name").orderBy("work_id"))
        works = works.join(names.select(F.col("name").alias("_name")).distinct(), "_name", "left_semi").withColumn("_nth", nth).filter(F.col("_nth") <= TOP_HITS)
        hits = names.join(works.select(F.col("_name").alias("name"), "work_id", *FIELDS), "name")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(alike), F.desc("shared"), "work_id")) - 1
        hits = hits.withColumn("hit_rank", rank).filter(F.col("hit_rank") < TOP_HITS)
        return asked.withColumnRenamed("name", "asked").join(hits, "asked").select("ref_idx", F.lit(self.api_rank).alias("api_rank"), "hit_rank", F.lit(self.source).alias("source"), *FIELDS)


def all_candidates(refs: DataFrame, connectors: list[CatalogTableConnector]) -> DataFrame:
    """The hits of every catalogue, missing columns null."""
    out = None
    for c in connectors:
        got = c.candidates(refs)
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def scored(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref_idx, api_rank, hit_rank, source, match_title, score). Records are normalised before they meet."""
    ready = lambda df: S.prepared(F.struct(*(F.col(f) for f in FIELDS)))
    left = refs.select("ref_idx", ready(refs).alias("ref"))
    right = candidates.select("ref_idx", "api_rank", "hit_rank", "source", F.col("title").alias("match_title"), ready(candidates).alias("cand"))
    return left.join(right, "ref_idx").select("ref_idx", "api_rank", "hit_rank", "source", "match_title", S.prepared_score(F.col("ref"), F.col("cand")).alias("score"))


def best(scores: DataFrame) -> DataFrame:
    """The highest score of each reference, first of ties by source and hit; none under ``MATCH_MIN``."""
    order = F.struct("score", -F.col("api_rank"), -F.col("hit_rank"))
    top = scores.groupBy("ref_idx").agg(F.max_by(F.struct("source", "match_title", "score"), order).alias("m"))
    return top.select("ref_idx", "m.*").filter(F.col("score") >= S.MATCH_MIN)


def verified(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref_idx, found, source, match_title, score, confidence) of every reference."""
    got = refs.select("ref_idx").join(best(scored(refs, candidates)), "ref_idx", "left")
    return got.select("ref_idx", F.coalesce(F.col("score") >= S.FOUND_MIN, F.lit(False)).alias("found"), "source", "match_title", "score", S.confidence(F.col("score")).alias("confidence"))


def statistics(results: DataFrame) -> DataFrame:
    """One row: total, found, not_found, rate in percent, and confidences among what is found."""
    n, hit = F.count("*"), F.count_if("found")
    grade = lambda g: F.count_if(F.col("found") & (F.col("confidence") == g)).alias(f"{g}_confidence")
    return results.agg(n.alias("total"), hit.alias("found"), (n - hit).alias("not_found"), F.when(n == 0, 0).otherwise(F.floor(hit * 100 / n + 0.5)).cast("long").alias("rate"), grade("high"), grade("medium"), grade("low"))


def source_distribution(results: DataFrame) -> DataFrame:
    return results.filter("found and source is not null").groupBy("source").agg(F.count("*").alias("n"))


def shown(results: DataFrame, which: str = "all") -> DataFrame:
    """The results that a list shows: ``all``, ``found`` or ``not-found``."""
    if which not in ("all", "found", "not-found"):
        raise ValueError(which)
    return results if which == "all" else results.filter("found" if which == "found" else "not found")
