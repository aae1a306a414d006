"""Registry of queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import export as X
from ..functions import similarity as S
from ..functions import text as T
from ..operators import bibliography as B
from ..operators import citations as OC
from ..operators import footnotes as OF
from ..operators import layout as L
from ..operators import verification as V
from . import synthetic as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "missing_grouped"


def query(oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# -- texts ----------------------------------------------------------------------------------------------------

_FOLD = "translate(text, 'İIıiŞşĞğÇçÖöÜü', 'iiiissggccoouu')"
_NORMAL = f"trim(regexp_replace(regexp_replace(lower(strip_accents({_FOLD})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def fold_turkish(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.fold_turkish(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, md5({_NORMAL}) AS normalized FROM documents")
def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("normalized"))


@query(f"SELECT doc_id, CAST(len(ts) AS INT) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens FROM (SELECT doc_id, list_filter(string_split({_NORMAL}, ' '), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)) AS ts FROM documents)")
def meaningful_tokens(spark: SparkSession, d: str) -> DataFrame:
    ts = _docs(spark, d).select("doc_id", T.tokens(T.normalized(F.col("text"))).alias("ts"))
    return ts.select("doc_id", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens"))


_PAIRS = "SELECT a.p_partkey AS k, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_partkey = b.p_partkey - 1"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = Y.parts(spark, d)
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("y")), "k")


def _lev_sql(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


def _dice_sql(a: str, b: str) -> str:
    g = lambda c: f"list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))"
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct({g(a)}), "
        f"lambda h: least(len(list_filter({g(a)}, lambda u: u = h)), len(list_filter({g(b)}, lambda u: u = h))))), 0) / (length({a}) + length({b}) - 2) END)"
    )


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents(translate({c}, 'İIıiŞşĞğÇçÖöÜü', 'iiiissggccoouu'))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _toks_sql(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"


def _similar_sql(a: str, b: str) -> str:
    """Over plain columns: wrapped in a scalar subquery so that each step is written once."""
    return f"""(SELECT CASE WHEN na = '' OR nb = '' THEN 0.0 WHEN na = nb THEN 1.0
      WHEN len(ta) >= 2 AND len(tb) >= 2 THEN len(list_distinct(list_intersect(ta, tb))) / len(list_distinct(list_concat(ta, tb)))
      WHEN len(ta) > 0 AND len(tb) > 0 THEN {_dice_sql("ja", "jb")} ELSE {_dice_sql("na", "nb")} END
      FROM (SELECT *, array_to_string(ta, ' ') AS ja, array_to_string(tb, ' ') AS jb FROM (SELECT na, nb, {_toks_sql("na")} AS ta, {_toks_sql("nb")} AS tb FROM (SELECT {_norm_sql(a)} AS na, {_norm_sql(b)} AS nb))))"""


@query(f"SELECT k, round({_lev_sql('x', 'y')}, 6) AS ratio FROM ({_PAIRS})")
def levenshtein_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", F.round(S.levenshtein_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


@query(f"SELECT k, round({_dice_sql('x', 'y')}, 6) AS dice FROM ({_PAIRS})")
def dice(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", F.round(S.dice(F.col("x"), F.col("y")), 6).alias("dice"))


@query(f"SELECT k, round({_similar_sql('x', 'y')}, 6) AS similarity FROM ({_PAIRS})")
def string_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("k", F.round(S.string_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


# -- citations ------------------------------------------------------------------------------------------------

# All names of the views but one are plain ASCII words, so their keys need no more than lower case.
_CITED = f"""SELECT {Y.DOC} AS doc_id, p_partkey AS para_idx, c.kind AS kind, c.no AS cit_no, c.display AS display, list_distinct(c.keys) AS keys FROM (SELECT *, unnest([
    {{'no': 0, 'kind': 'narrative', 'display': concat({Y.FIRST}, ' (', {Y.YEAR}, ')'), 'keys': [lower({Y.FIRST}) || ':' || {Y.YEAR}]}},
    {{'no': 1, 'kind': 'parenthetical', 'display': concat('see ', {Y.FIRST}, ', ', {Y.YEAR}), 'keys': [lower({Y.FIRST}) || ':' || {Y.YEAR}]}},
    {{'no': 2, 'kind': 'parenthetical', 'display': concat({Y.FAMILY}, ', ', {Y.YEAR}), 'keys': [lower({Y.FAMILY}) || ':' || {Y.YEAR}]}},
    {{'no': 3, 'kind': 'parenthetical', 'display': concat('see ', {Y.FIRST}, ' & ', {Y.FAMILY}, ', ', {Y.OTHER_YEAR}, 'a'), 'keys': [lower({Y.FIRST}) || ':' || {Y.OTHER_YEAR} || 'a', lower({Y.FAMILY}) || ':' || {Y.OTHER_YEAR} || 'a']}},
    {{'no': 4, 'kind': 'parenthetical', 'display': concat('Öztürk & World Bank, ', {Y.YEAR}), 'keys': ['ozturk:' || {Y.YEAR}, 'worldbank:' || {Y.YEAR}]}},
    {{'no': 5, 'kind': 'narrative', 'display': concat({Y.FIRST}, ' and ', {Y.FAMILY}, ' (', {Y.YEAR}, ')'), 'keys': [lower({Y.FIRST}) || ':' || {Y.YEAR}, lower({Y.FAMILY}) || ':' || {Y.YEAR}]}}]) AS c FROM part)"""
_REFS = Y.LISTED.replace("FROM part", ", lower(" + Y.FAMILY + ") || ':' || " + Y.YEAR + " AS key FROM part")
_MATCH = f"""{Y.named(cited=_CITED, refs=_REFS)}, hit AS (SELECT c.doc_id, c.para_idx, c.kind, c.cit_no, min(r.ref_idx) AS ref_idx FROM (SELECT *, unnest(keys) AS key FROM cited) c JOIN refs r ON c.doc_id = r.doc_id AND c.key = r.key GROUP BY ALL)"""
_MISSING = _MATCH + ", missing AS (SELECT c.* FROM cited c ANTI JOIN hit h ON c.doc_id = h.doc_id AND c.para_idx = h.para_idx AND c.kind = h.kind AND c.cit_no = h.cit_no)"
_KEYS = "array_to_string(list_sort(keys), '|')"


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return OC.extracted(Y.view(spark, d, Y.PARAGRAPHS))


def _references(spark: SparkSession, d: str) -> DataFrame:
    r = Y.view(spark, d, Y.LISTED)
    return r.withColumn("keys", F.array(T.key(F.col("family"), F.col("year")))).withColumn("families", F.array("family"))


def _sorted_keys():
    return F.array_join(F.array_sort("keys"), "|").alias("keys")


@query(f"{Y.named(cited=_CITED)} SELECT para_idx, cit_no, display FROM cited WHERE kind = 'parenthetical'")
def citations_parenthetical(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).filter("kind = 'parenthetical'").select("para_idx", "cit_no", "display")


@query(f"{Y.named(cited=_CITED)} SELECT para_idx, cit_no, display FROM cited WHERE kind = 'narrative'")
def citations_narrative(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).filter("kind = 'narrative'").select("para_idx", "cit_no", "display")


@query(f"{Y.named(cited=_CITED)} SELECT para_idx, kind, cit_no, {_KEYS} AS keys FROM cited")
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).select("para_idx", "kind", "cit_no", _sorted_keys())


@query(_MISSING + f" SELECT doc_id, para_idx, kind, cit_no, display, {_KEYS} AS keys FROM missing")
def missing_citations(spark: SparkSession, d: str) -> DataFrame:
    return OC.missing(_citations(spark, d), _references(spark, d)).select("doc_id", "para_idx", "kind", "cit_no", "display", _sorted_keys())


@query(_MATCH + " SELECT doc_id, para_idx, kind, cit_no, count(*) AS n FROM hit GROUP BY ALL")
def matched_citations(spark: SparkSession, d: str) -> DataFrame:
    return OC.matched(_citations(spark, d), _references(spark, d)).groupBy("doc_id", "para_idx", "kind", "cit_no").agg(F.count("*").alias("n"))


@query(_MISSING + f""", g AS (SELECT *, {_KEYS} AS group_key, row_number() OVER (PARTITION BY doc_id, {_KEYS} ORDER BY para_idx, cit_no) AS n FROM missing)
  SELECT doc_id, group_key, max(display) FILTER (WHERE n = 1) AS display, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(para_idx + 1))), ',') AS paragraphs FROM g GROUP BY ALL""")
def missing_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = OC.grouped(OC.missing(_citations(spark, d), _references(spark, d)))
    return rows.select("doc_id", "group_key", "display", "occurrences", F.array_join("paragraphs", ",").alias("paragraphs"))


# -- footnotes ------------------------------------------------------------------------------------------------

_PARTED = f"""SELECT doc_id, foot_ord, foot_id, CAST(i - 1 AS INT) AS part_idx, trim(ps[i]) AS part FROM (
  SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '((?:[^;“"«»”]|[“"«»”][^“"«»”]*(?:[“"«»”]|$))+)', 1) AS ps FROM foot)) WHERE trim(ps[i]) <> ''"""


def _footnotes(spark: SparkSession, d: str) -> DataFrame:
    return Y.view(spark, d, Y.FOOTNOTES)


@query(f"{Y.named(foot=Y.FOOTNOTES)} SELECT foot_ord, part_idx, part FROM ({_PARTED})")
def footnote_split(spark: SparkSession, d: str) -> DataFrame:
    return OF.parts(_footnotes(spark, d)).select("foot_ord", "part_idx", "part")


_SPACED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TIERS = f"""{Y.named(foot=Y.FOOTNOTES, refs=Y.LISTED)}, p AS (SELECT *, {_SPACED.format("part")} AS clean, regexp_matches(part, '[“"‘«''”’»]') AS marked,
  {_SPACED.format("regexp_extract(part, '[“]([^”]+)[”]', 1)")} AS quoted, regexp_matches(part, '[“][^”]+[”]') AS has_quote,
  CASE WHEN regexp_matches(part, '^[(][A-Za-z]+, [0-9]{{4}}[)]$') THEN lower(regexp_extract(part, '^[(]([A-Za-z]+)', 1)) || ':' || regexp_extract(part, '([0-9]{{4}})[)]$', 1) END AS inline,
  CASE WHEN regexp_matches(part, '^[A-Za-z]+, Q[.] .* [0-9]{{4}}[.]$') THEN lower(regexp_extract(part, '^([A-Za-z]+)', 1)) || ':' || regexp_extract(part, '([0-9]{{4}})[.]$', 1) END AS written FROM ({_PARTED})),
t AS (SELECT doc_id, ref_idx, lower(family) AS family, lower(family) || ':' || year AS key, {_SPACED.format("title")} AS title FROM refs),
c AS (SELECT p.doc_id, foot_ord, part_idx, ref_idx, key, contains(clean, title) OR (has_quote AND (contains(title, quoted) OR contains(quoted, title))) AS holds, string_split(clean, ' ') AS words,
  list_filter(string_split(title, ' '), lambda w: length(w) > 2) AS long_words, string_split(title, ' ')[1] AS first FROM p JOIN t ON p.doc_id = t.doc_id AND list_contains(string_split(clean, ' '), t.family) WHERE inline IS NULL AND written IS NULL),
s AS (SELECT *, CASE WHEN len(long_words) = 0 THEN 0.0 ELSE len(list_filter(long_words, lambda w: list_contains(words, w))) / len(long_words) END AS share FROM c),
b AS (SELECT doc_id, foot_ord, part_idx, key AS short FROM s WHERE holds OR (share > 0 AND (share >= 0.3 OR (length(first) > 2 AND list_contains(words, first))))
  QUALIFY row_number() OVER (PARTITION BY foot_ord, part_idx ORDER BY CASE WHEN holds THEN 0 ELSE 1 END, CASE WHEN holds THEN 0.0 ELSE -share END, ref_idx) = 1),
o AS (SELECT p.*, b.short, coalesce(inline, written, short) AS own, coalesce(inline, written, short) IS NULL AND regexp_matches(part, '^Ibid') AS again FROM p LEFT JOIN b USING (doc_id, foot_ord, part_idx)),
h AS (SELECT *, CASE WHEN again THEN last_value(own IGNORE NULLS) OVER w ELSE own END AS key FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY foot_ord, part_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
resolved AS (SELECT *, CASE WHEN again THEN last_value(CASE WHEN key IS NOT NULL THEN foot_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY foot_ord, part_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS resolved_from,
  CASE WHEN inline IS NOT NULL THEN 'footnote-inline' WHEN written IS NOT NULL THEN 'footnote-fulltext' WHEN short IS NOT NULL THEN 'footnote-shortened' WHEN key IS NOT NULL THEN 'footnote-repeat' ELSE 'footnote-unresolved' END AS kind FROM h)"""


@query(_TIERS + " SELECT foot_ord, part_idx, kind, coalesce(key, '') AS keys, resolved_from FROM resolved")
def footnote_resolved(spark: SparkSession, d: str) -> DataFrame:
    return OF.resolved(_footnotes(spark, d), _references(spark, d)).select("foot_ord", "part_idx", "kind", _sorted_keys(), "resolved_from")


@query(
    _TIERS
    + """ SELECT foot_ord, arg_min(kind, CASE WHEN kind = 'footnote-unresolved' THEN 1000 ELSE 0 END + part_idx) AS kind, count(*) AS n_parts, coalesce(array_to_string(list_sort(list_distinct(list(key) FILTER (WHERE key IS NOT NULL))), '|'), '') AS keys
  FROM resolved GROUP BY foot_ord"""
)
def footnote_kinds(spark: SparkSession, d: str) -> DataFrame:
    return OF.rolled_up(OF.resolved(_footnotes(spark, d), _references(spark, d))).select("foot_ord", "kind", "n_parts", _sorted_keys())


# -- bibliographies -------------------------------------------------------------------------------------------

_SECTION = r"""SELECT doc_id, CASE WHEN p % 5 <> 0 THEN trim(regexp_replace(regexp_extract(text, '(?s)(?:^|\n)(?:## References|Kaynakça)\n(.*)$', 1), '(?s)\nAPPENDIX.*$', ''), E' \n') END AS section FROM (SELECT *, doc_id AS p FROM sectioned)"""


@query(f"{Y.named(sectioned=Y.SECTIONED)} {_SECTION}")
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    return Y.view(spark, d, Y.SECTIONED).select("doc_id", B.section(F.col("text")).alias("section"))


@query(f"{Y.named(refs=Y.REFERENCES)} SELECT ref_idx, family || ', ' || initial || '.' AS authors FROM refs")
def authors(spark: SparkSession, d: str) -> DataFrame:
    part = F.trim(F.split_part("entry", F.lit("("), F.lit(1)))
    return Y.view(spark, d, Y.REFERENCES).select("ref_idx", F.array_join(B.authors(part), "; ").alias("authors"))


@query(f"{Y.named(refs=Y.REFERENCES)} SELECT ref_idx, family || ', ' || initial || '.' AS authors, CAST(year AS INT) AS year, title, journal, (ref_idx % 100 + 1) || '-' || (ref_idx % 100 + 9) AS pages FROM refs")
def parse_entry(spark: SparkSession, d: str) -> DataFrame:
    got = B.parsed(Y.view(spark, d, Y.REFERENCES).select("ref_idx", "entry"))
    return got.select("ref_idx", F.array_join("authors", "; ").alias("authors"), "year", "title", "journal", "pages")


@query(f"{Y.named(refs=Y.REFERENCES)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS INT) AS part_idx, entry FROM refs")
def reference_split(spark: SparkSession, d: str) -> DataFrame:
    glued = Y.view(spark, d, Y.REFERENCES).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", "entry"))), lambda x: x["entry"]), " ").alias("text"))
    return glued.select("doc_id", F.posexplode(B.split_entries(F.col("text"))).alias("part_idx", "entry"))


# -- verification ---------------------------------------------------------------------------------------------

_SCORED = f"""{Y.named(refs=Y.REFERENCES, cands=Y.CANDIDATES)}, pair AS (
  SELECT r.ref_idx, c.api_rank, c.hit_rank, c.source, r.title AS rt, c.title AS ct, r.journal AS rj, c.journal AS cj, CAST(r.year AS INT) AS ry, c.year AS cy, lower(r.family) AS rs, lower(split_part(c.author, ',', 1)) AS cs,
    CASE WHEN r.ref_idx % 17 = 0 THEN '10.1000/' || r.ref_idx ELSE '' END AS rd, replace(c.doi, 'https://doi.org/', '') AS cd FROM refs r JOIN cands c USING (ref_idx)
), scored AS (
  SELECT ref_idx, api_rank, hit_rank, source, ct AS match_title, CAST(CASE WHEN rd <> '' AND rd = cd THEN 100 ELSE floor(least(100, 50 * {_similar_sql("rt", "ct")}
    + CASE WHEN rs = cs OR (length(rs) >= 3 AND length(cs) >= 3 AND {_lev_sql("rs", "cs")} >= 0.85) THEN 25.0 ELSE 0.0 END
    + CASE WHEN ry = cy THEN 15.0 WHEN abs(ry - cy) <= 1 THEN 7.5 ELSE 0.0 END + 10 * {_similar_sql("rj", "cj")}) + 0.5) END AS INT) AS score FROM pair
)"""
_BEST = _SCORED + """, best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ref_idx ORDER BY score DESC, api_rank, hit_rank) AS n FROM scored) WHERE n = 1 AND score >= 30),
verified AS (SELECT r.ref_idx, coalesce(b.score >= 40, false) AS found, b.source, b.match_title, b.score, CASE WHEN b.score >= 80 THEN 'high' WHEN b.score >= 60 THEN 'medium' WHEN b.score >= 40 THEN 'low' END AS confidence FROM refs r LEFT JOIN best b USING (ref_idx))"""


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("isbn", F.lit(""))


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = Y.view(spark, d, Y.REFERENCES)
    doi = F.when(F.col("ref_idx") % 17 == 0, F.concat(F.lit("10.1000/"), F.col("ref_idx").cast("string"))).otherwise("")
    return _fields(r.select("ref_idx", "title", F.array(F.concat("family", F.lit(", "), "initial", F.lit("."))).alias("authors"), F.col("year").cast("int").alias("year"), "journal", doi.alias("doi")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _fields(Y.view(spark, d, Y.CANDIDATES).withColumn("authors", F.array("author")).withColumn("year", F.col("year").cast("int")))


@query(_SCORED + " SELECT * FROM scored")
def match_score(spark: SparkSession, d: str) -> DataFrame:
    return V.scored(_records(spark, d), _candidates(spark, d))


@query(_BEST + " SELECT ref_idx, source, match_title, score FROM best")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return V.best(V.scored(_records(spark, d), _candidates(spark, d)))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    return V.verified(_records(spark, d), _candidates(spark, d))


@query(_BEST + " SELECT * FROM verified")
def verify(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)


@query(_BEST + """ SELECT count(*) AS total, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE NOT found) AS not_found, CAST(floor(count(*) FILTER (WHERE found) * 100 / count(*) + 0.5) AS BIGINT) AS rate,
  count(*) FILTER (WHERE confidence = 'high') AS high_confidence, count(*) FILTER (WHERE confidence = 'medium') AS medium_confidence, count(*) FILTER (WHERE confidence = 'low') AS low_confidence FROM verified""")
def verification_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.statistics(_verified(spark, d))


@query(_BEST + " SELECT source, count(*) AS n FROM verified WHERE found GROUP BY source")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return V.source_distribution(_verified(spark, d))


@query(f"""{Y.named(refs=Y.REFERENCES)}, t AS (SELECT ref_idx, title, {_norm_sql("title")} AS name FROM refs), w AS (SELECT ref_idx, unnest(list_distinct({_toks_sql("name")})) AS word FROM t),
shared AS (SELECT a.ref_idx, b.ref_idx AS work_id, count(*) AS n FROM w a JOIN w b ON a.word = b.word GROUP BY ALL HAVING count(*) >= 2),
pair AS (SELECT ref_idx, work_id, n FROM shared UNION ALL SELECT a.ref_idx, b.ref_idx, 0 FROM t a JOIN t b ON a.name = b.name),
ranked AS (SELECT p.ref_idx, b.title, row_number() OVER (PARTITION BY p.ref_idx ORDER BY a.name = b.name DESC, p.n DESC, p.work_id) - 1 AS hit_rank FROM (SELECT ref_idx, work_id, max(n) AS n FROM pair GROUP BY ALL) p JOIN t a ON a.ref_idx = p.ref_idx JOIN t b ON b.ref_idx = p.work_id)
SELECT ref_idx, 0 AS api_rank, CAST(hit_rank AS INT) AS hit_rank, 'catalog' AS source, title FROM ranked WHERE hit_rank < 5""")
def catalog_candidates(spark: SparkSession, d: str) -> DataFrame:
    works = _records(spark, d).withColumn("work_id", F.col("ref_idx")).drop("ref_idx")
    return V.all_candidates(_records(spark, d), [V.CatalogTableConnector(works, "catalog", 0)]).select("ref_idx", "api_rank", "hit_rank", "source", "title")


# -- exports --------------------------------------------------------------------------------------------------

_KIND = "CASE ref_idx % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'book' WHEN 2 THEN 'chapter' ELSE 'web' END"
_STRUCT = f"SELECT ref_idx, entry AS display, family, initial || '.' AS given, title, year, {_KIND} AS type, CASE WHEN ref_idx % 4 IN (0, 2) THEN journal ELSE '' END AS container, CASE WHEN ref_idx % 4 IN (1, 2) THEN 'Press' ELSE '' END AS publisher, CASE WHEN ref_idx % 8 = 1 THEN 'Ankara' ELSE '' END AS place, CASE WHEN ref_idx % 4 = 3 THEN 'https://a.example/' || ref_idx ELSE '' END AS url, CASE WHEN ref_idx % 17 = 0 THEN '10.1000/' || ref_idx ELSE '' END AS doi FROM refs"
_ITEMS = Y.named(refs=Y.REFERENCES) + f", items AS ({_STRUCT})"
_opt = lambda tag, c: f"CASE WHEN {c} <> '' THEN '{tag}  - ' || {c} END"


def _structured(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(_STRUCT.replace("FROM refs", "FROM {refs}"), refs=Y.view(spark, d, Y.REFERENCES))
    author = F.struct("family", "given", F.concat_ws(" ", "given", "family").alias("full"))
    text = F.concat_ws(" ", "given", "family").alias("author_text")
    s = F.struct("title", "year", "type", "container", "publisher", "place", "url", "doi", F.array(author).alias("authors"), text, F.concat_ws(", ", "family", "given").alias("bibliography_author_text"), F.col("year").alias("date_text"), F.lit("").alias("access_date"))
    return r.select("ref_idx", "display", s.alias("s"))


@query(_ITEMS + f""" SELECT ref_idx, concat_ws(E'\\n', 'TY  - ' || CASE type WHEN 'article' THEN 'JOUR' WHEN 'web' THEN 'WEB' WHEN 'chapter' THEN 'CHAP' ELSE 'BOOK' END, 'AU  - ' || family || ', ' || given, 'TI  - ' || title,
  {_opt("T2", "container")}, {_opt("PB", "publisher")}, {_opt("CY", "place")}, 'PY  - ' || year, {_opt("DO", "doi")}, {_opt("UR", "url")}, 'N1  - Original: ' || display, 'ER  -') AS ris FROM items""")
def ris(spark: SparkSession, d: str) -> DataFrame:
    return _structured(spark, d).select("ref_idx", X.ris(F.col("display"), F.col("s")).alias("ris"))


_field = lambda n, c: f"CASE WHEN {c} <> '' THEN '  {n} = {{' || {c} || '}}' END"


@query(_ITEMS + f""" SELECT ref_idx, '@' || CASE type WHEN 'article' THEN 'article' WHEN 'web' THEN 'online' WHEN 'chapter' THEN 'incollection' ELSE 'book' END || '{{' || family || year || left(replace(title, ' ', ''), 18) || E',\\n' ||
  concat_ws(E',\\n', {_field("title", "title")}, {_field("author", "given || ' ' || family")}, {_field("year", "year")}, CASE WHEN type = 'article' THEN {_field("journal", "container")} END, CASE WHEN type = 'chapter' THEN {_field("booktitle", "container")} END,
  {_field("publisher", "publisher")}, {_field("address", "place")}, {_field("doi", "doi")}, {_field("url", "url")}, {_field("note", "'Original: ' || display")}) || E'\\n}}' AS bibtex FROM items""")
def bibtex(spark: SparkSession, d: str) -> DataFrame:
    return _structured(spark, d).select("ref_idx", X.bibtex(F.col("display"), F.col("s")).alias("bibtex"))


@query(_ITEMS + " SELECT ref_idx, CASE type WHEN 'article' THEN 'article-journal' WHEN 'web' THEN 'webpage' ELSE type END AS type, title, CAST(year AS INT) AS year, nullif(doi, '') AS doi, nullif(url, '') AS url, nullif(container, '') AS container FROM items")
def csl(spark: SparkSession, d: str) -> DataFrame:
    c = _structured(spark, d).select("ref_idx", X.csl(F.col("ref_idx"), F.col("display"), F.col("s"), "2024-01-31").alias("c"))
    return c.select("ref_idx", "c.type", "c.title", F.col("c.issued.date-parts")[0][0].alias("year"), F.col("c.DOI").alias("doi"), F.col("c.URL").alias("url"), F.col("c.container-title").alias("container"))


@query(_ITEMS + " SELECT ref_idx, CASE WHEN doi <> '' THEN 'doi-ready' WHEN url <> '' THEN 'url-ready' ELSE 'scholar-needed' END AS status FROM items")
def verification_status(spark: SparkSession, d: str) -> DataFrame:
    return _structured(spark, d).select("ref_idx", X.status(F.col("display"), F.col("s")).alias("status"))


_PRINTED = "concat_ws(', ', nullif(concat_ws(': ', nullif(place, ''), nullif(publisher, '')), ''), year)"


@query(_ITEMS + f""" SELECT ref_idx, CASE WHEN type IN ('article', 'web') THEN given || ' ' || family || ', “' || title || '”' || CASE WHEN container <> '' THEN ', ' || container ELSE '' END || ' (' || year || ')' || CASE WHEN url <> '' THEN ', ' || url ELSE '' END || '.'
    ELSE given || ' ' || family || ', ' || title || ' (' || CASE WHEN container <> '' THEN container || ', ' ELSE '' END || {_PRINTED} || ').' END AS footnote,
  CASE WHEN type IN ('article', 'web') THEN regexp_replace(family || ', ' || given, '[.]+$', '') || '. “' || title || '”' || CASE WHEN container <> '' THEN '. ' || container ELSE '' END || '. ' || year || CASE WHEN url <> '' THEN '. ' || url ELSE '' END || '.'
    ELSE regexp_replace(family || ', ' || given, '[.]+$', '') || '. ' || title || CASE WHEN container <> '' THEN '. ' || container ELSE '' END || '. ' || {_PRINTED} || '.' END AS bibliography FROM items""")
def isnad_format(spark: SparkSession, d: str) -> DataFrame:
    return _structured(spark, d).select("ref_idx", X.footnote(F.col("s")).alias("footnote"), X.bibliography_entry(F.col("s")).alias("bibliography"))


# -- layout ---------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, trim(ls[i]) AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i]) <> ''"


@query(f"""WITH l AS (SELECT *, line_no // 4 AS page_no FROM ({_LINES})), n AS (SELECT doc_id, max(page_no) + 1 AS n_pages FROM l GROUP BY doc_id),
f AS (SELECT DISTINCT doc_id, page_no, trim(regexp_replace(regexp_replace(lower(line), '\\b\\d{{1,4}}\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM l)
  SELECT doc_id, form, count(*) AS pages FROM f JOIN n USING (doc_id) WHERE length(form) >= 8 GROUP BY doc_id, form, n_pages HAVING count(*) >= greatest(3, ceil(n_pages * 0.4))""")
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of documents in pages of four lines."""
    return L.running_lines(L.paged_lines(_docs(spark, d), 4))


@query(f"""WITH l AS ({_LINES}), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM l),
n AS (SELECT *, CASE WHEN prev IS NOT NULL AND (regexp_matches(prev, '-$') OR regexp_matches(line, '^\\p{{Ll}}') OR NOT regexp_matches(prev, '[.?!:]$')) THEN 0 ELSE 1 END AS new FROM b),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS para_idx FROM n)
SELECT doc_id, CAST(para_idx AS BIGINT) AS para_idx, count(*) AS n_lines FROM p GROUP BY ALL""")
def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(L.lines(_docs(spark, d))).select("doc_id", "para_idx", "n_lines")


@query("SELECT p_partkey AS doc_id, 1 AS line_no FROM part WHERE p_partkey % 5 <> 0")
def references_heading(spark: SparkSession, d: str) -> DataFrame:
    rows = L.lines(Y.view(spark, d, Y.SECTIONED))
    return rows.filter(C.is_references_heading(F.regexp_replace("line", "^#+ ", ""))).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


@query(f"{Y.named(refs=Y.REFERENCES)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS INT) AS ref_no, entry FROM refs")
def section_references(spark: SparkSession, d: str) -> DataFrame:
    r = Y.view(spark, d, Y.REFERENCES)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", "entry"))), lambda x: x["entry"])
    docs = r.groupBy("doc_id").agg(F.concat(F.lit("Body.\nReferences\n"), F.array_join(lines, "\n")).alias("text"))
    return B.references(docs).select("doc_id", F.col("ref_idx").alias("ref_no"), "entry")


@query(_BEST + """, r AS (SELECT doc_id, found, row_number() OVER (PARTITION BY doc_id, found ORDER BY ref_idx) || '. ' || entry || CASE WHEN found THEN chr(10) || '   ' || source || ' | ' || score || '/100' ELSE chr(10) || '   Authors: ' || family || ', ' || initial || '.' || chr(10) || '   Year: ' || year END AS line,
    row_number() OVER (PARTITION BY doc_id, found ORDER BY ref_idx) AS n FROM verified JOIN refs USING (ref_idx))
  SELECT doc_id, 'Date: 2024-01-31' || chr(10) || 'References: ' || count(*) || chr(10) || 'Found: ' || count(*) FILTER (WHERE found) || chr(10) || 'Not found: ' || count(*) FILTER (WHERE NOT found) || chr(10) || 'Rate: ' || CAST(floor(count(*) FILTER (WHERE found) * 100 / count(*) + 0.5) AS BIGINT) || '%'
    || chr(10) || chr(10) || 'FOUND' || chr(10) || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) ORDER BY n) FILTER (WHERE found), '') || chr(10) || chr(10) || 'NOT FOUND' || chr(10) || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) ORDER BY n) FILTER (WHERE NOT found), '') AS report FROM r GROUP BY doc_id""")
def verification_report(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import reports

    refs = Y.view(spark, d, Y.REFERENCES).select("ref_idx", "doc_id", F.col("entry").alias("original_text"), F.array(F.concat("family", F.lit(", "), "initial", F.lit("."))).alias("authors"), "year")
    return reports.verification_report(_verified(spark, d).join(refs, "ref_idx").withColumn("doi", F.lit("")), "2024-01-31")


@query(f"""{Y.named(refs=Y.REFERENCES)} SELECT ref_idx, initial || '. ' || family AS author_text, year, title, journal || ', ' || regexp_extract(entry, 'Journal, (.*)[.]$', 1) AS container, 'article' AS type,
  array_to_string(list_sort(list_distinct([lower(family) || ':' || year, lower(initial || left(family, 1)) || ':' || year])), '|') AS keys FROM refs""")
def record_parse(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import records as R

    got = R.parsed(Y.view(spark, d, Y.REFERENCES).select("ref_idx", "entry"))
    return got.select("ref_idx", "structured.author_text", "structured.year", "structured.title", "structured.container", "structured.type", _sorted_keys())


def _manuscripts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts: the body's paragraphs, a heading, and the bibliography, of each document of the views."""
    lines = lambda df, n, c, o: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda x: x[c]), "\n").alias(n))
    body, refs = lines(Y.view(spark, d, Y.PARAGRAPHS), "body", "text", "para_idx"), lines(Y.view(spark, d, Y.LISTED), "refs", "entry", "ref_idx")
    return body.join(refs, "doc_id").select("doc_id", F.concat_ws("\n", "body", F.lit("Kaynakça"), "refs").alias("text"))


@query(_MISSING + f""", n AS (SELECT doc_id, count(*) AS n_refs FROM refs GROUP BY doc_id), b AS (SELECT {Y.DOC} AS doc_id, count(*) AS body FROM part GROUP BY ALL), m AS (SELECT doc_id, count(*) AS missing FROM missing GROUP BY doc_id)
  SELECT doc_id, body + 1 + n_refs AS paragraphs, body AS body_paragraphs, 6 * body AS citations, n_refs AS "references", coalesce(missing, 0) AS missing FROM n JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""")
def audit_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from .audit import audit

    return audit(_manuscripts(spark, d))["diagnostics"].select("doc_id", "paragraphs", "body_paragraphs", "citations", "references", "missing")


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each reference as two lines, the second indented; forty lines a page under a running header."""
    r = Y.view(spark, d, Y.REFERENCES)
    cut = F.length("entry") - F.length(F.regexp_extract("entry", r"(\S+ \S+)$", 1))
    lines = r.select("doc_id", "ref_idx", F.posexplode(F.array(F.trim(F.left("entry", cut)), F.trim(F.substr("entry", cut + 1)))).alias("k", "text"))
    n = F.row_number().over(L.Window.partitionBy("doc_id").orderBy("ref_idx", "k")) - 1
    lines = lines.withColumn("n", n).withColumn("page_no", F.floor(F.col("n") / 10).cast("int") + 1).withColumn("line_no", (F.col("n") % 10 + 1).cast("int"))
    body = lines.select("doc_id", "page_no", "line_no", "text", (F.lit(50.0) + F.col("k") * 20).alias("min_x"), F.lit(400.0).alias("max_x"), (F.lit(580) - F.col("line_no") * 12).cast("int").alias("y"))
    heads = body.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0).alias("line_no"), F.concat(F.col("page_no").cast("string"), F.lit(" Journal of Lines")).alias("text"), F.lit(50.0).alias("min_x"), F.lit(200.0).alias("max_x"), F.lit(630).alias("y"))
    return body.unionByName(heads)


@query(f"{Y.named(refs=Y.REFERENCES)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS INT) AS para_idx, entry AS text FROM refs")
def page_bibliography(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import document

    return document.bibliography(_page_lines(spark, d)).select("doc_id", "para_idx", "text")


@query(f"""{Y.named(refs=Y.REFERENCES)}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS i FROM refs), p AS (SELECT *, CAST(i // 5 + 1 AS INT) AS page_no, lead(i // 5) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM i // 5 AS more FROM n)
  SELECT doc_id, page_no, chr(10) || '## ' || page_no || ' Journal of Lines' || chr(10) || chr(10) || chr(10) || string_agg(CASE WHEN more THEN entry ELSE regexp_extract(entry, '^(.*) (\\S+ \\S+)$', 1) END, chr(10) || chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id, page_no""")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import pages

    return pages.markdown(_page_lines(spark, d))


_AUDITED = _MATCH + f""", notes AS ({Y.NOTES}), own AS (SELECT n.doc_id, foot_ord, foot_id, text, CASE WHEN foot_ord % 3 = 0 THEN lower({Y.FAMILY}) || ':' || {Y.YEAR} END AS own FROM notes n JOIN part ON p_partkey = foot_ord
), keyed AS (SELECT *, CASE foot_ord % 3 WHEN 0 THEN own WHEN 1 THEN lag(own) OVER (PARTITION BY doc_id ORDER BY foot_ord) END AS key FROM own)"""


def _audited_notes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from .audit import audit

    return audit(_manuscripts(spark, d), Y.view(spark, d, Y.NOTES))


@query(_AUDITED + """, gaps AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY foot_ord) AS n FROM keyed k WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = k.doc_id AND r.key = k.key))
  SELECT doc_id, key AS group_key, max(text) FILTER (WHERE n = 1) AS display, count(*) AS occurrences, string_agg(foot_id, ',' ORDER BY foot_ord) AS foot_ids FROM gaps GROUP BY doc_id, key""")
def missing_footnotes(spark: SparkSession, d: str) -> DataFrame:
    return _audited_notes(spark, d)["missing_footnotes"].select("doc_id", "group_key", "display", "occurrences", F.array_join("foot_ids", ",").alias("foot_ids"))


@query(_AUDITED + " SELECT doc_id, foot_ord, text AS part FROM keyed WHERE key IS NULL")
def unresolved_footnotes(spark: SparkSession, d: str) -> DataFrame:
    return _audited_notes(spark, d)["unresolved_footnotes"].select("doc_id", "foot_ord", "part")


@query(_AUDITED + " SELECT doc_id, count(*) AS footnotes, count(*) FILTER (WHERE key IS NULL) AS unresolved_footnotes FROM keyed GROUP BY doc_id")
def footnote_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _audited_notes(spark, d)["footnote_diagnostics"].select("doc_id", "footnotes", "unresolved_footnotes")


@query(_ITEMS + """ SELECT ref_idx, 'src-' || row_number() OVER (PARTITION BY cast(floor(ref_idx / 100) as bigint) ORDER BY ref_idx) AS id, title, given || ' ' || family AS author, year, type, doi, CASE WHEN type = 'web' THEN 'web' WHEN type = 'book' THEN 'google' ELSE 'scholar' END AS verification_kind,
  CASE WHEN type = 'web' THEN 'Web' WHEN type = 'book' THEN 'Google' ELSE 'Scholar' END AS verification_label, title || ' ' || given || ' ' || family || ' ' || year AS query FROM items""")
def verification_records(spark: SparkSession, d: str) -> DataFrame:
    from .audit import records

    rows = _structured(spark, d).select(F.floor(F.col("ref_idx") / 100).alias("doc_id"), "ref_idx", "display", F.col("s").alias("structured"))
    return records(rows, "2024-01-31").select("ref_idx", "id", "title", "author", "year", "type", "doi", "verification_kind", "verification_label", "query")


@query(_AUDITED + """, gaps AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY foot_ord) AS n FROM keyed k WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = k.doc_id AND r.key = k.key)),
g AS (SELECT doc_id, key, max(text) FILTER (WHERE n = 1) AS display, count(*) AS times FROM gaps GROUP BY doc_id, key),
m AS (SELECT doc_id, count(*) AS n, string_agg('- ' || display || ' | ' || times || ' times', chr(10) ORDER BY display, key) AS lines FROM g GROUP BY doc_id),
u AS (SELECT doc_id, string_agg('- ' || foot_id || ': ' || text, chr(10) ORDER BY foot_ord) AS lines FROM keyed WHERE key IS NULL GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n, string_agg('- ' || entry || ' | scholar-needed', chr(10) ORDER BY ref_idx) AS lines FROM refs GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS notes, count(*) FILTER (WHERE key IS NULL) AS unresolved FROM keyed GROUP BY doc_id)
  SELECT doc_id, concat_ws(chr(10), 'Date: 2024-01-31', 'Citations in footnotes: ' || notes, 'References: ' || e.n, 'Sources missing: ' || coalesce(m.n, 0), 'Footnotes not resolved: ' || unresolved, '', 'Sources missing:', coalesce(m.lines, ''), '', 'Footnotes not resolved:', coalesce(u.lines, ''), '', 'Records:', coalesce(e.lines, '')) AS report
  FROM a JOIN e USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id)""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import reports

    return reports.audit_report(_audited_notes(spark, d), "2024-01-31", footnotes=True)


# -- whole page documents ---------------------------------------------------------------------------------------


def _whole_pages(spark: SparkSession, d: str) -> DataFrame:
    return Y.view(spark, d, Y.PAGE_LINES)


_PAGE_FACTS = f"""WITH p AS (SELECT {Y.DOC} AS doc_id, p_partkey, lower({Y.FIRST}) || ':' || {Y.YEAR} AS told, lower({Y.FAMILY}) || ':' || {Y.YEAR} AS cited FROM part),
r AS (SELECT DISTINCT doc_id, unnest([cited, lower(upper(substr(p_name, 1, 1)) || left({Y.FAMILY}, 1)) || ':' || {Y.YEAR}]) AS key FROM p JOIN part USING (p_partkey) WHERE p_partkey % 3 <> 0),
c AS (SELECT doc_id, p_partkey, unnest(CASE WHEN p_partkey % 7 = 0 THEN [told, cited, cited] ELSE [told, cited] END) AS key FROM p),
m AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = c.doc_id AND r.key = c.key) AS gone FROM c),
n AS (SELECT doc_id, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN cited ELSE last_value(CASE WHEN p_partkey % 7 = 0 THEN cited END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p_partkey) END AS key FROM p WHERE p_partkey % 7 < 2),
l AS (SELECT doc_id, p_partkey, k, row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey, k) - 1 AS i FROM (SELECT doc_id, p_partkey, unnest([0, 1]) AS k FROM p WHERE p_partkey % 3 <> 0 UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM p)),
e AS (SELECT doc_id, count(*) FILTER (WHERE k = 0 AND (doc_id % 2 = 1 OR i % 40 < 20)) AS entries FROM l GROUP BY doc_id)"""


@query(
    _PAGE_FACTS
    + """ SELECT doc_id, body + 1 + entries AS paragraphs, body AS body_paragraphs, listed + 1 AS candidates, 1::BIGINT AS unparsed, listed AS "references", citations, missing, notes AS footnotes, unresolved AS unresolved_footnotes
  FROM (SELECT doc_id, sum(1 + (p_partkey % 10 = 0)::INT + (p_partkey % 7 < 2)::INT)::BIGINT AS body, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS listed FROM p GROUP BY doc_id) JOIN e USING (doc_id)
  JOIN (SELECT doc_id, count(*) AS citations, count(*) FILTER (WHERE gone) AS missing FROM m GROUP BY doc_id) USING (doc_id)
  JOIN (SELECT doc_id, count(*) AS notes, count(*) FILTER (WHERE key IS NULL) AS unresolved FROM n GROUP BY doc_id) USING (doc_id)"""
)
def audit_pages(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the audit of page documents, from lines to resolved footnotes."""
    from .audit import audit_pages

    return audit_pages(_whole_pages(spark, d))["diagnostics"].select("doc_id", "paragraphs", "body_paragraphs", "candidates", "unparsed", "references", "citations", "missing", "footnotes", "unresolved_footnotes")


@query(_PAGE_FACTS + " SELECT doc_id, key AS group_key, count(*) AS occurrences FROM m WHERE gone GROUP BY doc_id, key")
def missing_in_pages(spark: SparkSession, d: str) -> DataFrame:
    from .audit import audit_pages

    return audit_pages(_whole_pages(spark, d))["missing"].select("doc_id", "group_key", "occurrences")


# Lines of the documents as pages of forty, and what each adds to its paragraph.
_DOC_LINES = f"""SELECT doc_id, CAST(line_no // 40 + 1 AS INT) AS page_no, line_no, line FROM ({_LINES}) WHERE length(line) > 1"""


@query(f"""WITH l AS ({_DOC_LINES}), b AS (SELECT *, lag(line) OVER w AS prev FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT *, prev IS NOT NULL AND (prev LIKE '%-' OR regexp_matches(line, '^\\p{{Ll}}') OR NOT regexp_matches(prev, '[.?!:]$')) AS goes_on FROM b),
n AS (SELECT *, lead(goes_on) OVER (PARTITION BY doc_id ORDER BY line_no) AS more, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM o),
x AS (SELECT *, CASE WHEN NOT goes_on OR prev LIKE '%-' THEN '' ELSE ' ' END || CASE WHEN line LIKE '%-' AND more AND NOT regexp_matches(regexp_extract(line, '(\\S*)$', 1), '/|http|www\\.') THEN left(line, length(line) - 1) ELSE line END AS piece FROM n)
SELECT doc_id, CAST(para - 1 AS BIGINT) AS para_idx, min(page_no) AS page_no, 'body' AS part, md5(string_agg(piece, '' ORDER BY line_no)) AS text FROM x GROUP BY doc_id, para""")
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents' lines, forty a page."""
    from ..operators import document

    place = (F.lit(600) - 12 * (F.col("line_no") % 40)).cast("int").alias("y")
    lines = L.paged(L.lines(_docs(spark, d)), 40).select("doc_id", "page_no", "line_no", F.col("line").alias("text"), F.lit(50.0).alias("min_x"), F.lit(500.0).alias("max_x"), place)
    return document.paragraphs(lines).select("doc_id", "para_idx", "page_no", "part", F.md5("text").alias("text"))


# -- from texts to catalogues -----------------------------------------------------------------------------------

_HITS = f"""{Y.named(numbered=Y.REFERENCES, works=Y.WORKS)}, refs AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS INT) AS ref_no FROM numbered),
t AS (SELECT ref_idx, {_norm_sql("title")} AS name FROM refs), k AS (SELECT api_rank, work_id, {_norm_sql("title")} AS name FROM works),
tw AS (SELECT ref_idx, unnest(list_distinct({_toks_sql("name")})) AS word FROM t), kw AS (SELECT api_rank, work_id, unnest(list_distinct({_toks_sql("name")})) AS word FROM k),
met AS (SELECT ref_idx, api_rank, work_id, count(*) AS n FROM tw JOIN kw USING (word) GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT ref_idx, api_rank, work_id, 0 FROM t JOIN k USING (name)),
cands AS (SELECT m.ref_idx, m.api_rank, m.work_id, row_number() OVER (PARTITION BY m.ref_idx, m.api_rank ORDER BY t.name = k.name DESC, m.n DESC, m.work_id) - 1 AS hit_rank
  FROM (SELECT ref_idx, api_rank, work_id, max(n) AS n FROM met GROUP BY ALL) m JOIN t USING (ref_idx) JOIN k ON k.api_rank = m.api_rank AND k.work_id = m.work_id QUALIFY hit_rank < 5),
pair AS (SELECT r.ref_idx, c.api_rank, c.hit_rank, w.source, r.title AS rt, w.title AS ct, r.journal AS rj, w.journal AS cj, CAST(r.year AS INT) AS ry, w.year AS cy, lower(r.family) AS rs, lower(w.family) AS cs, '' AS rd, '' AS cd
  FROM cands c JOIN refs r USING (ref_idx) JOIN works w ON w.api_rank = c.api_rank AND w.work_id = c.work_id), scored AS ({_SCORED.split("), scored AS (")[1]}"""


def _verification(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from .verification import verification

    r = Y.view(spark, d, Y.REFERENCES)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", "entry"))), lambda x: x["entry"])
    docs = r.groupBy("doc_id").agg(F.concat(F.lit("Body.\nReferences\n"), F.array_join(lines, "\n")).alias("text"))
    works = Y.view(spark, d, Y.WORKS).withColumn("authors", F.array("author")).withColumn("doi", F.lit("")).withColumn("isbn", F.lit(""))
    return verification(docs, [V.CatalogTableConnector(works.filter(F.col("source") == name), name, i) for i, name in enumerate(("openalex", "crossref"))])


@query(_HITS + _BEST[len(_SCORED) :] + " SELECT doc_id, ref_no, found, source, match_title, score, confidence FROM verified JOIN refs USING (ref_idx)")
def verification(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts: their bibliographies, parsed, against two catalogues."""
    got = _verification(spark, d)["results"]
    return got.select("doc_id", F.col("ref_idx.ref_no").alias("ref_no"), "found", "source", "match_title", "score", "confidence")


@query(f"{Y.named(cited=_CITED)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, cit_no) AS INT) AS position, para_idx, display FROM cited QUALIFY position <= 80")
def citations_shown(spark: SparkSession, d: str) -> DataFrame:
    """A report of each document's first eighty citations."""
    return OC.shown(_citations(spark, d)).select("doc_id", "position", "para_idx", "display")


_OF_DOC = "CAST(floor(ref_idx / 100) AS BIGINT)"


@query(f"SELECT {_OF_DOC} AS doc_id, CAST(row_number() OVER (PARTITION BY {_OF_DOC} ORDER BY ref_idx) AS INT) AS position, ref_idx, bibliography AS text FROM ({ORACLES['isnad_format']})")
def isnad_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Each document's bibliography in its own order."""
    from . import audit

    rows = _structured(spark, d).select(F.floor(F.col("ref_idx") / 100).alias("doc_id"), "ref_idx", F.col("s").alias("structured"))
    return audit.isnad_bibliography(rows).select("doc_id", "position", "ref_idx", "text")


@query(
    f"""SELECT doc_id, md5(string_agg(ris, chr(10) ORDER BY ref_idx)) AS ris, md5(string_agg(bibtex, chr(10) || chr(10) ORDER BY ref_idx)) AS bibtex, count(*) AS n
  FROM (SELECT {_OF_DOC} AS doc_id, * FROM ({ORACLES['ris']}) JOIN ({ORACLES['bibtex']}) USING (ref_idx)) GROUP BY doc_id"""
)
def export_files(spark: SparkSession, d: str) -> DataFrame:
    """The export files of each document: RIS, BibTeX, and the number of items of the JSON array."""
    from ..sources import reports

    s = _structured(spark, d)
    rows = s.select(F.floor(F.col("ref_idx") / 100).alias("doc_id"), "ref_idx", X.ris(F.col("display"), F.col("s")).alias("ris"), X.bibtex(F.col("display"), F.col("s")).alias("bibtex"), X.csl(F.col("ref_idx"), F.col("display"), F.col("s"), "2024-01-31").alias("csl"))
    whole = reports.export_files(rows)
    n = F.size(F.from_json("csl", "array<struct<id:string,title:string>>")).cast("long")
    return whole.select("doc_id", F.md5("ris").alias("ris"), F.md5("bibtex").alias("bibtex"), n.alias("n"))


# -- entries of several kinds -----------------------------------------------------------------------------------

_STYLED = Y.named(refs=Y.VARIED)
_VARIED_TITLE = "CASE style WHEN 0 THEN 'The ' || name || ' ' || kind WHEN 1 THEN 'On ' || name || ', ' || kind WHEN 2 THEN 'Pages of ' || name WHEN 3 THEN 'History of ' || kind ELSE 'A chapter on ' || name END"


@query(
    _STYLED
    + f""" SELECT ref_idx, CASE style WHEN 0 THEN family || '; ' || first || '; Anderson' ELSE family END AS families, year, {_VARIED_TITLE} AS title,
  CASE style WHEN 0 THEN brand || ' Journal, ' || size || '(2), 4-9' WHEN 1 THEN brand || ' Journal, 3(2), 1-9' WHEN 4 THEN 'In Doe, A. (Ed.), Book of ' || kind || ' (pp. 1-9)' ELSE '' END AS container,
  CASE WHEN style > 2 THEN 'Press House' ELSE '' END AS publisher, CASE style WHEN 3 THEN 'Ankara' WHEN 4 THEN 'London' ELSE '' END AS place, CASE style WHEN 2 THEN 'https://a.example/' || ref_idx ELSE '' END AS url,
  CASE style WHEN 2 THEN 'web' WHEN 3 THEN 'book' WHEN 4 THEN 'chapter' ELSE 'article' END AS type, CASE style WHEN 2 THEN 'Accessed: 03.04.2021' ELSE '' END AS access_date,
  CASE style WHEN 0 THEN 6 ELSE 2 END AS n_keys FROM refs"""
)
def varied_records(spark: SparkSession, d: str) -> DataFrame:
    """Structured records of entries of five kinds."""
    from ..functions import records as R

    got = R.parsed(Y.view(spark, d, Y.VARIED).select("ref_idx", "entry"))
    names = F.array_join(F.transform("structured.authors", lambda a: a["family"]), "; ").alias("families")
    return got.select("ref_idx", names, *(f"structured.{c}" for c in ("year", "title", "container", "publisher", "place", "url", "type", "access_date")), F.size("keys").alias("n_keys"))


@query(
    _STYLED
    + f""" SELECT ref_idx, CASE style WHEN 0 THEN family || ', ' || initial || '.; ' || first || ', Q.; Anderson, Z.' WHEN 3 THEN family || ', ' || first ELSE family || ', ' || initial || '.' END AS authors, CASE WHEN style <> 3 THEN CAST(year AS INT) END AS year,
  {_VARIED_TITLE} AS title, CASE style WHEN 2 THEN 'https:// a.example/ ' || ref_idx || '. (Accessed: 03.04.2021)' WHEN 3 THEN 'Ankara: Press House, ' || year WHEN 4 THEN 'In Doe, A. (Ed.), Book of ' || kind || ' (pp. 1-9). Press House, London' ELSE brand || ' Journal' END AS journal,
  CASE style WHEN 0 THEN '4-9' WHEN 1 THEN '1-9' WHEN 4 THEN '1-9' ELSE '' END AS pages FROM refs"""
)
def varied_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields for a catalogue's comparison, of entries of five kinds."""
    got = B.parsed(Y.view(spark, d, Y.VARIED).select("ref_idx", "entry"))
    return got.select("ref_idx", F.array_join("authors", "; ").alias("authors"), "year", "title", "journal", "pages")


@query(_STYLED + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) AS i FROM refs) SELECT doc_id, CAST(i - 1 AS INT) AS ref_no, CASE WHEN style = 3 THEN '[' || i || '] ' ELSE '' END || entry AS entry FROM n""")
def varied_references(spark: SparkSession, d: str) -> DataFrame:
    """Numbered bibliographies between a heading and an appendix, parted."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", "entry"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["entry"]))
    docs = Y.view(spark, d, Y.VARIED).groupBy("doc_id").agg(F.concat(F.lit("Body.\n## Kaynaklar\n"), F.array_join(lines, "\n"), F.lit("\nAPPENDIX\nmore")).alias("text"))
    return B.references(docs).select("doc_id", F.col("ref_idx").alias("ref_no"), "entry")
