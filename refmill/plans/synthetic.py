"""Bibliographies, texts, footnotes and catalogues derived from the ``part`` table, in SQL that Spark and DuckDB share.

The given tables hold no citations, so the citation queries read these views of ``part``; each grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FAMILY = "concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"
FIRST = "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2))"
YEAR = "cast(1950 + p_partkey % 70 as string)"
OTHER_YEAR = "cast(1950 + p_partkey % 50 as string)"
#: A hundred parts make a document, so documents keep their size and grow in number.
DOC = "cast(floor(p_partkey / 100) as bigint)"

#: One bibliography entry a part.
REFERENCES = f"""SELECT p_partkey AS ref_idx, {DOC} AS doc_id, {FAMILY} AS family, upper(substr(p_name, 1, 1)) AS initial, {YEAR} AS year,
  concat(p_name, ' ', p_type) AS title, concat(p_brand, ' Journal') AS journal,
  concat({FAMILY}, ', ', upper(substr(p_name, 1, 1)), '. (', {YEAR}, '). ', p_name, ' ', p_type, '. ', p_brand, ' Journal, ', cast(p_size as string), '(', cast(p_partkey % 12 + 1 as string), '), ',
    cast(p_partkey % 100 + 1 as string), '-', cast(p_partkey % 100 + 9 as string), '.') AS entry
FROM part"""
#: Bibliographies that leave out a third of what is cited, for the queries that look for missing entries.
LISTED = f"{REFERENCES} WHERE p_partkey % 3 <> 0"

#: One paragraph a part, with six citations: two in the text, one of them before its parenthesis, and four in
#: parentheses; one of those is written twice, one has a letter beyond ASCII and a corporate name.
PARAGRAPHS = f"""SELECT p_partkey AS para_idx, {DOC} AS doc_id,
  concat({FIRST}, ' (', {YEAR}, ') says so (see ', {FIRST}, ', ', {YEAR}, '). Earlier work (', {FAMILY}, ', ', {YEAR}, '; ', {FAMILY}, ', ', {YEAR}, '; see ', {FIRST}, ' & ', {FAMILY}, ', ', {OTHER_YEAR}, 'a; Öztürk & World Bank, ', {YEAR}, ') and ',
    {FIRST}, ' and ', {FAMILY}, ' (', {YEAR}, ') agree, against (', p_type, ') in ', p_brand, '.') AS text
FROM part"""

#: Footnotes: a citation, a repetition of the last one, and one that cites nothing.
NOTES = f"""SELECT {DOC} AS doc_id, p_partkey AS foot_ord, cast(p_partkey as string) AS foot_id,
  CASE WHEN p_partkey % 3 = 0 THEN concat('(', {FAMILY}, ', ', {YEAR}, ')') WHEN p_partkey % 3 = 1 THEN concat('Ibid., p. ', cast(p_size as string), '.') ELSE concat('Nothing is cited in note ', cast(p_size as string), '.') END AS text
FROM part"""

#: Footnotes of five kinds: in parentheses, repeated, shortened with a quotation, written out, and one that names a title.
FOOTNOTES = f"""SELECT {DOC} AS doc_id, p_partkey AS foot_ord, cast(p_partkey as string) AS foot_id,
  CASE WHEN p_partkey % 4 = 0 THEN concat('(', {FAMILY}, ', ', {YEAR}, ')')
    WHEN p_partkey % 4 = 1 THEN concat('Ibid., p. ', cast(p_size as string), '.')
    WHEN p_partkey % 4 = 2 THEN concat({FAMILY}, ', “', p_name, ' ', p_type, '; more”, ', cast(p_size as string), '; ', {FIRST}, ', other.')
    WHEN p_partkey % 8 = 7 THEN concat({FAMILY}, ', Q. The written-out title. ', {YEAR}, '.')
    ELSE concat('A note on ', p_name, '.') END AS text
FROM part"""

#: A text with a bibliography between a heading and an appendix.
SECTIONED = f"""SELECT p_partkey AS doc_id, concat('Body of ', p_name, '.\n', CASE WHEN p_partkey % 5 = 0 THEN 'No list here' WHEN p_partkey % 2 = 0 THEN '## References' ELSE 'Kaynakça' END, '\n', {FAMILY}, ', X. (', {YEAR}, '). ', p_type, '.\n',
  CASE WHEN p_partkey % 3 = 0 THEN 'APPENDIX\nextra ' ELSE '' END, p_brand) AS text
FROM part"""

#: Catalogue hits: two sources, up to two hits a reference, with perturbed titles and years.
CANDIDATES = f"""SELECT p_partkey AS ref_idx, k AS api_rank, j AS hit_rank, CASE WHEN k = 0 THEN 'openalex' ELSE 'crossref' END AS source,
  CASE WHEN (p_partkey + k + j) % 4 = 0 THEN concat(p_name, ' ', p_type) WHEN (p_partkey + k + j) % 4 = 1 THEN concat(p_name, ' revisited') WHEN (p_partkey + k + j) % 4 = 2 THEN p_brand ELSE concat(p_type, ' of ', p_name) END AS title,
  concat({FAMILY}, CASE WHEN (p_partkey + j) % 3 = 0 THEN 'x' ELSE '' END, ', Q.') AS author, 1950 + p_partkey % 70 + (p_partkey + k) % 3 AS year,
  concat(p_brand, CASE WHEN j = 0 THEN ' Journal' ELSE ' Review' END) AS journal, CASE WHEN p_partkey % 17 = 0 AND j = 1 THEN concat('https://doi.org/10.1000/', cast(p_partkey as string)) ELSE '' END AS doi
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part``, dealt over all tasks: a row is a few bytes of a file but much work, and files are parted by bytes."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition(n, "p_partkey")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=parts(spark, sf_dir))


def named(**views: str) -> str:
    """A WITH clause of views for DuckDB."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items())


_LISTED_LINES = f"""SELECT {DOC} AS doc_id, p_partkey, k, CASE WHEN k = 0 THEN concat({FAMILY}, ', ', upper(substr(p_name, 1, 1)), '. (', {YEAR}, '). ', p_name, ' ', p_type, '.')
    ELSE concat(p_brand, ' Journal, ', cast(p_size as string), '(', cast(p_partkey % 12 + 1 as string), '), ', cast(p_partkey % 100 + 1 as string), '-', cast(p_partkey % 100 + 9 as string), '.') END AS text
  FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) WHERE p_partkey % 3 <> 0
  UNION ALL SELECT DISTINCT {DOC}, cast(-1 as bigint), 0, '– – – – – – –.' FROM part"""

#: Lines of a body: three a part, broken within a citation and a word; a line that many pages repeat, and notes.
BODY_LINES = f"""SELECT {DOC} AS doc_id, p_partkey, k, CASE k WHEN 0 THEN concat({FIRST}, ' (', {YEAR}, ') says that earlier work (', {FAMILY}, ',') WHEN 1 THEN concat({YEAR}, ') on ', p_name, ' inter-') WHEN 2 THEN 'feres with it.'
    WHEN 3 THEN 'Sample 1 was measured again and again.' WHEN 4 THEN CASE WHEN p_partkey % 7 = 0 THEN concat(cast(p_partkey % 100 as string), ' See (', {FAMILY}, ', ', {YEAR}, ').') ELSE concat(cast(p_partkey % 100 as string), ' Ibid., p. 5.') END END AS text
  FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) WHERE k < 3 OR (k = 3 AND p_partkey % 10 = 0) OR (k = 4 AND p_partkey % 7 < 2)"""

#: Pages of whole documents: thirty lines of body a page under a header in the margin, a heading, and a bibliography
#: in one column, or in two where the document's number is even, with an entry that names nobody.
PAGE_LINES = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey, k) - 1 AS n FROM ({BODY_LINES})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey, k) - 1 AS n, 1 + doc_id % 2 AS one FROM ({_LISTED_LINES})),
c AS (SELECT *, cast(floor(n / (40 / one)) as int) AS page, cast(floor(n % (40 / one) / 20) as int) AS col, cast(n % 20 as int) AS row FROM r)
SELECT doc_id, cast(floor(n / 30) as int) + 1 AS page_no, cast(n % 30 as int) + 1 AS line_no, text, 50.0D AS min_x, 500.0D AS max_x, cast(600 - 12 * (n % 30) as int) AS y FROM b
UNION ALL SELECT DISTINCT doc_id, cast(floor(n / 30) as int) + 1, 0, 'A Journal of Lines', 50.0D, 200.0D, 700 FROM b
UNION ALL SELECT DISTINCT doc_id, 1000, 1, 'Kaynakça', 50.0D, 120.0D, 600 FROM b
UNION ALL SELECT doc_id, 1001 + page, row * 2 + col + 1, text, 50.0D + col * 250 + k * 20, 250.0D + col * 250, cast(600 - 12 * row as int) FROM c"""


#: Two catalogues: half the parts as they are cited, with years that are off by up to two, and all with other titles, names and journals.
WORKS = f"""SELECT 'openalex' AS source, 0 AS api_rank, p_partkey AS work_id, concat(p_name, ' ', p_type) AS title, {FAMILY} AS family, concat({FAMILY}, ', ', upper(substr(p_name, 1, 1)), '.') AS author, cast(1950 + p_partkey % 70 + p_partkey % 3 as int) AS year,
  concat(p_brand, ' Journal') AS journal FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'crossref', 1, p_partkey, concat(p_type, ' of ', p_name, CASE WHEN p_partkey % 5 = 0 THEN ' revisited' ELSE '' END), concat({FAMILY}, 'x'), concat({FAMILY}, 'x, Q.'), cast(1950 + p_partkey % 70 as int), concat(p_brand, ' Review') FROM part"""


_INITIAL = "upper(substr(p_name, 1, 1))"
#: Entries of five kinds: three authors, a quoted title, a broken link with its date of access, a book with a bare year, a chapter.
VARIED = f"""SELECT p_partkey AS ref_idx, {DOC} AS doc_id, p_partkey % 5 AS style, {FAMILY} AS family, {FIRST} AS first, {_INITIAL} AS initial, {YEAR} AS year, p_name AS name, p_type AS kind, p_brand AS brand, cast(p_size as string) AS size,
  CASE p_partkey % 5 WHEN 0 THEN concat({FAMILY}, ', ', {_INITIAL}, '., ', {FIRST}, ', Q., & Anderson, Z. (', {YEAR}, '). The ', p_name, ' ', p_type, '. ', p_brand, ' Journal, ', cast(p_size as string), '(2), 4-9.')
    WHEN 1 THEN concat({FAMILY}, ', ', {_INITIAL}, '. (', {YEAR}, '). “On ', p_name, ', ', p_type, '.” ', p_brand, ' Journal, 3(2), 1-9.')
    WHEN 2 THEN concat({FAMILY}, ', ', {_INITIAL}, '. (', {YEAR}, '). Pages of ', p_name, '. https:// a.example/ ', cast(p_partkey as string), '. (Accessed: 03.04.2021).')
    WHEN 3 THEN concat({FAMILY}, ', ', {FIRST}, '. History of ', p_type, '. Ankara: Press House, ', {YEAR}, '.')
    ELSE concat({FAMILY}, ', ', {_INITIAL}, '. (', {YEAR}, '). A chapter on ', p_name, '. In Doe, A. (Ed.), Book of ', p_type, ' (pp. 1-9). Press House, London.') END AS entry
FROM part"""
