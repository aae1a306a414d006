"""Personal data in texts (DataFrame operations only).

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs, ranges and digit
counts elsewhere) and words nearby adjust each span's score. The four base kinds keep every confirmed span;
the kinds added by this method (``iban``, ``ssn``) also need a score of ``THRESHOLD``.

A kind's matches are found over the whole text with what follows each, and as the gaps between them; the running sum
of their lengths gives positions in code points. Context is the code points before and after a span by position,
whatever other matches lie there. The expressions for Spark are written so that a failed match costs time in proportion
to its length: a run is entered at its start, or where the last match ended, and never given back. They confirm the
spans that the plain expressions confirm (for cards they also match lone digits, which no checksum confirms).

Edge cases: a null text is an empty one and has no span; several kinds may overlap, and one stretch may be of several
kinds; equal rows stay equal rows; an empty table gives an empty result. Very long texts cost time in proportion to
their length. Columns of any name are kept; only one named as the output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
THRESHOLD = 60
CONTEXT_BONUS = 20
#: Code points looked at before and after a span.
BEFORE, AFTER = 40, 20
#: Matches that are worked through at a time.
CHUNK = 64


class Kind(NamedTuple):
    name: str
    pattern: str  # for Spark
    plain: str  # the same matches, without lookaround or possessive quantifiers
    maybe: str  # a text without this has no match
    points: int  # with its checksum
    context: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"@[A-Za-z0-9-]", 80, "mail|contact|write to"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]\.[0-9]", 60, "address|host|server|login"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9]", 80, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 60, "tel|phone|call|fax|mobile"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}", 80, "iban|account|bank|transfer"),
    Kind("ssn", r"[0-9][0-9-]*[0-9]", r"[0-9][0-9-]*[0-9]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, "ssn|social|security"),
)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(m: Column) -> Column:
    """Of an IBAN: its first four characters go last, letters count from 10 on."""
    text = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
    step = lambda s, c: F.when(c >= "A", s * 100 + code(c)).otherwise(s * 10 + code(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(name: str, m: Column) -> Column:
    n = F.length(digits(m))
    if name == "ip":
        part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if name == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    if name == "phone":
        return n.between(9, 15)
    if name == "iban":
        return F.when(F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), mod97(m)).otherwise(False)
    if name == "ssn":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def zipped(matches: Column, gaps: Column, after: Column) -> Column:
    """Each match with the gap before it and the text after it."""
    return F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("gap"), F.get(after, i).alias("after")))


def spans(items: Column, kind: Kind) -> Column:
    """Of the zipped matches, a column by itself. They go in chunks, each from its own start, so appending stays cheap."""
    entry = "struct<kind:string,start:int,end:int,score:int>"
    whole = lambda x: F.concat(x["gap"], x["m"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        near = F.lower(F.concat(F.right(F.concat(acc["tail"], x["gap"]), F.lit(BEFORE)), F.lit(" "), x["after"]))
        score = F.lit(kind.points) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0)
        keep = confirmed(kind.name, x["m"])
        if kind.name not in BASE:
            keep = keep & (score >= THRESHOLD)
        one = F.array(F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score")))
        tail = F.right(F.concat(acc["tail"], whole(x)), F.lit(BEFORE))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def chunk(z: Column) -> Column:
        start = F.struct(z["start"].alias("at"), z["tail"].alias("tail"), F.array().cast(f"array<{entry}>").alias("out"))
        return F.aggregate(z["items"], start, step, lambda acc: acc["out"])

    # A match has a code point at least, so the last BEFORE items hold the text before a chunk.
    each = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    cut = F.transform(
        each,
        lambda k: F.struct(
            F.slice(items, k * CHUNK + 1, F.lit(CHUNK)).alias("items"),
            F.right(F.array_join(F.transform(F.slice(items, F.greatest(k * CHUNK + 1 - BEFORE, F.lit(1)), F.least(k * CHUNK, F.lit(BEFORE))), whole), ""), F.lit(BEFORE)).alias("tail"),
        ),
    )
    sized = lambda c: F.aggregate(c["items"], F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"]))
    chunks = "array<struct<start:int,tail:string,items:array<struct<m:string,gap:string,after:string>>>>"
    started = F.aggregate(
        cut,
        F.struct(F.lit(0).alias("at"), F.array().cast(chunks).alias("out")),
        lambda acc, c: F.struct((acc["at"] + sized(c)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), c["tail"].alias("tail"), c["items"].alias("items")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(items) > 0, F.flatten(F.transform(started, chunk))).otherwise(F.array().cast(f"array<{entry}>"))


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` (_row, _t) with ``_pii``."""
    for k in KINDS:
        none = F.array().cast("array<string>")
        maybe = F.col("_t").rlike(k.maybe)
        # The lookahead always holds and takes nothing, so matches are those of the pattern alone.
        after = F.regexp_extract_all("_t", F.lit(rf"(?:{k.pattern})(?=((?s:.{{0,{AFTER}}})))"), F.lit(1))
        rows = rows.withColumn(f"_m_{k.name}", F.when(maybe, F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0))).otherwise(none))
        some = F.size(f"_m_{k.name}") > 0
        rows = rows.withColumn(f"_g_{k.name}", F.when(some, F.split("_t", k.pattern, -1)).otherwise(none)).withColumn(f"_a_{k.name}", F.when(some, after).otherwise(none))
    for k in KINDS:
        rows = rows.withColumn(f"_i_{k.name}", zipped(*(F.col(f"_{x}_{k.name}") for x in "mga")))
    return rows.withColumn("_pii", F.concat(*(spans(F.col(f"_i_{k.name}"), k) for k in KINDS))).select("_row", "_t", "_pii")


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """The whole row apart, so that its names can't clash with any used here, and the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))


def _columns(docs: DataFrame, but: str) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != but]


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end, score>> by kind as listed, then start."""
    return _found(_rows(docs, text)).select(*_columns(docs, out), F.col("_pii").alias(out))


def named(found: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """kind:start:end, joined by commas."""
    found = F.filter(found, keep) if keep else found
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans and the best score of each document."""
    got = find(docs.select("doc_id", "text"), out="_pii").select("doc_id", "_pii")
    count = lambda name: F.size(F.filter("_pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = named(F.col("_pii"), lambda s: s["kind"].isin(*BASE))
    best = F.coalesce(F.array_max(F.transform("_pii", lambda s: s["score"])), F.lit(0)).alias("top_score")
    return got.select("doc_id", *(count(k) for k in BASE), F.sha2(base, 256).alias("base_sha256"), named(F.col("_pii")).alias("spans"), *(count(k.name) for k in KINDS[len(BASE) :]), best)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each found span by ``<KIND>``; where spans overlap, the earlier start wins, then the longer span.

    A null text stays null. Other columns, their names included, stay as they are.
    """
    by_start = F.array_sort(F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["neg_end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substr(F.col("_t"), acc["at"] + 1))

    clean = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, finish)
    new = F.when(F.size("_pii") == 0, F.col(f"_row.`{text}`")).otherwise(clean)
    return _found(_rows(docs, text)).select(*(new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL for :func:`report`, with the plain expressions."""
    ok = {
        "email": "true",
        "ip": r"regexp_matches(m, '^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$')",
        "card": """(length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(regexp_replace(m, '[^0-9]', '', 'g'))),
            lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i + 1] AS INT)
                ELSE (2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i + 1] AS INT)) // 10 + (2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i + 1] AS INT)) % 10 END)) % 10 = 0)""",
        "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": """(length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(m, ' ', '')[5:] || m[1:4], ''),
            lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS BIGINT) ELSE CAST(c AS BIGINT) END)), lambda s, d: (CASE WHEN d >= 10 THEN s * 100 + d ELSE s * 10 + d END) % 97) = 1)""",
        "ssn": "(regexp_matches(m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000')",
    }
    parts = []
    for n, k in enumerate(KINDS):
        keep = ok[k.name] + ("" if k.name in BASE else f" AND score >= {THRESHOLD}")
        near = f"substr(t, greatest(start - {BEFORE}, 0) + 1, least(start, {BEFORE})) || ' ' || substr(t, start + length(m) + 1, {AFTER})"
        parts.append(rf"""
  SELECT doc_id, rid, {n} AS kind_no, '{k.name}' AS kind, start, start + length(m) AS "end", score FROM (
    SELECT doc_id, rid, m, start, {k.points} + CASE WHEN regexp_matches(lower({near}), '{k.context}') THEN {CONTEXT_BONUS} ELSE 0 END AS score FROM (
      SELECT doc_id, rid, t, ms[i] AS m, (sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY rid ORDER BY i) - length(ms[i]))::BIGINT AS start FROM (
        SELECT doc_id, rid, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, rid, t, regexp_extract_all(t, '{k.plain}') AS ms, string_split_regex(t, '{k.plain}') AS gs FROM d)))
  ) WHERE {keep}""")
    count = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}')::BIGINT AS n_{k.name}" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT rid, {count}, coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY kind_no, start) FILTER (WHERE kind_no < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY kind_no, start) AS spans, max(score) AS top_score FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(top_score, 0) AS INT) AS top_score
FROM d LEFT JOIN a USING (rid)
"""
