"""PII and mixing, the two operators of DataFrame operations only."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from refmill.llm import mixing, pii

DOCS = "doc_id long, text string, lang string, source string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("a1.@+ -9_%2é😀5.()") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    return [
        None, "", "a@b.c_d@e.f a@b.c.@d.e x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111111111111112", "+1 (017) 555-7713, call", "😀 me@x.org é 10.0.0.1", *made,
        "a" * 60_000 + "@", "1" * 60_000, "1 " * 30_000, ".a" * 20_000 + "@x.y", "a@b" + ".c" * 20_000, "+1" + " " * 30_000,
    ]


def test_base_spans_are_those_of_the_plain_expressions(spark):
    rows = [(i, t, None, None) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    for i, t, *_ in rows:
        base = base_spans(t)
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PLAIN] == [kinds.count(k) for k in PLAIN]


@pytest.mark.parametrize(("text", "kind", "n"), [("pay to DE89 3704 0044 0532 0130 00 now", "iban", 1), ("DE88370400440532013000", "iban", 0), ("social security 123-45-6789", "ssn", 1), ("part 123-45-6789", "ssn", 0)])
def test_added_kinds_need_checksum_or_context(spark, text, kind, n):
    assert pii.report(spark.createDataFrame([(1, text, None, None)], DOCS)).first()[f"n_{kind}"] == n


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "write me@x.org or 10.0.0.1!", "en", "s"), (2, None, "en", "s"), (3, "clean", None, None)], DOCS).withColumn("spans", F.lit("mine"))
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"]) == ("write <EMAIL> or <IP>!", None, "clean")
    assert got[1]["spans"] == "mine"


@pytest.mark.parametrize(
    ("text", "kind", "n"),
    [
        ("social security number on file since 2019: 123-45-6789", "ssn", 1),  # a number between context and span
        ("social " + "x" * 60 + " 123-45-6789", "ssn", 0),
        ("ref 123-45-6789 and 5 more, ssn", "ssn", 1),
        ("ref 123-45-6789 " + "x" * 20 + " ssn", "ssn", 0),
    ],
)
def test_context_goes_by_position(spark, text, kind, n):
    assert pii.report(spark.createDataFrame([(1, text, None, None)], DOCS)).first()[f"n_{kind}"] == n


def test_spark_and_sql_agree_on_context(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    bits = ["card a5a 4111111111111111", "4111 1111 1111 1111", "7", "12", "pay", "visa", "ssn", "123-45-6789", "+49 30 901820", "call 5", "a@b.cc", "mail", "10.0.0.1", "host", "é", "😀", "\n", "DE89370400440532013000", "iban", "x" * 45]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    texts += [None, "", " ".join(rng.choice(bits) for _ in range(3000)), "a@b.cc " * 500]
    rows = [(i, t, None, None) for i, t in enumerate(texts + texts[:3])]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    got = pii.report(spark.createDataFrame(rows, DOCS))
    want = con.execute(f"select {', '.join(got.columns)} from ({pii.oracle()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "en", "s")], DOCS)
    for name in ("_pii", "_pii_spans", "_m_email", "_row", "_t", "key", "cell", "size", "bits"):
        df = df.withColumn(name, F.lit(name))
    assert pii.redact(df).drop("text").collect() == df.drop("text").collect()
    assert mixing.mixed(df).drop("copies").collect() == df.collect()


def water_fill(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] for s in capped} | share
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 40))), None, rng.choice(["a"] * 30 + ["b", "c", "d", None, "é"])) for i in range(3000)]
    rows += [(4000, None, None, "b"), (4001, " \t\n", None, "z"), (4002, "x " * 500, None, "c")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    size, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    want = water_fill(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 500
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_longer_documents_are_likelier(spark):
    """Documents of a size are included as often as their probability says, and the sample has its words."""
    rows = [(i, "w " * n, None, "ab"[i % 2]) for i, n in enumerate([1, 3, 7, 20, 60, 150, 9] * 800)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for odd in (0, 1):
        of = [r for r in got if r["doc_id"] % 2 == odd]
        whole = int(of[0]["target"] / of[0]["source_size"])
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 75
        hits: dict = {}
        for r in of:
            hits.setdefault((r["size"], r["inclusion"]), []).append(r["copies"] - whole)
        p = [x for _, x in sorted(hits)]
        assert len(p) == 7 and p == sorted(p) and 0 < p[0] < p[-1] <= 1
        for (_, want), seen in hits.items():
            assert abs(sum(seen) / len(seen) - want) < 5 * (want * (1 - want) / len(seen)) ** 0.5 + 0.01


def test_equal_ranks_go_together(spark):
    df = spark.createDataFrame([(7, "a b c", None, "s")] * 10 + [(8, "a b c", None, "t")] * 10, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 20 and len({(r["doc_id"], r["copies"]) for r in got}) == 2


def test_sources_in_order(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "a long, b long")
    got = mixing.in_order(df.repartition(5), [F.col("b").desc()], ("a",)).collect()
    before = 0
    for n, r in enumerate(sorted(got, key=lambda r: -r["b"])):
        assert (r["before_n"], r["before_a"]) == (n, before)
        before += r["a"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0
    assert pii.report(none).count() == 0
