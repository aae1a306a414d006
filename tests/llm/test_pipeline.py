"""The pipeline's stages take effect, each against a plain version."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from refmill.llm import mixing, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert tuple(df.columns) == P.COLUMNS
    assert set(P.COLUMNS) < set(stages[-1].columns)


def test_each_stage_takes_effect(stages):
    n = [df.count() for df in stages]
    assert n[0] > n[1] > n[2] == n[3] and n[4] == n[5] > 0
    seeds = F.col("text").rlike(r"(?i)(?<!\w)(idiot|moron|worthless)(?!\w)")
    assert stages[0].filter(seeds).count() > 0 and stages[1].filter(seeds).count() == 0
    assert stages[2].select("text").distinct().count() == n[2]
    assert stages[3].filter(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert stages[5].filter(~F.col("lossless")).count() == 0


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_ids_lose_nothing(spark):
    a, b, c = ("alpha " + " ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (5, c), (5, c), (None, c), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], ROWS)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in P.drop_near_duplicates(spark, docs, SF).collect()))
    assert got == sorted([(0, b), (1, a), (5, c), (-1, c), (7, ""), (7, ""), (8, "")])


def test_near_duplicates_are_those_of_all_pairs(spark, stages):
    """The stage on its own input: one row, the least id, of each component of exact links."""
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split("[\\x20\\x09-\\x0D]+", low) if w]
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == [i for i in sorted(sets) if find(i) == i]


def test_mixing_takes_what_the_operator_says(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    got = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert dict(got) == {i: n for i, n in copies.items() if n}


def test_redaction_replaces_the_spans_found(stages):
    found = {r["doc_id"]: (r["text"], r["pii"]) for r in pii.find(stages[2]).collect()}
    for r in stages[3].collect():
        text, spans = found[r["doc_id"]]
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
                at = s["end"]
        assert r["text"] == ("".join(out) + text[at:] if spans else text)


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "some words that are here for all", "en", "a", 31), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(7))
    for some in (docs, docs.limit(0)):
        df = some
        for name, stage in P.STAGES:
            df = stage(spark, df, SF)
            assert df.count() <= some.count() * 3, name
