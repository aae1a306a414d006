"""Alignment, hard negatives and licence scans against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from refmill.llm import alignment, ann, learning, licenses, negatives, pieces, quality, toxicity, vecjoin
from refmill.llm.common import importable


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def odd(x):
    return sorted(x, key=lambda r: tuple((v is not None, str(v)) for v in r))


# --- alignment


def plain_alignment(rows):
    """Every pair of tokens compared, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.A_FILE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    of = alignment.byte_alphabet()

    def spans(tokens):
        out, at = [], 0
        for i, b in tokens:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out

    count, docs = Counter(), []
    for d, text in rows:
        a = [(i, bytes(of[c] for c in t.id_to_token(i))) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append((d, None))
            continue
        a, b = spans(a), spans(b)
        groups, low = [], 0
        for e in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(i) for i, s, _ in x if low <= s < e) for x in (a, b)))
            low = e
        links = [(i, k) for i, s, e in a for k, s2, e2 in b if s < e2 and s2 < e]
        count.update(links)
        docs.append((d, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, x in docs:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links, digest = x
            out.append((d, a, b, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out, count


TEXTS = [
    (1, "Hello world, naïve café <|endoftext|> <s> 漢字 \n\n x"), (2, None), (3, ""), (4, "a▁b"), (5, "  two  blanks "), (6, "Hello world"), (6, "Hello world, world world"),
    (None, "don't 😀"), (8, "\t\r\n"), (9, " x é ﬁ"), (10, "the " * 300), (11, "Hello world"),
]


@pytest.mark.parametrize("size", [alignment.CONTAINER, 25])
def test_alignment_is_that_of_all_pairs_of_tokens(spark, size):
    rng = random.Random(2)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(["alpha", "Beta,", "gamma-ray", "é", "12", "日本", "\n"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    got = alignment.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_a", F.lit("clash")), size=size)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert odd(map(tuple, got.collect())) == odd(plain_alignment(rows)[0])


def test_alignment_dictionary_counts_documents_and_links(spark):
    got = alignment.dictionary(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    _, count = plain_alignment(TEXTS)
    assert {(r["a"], r["b"]): r["n_links"] for r in got.collect()} == count
    the = got.filter("a_bytes = binary(' the') and b_bytes = binary(' the')").first()
    assert (the["n_docs"], the["n_links"], the["best"]) == (1, 300, True)


def test_alignment_of_nothing(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_in_segments_and_blocks_align_alike():
    t = alignment.tokenizers()
    text = "some words about 1900 and more, " * 3_000 + "x" * 5_000 + " " * 2_000 + "end"
    whole, blocks = alignment.linked(t, ["a", text, "b c"]), alignment.linked(t, ["a", text, "b c"], block=700)
    assert (whole.counts == blocks.counts).all() and whole.digests == blocks.digests
    assert (whole.codes == blocks.codes).all() and (whole.times == blocks.times).all()
    parts = alignment.segments(text, 1_000)
    assert len(parts) > 50 and " ".join(parts) == text
    assert [i for p in parts for i in t.a.encode_ordinary(" " + p)] == t.exact.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in t.b.encode(p)] == t.b.encode(text)


def test_no_piece_joins_what_segments_cut():
    t = alignment.tokenizers()
    assert not any(re.search(rb"[A-Za-z0-9] ", x) for x in t.a_bytes.to_pylist() + t.b_bytes.to_pylist())


def test_planes_keep_documents_and_multiplicities():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 40, 4_000) << 16 | rng.integers(0, 500, 4_000))
    times = rng.integers(1, 70, len(codes))
    half = codes & 0xFFFF < 250
    both = alignment.merged([alignment.planes_of(codes[h], times[h]) for h in (half, ~half)])
    back = [alignment.restored(alignment.compressed(p, 500), 500) for p in both]
    pairs, docs, links = alignment.counted_pairs(back)
    for p, d, n in zip(pairs, docs, links, strict=True):
        assert d == (codes >> 16 == p).sum() and n == times[codes >> 16 == p].sum()


# --- hard negatives


def plain_negatives(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        c = [int(np.floor(256 * float(x))) for x in v]
        if sum((256 * float(x)) ** 2 for x in v) >= 2.0**62:
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept[i] = min(kept.get(i, (label, c)), (label, c))
    out = []
    for a, (label, v) in kept.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in kept.items() if i != a}
        by = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in by if kept[i][0] == label][:5]:
            found = [i for i in by if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(found, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=9)], int(rng.integers(0, 4)) if i % 3 else 1) for i in range(600)]
    rows += [(700 + i, rows[3][1], 2) for i in range(20)]  # ties
    rows += [(750, None, 1), (800, rows[1][1], None), (801, [1.0, None], 1), (802, [float("nan")] * 9, 1), (803, [float("inf")] * 9, 1), (None, rows[0][1], 1)]
    rows += [(850, [0.0] * 9, 1), (900, [], 2), (901, rows[4][1][:4], 1), (950, rows[5][1] * 2, 3), (952, [3e38] * 9, 1), (1000, [-5.0] * 9, 77)]
    return [*rows, (100, rows[9][1], 0), (100, rows[9][1], 3)]


@pytest.mark.parametrize("tile", [negatives.TILE, 7])
def test_negatives_are_those_of_all_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 3 if tile == 7 else negatives.ANCHOR_TILE)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).withColumn("tile", F.lit(1))
    got = negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 65), (64, 64, 64), (131, 67, 203), (0, 5, 3), (40, 0, 40)])
def test_strassen_is_the_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 40), 1 << 40, (m, k)), rng.integers(-(1 << 40), 1 << 40, (k, n))
    exact = (a.astype(object) @ b.astype(object)) if k else np.zeros((m, n), dtype=object)
    want = np.array([[(int(x) + (1 << 63)) % (1 << 64) - (1 << 63) for x in row] for row in exact], dtype=np.int64).reshape(m, n)
    assert (negatives.strassen(a, b) == want).all()


def test_windows_at_their_borders():
    for p in (0, 1, 2, 19, 20, 21, 39, 40, 41, 10**18):
        low, high = p // 2 + p % 2, p + -p // 20
        assert 50 * p <= 100 * low and not 50 * p <= 100 * (low - 1)
        assert 100 * high <= 95 * p and not 100 * (high + 1) <= 95 * p


# --- licences

LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0 (the \"License\")"), (2, "Released under the MIT License."), (3, "Arbeit mit Lizenz"), (4, None), (5, ""),
    (6, "SPDX-License-Identifier: GPL-2.0-or-later"), (7, "cc by cc by-nc 4.0 CC BY"), (8, "GNU Lesser General Public License v2.1 or later. All rights reserved!"),
    (9, "https://creativecommons.org/licenses/by-sa/3.0/"), (7, "cc\x00by, all\nrights\treserved, all rights  reserved"), (None, "éall rights reserved allé rights reserved"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"),
    (11, "general public license " * 3 + "general public"), (12, "the bsd 3-clause license, a BSD license; BSD-3-Clause"), (13, "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_licences(text):
    """Every rule on the whole text, every detection compared with every other."""
    words = plain_words(text)
    joined = f" {'  '.join(words)} "
    found = []
    for r in licenses.rules():
        if set(r.keywords) & set(words):
            found += [(joined.count(" ", 0, m.start()) // 2, joined.count(" ", 0, m.end()) // 2, r) for m in re.finditer(licenses.expression(r), joined)]
    level = list(licenses.KINDS).index

    def gone(d, o):
        if o is d or o[2].kind == "phrase" or not (o[0] <= d[0] and d[1] <= o[1]):
            return False
        mine, other = (level(d[2].kind), d[0] - d[1], d[2].order), (level(o[2].kind), o[0] - o[1], o[2].order)
        return other[0] < mine[0] or other < mine

    stay = [d for d in found if d[2].kind == "phrase" or not any(gone(d, o) for o in found)]
    return words, sorted(stay, key=lambda d: (d[0], -d[1], level(d[2].kind), d[2].order))


def test_licences_are_those_of_all_rules(spark):
    rng = random.Random(3)
    some = [t for _, t in LICENSED if t]
    rows = LICENSED + [(50 + i, " ".join(rng.choice([*some, "word", "license", "under the", "version 2.0 or later", "gnu", "creative commons attribution"]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = odd(map(tuple, licenses.report(docs).collect()))
    want = []
    for d, t in rows:
        words, stay = plain_licences(t)
        base = [(s, licenses.BASE[p]) for p in licenses.BASE for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in base]
        labels = sorted({r.label for *_, r in stay})
        want.append(
            (d, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), max((licenses.KINDS[r.kind] for *_, r in stay), default=0.0), len(stay), ",".join(f"{r.label}:{s}:{e}" for s, e, r in stay))
        )
        assert {x for _, x in base} <= set(labels)
    assert got == odd(want)


def test_licence_labels_of_known_statements():
    scanner = licenses.Scanner()
    label = lambda t: {scanner.rules[o].label for *_, o in scanner.kept(scanner.found(t)[1])}
    for text, want in (
        (LICENSED[0][1], {"apache-2.0"}), (LICENSED[1][1], {"mit"}), (LICENSED[2][1], set()), (LICENSED[5][1], {"gpl-2.0-or-later"}), (LICENSED[7][1], {"lgpl-2.1-or-later", "gpl", "reserved"}),
        (LICENSED[8][1], {"cc-by-sa-3.0"}), (LICENSED[11][1], {"mit"}), (LICENSED[14][1], {"gpl-3.0-or-later", "gpl"}),
    ):
        assert label(text) == want


def test_licence_columns_stay_and_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([(1, "MIT License", "x")], "`a.b` long, text string, row string")
    assert [r.asDict(True) for r in licenses.detect(docs).select("`a.b`", "row", "licenses.found.label").collect()] == [{"a.b": 1, "row": "x", "label": ["mit"]}]
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_licence_texts_take_time_in_proportion():
    import time

    scanner = licenses.Scanner()
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        words, found = scanner.found("licensed under the apache license version 2.0 cc by all rights reserved " * n)
        assert words == 13 * n and len(scanner.kept(found)) == 4 * n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_there_are_hundreds_of_rules_and_all_compile():
    assert len(licenses.rules()) > 300 and len(licenses.Scanner().compiled) == len(licenses.rules())


# --- what earlier operators owe


def test_toxicity_of_megabytes_of_hits_and_exceptions():
    import time

    find = toxicity.automaton({f" {w} ": 3.0 for w in toxicity.SEED})
    began = time.process_time()
    got = toxicity.features(toxicity.fold("you idiot trash can take out the trash clown fish " * 160_000), find)
    assert got[:2] == (3.0, 3.0) and time.process_time() - began < 60


@pytest.mark.parametrize("module", [toxicity, quality, pieces])
def test_kept_columns_may_have_any_name(spark, module):
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, `a.b` string")
    if module is pieces:
        got = pieces.tokenize(docs, keep=("a.b",))
    else:
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        got = module.score(docs, module.fit(docs, labels), keep=("a.b",))
    assert got.select("`a.b`").first()[0] == "x"


def test_isotonic_curve_is_the_best_non_decreasing_fit():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 40):
        x, y, w = np.sort(rng.random(n)), (rng.random(n) < 0.5).astype(float), rng.random(n) + 0.1
        at, value = learning.isotonic(x, y, w)
        # The best fit at i is the largest, over starts, of the least mean over ends.
        mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()  # noqa: B023, E731
        best = np.array([max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])
        got = np.interp(x, at, value)
        inner = (best > 0) & (best < 1)
        assert np.allclose(got[inner], best[inner]) and (np.diff(got) >= 0).all()


def test_norms_that_overflow_when_squared_hide_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEEDS", 24)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 16))
    x[7] *= 1e160 / np.linalg.norm(x[7])
    x[8] *= 1e200
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    with np.errstate(over="ignore"):
        s = x[::20] @ x.T
    hits = 0
    for k, q in enumerate(range(0, 600, 20)):
        s[k, q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s[k], kind="stable")[:20].tolist()))
    assert hits / (30 * 20) >= 0.95


def test_scaling_keeps_direction_and_small_rows():
    x = np.array([[3.0, 4.0], [3e160, 4e160], [1.5e308, 1.5e308], [5e-324, 0.0]])
    y, norm = ann.within_range(x)
    assert (y[0] == x[0]).all() and (y[3] == x[3]).all() and norm[0] == 5.0
    assert np.isfinite((y * y).sum(axis=1)).all() and y[1, 0] / y[1, 1] == 0.75 and 2.0**499 <= np.hypot(*y[1]) <= 2.0**500


def test_many_pivots_and_copies_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    pivots = vecjoin.unit(rng.normal(size=(4_096, 64)))
    x = rng.normal(size=(400, 64))
    batch = pa.record_batch([pa.array(range(400), pa.int64()), pa.array([1] * 400, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "n", "vec"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in vecjoin._placed(pivots, np.full(4_096, 1.2), float(np.arccos(0.9)))(iter([batch])))
    assert rows > 100 * 400 and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


@pytest.mark.parametrize("few", [50, 1 << 20])
def test_vectors_are_placed_alike_in_any_batches(monkeypatch, few):
    import pyarrow as pa

    monkeypatch.setattr(vecjoin, "AT_ONCE", few)
    monkeypatch.setattr(vecjoin, "BATCH", 7 if few == 50 else vecjoin.BATCH)
    rng = np.random.default_rng(3)
    r = float(np.arccos(0.9))
    pivots = vecjoin.unit(rng.normal(size=(9, 5)))
    pivots[4] = pivots[2] * (1 - 1e-16)
    x = rng.normal(size=(200, 5))
    u = vecjoin.unit(x)
    angle = np.arccos(np.clip(u @ pivots.T, -1, 1))
    home = angle.argmin(axis=1)
    radius = np.array([angle[home == c, c].max(initial=-np.inf) for c in range(9)])
    batch = pa.record_batch([pa.array(range(200), pa.int64()), pa.array([1] * 200, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "n", "vec"])
    cells = {}
    for b in vecjoin._placed(pivots, radius, r)(iter([batch])):
        for v, c in zip(b["vec_id"].to_pylist(), b["cell"].to_pylist(), strict=True):
            cells.setdefault(v, []).append(c)
    assert all(len(c) == len(set(c)) for c in cells.values())
    for i, j in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist():
        assert min(home[i], home[j]) in cells[i] and min(home[i], home[j]) in cells[j]
