"""Shortened citations: postings against the plain comparison of each part with each title of its family."""

import random

from pyspark.sql import functions as F

from refmill.operators import footnotes as OF
from refmill.operators.footnotes import FEW

WORDS = ["tarih", "islam", "ev", "su", "kitap", "art", "particular", "medeniyet", "bilim", "sanat", "o", "devlet", "toplum", "ahlak", "seyahat", "divan"]
REFS = "doc_id long, ref_idx long, title string, families array<string>"


def made(seed: int, n_titles: int, n_notes: int):
    """References of three families (one with nearly all titles) and notes that quote, shorten or miss them."""
    rng = random.Random(seed)
    titles = [" ".join(rng.choices(WORDS, k=rng.choice((1, 1, 2, 3, 4, 6, 10)))) for _ in range(n_titles)]
    refs = [(1, i, t, ["Demir"] if i % 12 else ["Kaya", "Demir"]) for i, t in enumerate(titles)] + [(1, n_titles, "!", ["Demir"]), (1, n_titles + 1, None, ["Demir"]), (2, 0, titles[0], ["Kaya"])]
    notes = []
    for i in range(n_notes):
        t = rng.choice(titles)
        cut = t[rng.randrange(len(t)) :][: rng.choice((1, 2, 3, 5, 12, 40))]
        some = " ".join(rng.choices(WORDS, k=rng.randrange(4)))
        text = rng.choice((f"Demir, {t}, 12", f"Demir “{cut}”", f"Kaya {some}", f"Demir {some} 'x{cut}'", f"Demir “, ” {some}", f"Kimse {t}", f"Demir {cut}", "Demir", ""))
        notes.append((1 + (i % 9 == 0), i, 0, text))
    return refs, notes


def frames(spark, refs, notes):
    return spark.createDataFrame(notes, "doc_id long, foot_ord int, part_idx int, part string"), spark.createDataFrame(refs, REFS)


def plain(refs, notes):
    """The winner of each note, by comparing it with each reference in order."""
    import re

    spaced = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    out = {}
    for doc, ord_, part, text in notes:
        clean = spaced(text)
        words = clean.split(" ")
        m = re.search("[“\"‘«']([^”\"’»']+)[”\"’»']", text)
        quoted = spaced(m[1]) if m else None
        best = None
        for d, i, title, families in refs:
            if d != doc or not title or not any(spaced(f) in words for f in families):
                continue
            t = spaced(title)
            long_words = [w for w in t.split(" ") if len(w) > 2]
            share = sum(w in words for w in long_words) / len(long_words) if long_words else 0
            first = t.split(" ")[0]
            if t in clean or (quoted is not None and (quoted in t or t in quoted)):
                rank = (0, 0.0, i)
            elif share > 0 and (share >= 0.3 or (len(first) > 2 and first in words)):
                rank = (1, -share, i)
            else:
                continue
            best = min(best or rank, rank)
        if best:
            out[doc, ord_, part] = best[2]
    return out


def test_postings_find_what_a_plain_comparison_finds(spark):
    for seed, few in ((1, 0), (2, 3), (3, FEW)):
        refs, notes = made(seed, 90, 300)
        got = OF.shortened(*frames(spark, refs, notes), few=few).collect()
        assert {(r["doc_id"], r["foot_ord"], r["part_idx"]): r["ref_idx"] for r in got} == plain(refs, notes)


def test_a_name_in_every_note_pairs_few(spark):
    """One author of all titles, named in all notes: pairs grow with the notes, not with notes times titles."""
    titles = [f"birinci{i} kelime{i % 40} ortak sonuncu{i}" for i in range(400)]
    refs = [(1, i, t, ["Demir"]) for i, t in enumerate(titles)]
    notes = [(1, i, 0, f"Demir, {titles[i % 400]}, s. {i}") for i in range(800)]
    rows, references = frames(spark, refs, notes)
    words = rows.withColumn("clean", F.lower("part")).withColumn("words", F.split(F.regexp_replace("clean", "[,.]", ""), " ")).withColumn("quoted", F.lit("")).withColumn("has_quote", F.lit(False))
    pairs = OF.shortened_candidates(words, references.select("doc_id", F.lit("demir").alias("family"), "ref_idx", "title")).count()
    assert 800 <= pairs <= 800 * 12
    got = {r["foot_ord"]: r["ref_idx"] for r in OF.shortened(rows, references).collect()}
    assert got == {i: i % 400 for i in range(800)}


def test_nothing_to_shorten(spark):
    rows, refs = frames(spark, [], [])
    assert OF.shortened(rows, refs).count() == 0
    rows, refs = frames(spark, [(None, 0, "Tarih", ["Demir"]), (1, 0, None, None)], [(None, 0, 0, "Demir, Tarih"), (1, 1, 0, None)])
    assert OF.shortened(rows, refs).count() == 0
