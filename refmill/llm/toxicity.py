"""Toxicity by a weighted lexicon.

A text is folded first: lower case, accents and homoglyphs to Latin letters, digits and signs to the letters they
stand for where they stand among letters (a plain number is no word), everything else to blanks. An Aho-Corasick automaton then finds the lexicon's words
and word beginnings, and the exception phrases that cancel what they cover. The weights of the hits, alone and
per length of the text, go through a logistic curve.

The lexicon starts from ``SEED`` and learns weights, and further entries, from document frequencies in a bounded
sample of labelled rows. Its size is bounded too, so it is small enough to go to every task.

Edge cases: a null or empty text has no hit and gets the curve's value for none; without labels, or with one class
only, the seed lexicon and a fixed curve hold; repeated rows and equal texts get equal scores; an empty table gives an
empty result; a null doc_id is not held out; very long texts are scored whole, in time proportional to their length
(and to the logarithm of the exceptions in them); a document labelled twice counts as toxic if either label says so.
Other columns are not read; those that
are asked to be kept stay, but for one named ``score``, which the score replaces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fit_sample, logistic, remainder, sigmoid

SEED = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "dumb", "imbecile", "vermin", "filth")
#: Phrases in which a word of the lexicon is none.
EXCEPTIONS = (
    "clown fish", "clown car", "rodeo clown", "circus clown", "clown nose", "class clown",
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash day", "trash folder", "take out the trash", "space trash", "trash compactor",
    "idiot proof", "idiot light", "idiots guide", "the idiot by dostoevsky",
    "sore loser board game", "loser of the match", "winner and loser", "winners and losers", "loser bracket", "losers bracket",
    "dumb bell", "dumb waiter", "dumb terminal", "deaf and dumb", "struck dumb", "dumb luck",
    "pond scum", "soap scum", "scum line", "pathetic fallacy", "vermin control", "filth removal", "worthless check", "worthless stock", "stupid question sorry", "disgusting smell",
)
SEED_WEIGHT = 3.0
#: Entries at most; the automaton goes to every task.
LEXICON_SIZE = 2_000
MIN_DOCS, MIN_Z, PREFIXES = 4, 3.0, (4, 5, 6, 7)
THRESHOLD = 0.3

#: Signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i"}
#: Letters of other scripts that look like Latin ones (Cyrillic, Greek, Armenian, others), by what they look like.
LOOKS = {
    "a": "аαɑ", "b": "вβьƅ", "c": "сϲς", "d": "ԁժ", "e": "еεєҽ", "f": "ƒϝ", "g": "ɡցԍ", "h": "нһհ", "i": "іιıɪ", "j": "јϳ", "k": "кκ", "l": "ӏℓ", "m": "м", "n": "пηոռ", "o": "оοσօ",
    "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ԝωшѡ", "x": "хχ", "y": "уγүყ", "z": "ᴢʐ",
}
HOMOGLYPHS = {c: latin for latin, many in LOOKS.items() for c in many}
#: Names of letters that only their form or frame tells from a Latin one: small capitals, hooks and strokes, squares, flags.
_NAMED = re.compile(r"(?:LATIN .*LETTER |REGIONAL INDICATOR SYMBOL LETTER |SQUARED LATIN CAPITAL LETTER )(?:SMALL CAPITAL )?([A-Z])(?: WITH .*)?")


class _Fold(dict):
    """Table for str.translate, filled as characters are met; the substitutes stay as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
        if not plain.isascii() and (named := _NAMED.fullmatch(unicodedata.name(c, ""))):
            plain = named[1].lower()
        letters = plain.isalpha() and plain.isascii()
        self[code] = out = plain if letters or (len(plain) == 1 and plain in SUBSTITUTES) else "" if unicodedata.combining(c) else " "
        return out


_FOLD = _Fold()
_AS_LETTERS = str.maketrans(SUBSTITUTES)


def _word(token: str) -> str:
    """A token with substitutes as a word, or as nothing if no letter is in it."""
    return token.translate(_AS_LETTERS) if any("a" <= c <= "z" for c in token) else ""


def fold(text: str | None) -> str:
    """Words of a to z between single blanks, with one at either end."""
    words = (text or "").translate(_FOLD).split()
    return f" {' '.join(filter(None, [w if w.isalpha() else _word(w) for w in words]))} "


def _terms(words: set[str]) -> set[str]:
    """" word " and " beginning" for each word."""
    found = {f" {w} " for w in words if len(w) >= 3}
    for n in PREFIXES:
        found.update(f" {w[:n]}" for w in words if len(w) > n)
    return found


#: Terms whose counts a task holds before it passes them on.
TERMS_HELD = 100_000


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a term, summed over the partition, at most ``TERMS_HELD`` terms at a time."""
    counts = Counter(), Counter()

    def passed() -> pa.RecordBatch:
        terms = list(counts[0] | counts[1])
        out = pa.record_batch({"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]}, schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
            counts[label].update(_terms(set(fold(text.as_py()).split())))
            if len(counts[0]) + len(counts[1]) > TERMS_HELD:
                yield passed()
    yield passed()


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """term -> weight (log odds ratio), from (text, label) rows; at most ``LEXICON_SIZE`` terms."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    n0, n1 = n.get(0, 0), n.get(1, 0)
    seeds = {f" {w} ": SEED_WEIGHT for w in SEED}
    if not n0 or not n1:
        return seeds
    per = sample.select("text", "label").mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    ratio = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    best = per.filter(F.col("a") >= MIN_DOCS).withColumn("weight", ratio).withColumn("z", ratio / F.sqrt(1 / a + 1 / b)).filter((F.col("z") >= MIN_Z) & (F.col("weight") >= 1.0))
    top = best.orderBy(F.desc("z"), "term").limit(LEXICON_SIZE).collect()  # bounded by LEXICON_SIZE
    kept: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["term"]), r["term"])):  # the shortest beginning that explains a word stands for it
        if not any(r["term"][:i] in kept and kept[r["term"][:i]] >= 0.75 * r["weight"] for i in range(4, len(r["term"]))):
            kept[r["term"]] = float(r["weight"])
    return {t: w for t, w in seeds.items() if t not in kept} | kept


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t, w in lexicon.items():
        found.add_word(t, (len(t), w))
    for p in exceptions:
        found.add_word(fold(p), (len(fold(p)), None))
    found.make_automaton()
    return found


def features(folded: str, find) -> tuple[float, float, float]:
    """Sum of the weights of distinct hits, largest weight, weight of all hits per square root of the words."""
    hits = [(end - n + 1, end, w) for end, (n, w) in find.iter(folded)]
    if not hits:
        return 0.0, 0.0, 0.0
    starts, reach = [], []  # of the exceptions by start: the furthest end so far
    for s, e in sorted((s, e) for s, e, w in hits if w is None):
        starts.append(s)
        reach.append(max(e, reach[-1] if reach else e))
    spared = lambda s, e: (k := bisect_right(starts, s)) > 0 and reach[k - 1] >= e
    each = Counter(folded[s : e + 1] for s, e, w in hits if w is not None and not spared(s, e))
    weights = {folded[s : e + 1]: w for s, e, w in hits if w is not None}
    if not each:
        return 0.0, 0.0, 0.0
    return min(20.0, sum(weights[t] for t in each)), max(weights[t] for t in each), min(20.0, sum(weights[t] * n for t, n in each.items()) / folded.count(" ") ** 0.5)


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(lexicon)
        for batch in batches:
            x = np.array([features(fold(t.as_py()), find) for t in batch["text"]], dtype=float).reshape(-1, 3)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([batch[c] for c in rest] + [pa.array(x[:, i]) for i in range(3)], names=[*rest, "f_sum", "f_max", "f_dense"])

    return run


#: Used when there is nothing to fit.
PLAIN_CURVE = np.array([0.8, 0.4, 0.3, -3.0])


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and curve from a bounded sample of the labelled rows that aren't held out."""
    sample, _, n1 = fit_sample(labels, "toxic", parts, held)
    # at most two classes of FIT_ROWS_PER_CLASS ids: small by construction
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    lexicon = learn_lexicon(rows)
    got = rows.select("text", "label", "weight").mapInArrow(_featured(lexicon), "label int, weight double, f_sum double, f_max double, f_dense double").toPandas()
    if not n1 or got["label"].nunique() < 2:
        return lexicon, PLAIN_CURVE
    return lexicon, logistic(got[["f_sum", "f_max", "f_dense"]].to_numpy(), got["label"].to_numpy(float), got["weight"].to_numpy(float))


def _scored(lexicon: dict[str, float], curve: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(lexicon)
        for batch in batches:
            x = np.array([features(fold(t.as_py()), find) for t in batch["text"]], dtype=float).reshape(-1, 3)
            yield pa.record_batch([batch[f"kept{i}"] for i in range(len(keep))] + [pa.array(sigmoid(x @ curve[:-1] + curve[-1]))], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and a score from 0 to 1 of each row's text."""
    lexicon, curve = model
    keep = tuple(c for c in dict.fromkeys(keep) if c != "score")
    cols = [*(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)), "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "score double"
    return docs.select(*cols).mapInArrow(_scored(lexicon, curve, list(keep)), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
