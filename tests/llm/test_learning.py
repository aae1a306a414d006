"""What the label-fitted operators learn, against plain versions."""

import math
import random
import time

import numpy as np
import pytest

from refmill.llm import learning, toxicity


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_is_the_best_fit(seed):
    """Each value is the largest over starts of the smallest mean over ends; means of 0 or 1 are drawn in."""
    rng = np.random.default_rng(seed)
    n = 40
    x = rng.permutation(n).astype(float)
    y = (rng.random(n) < x / n).astype(float)
    w = rng.integers(1, 4, n).astype(float)
    at, value = learning.isotonic(x, y, w)
    order = np.argsort(x)
    xs, ys, ws = x[order], y[order], w[order]
    mean = lambda j, k: (ys[j : k + 1] * ws[j : k + 1]).sum() / ws[j : k + 1].sum()
    best = [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    want, start = np.zeros(n), 0
    for i in range(1, n + 1):
        if i == n or not math.isclose(best[i], best[start], abs_tol=1e-12):
            weight = ws[start:i].sum()
            total = best[start] * weight
            extreme = math.isclose(best[start], 0, abs_tol=1e-12) or math.isclose(best[start], 1)
            want[start:i] = (total + 0.5) / (weight + 1) if extreme else best[start]
            start = i
    assert np.allclose(np.interp(xs, at, value), np.maximum.accumulate(want))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def plain_lexicon(rows):
    """term -> weight by counting each term's documents of each class in one dictionary."""
    n = {y: sum(label == y for _, label in rows) for y in (0, 1)}
    held = {}
    for text, label in rows:
        words = {w for w in toxicity.fold(text).split()}
        terms = {f" {w} " for w in words if len(w) >= 3} | {f" {w[:k]}" for w in words for k in (4, 5, 6, 7) if len(w) > k}
        for t in terms:
            held.setdefault(t, [0, 0])[label] += 1
    found = []
    for t, (clean, toxic) in held.items():
        a, b = toxic + 0.5, clean + 0.5
        ratio = math.log(a / (n[1] - toxic + 0.5)) - math.log(b / (n[0] - clean + 0.5))
        z = ratio / math.sqrt(1 / a + 1 / b)
        if toxic >= 4 and z >= 3 and ratio >= 1:
            found.append((t, ratio))
    kept = {}
    for t, ratio in sorted(found, key=lambda f: (len(f[0]), f[0])):
        if not any(kept.get(t[:i], -1) >= 0.75 * ratio for i in range(4, len(t))):
            kept[t] = ratio
    return {f" {w} ": 3.0 for w in toxicity.SEED if f" {w} " not in kept} | kept


def made(seed):
    rng = random.Random(seed)
    clean = ["meadow", "river", "garden", "window", "letter", "bridge", "market", "winter"]
    bad = ["grubling", "grublings", "grubby", "snarkle", "idiot", "blorp"]
    rows = [(" ".join(rng.choices(clean, k=12) + rng.choices(bad, k=rng.randrange(1, 4))), 1) for _ in range(60)]
    rows += [(" ".join(rng.choices(clean, k=14) + (["blorp"] if rng.random() < 0.3 else [])), 0) for _ in range(140)]
    return rows + [("", 0), (None, 0), (None, 1)]


@pytest.mark.parametrize("held", [100_000, 5])
def test_learned_lexicon_is_that_of_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "TERMS_HELD", held)
    rows = made(4)
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    want = plain_lexicon(rows)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)
    assert any(t.startswith(" grub") for t in got)


def test_a_long_text_full_of_hits_takes_time_in_proportion():
    find = toxicity.automaton({f" {w} ": 1.0 for w in toxicity.SEED})
    text = "trash can, idiot; clown nose and stupid loser. " * (8_000_000 // 47)
    began = time.time()
    total, top, dense = toxicity.features(toxicity.fold(text), find)
    assert time.time() - began < 60
    assert (total, top, dense) == (3.0, 1.0, 20.0)
