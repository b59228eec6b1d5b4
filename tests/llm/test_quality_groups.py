"""Quality rules where groups are small, and junk of extreme word length."""

import random

import pytest

pytest.importorskip("sievework.llm")

from sievework.llm import quality_mcd  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long"
SYL = ["the", "an", "on", "re", "ti", "ou", "chen", "ing", "wh"]


def clean(rng, n):
    return ["".join(rng.choice(SYL) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, a, b, len(t)) for i, (t, a, b) in enumerate(rows)], DDL)
    return {r.doc_id: r.kept for r in quality_mcd.quality(df).collect()}


def test_junk_in_small_groups_is_judged(spark):
    """A new source, a null one, a small language, and a group of 100 of which most fail the base rule."""
    rng = random.Random(4)
    rows = [(" ".join(clean(rng, rng.randrange(30, 300))), "en", "s") for _ in range(300)]
    junk = lambda: " ".join(w + rng.choice(["***", "$$$"]) for w in clean(rng, 100))
    at = len(rows)
    rows += [(junk(), *group) for group in (("en", "new"), ("en", None), (None, None), ("xx", "s")) for _ in range(10)]
    rows += [(junk(), "en", "failing") for _ in range(5)]
    end = len(rows)
    rows += [("short", "en", "failing")] * 100
    got = kept(spark, rows)
    assert not any(got[i] for i in range(at, end))
    assert sum(got[i] for i in range(at)) >= 0.99 * at


def test_extreme_word_length_is_junk(spark):
    rng = random.Random(5)
    rows = [(" ".join(clean(rng, rng.randrange(30, 300))), "en", "s") for _ in range(300)]
    rows += [(" ".join("".join(clean(rng, 60)) for _ in range(12)), "en", "s") for _ in range(8)]
    rows += [(" ".join("".join(clean(rng, 40))), "en", "s") for _ in range(8)]
    rows += [(" ".join(clean(rng, n)), "en", "s") for n in (15, 20, 3000, 9000)]
    got = kept(spark, rows)
    assert not any(got[i] for i in range(300, 316))
    assert all(got[i] for i in range(316, 320)) and sum(got[i] for i in range(300)) >= 297
