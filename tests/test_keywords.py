"""Keywords stay in the row of their text."""

import itertools
import random

from topiclake.functions import keywords
from tests.test_lake import reference_keywords


def test_no_row_per_token_is_sorted(spark):
    texts = [" ".join(f"word{(i * i + t) % 37}" if i % 5 else "to" for i in range(200)) for t in range(3)]
    df = spark.createDataFrame([*enumerate(texts), (7, ""), (8, None)], "id long, t string")
    found = keywords.extract_keywords(df, "id", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan
    want = {i: reference_keywords(t) for i, t in enumerate(texts)}
    assert {r.id: r.yaked for r in found.collect()} == {i: w for i, w in want.items() if w}
    # Copies of a text count together, each with its own places.
    twice = keywords.term_scores(df.unionByName(df), "id", "t").filter("term = 'word5'")
    once = keywords.term_scores(df, "id", "t").filter("term = 'word5'")
    assert {r.id: r.tf for r in twice.collect()} == {r.id: 2 * r.tf for r in once.collect()}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_within_a_bound():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for a, b in itertools.product(words, words):
        for most in (-1, 0, 1, 2, 4, 12):
            assert keywords.within_edits(a, b, most) == (_edits(a, b) <= most)
    for longest in range(1, 60):
        fits = [d for d in range(longest + 1) if 1 - d / longest > 0.85]
        assert keywords._most_edits(longest, 0.85) == max(fits)


def test_slices_and_copies_do_not_matter(spark, monkeypatch):
    """Rows are looked at slice by slice, on numbers of tokens and not on nested expressions of a row."""
    rng = random.Random(5)
    words = ["winter", "winters", "market", "marketting", "ab", "éé", "ééé", "日本語", "light", "zoo"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 70]))) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[5]), (None, texts[6]), (None, texts[7]), (50, None), (51, "  ab  ")]
    df = spark.createDataFrame(rows, "id long, t string")

    def found():
        return [
            sorted(map(repr, f(df, "id", "t").collect()))
            for f in (keywords.term_scores, keywords.keyword_candidates, keywords.extract_keywords)
        ]

    whole = found()
    monkeypatch.setattr(keywords, "SLICE_BYTES", 100)
    assert found() == whole and all(whole)
    ids = [r.id for r in keywords.extract_keywords(df, "id", "t").collect()]
    assert len(ids) == len(set(ids)) and None in ids and 51 not in ids and 50 not in ids
    plan = keywords.keyword_candidates(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("Exchange") == 1
