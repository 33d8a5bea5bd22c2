import random
import re

import numpy as np
import pytest

from tests.llm.conftest import base_rows
from topiclake.llm import licenses as L


def scan(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return L.scan(df, ["doc_id"], **how).orderBy("doc_id", "start").collect()


def brute_matched(template, words):
    """Longest common subsequence of a template with any stretch of words: an upper bound."""
    best = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for i, w in enumerate(words, 1):
            new.append(max(new[-1], best[i], best[i - 1] + (t == w)))
        best = new
    return best[-1]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_longest_common_subsequence(spark, seed):
    """Templates of all lengths, changed up to the coverage and beyond: found exactly if enough words are left."""
    rng = random.Random(seed)
    templates, texts, wanted = {}, [], set()
    for t in range(40):
        size = rng.randrange(1, 90)
        templates[f"t{t}"] = " ".join(f"w{t}x{i}" for i in range(size))
    for name, template in templates.items():
        words = template.split()
        spare = len(words) - -(-4 * len(words) // 5)
        for changes in {0, spare, spare + 1, rng.randrange(spare + 1)}:
            text = list(words)
            for n, i in enumerate(sorted(rng.sample(range(len(words)), min(changes, len(words))), reverse=True)):
                kind = rng.randrange(3) if n < 3 else 0
                text[i : i + 1] = [["changed"], [], [text[i], "put"]][kind]
            text = ["so"] * rng.randrange(6) + text + ["so"] * rng.randrange(6)
            matched = brute_matched(words, text)
            if 5 * matched >= 4 * len(words):
                wanted.add((len(texts), name, matched))
            texts.append(" ".join(text))
    found = {(r.doc_id, r.license, r.matched) for r in scan(spark, texts, templates=templates)}
    assert found == wanted and len(wanted) > 80


def test_fingerprints_lose_no_diagonal():
    """The index gives the same matches as a walk over all bands, in texts of few kinds of words."""
    rng = random.Random(8)
    kinds = [f"k{i}" for i in range(12)]
    templates = {f"t{i}": " ".join(rng.choice(kinds) for _ in range(rng.randrange(3, 25))) for i in range(20)}
    index = L.Index(templates, 0.8)
    for template in templates.values():
        words = template.split()
        text = rng.choices(kinds, k=30) + words[: len(words) // 2] + ["x"] + words[len(words) // 2 :] + rng.choices(kinds, k=30)
        words, hashes = L._words(" ".join(text))
        hits = [(t, lines) for t, _, lines in index.hits(words, hashes)]
        every = [(t, np.arange(-100, len(hashes) + 100)) for t in range(len(templates))]
        got, want = set(L.matches(index, hashes, hits)), set(L.matches(index, hashes, every))
        # What is found only by the walk has no run of a fingerprint's length.
        for t, _, a, b in want - got:
            span, part = index.span[t], hashes[max(a - 1, 0) : b + 1].tolist()
            runs = {tuple(part[i : i + span]) for i in range(len(part) - span + 1)}
            own = index.words[t].tolist()
            assert not any(tuple(own[i : i + span]) in runs for i in range(len(own) - span + 1))
        assert got


def test_whole_license_texts_and_headings(spark):
    t = L.TEMPLATES
    bsd = t["bsd-2-clause"].replace(" THIS SOFTWARE", f" 3. {t['bsd-third-clause']} THIS SOFTWARE")
    texts = [f"Copyright 2020 someone. {bsd}", f"MIT License Copyright (c) 2021 {t['mit-text']}", t["gpl-2.0-heading"],
             "Mozilla Public License Version 2.0", t["mpl-2.0-notice"]]
    found = {}
    for r in scan(spark, texts):
        found.setdefault(r.doc_id, set()).add((r.license, r.coverage))
    assert {n for n, c in found[0] if c > 0.95} == {"bsd-2-clause", "bsd-third-clause"}
    assert ("mit-text", 1.0) in found[1]
    assert [found[i] for i in (2, 3, 4)] == [
        {("gpl-2.0-heading", 1.0)}, {("mpl-2.0-heading", 1.0)}, {("mpl-2.0-notice", 1.0)}
    ]


def test_names_of_new_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "t")], "license long, text string")
    with pytest.raises(ValueError):
        L.scan(df, ["license"])


def test_whole_notices_and_spans(spark):
    pad = "é some words before. "
    texts = [pad + t + " and after" for t in L.TEMPLATES.values()]
    rows = {}
    for r in scan(spark, texts):
        rows.setdefault(r.doc_id, []).append(r)
    for i, (name, template) in enumerate(L.TEMPLATES.items()):
        first = rows[i][0]
        assert (first.license, first.coverage) == (name, 1.0)
        # The span begins at the first word and ends behind the last one.
        assert texts[i][first.start : first.end] == template.rstrip(".)/")


def test_changed_and_missing_words(spark):
    words = L.TEMPLATES["mit"].split()
    changed = [w if i % 15 else "changed" for i, w in enumerate(words)]
    short = words[: len(words) // 2]
    found = scan(spark, [" ".join(changed), " ".join(short), " ".join(words[:40] + ["new"] * 3 + words[40:])])
    assert [(r.doc_id, r.license) for r in found] == [(0, "mit"), (2, "mit")]
    assert 0.85 < found[0].coverage < 1 and found[1].coverage > 0.97


def test_alignment_never_beats_the_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        template = [rng.randrange(6) for _ in range(12)]
        words = [rng.randrange(6) for _ in range(20)]
        at = rng.randrange(0, 9)
        words[at : at + 12] = [t if rng.random() < 0.8 else 9 for t in template]
        matched, a, b = L.align(template, words, at, 3)
        same = sum(x == y for x, y in zip(template, words[at : at + 12]))
        assert same - 4 <= matched <= brute_matched(template, words)
        assert 0 <= a <= b <= len(words)


def test_repeats_and_edges(spark, docs, no_docs, clashing):
    line = L.TEMPLATES["mit-line"]
    found = scan(spark, [f"{line} x y z {line}\n{line}", None, "", line[:-10]])
    assert [r.doc_id for r in found] == [0, 0, 0]
    assert len({r.start for r in found}) == 3
    assert L.scan(no_docs, ["doc_id"]).count() == 0
    assert L.scan(docs, ["doc_id"]).count() == 0
    assert L.scan(clashing, ["doc_id"]).count() == 0
    assert len(base_rows()) == docs.count()
    assert scan(spark, ["any words"], templates={}) == []


def test_one_word_dropped_replaced_or_inserted_in_every_template(spark):
    texts, wanted = ["Released under MIT License."], ["mit-line"]
    for name, template in L.TEMPLATES.items():
        words = template.split()
        for i in range(len(words)):
            if len(L._words(words[i])[1]) != 1:
                continue
            texts += [
                " ".join(["so", *words[:i], *new, *words[i + 1 :], "so"])
                for new in ([], ["changed"], [words[i], "inserted"])
            ]
            wanted += [name] * 3
    found = {(r.doc_id, r.license) for r in scan(spark, texts)}
    # A line is part of its notice; without one word, notices of the GPL family are those of another.
    inside = {"apache-2.0-line": "apache-2.0-notice", "agpl-3.0-notice": "gpl-notice", "gpl-2.0-notice": "gpl-notice"}
    missing = [
        (texts[i], name) for i, name in enumerate(wanted)
        if (i, name) not in found and (i, inside.get(name)) not in found
        and not any(d == i and n.startswith("cc-by") and name.startswith("cc-by") for d, n in found)
    ]
    assert not missing


def test_evenly_spaced_changes_at_the_edge_of_the_coverage(spark):
    texts = []
    for template in L.TEMPLATES.values():
        words = re.findall("[A-Za-z0-9]+", template)
        most = len(words) - -(-4 * len(words) // 5)
        at = {(2 * k + 1) * len(words) // (2 * most) for k in range(most)}
        texts.append(" ".join("changed" if i in at else w for i, w in enumerate(words)))
    found = {(r.doc_id, r.license) for r in scan(spark, texts)}
    names = list(L.TEMPLATES)
    assert [n for i, n in enumerate(names) if (i, n) not in found] == []
