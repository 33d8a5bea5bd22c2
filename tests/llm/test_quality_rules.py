import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENT, SENTENCE, base_rows
from topiclake.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    starts = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if starts[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark, docs):
    rows = Q.judge(docs, "doc_id").collect()
    assert Counter((r.doc_id, *(r[c] for c in NAMES)) for r in rows) == Counter((r[0], *plain(r[1])) for r in base_rows())
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t#é"), max_size=120), min_size=1, max_size=40))
def test_counts_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = Q.plain_counts(df, "t", ["i"]).orderBy("i").collect()
    assert [tuple(r[c] for c in NAMES) for r in rows] == [plain(t) for t in texts]


def test_repetition_within_words(spark):
    text = " ".join(["a b c d e f g h"] * 3 + [str(i) for i in range(50)])
    df = spark.createDataFrame([(1, text)], "i long, t string")
    assert Q.plain_counts(df, "t", ["i"]).first().n_repeat_words == plain(text)[4] == 24


def test_divergent_texts_go(spark):
    clean = [(i, " ".join([SENTENCE] + [f"{SENTENCE[:20]}{chr(97 + (i + j) % 26)}" for j in range(30)]), "en", "s", 1) for i in range(30)]
    symbols = [(100, " ".join(f"{w}%%%***" for w in f"{SENTENCE} {' '.join(map(chr, range(97, 123)))}".split()), "en", "s", 1)]
    foreign = [(101, " ".join(f"zq{i}x" for i in range(200)).replace("0", "o"), "en", "s", 1)]
    df = spark.createDataFrame(clean + symbols + foreign, DOCUMENT)
    kept = {r.doc_id: r.kept for r in Q.judge(df, "doc_id", class_chars=100, word_words=50).collect()}
    assert not kept[100] and not kept[101]


def test_distance(spark):
    df = spark.sql("select array(1d, 0d) p, array(0d, 3d) q, array(2d, 2d) r, array(0d, 0d) z, cast(null as array<double>) n")
    row = df.select(
        Q.js_distance(F.col("p"), F.col("q")).alias("far"), Q.js_distance(F.col("r"), F.col("r")).alias("same"),
        Q.js_distance(F.col("p"), F.col("z")).alias("empty"), Q.js_distance(F.col("p"), F.col("n")).alias("none"),
    ).first()
    assert abs(row.far - 1) < 1e-12 and row.same == 0 and row.empty is None and row.none is None


def test_edges(spark, no_docs, clashing):
    assert Q.judge(no_docs, "doc_id").count() == 0
    assert Q.judge(clashing, "doc_id").count() == clashing.count()


def test_plan_has_no_python(spark, docs):
    plan = Q.judge(docs, "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
