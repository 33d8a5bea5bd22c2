"""Cleaning against the same steps written with Python's ``re``."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topiclake.functions.clean import SIGNS, clean_text
from topiclake.functions.words import ENGLISH, drop_words, is_ascii_alnum, remove_stopwords

# The patterns of the cleaning steps.
EMOJI = (
    "[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F700-\U0001F77F"
    "\U0001F780-\U0001F7FF\U0001F800-\U0001F8FF\U0001F900-\U0001F9FF\U0001FA00-\U0001FA6F"
    "\U0001FA70-\U0001FAFF\u2600-\u27BF\U0001F1E6-\U0001F1FF\U0001F201-\U0001F251"
    "\u2B06-\u2B07\U0001F200-\U0001F251\u203C-\u32FF\u2702-\u27B0]+"
)
STEPS = [
    (EMOJI, ""), (r"@\S+", ""), (r"<.*?>", ""), (r"[-+]?[.\d]*\d+[:,./\d]*", ""),
    (r"https?://\S+|www\.\S+", "URL"), (r"([!?.]){1,}", r"\1 "), (r"[8:=;]['\-]?[)dDp]", ""),
    (r"[8:=;]['\-]?[(\\/]", ""), (r"<3", "HEART"), (r"[?!:,./\"“”’‘();_#+&*$@…»|]", ""),
    (r"[•'—\[\]%]", ""), (r"’s\b", ""), (r"'s\b", ""), (r"\b(\S*?)([a-z])\2{2,}\b", r"\1\2 "),
    (" - ", " "), (r"\s+", " "),
]


def python_clean(text):
    for pattern, replacement in STEPS:
        text = re.sub(pattern, replacement, text)
    return " ".join(w.strip(SIGNS) for w in text.split(" ")).lower()


def spark_clean(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", clean_text("t", **kw).alias("c")).orderBy("i").collect()
    return [r.c for r in rows]


SAMPLES = [
    "Hello @bob.example, see https://a.b/c?d=1 or www.x.org!!! <b>now</b>",
    "soooo gooood yaaaay heyyy-looool aaa-bbb Aaaa éeee eeeé",
    "I <3 you :) :-( =D 8/ ;p it's Bob’s 1,234.56 -7 +3.5 ...5 ....",
    "tabs\tand\nnew\r\nlines\u00a0nbsp\u2003em\x1cfs <a\nb> <ok>",
    "🙂🎉 Ünïcode ١٢٣ ｶﾅ かな \u203c 〜 x - y -- z -a- ^b^ ~ `",
    "", " ", "...", "!!!???", "@", "@@@ a", "<<<>>>", "----", "a---b", "--a--b--",
    "http://", "www.", "3<3<3", "\\o/ {x} [y] 100% •bullet— “quoted”", "=== ==)a :'( ;-)",
    "xyzzz zzz z1zzz _aaa aaa_ aaa1 AAAaaa",
]


def test_samples(spark):
    assert spark_clean(spark, SAMPLES) == [python_clean(t) for t in SAMPLES]


def test_unreachable_steps_change_nothing(spark):
    assert spark_clean(spark, SAMPLES, unreachable=True) == spark_clean(spark, SAMPLES)


ALPHABET = st.text(
    alphabet="abzAZ eé13.,:;-+!?'\"<>()[]/\\@#=8dDp_\t\n\u00a0’“…»•—%^~`|{}*&$🙂w", max_size=40
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(ALPHABET, min_size=30, max_size=60))
def test_any_text(spark, texts):
    got = spark_clean(spark, texts)
    want = [python_clean(t) for t in texts]
    assert got == want


def test_long_junk(spark):
    junk = ["." * 50_000, "-" * 50_000 + "x", "x" + "-" * 50_000 + "y", "+." * 25_000,
            "a" * 3_000 + "1", "<" * 3_000]
    got = spark_clean(spark, junk)
    assert got[0].strip() == "" and got[1] == "x" and got[2] == junk[2]
    assert got[3].strip() == "" and got[5] == ""


def test_lower_and_stop_words_idempotent(spark):
    df = spark.createDataFrame([("The cat and THE dog don't sit",), ("  ",), ("ab abc",)], "t string")
    once = df.select(drop_words(clean_text("t"), ENGLISH).alias("t"))
    twice = once.select(drop_words("t", ENGLISH).alias("t"))
    assert [r.t for r in once.collect()] == ["cat dog sit", "", "abc"]
    assert once.collect() == twice.collect()


def test_long_stop_list_gives_equal_rows(spark):
    """Nulls, repeated keys and repeated rows included."""
    rows = [(1, "aaa bbb ccc"), (2, "bbb"), (3, ""), (3, "ddd"), (3, "ccc aaa"), (3, "ddd"), (None, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    stops = spark.createDataFrame([("bbb",), ("zzz",), (None,)], "word string")
    order = ["k", "t"]
    short = remove_stopwords(df, "t", stops).orderBy(*order).collect()
    long = remove_stopwords(df, "t", stops, max_words=1).orderBy(*order)
    assert long.collect() == short and len(short) == len(rows)
    assert "BatchEvalPython" not in long._jdf.queryExecution().toString()


def test_nfkc(spark):
    words = ["abc1", "ＡＢＣ", "é", "", "a b", "①", "ﬁ", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(is_ascii_alnum(F.col("w"))).collect()]
    assert got == [True, True, False, True, False, True, True, None]


@pytest.mark.parametrize("n", [1])
def test_cleaning_stays_in_the_jvm(spark, n):
    plan = spark.range(n).select(clean_text(F.col("id").cast("string")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
