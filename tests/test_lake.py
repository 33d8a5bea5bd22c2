"""Increments from raw files to the gold star, in batches and as streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiclake.functions import keywords, segment, vectorize
from topiclake.operators import words
from topiclake.plans import bronze, gold, silver
from topiclake.sources import feed, resources
from topiclake.sources.catalog import Catalog
from topiclake.streaming import landing as streams

DAY = dt.datetime(2024, 12, 15, 10, 0, 5)


def post(author, text, minutes=0, days=0, like=1):
    return (author, text, DAY + dt.timedelta(days=days, minutes=minutes), like, 0, 0, 0)


BATCHES = [
    [post("ann.x", "Winter market, \"lights\"\nand music everywhere"),
     post("bob.x", "Public health news today", 1),
     post("bob.x", "Public health news today", 1, like=9),      # collected twice
     post("cyd.x", "...", 2), post("dan.x", None, 3)],
    [post("ann.x", "Snow in the mountains", days=1),
     post("eve.x", "Public transport strike", days=1, minutes=1),
     post("bob.x", "Public health news today", 1)],             # delivered again
    [post("fay.x", "Late mountain pictures", minutes=30),        # older than the mark
     post("eve.x", "Nature photography club", days=2)],
]


def write_days(spark, root):
    for i, rows in enumerate(BATCHES):
        feed.write_csv(spark.createDataFrame(rows, "author string, text string, "
                       "created_at timestamp, like_count int, repost_count int, "
                       "quote_count int, reply_count int").coalesce(1), f"{root}/2024-12-{16 + i}")


def facts(catalog):
    posts = catalog.load("silver", "posts")
    joined = posts.join(catalog.load("silver", "time"), "SK_time").join(
        catalog.load("silver", "author"), "SK_author"
    )
    return {(r.author, str(r.created_at), r.yaked, r.like_count) for r in joined.collect()}


def dense(catalog, table, key):
    df = catalog.load("silver", table)
    n = df.count()
    assert sorted(r[0] for r in df.select(key).collect()) == list(range(1, n + 1))
    return n


def test_three_increments(spark, tmp_path):
    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    days, counts = [], []
    while (day := bronze.load_oldest_day(catalog, f"{tmp_path}/in")) is not None:
        days.append(day)
        counts.append(silver.refresh(catalog, silver.cleaned_words))
    assert days == ["2024-12-16", "2024-12-17", "2024-12-18"]
    assert counts == [2, 2, 2]
    got = facts(catalog)
    assert ("bob.x", "2024-12-15 10:01:00", "public health news today", 9) in got
    assert any(g[0] == "ann.x" and g[2] == "winter market lights music everywhere" for g in got)
    assert any(g[0] == "fay.x" for g in got)
    assert dense(catalog, "posts", "SK_post") == sum(counts)
    assert dense(catalog, "author", "SK_author") == 4
    assert dense(catalog, "time", "SK_time") == sum(counts)
    whole = Catalog(spark, f"{tmp_path}/whole")
    while bronze.load_oldest_day(whole, f"{tmp_path}/in"):
        pass
    silver.refresh(whole, silver.cleaned_words)
    assert facts(whole) == got
    assert silver.refresh(catalog, silver.cleaned_words) == 0

    gold.refresh(catalog)
    gold.refresh(catalog)
    posts = catalog.load("gold", "posts")
    assert posts.count() == sum(counts) and "yaked" not in posts.columns
    assert posts.select("SK_post").distinct().count() == sum(counts)
    lengths = posts.select(F.size("embedding")).distinct().collect()
    assert [r[0] for r in lengths] == [vectorize.DIMENSIONS]
    assert catalog.load("gold", "author").count() == catalog.load("silver", "author").count()
    back = gold.with_created_at(posts, catalog.load("gold", "time"))
    assert back.count() == sum(counts) and "created_at" in back.columns


def test_broken_load_is_run_again(spark, tmp_path, monkeypatch):
    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    bronze.load_oldest_day(catalog, f"{tmp_path}/in")
    append = Catalog.append

    def breaks(self, df, layer, table):
        if table == "loads":
            raise RuntimeError("lost")
        append(self, df, layer, table)

    monkeypatch.setattr(Catalog, "append", breaks)
    with pytest.raises(RuntimeError):
        silver.refresh(catalog, silver.cleaned_words)
    monkeypatch.undo()
    bronze.load_oldest_day(catalog, f"{tmp_path}/in")
    assert silver.refresh(catalog, silver.cleaned_words) == 4
    assert dense(catalog, "posts", "SK_post") == 4 and len(facts(catalog)) == 4
    assert dense(catalog, "author", "SK_author") == 3


def test_load_reads_only_new_batches(spark, tmp_path):
    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    bronze.load_oldest_day(catalog, f"{tmp_path}/in")
    silver.refresh(catalog, silver.cleaned_words)
    bronze.load_oldest_day(catalog, f"{tmp_path}/in")
    batches = silver.unread_batches(catalog)
    df = silver.new_posts(catalog, batches)
    assert len(batches) == 1 and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "batch" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # A load up to a moment leaves the rest for the next one.
    assert silver.refresh(catalog, silver.cleaned_words, until=DAY) == 0
    assert silver.refresh(catalog, silver.cleaned_words) == 2
    assert silver.unread_batches(catalog) == []


def test_broken_bronze_load_doubles_nothing(spark, tmp_path, monkeypatch):
    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    append = Catalog.append

    def breaks(self, df, layer, table):
        if table == "files":
            raise RuntimeError("lost")
        append(self, df, layer, table)

    monkeypatch.setattr(Catalog, "append", breaks)
    with pytest.raises(RuntimeError):
        bronze.load_oldest_day(catalog, f"{tmp_path}/in")
    monkeypatch.undo()
    assert bronze.load_oldest_day(catalog, f"{tmp_path}/in") == "2024-12-16"
    assert bronze.posts(catalog).count() == 5
    assert silver.refresh(catalog, silver.cleaned_words) == 2


def test_late_posts_reach_bronze_and_silver(spark, tmp_path):
    schema = ("author string, text string, created_at timestamp, like_count int, repost_count int, "
              "quote_count int, reply_count int")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    for i, rows in enumerate([
        [post("ann.x", "First mountain picture", days=20), post("bob.x", "Other words entirely", days=20)],
        [post("cyd.x", "Very late message here", days=1), post("ann.x", "First mountain picture", days=20),
         post("dan.x", "Another month message", days=-20)],
    ]):
        feed.write_csv(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_path}/in/part{i}")
        streams.start_bronze(catalog, f"{tmp_path}/in", f"{tmp_path}/c").awaitTermination(120)
        streams.start_silver(catalog, f"{tmp_path}/s", silver.cleaned_words).awaitTermination(120)
    assert catalog.load("bronze", "posts").count() == 4
    assert {f[0] for f in facts(catalog)} == {"ann.x", "bob.x", "cyd.x", "dan.x"}


def test_keywords_do_not_depend_on_the_cut(spark, tmp_path):
    """One load, one per day and all days in another order give the same rows."""
    schema = ("author string, text string, created_at timestamp, like_count int, repost_count int, "
              "quote_count int, reply_count int")
    days = [
        [post("ann.x", "socialmedia market opened today", days=i), post("bob.x", "social club meets", i, i),
         post("cyd.x", f"media news number{i} social media", 2 * i, i)] for i in range(3)
    ]
    whole = [r for d in days for r in d]
    found = []
    for name, loads in (("one", [whole]), ("three", days), ("back", days[::-1])):
        catalog = Catalog(spark, f"{tmp_path}/{name}")
        learnt = spark.createDataFrame(whole, schema)
        vocabulary = segment.learn_vocabulary(silver.cleaned_words(learnt, "author"), "yaked")
        catalog.overwrite(vocabulary, "silver", "vocabulary")
        for rows in loads:
            silver.load_posts(catalog, bronze.with_day(spark.createDataFrame(rows, schema)))
        found.append(facts(catalog))
    assert found[0] == found[1] == found[2] and len(found[0]) == 9
    assert any("social media" in f[2] for f in found[0] if f[0] == "ann.x")


def test_streams(spark, tmp_path):
    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    for _ in range(2):                                   # a restart adds nothing
        q = streams.start_bronze(catalog, f"{tmp_path}/in", f"{tmp_path}/c1")
        q.awaitTermination(120)
        q = streams.start_silver(catalog, f"{tmp_path}/c2", silver.cleaned_words, files_per_batch=2)
        q.awaitTermination(120)
    assert catalog.load("bronze", "posts").count() == 8   # two re-collected copies gone
    assert dense(catalog, "posts", "SK_post") == 6
    assert {f[0] for f in facts(catalog)} == {"ann.x", "bob.x", "eve.x", "fay.x"}


RAW_ROWS = "author string, text string, created_at timestamp, like_count int, repost_count int, quote_count int, reply_count int"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_streams_and_batches_keep_the_highest_counters(spark, tmp_path, order):
    """Copies with other counters, in one file, across files and runs, in every order."""
    files = [
        [post("ann.x", "First mountain picture", like=1), post("ann.x", "First mountain picture", like=4),
         post("bob.x", "Other words entirely", like=7)],
        [post("ann.x", "First mountain picture", like=9), post("bob.x", "Other words entirely", like=2),
         post("cyd.x", "Third message here", like=None), post("dan.x", "Quiet one over there", 5, like=0)],
        [post("cyd.x", "Third message here", like=3), post("ann.x", "First mountain picture", like=5)],
    ]
    want = {("ann.x", 9), ("bob.x", 7), ("cyd.x", 3), ("dan.x", 0)}
    lakes = {}
    for name in ("steps", "once", "batch"):
        catalog = lakes[name] = Catalog(spark, f"{tmp_path}/{name}")
        for i in order:
            path = f"{tmp_path}/in-{name}/2024-12-{10 + i}"
            feed.write_csv(spark.createDataFrame(files[i], RAW_ROWS).coalesce(1), path)
            if name == "steps":
                streams.start_bronze(catalog, f"{tmp_path}/in-{name}", f"{tmp_path}/c").awaitTermination(120)
                streams.start_silver(catalog, f"{tmp_path}/s", silver.cleaned_words).awaitTermination(120)
                gold.refresh(catalog)
        if name == "once":
            streams.start_bronze(catalog, f"{tmp_path}/in-{name}", f"{tmp_path}/c1").awaitTermination(120)
            streams.start_silver(catalog, f"{tmp_path}/s1", silver.cleaned_words).awaitTermination(120)
        if name == "batch":
            while bronze.load_oldest_day(catalog, f"{tmp_path}/in-{name}"):
                silver.refresh(catalog, silver.cleaned_words)
        assert {(f[0], f[3]) for f in facts(catalog)} == want
        assert dense(catalog, "posts", "SK_post") == 4
    rows = lakes["once"].load("bronze", "posts")
    assert {(r.author, r.like_count) for r in rows.collect()} == want
    held = lakes["steps"].load("gold", "posts")
    assert sorted(r.like_count for r in held.collect()) == [0, 3, 7, 9]


def test_raised_counters_after_a_break(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, f"{tmp_path}/lake")

    def load(rows):
        return silver.load_posts(catalog, bronze.with_day(spark.createDataFrame(rows, RAW_ROWS)), silver.cleaned_words)

    load([post("ann.x", "First mountain picture", like=1), post("bob.x", "Other words entirely", days=1)])
    gold.refresh(catalog)
    replace = Catalog.replace_load

    def breaks(self, df, layer, table):
        if table == "posts":
            raise RuntimeError("lost")
        replace(self, df, layer, table)

    monkeypatch.setattr(Catalog, "replace_load", breaks)
    with pytest.raises(RuntimeError):
        load([post("ann.x", "First mountain picture", like=8)])
    monkeypatch.undo()
    gold.refresh(catalog)                                # takes over what is not there yet
    assert load([post("ann.x", "First mountain picture", like=8)]) == 0
    gold.refresh(catalog)
    for layer in ("silver", "gold"):
        assert sorted(r.like_count for r in catalog.load(layer, "posts").collect()) == [1, 8]
    days = {r.day_collect for r in catalog.load("silver", "revised").collect()}
    assert days == {15}                                  # the other day was not written again


def test_archive_moves_consumed_files(spark, tmp_path):
    import pathlib

    write_days(spark, f"{tmp_path}/in")
    catalog = Catalog(spark, f"{tmp_path}/lake")
    for _ in range(2):
        q = streams.start_bronze(catalog, f"{tmp_path}/in", f"{tmp_path}/c", f"{tmp_path}/done",
                                 once=False, files_per_batch=1)
        q.awaitTermination(120)
    assert catalog.load("bronze", "posts").count() == 10
    moved = list(pathlib.Path(f"{tmp_path}/done").rglob("*.csv"))
    assert 1 <= len(moved) <= 3


def test_bad_values_and_feed(spark, tmp_path):
    path = tmp_path / "2024-12-20_01-02-03_en.csv"
    path.write_text('author,text,created_at,like_count,repost_count,quote_count,reply_count\r\n'
                    'a.b,"two\nlines, ""quoted""",2024-12-20 01:02:03,1,2,3,4\r\n'
                    'c.d,ok,not a date,x,2,3,4\r\n')
    (tmp_path / "notes.csv").write_text("no date in the name")
    files = feed.input_files(spark, str(tmp_path)).collect()
    assert [r.file_date for r in files] == ["2024-12-20"]
    rows = feed.read_csv(spark, [files[0].file], "bad").orderBy("author").collect()
    assert rows[0].text == 'two\nlines, "quoted"' and rows[0].like_count == 1
    assert rows[1].created_at is None and rows[1].like_count is None and rows[1].bad is not None
    record = {"post": {"author": {"handle": "a.b"}, "record": {"text": "t",
              "created_at": "2024-12-20T01:02:03Z"}, "like_count": 5}}
    (tmp_path / "feed.json").write_text(json.dumps(record))
    flat = feed.flatten_feed(feed.read_feed(spark, str(tmp_path / "feed.json"))).first()
    assert flat.author == "a.b" and flat.like_count == 5 and flat.reply_count is None


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["the", "don't"]))
    (tmp_path / "b.json").write_text(json.dumps(
        {"pronoum_stopwords": ["thou"], "extra_stopwords": ["the"], "internet_stopwords": ["lol"]},
        indent=1))
    got = resources.load_stopwords(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert sorted(r.word for r in got.collect()) == ["don't", "dont", "lol", "the", "thou"]


def test_labels_runs_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 0), (2, "x", -1)], "SK_post long, yaked string, labels int")
    resources.write_labels(df, f"{tmp_path}/l")
    got = resources.read_labels(spark, f"{tmp_path}/l").orderBy("SK_post").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b"', 0), (2, "x", -1)]
    names = [f"{m}-{i}" for m in ("HDBSCAN", "DBSCAN") for i in range(1, 6)]
    runs = spark.createDataFrame([(n, float(i), 1.0, 2.0) for i, n in enumerate(names)],
                                 resources.RUN_METRICS)
    table = resources.layer_table([runs.filter("Name like 'H%'"), runs.filter("Name like 'D%'")])
    assert [(r.Model, r.Layer) for r in table.orderBy("silhouette_avg").collect()] == [
        (n.split("-")[0], int(n.split("-")[1])) for n in names]
    rows = resources.run_rows(spark, [{"name": "x-1", "params": {"k": 2}, "metrics": {"m": 1}}])
    assert rows.first().params == {"k": "2"} and rows.first().metrics == {"m": 1.0}


def reference_keywords(text, n=3, window=2, top=15, dedup=0.85, max_score=0.05):
    words = text.split(" ")
    long = [w for w in set(words) if len(w) >= 3]
    tf = {w: words.count(w) for w in set(words)}
    mean, std = np.mean([tf[w] for w in long]), np.std([tf[w] for w in long])
    score = {}
    for w in long:
        left = [words[i - j] for i, x in enumerate(words) if x == w
                for j in range(1, window + 1) if i - j >= 0]
        right = [words[i + j] for i, x in enumerate(words) if x == w
                 for j in range(1, window + 1) if i + j < len(words)]
        rel = sum(0.5 + (len(set(s)) / len(s) if s else 0) * tf[w] / max(tf.values())
                  for s in (left, right))
        score[w] = keywords.POSITION * rel / (tf[w] / (mean + std) / rel + 1 / rel)
    found = {}
    for i in range(len(words)):
        for size in range(1, n + 1):
            p = words[i:i + size]
            if len(p) == size and all(len(w) >= 3 for w in p):
                found.setdefault(" ".join(p), []).append(i)
    ranked = []
    for k, at in found.items():
        s = [score[w] for w in k.split(" ")]
        value = np.prod(s) / ((sum(s) + 1) * len(at))
        if value < max_score:
            ranked.append((value, min(at), k))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    taken = []
    for _, _, k in sorted(ranked):
        if len(taken) < top and not any(
            1 - distance(t, k) / max(len(t), len(k)) > dedup for t in taken
        ):
            taken.append(k)
    return " ".join(dict.fromkeys(" ".join(taken).split(" "))) if taken else None


def test_keywords(spark):
    texts = [
        "winter market lights music market lights winter market",
        "public health news today public health minister speaks health budget vote public",
        "one two three one two three four ab one two five six",
        "word", "ab cd", "same same same same",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.yaked for r in keywords.extract_keywords(df, "id", "t").collect()}
    want = {i: reference_keywords(t) for i, t in enumerate(texts) if t != "ab cd"}
    assert got == {i: w for i, w in want.items() if w}
    plan = keywords.extract_keywords(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_segmentation(spark):
    corpus = ["social media"] * 20 + ["social club"] * 9 + ["media news"] * 5 + ["socialmedia xqzt"] * 2
    df = spark.createDataFrame([(t,) for t in corpus], "t string")
    vocabulary = segment.learn_vocabulary(df, "t")
    rows = spark.createDataFrame([("socialmedia newsclub xq social",), ("",), (None,)], "t string")
    got = [r.t for r in segment.segment_words(rows, "t", vocabulary).collect()]
    assert got == ["social media news club xq social", "", None]


def test_segmentation_is_that_of_all_substrings(spark):
    """Words longer than several prefix tables and than a chunk, letters beyond the first plane."""
    rng = np.random.default_rng(5)

    def random_word(n):
        return "".join(rng.choice(list("abé𝒳"), n))

    known = sorted({random_word(n) for n in [1, 2, 3, 4, 5, 8, 9, 17, 40] for _ in range(5)})
    words = sorted({"".join(rng.choice(known, rng.integers(1, 9))) for _ in range(40)} | {"q", "abq", "a" * 1300})
    counts = [(w, int(rng.integers(2, 99))) for w in known]
    vocabulary = spark.createDataFrame(counts, "word string, n long")
    cost = {r.word: r.cost for r in segment.word_costs(vocabulary).collect()}
    rank = sorted(counts, key=lambda c: (-c[1], c[0].encode()))
    assert all(abs(cost[w] - np.log((i + 1) * np.log(len(known)))) < 1e-12 for i, (w, _) in enumerate(rank))
    numbered = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    found = segment.known_pieces(numbered, segment.word_costs(vocabulary)).collect()
    want = {
        (i, a + 1, n) for i, w in enumerate(words) for a in range(len(w))
        for n in {len(k) for k in known} if w[a : a + n] in cost and a + n <= len(w)
    }
    assert len(found) == len(want) and {(r.id, r.start, r.size) for r in found} == want

    def cheapest(word):
        parts = {}
        for a in range(len(word)):
            for n in {len(k) for k in known}:
                if a + n <= len(word) and word[a : a + n] in cost:
                    parts.setdefault(a + n, []).append((a, cost[word[a : a + n]]))
        return segment.split_word(word, parts)

    got = {r.word: r.divided for r in segment.divisions(numbered, vocabulary).collect()}
    assert got == {w: cheapest(w) for w in words if cheapest(w) != w}


def test_segmentation_rows_grow_with_letters(spark, monkeypatch):
    """One long known word adds no row to words that do not begin like it."""
    counted = {}

    def counting(df, name="stage"):
        out = staged(df, name)
        counted[name] = counted.get(name, 0) + out.count()
        return out

    staged = segment.stage
    monkeypatch.setattr(segment, "stage", counting)
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = "".join(letters[(i * i + i // 7) % 26] for i in range(5000))
    rows = [(1, long), (2, "z" * 5000), (3, long[:2500] + "zz" + long[2600:])]
    numbered = spark.createDataFrame(rows, "id long, word string")
    costs = spark.createDataFrame([(long, 1.0), ("zz", 2.0), ("abcd", 3.0)], "word string, cost double")
    found = segment.known_pieces(numbered, costs)
    assert {(r.id, r.start, r.size) for r in found.filter("size > 2").collect()} >= {(1, 1, 5000)}
    assert counted["walk"] < 3 * 5000


def test_vectors(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb bb"), (3, "")], "id long, t string")
    rows = {r.id: np.array(r.embedding) for r in vectorize.vectorize(df, "t").collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and rows[3].sum() == 0
    assert sorted(rows[2][rows[2] > 0].round(4)) == [0.4472, 0.8944]
    idf = vectorize.fit_idf(df, "t")
    weighted = vectorize.vectorize(df, "t", idf=idf)
    assert weighted.columns == ["id", "t", "embedding"]

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)

    got = {r.id: r.embedding for r in vectorize.vectorize(df, "t", encoder).collect()}
    assert got == {1: [5.0, 1.0], 2: [8.0, 1.0], 3: [0.0, 1.0]}


@pytest.mark.parametrize("few", [32, 3, 1])
def test_vocabulary_pairs(spark, monkeypatch, few):
    """Sets and bitmaps give the pairs of plain Python, with words that every cluster knows."""
    monkeypatch.setattr(words, "FEW", few)
    rng = np.random.default_rng(5)
    rows = [(c, " ".join([f"all{i}" for i in range(70)] + [f"w{i}" for i in rng.integers(0, 40, 12)]))
            for c in range(-1, 50)]
    rows += [(50, "lonely"), (51, ""), (51, None), (None, "all1 all2"), (3, "all1 all1")]
    df = spark.createDataFrame(rows, "label int, text string").repartition(4)
    held = {}
    for c, text in rows:
        if c is not None:
            held.setdefault(c, set()).update(w for w in (text or "").split(" ") if w)
    want = {}
    for a in held:
        for b in held:
            if a < b and held[a] & held[b]:
                want[a, b] = (len(held[a] & held[b]), len(held[a] | held[b]))
    got = {(r.a, r.b): (r.both, r.either) for r in words.vocabulary_jaccard(df, "label", "text").collect()}
    assert got == want


def test_backlog_gives_the_loads_of_single_days(spark, tmp_path, monkeypatch):
    """All days in one pass: the same rows, keys, marks and numbers as day by day, also after a break."""
    write_days(spark, f"{tmp_path}/in")
    single = Catalog(spark, f"{tmp_path}/single")
    while bronze.load_oldest_day(single, f"{tmp_path}/in"):
        silver.refresh(single, silver.cleaned_words)
    once = Catalog(spark, f"{tmp_path}/once")
    assert bronze.load_backlog(once, f"{tmp_path}/in") == ["2024-12-16", "2024-12-17", "2024-12-18"]
    assert bronze.load_backlog(once, f"{tmp_path}/in") == []
    append = Catalog.append

    def breaks(self, df, layer, table):
        if table == "loads":
            raise RuntimeError("lost")
        append(self, df, layer, table)

    monkeypatch.setattr(Catalog, "append", breaks)
    with pytest.raises(RuntimeError):
        silver.refresh(once, silver.cleaned_words, each=True)
    monkeypatch.undo()
    assert silver.refresh(once, silver.cleaned_words, each=True) == 6
    assert silver.refresh(once, silver.cleaned_words, each=True) == 0

    def rows(catalog, table, *columns):
        return sorted(map(tuple, catalog.load("silver", table).select(*columns).collect()), key=str)

    for table, columns in (("loads", ("mark", "last_post")), ("author", ("SK_author", "author")),
                           ("time", ("SK_time", "created_at")), ("ledger", ("h1", "h2", "day_collect", "load"))):
        assert rows(once, table, *columns) == rows(single, table, *columns)
    assert facts(once) == facts(single)
    assert dense(once, "posts", "SK_post") == 6
    last = {i: r.last_post for i, r in enumerate(once.load("silver", "loads").orderBy("last_post").collect())}
    for r in once.load("silver", "posts").collect():     # the keys of a load end at its number
        assert last.get(r.load - 1, 0) < r.SK_post <= last[r.load]


def test_backlog_jobs_do_not_grow_with_the_days(spark, tmp_path):
    """Sixteen days start as many jobs as two."""
    started = []
    for n in (2, 16):
        rows = [post(f"a{i}.x", f"Winter pictures number{i} mountain", days=i) for i in range(n)]
        path = f"{tmp_path}/in{n}"
        df = spark.createDataFrame(rows, RAW_ROWS).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
        feed.write_csv(df, path, ["day"])
        catalog = Catalog(spark, f"{tmp_path}/lake{n}")
        spark.sparkContext.setJobGroup(path, "backlog")
        assert len(bronze.load_backlog(catalog, path)) == n
        assert silver.refresh(catalog, silver.cleaned_words, each=True) == n
        started.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(path)))
        assert catalog.load("silver", "loads").count() == n
    assert started[1] <= started[0] + 6


def test_spread_runs_no_join(spark, tmp_path):
    """Posts are spread over the cores without a job that joins them."""
    from workload import views

    for name, rows in (
        ("documents", "SELECT id AS doc_id, 'a b' AS text FROM range(50)"),
        ("events", "SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id AS user_id, 1.0D AS value FROM range(50)"),
    ):
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sparkContext.setJobGroup("views", "views")
        rows = views.cleaned(spark, str(tmp_path))
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("views"))
        assert before <= 2                                # the schemas of the two files
        assert rows.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


def test_landing_writes_texts_once(spark, tmp_path, monkeypatch):
    """A stream's batch reaches bronze without a staged copy, and no group of it is shuffled by its texts."""
    rows = [post("ann.x", "First mountain picture", like=i % 3) for i in range(6)]
    rows += [post(None, "x"), post("x", None), post("x", None, like=4)]   # nulls in different columns
    feed.write_csv(spark.createDataFrame(rows, RAW_ROWS).coalesce(1), f"{tmp_path}/in/a")
    staged = []
    monkeypatch.setattr(streams, "stage", lambda df, name: staged.append(name) or df, raising=False)
    catalog = Catalog(spark, f"{tmp_path}/lake")
    streams.start_bronze(catalog, f"{tmp_path}/in", f"{tmp_path}/c").awaitTermination(120)
    got = {(r.author, r.text, r.like_count) for r in catalog.load("bronze", "posts").collect()}
    assert got == {("ann.x", "First mountain picture", 2), (None, "x", 1), ("x", None, 4)}
    assert catalog.load("bronze", "ledger").count() == 3 and staged == []


def test_blank_filter_cleans_no_text_twice(spark, tmp_path, monkeypatch):
    """The filter on blank posts stays above the cleaning."""
    plans, real = [], silver.assign_keys
    monkeypatch.setattr(silver, "assign_keys", lambda df, *a, **k: plans.append(df) or real(df, *a, **k))
    catalog = Catalog(spark, f"{tmp_path}/lake")
    rows = spark.createDataFrame([post("ann.x", "Winter pictures"), post("bob.x", "...")], RAW_ROWS)
    assert silver.load_posts(catalog, bronze.with_day(rows), silver.cleaned_words) == 1
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_join") == 1


@pytest.mark.parametrize("directed", [False, True])
def test_edges_by_numbers_and_by_words(spark, monkeypatch, directed):
    """Both ways of counting pairs give equal edges, and the numbered one shuffles no words of pairs."""
    texts = [("b a b a c b",), ("a b é z é",), ("z z a",), ("rare b a",), (None,), ("",), ("a",)] * 2
    df = spark.createDataFrame(texts, "post string")
    edges = words.cooccurrence(df, "post", 4, directed)
    got = sorted(map(tuple, edges.collect()))
    monkeypatch.setattr(words, "NUMBERED_ROWS", 0)
    assert got == sorted(map(tuple, words.cooccurrence(df, "post", 4, directed).collect()))
    assert ("a", "b", 10 if not directed else 4) in got
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w1" not in plan


def test_null_authors_get_a_key_in_every_load(spark):
    rows = spark.createDataFrame([(None, 0), ("b", 0), ("a", 1), (None, 1), ("b", 1), (None, 1)], "author string, load int")
    known = spark.createDataFrame([("c", 1)], "author string, SK_author long")
    got = silver.new_authors(rows, known, 2).collect()
    assert sorted((r.SK_author, r.author) for r in got) == [(2, None), (3, "b"), (4, None), (5, "a")]


def test_dimensions_of_rows_without_a_load(spark):
    """Rows of one load need no column for it, and rows of a null author or minute keep their keys."""
    minute = [dt.datetime(2024, 1, 5, 10, m) for m in (3, 1)]
    rows = [(1, "b", minute[0]), (2, "a", minute[1]), (3, None, minute[1]), (4, "b", None), (5, None, None)]
    rows = spark.createDataFrame(rows, "SK_post long, author string, created_at timestamp")
    none = spark.createDataFrame([], "created_at timestamp, author string")
    time = silver.new_times(rows.select("created_at"), none, 1)
    author = silver.new_authors(rows.select("author"), none, 1)
    assert sorted((r.SK_author, r.author) for r in author.collect()) == [(1, None), (2, "a"), (3, "b")]
    facts = silver.with_keys(rows, time, author, nulls=True)
    assert sorted((r.SK_post, r.SK_author, r.SK_time) for r in facts.collect()) == [
        (1, 3, 3), (2, 2, 2), (3, 1, 2), (4, 3, 1), (5, 1, 1)]
    assert silver.with_keys(rows, time, author).count() == 2
