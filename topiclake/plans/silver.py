"""Bronze posts into the silver star: cleaned posts, minutes and authors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.functions.calendar import calendar_parts, to_minute
from topiclake.functions.clean import clean_text
from topiclake.functions.keywords import extract_keywords
from topiclake.functions.segment import learn_vocabulary, segment_words
from topiclake.functions.words import ENGLISH, drop_words, remove_stopwords
from topiclake.operators.keys import assign_keys
from topiclake.plans.bronze import batches as bronze_batches
from topiclake.plans.bronze import posts as bronze_posts
from topiclake.plans.bronze import with_month
from topiclake.schemas import TABLES
from topiclake.session import stage
from topiclake.sources.catalog import Catalog, high_water

COUNTERS = ["like_count", "repost_count", "quote_count", "reply_count"]
IDENTITY = ["created_at", "text", "author"]

TextPlan = Callable[[DataFrame, str], DataFrame]


def cleaned_words(df: DataFrame, key: str) -> DataFrame:
    """``yaked`` = cleaned text without stop words."""
    return df.withColumn("yaked", drop_words(clean_text("text"), ENGLISH)).drop("text")


def without_words(stops: DataFrame) -> TextPlan:
    """A plan like :func:`cleaned_words` with the stop words of a table."""

    def plan(df: DataFrame, key: str) -> DataFrame:
        cleaned = df.withColumn("yaked", clean_text("text")).drop("text")
        return remove_stopwords(cleaned, "yaked", stops)

    return plan


def keyword_words(df: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``yaked`` = words of the keywords of the cleaned, divided text.

    Words are divided with the given vocabulary; without one, with the words of ``df`` itself.
    """
    words = stage(cleaned_words(df, key), "words")
    if vocabulary is None:
        vocabulary = learn_vocabulary(words, "yaked")
    divided = segment_words(words, "yaked", vocabulary)
    found = extract_keywords(divided, key, "yaked")
    return words.drop("yaked").join(found, key)


def learn_words(catalog: Catalog) -> DataFrame:
    """Learn the vocabulary from all posts in bronze, and write it down in place of the last one."""
    posts = distinct_posts(bronze_posts(catalog).select(*IDENTITY).dropna(subset=["text"]))
    words = cleaned_words(posts, "created_at")
    catalog.overwrite(stage(learn_vocabulary(words, "yaked"), "vocabulary"), "silver", "vocabulary")
    return catalog.load("silver", "vocabulary")


def lake_keywords(catalog: Catalog) -> TextPlan:
    """The keyword plan with the lake's vocabulary, so that a text's words do not depend on the load
    it comes in. The vocabulary is learnt when there is none yet."""

    def plan(df: DataFrame, key: str) -> DataFrame:
        vocabulary = catalog.load("silver", "vocabulary")
        if vocabulary.isEmpty():
            vocabulary = learn_words(catalog)
        return keyword_words(df, key, vocabulary)

    return plan


def distinct_posts(df: DataFrame) -> DataFrame:
    """One row per (created_at, text, author), with its highest counters.

    A grouped maximum shrinks re-collected copies inside each task before anything is shuffled. Copies
    from several loads (column ``load``) are a post of the first of them.
    """
    load = [c for c in df.columns if c == "load"]
    rest = [c for c in df.columns if c not in (*IDENTITY, *load)]
    if not rest:
        return df.distinct()
    first = [c for c in COUNTERS if c in rest] + [c for c in rest if c not in COUNTERS]
    best = df.groupBy(*IDENTITY).agg(
        F.max(F.struct(*first)).alias("b"), *[F.min(c).alias(c) for c in load]
    )
    return best.select(*IDENTITY, *[F.col(f"b.{c}").alias(c) for c in rest], *load)


def newer_than(df: DataFrame, mark, column: str = "created_at") -> DataFrame:
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def unread_batches(catalog: Catalog) -> list[str]:
    """Finished bronze batches that no finished load has read, those of the oldest files first."""
    loads = catalog.load("silver", "loads").count()
    done = catalog.load("silver", "reads").filter(F.col("load") < loads).select("batch")
    unread = bronze_batches(catalog).join(done, "batch", "left_anti")
    return [r.batch for r in unread.orderBy("file_date", "batch").collect()]


def planned_loads(catalog: Catalog, batches: list[str], each: bool) -> dict[str, int]:
    """The number of the load that is to read each batch: the next one, or with ``each`` one after another.

    The plan is written down first. A load that is run again after a break gives the batches of its
    first try the same numbers, whatever has come in between, and so replaces what that try left.
    """
    first = catalog.load("silver", "loads").count()
    old = catalog.load("silver", "plans").filter(F.col("load") >= first)
    kept = {r.batch: r.load for r in old.groupBy("batch").agg(F.max("load").alias("load")).collect()}
    plan = {b: kept[b] for b in batches if b in kept}
    new = [b for b in batches if b not in kept]
    after = max(plan.values(), default=first - 1) + 1
    plan |= {b: after + i if each else first for i, b in enumerate(new)}
    if new:
        rows = [(b, plan[b]) for b in new]
        listed = catalog.spark.createDataFrame(rows, TABLES["silver", "plans"]).coalesce(1)
        catalog.append(listed, "silver", "plans")
    return plan


def new_posts(
    catalog: Catalog, batches: list[str], until=None, loads: dict[str, int] | None = None
) -> DataFrame:
    """Posts of the given bronze batches, which are partitions, whenever they were created; with
    ``loads`` the number of the load that reads their batch stands in ``load``."""
    rows = catalog.load("bronze", "posts").filter(F.col("batch").isin(batches))
    if loads:
        numbers = catalog.spark.createDataFrame(list(loads.items()), TABLES["silver", "plans"])
        rows = rows.join(F.broadcast(numbers), "batch")  # one row per batch
    rows = rows.drop("source_file", "batch")
    return rows if until is None else rows.filter(F.col("created_at") <= F.lit(until))


def digests(df: DataFrame) -> DataFrame:
    """Two hashes of the identity. A hash passes over nulls, so which columns are null is hashed as well."""
    parts = [*IDENTITY, *[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(IDENTITY)]]
    return df.withColumn("h1", F.xxhash64(*parts)).withColumn("h2", F.xxhash64(F.lit(1), *parts))


def seen_in(ledger: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """Digests (and ``more`` columns) in the ledger of the days that the rows are from.

    The days are collected (at most 31 and a few months) and filter the ledger as literals: the day
    prunes its partitions, the month what is read of them.
    """
    days = with_month(rows).select("day_collect", "month_collect").distinct().collect()
    listed = ledger.filter(
        F.col("day_collect").isin(sorted({r.day_collect for r in days if r.day_collect}))
        & F.col("month_collect").isin(sorted({r.month_collect for r in days if r.month_collect}))
    )
    return listed.select("day_collect", "h1", "h2", *more)


def counters() -> Column:
    """The counters as one value; the greater one has the higher first counter that differs."""
    return F.struct(*COUNTERS)


def raise_counters(catalog: Catalog, copies: DataFrame) -> int:
    """Give loaded posts the counters of later copies (SK_post, day_collect, counters) that are higher.

    Only the partitions, by day and load, that hold such posts are written again. Nothing is lost if
    this breaks off: counters only rise, so a second run writes the same. The marks come first; they
    tell gold which days to look at. Returns the number of posts.
    """
    days = [r.day_collect for r in copies.select("day_collect").distinct().collect()]  # at most 31
    posts = catalog.load("silver", "posts").filter(F.col("day_collect").isin(days))
    new = copies.select("SK_post", counters().alias("_new"))
    higher = stage(
        posts.join(new, "SK_post").filter(F.col("_new") > counters()).select("SK_post", "day_collect", "load", "_new"),
        "higher",
    )
    n = higher.count()
    if not n:
        return 0
    mark = uuid.uuid4().hex
    catalog.append(higher.select("day_collect", F.lit(mark).alias("mark")).distinct(), "silver", "revised")
    touched = posts.join(higher.select("day_collect", "load").distinct(), ["day_collect", "load"], "left_semi")
    raised = touched.join(higher.select("SK_post", "_new"), "SK_post", "left")
    raised = raised.withColumns(
        {c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) for c in COUNTERS}
    ).drop("_new")
    catalog.replace_load(stage(raised, "raised"), "silver", "posts")
    return n


def first_loads(rows: DataFrame, column: str) -> DataFrame:
    """(column, load): each value with the first load that has it; null, which no join finds again, with all.

    Rows without a column ``load`` are those of one load.
    """
    if "load" not in rows.columns:
        rows = rows.withColumn("load", F.lit(0))
    again = F.when(F.col(column).isNull(), F.col("load")).alias("_again")
    return rows.groupBy(column, again).agg(F.min("load").alias("load")).drop("_again")


def new_times(minutes: DataFrame, known: DataFrame, start: int) -> DataFrame:
    """Minutes that the time dimension does not hold yet, with keys in order of their load and of time."""
    fresh = first_loads(minutes, "created_at").join(known.select("created_at"), "created_at", "left_anti")
    keyed = assign_keys(fresh, "SK_time", start, ["load", "created_at"])
    return keyed.select("SK_time", "created_at", *calendar_parts("created_at"))


def new_authors(authors: DataFrame, known: DataFrame, start: int) -> DataFrame:
    fresh = first_loads(authors, "author").join(known.select("author"), "author", "left_anti")
    return assign_keys(fresh, "SK_author", start, ["load", "author"]).drop("load")


def with_keys(posts: DataFrame, time: DataFrame, author: DataFrame, nulls: bool = False) -> DataFrame:
    """Surrogate keys from the whole dimensions, old and new rows alike.

    The size of the written tables decides between a broadcast and a sorted join, in which a very
    busy author is split. With ``nulls`` a null is a value like others, for dimensions of one load, which
    hold it once.
    """
    minutes, authors = time.select("created_at", "SK_time"), author.select("author", "SK_author")
    if not nulls:
        return posts.join(minutes, "created_at").join(authors, "author")
    keyed = posts
    for known, value in ((minutes, "created_at"), (authors, "author")):
        known = known.withColumnRenamed(value, "_value")
        keyed = keyed.join(known, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
    return keyed


def load_posts(
    catalog: Catalog, bronze: DataFrame, text_plan: TextPlan | None = None,
    batches: dict[str, int] | None = None,
) -> int:
    """Load a batch of bronze rows into the star; returns the number of new posts.

    Rows with a column ``load`` are those of several loads, done in one pass: keys, marks and numbers
    become the same as if they had been done one after another.

    Posts that an earlier load has loaded are known by their digests, so late and repeated posts
    are safe whatever the order of the loads; higher counters of a repeated post replace those it
    had. ``batches`` are the bronze batches read in full, with the numbers of their loads.
    The rows in ``loads`` are written last. A load that broke off before it is simply run again: it
    has the same number, ignores what its first try left in the ledger and replaces its posts.
    """
    load, last_post, held = catalog.load("silver", "loads").agg(
        F.count("*").cast("int"), F.coalesce(F.max("last_post"), F.lit(0)), F.max("mark")
    ).first()
    numbers = sorted(set(batches.values())) if batches else [load]
    if "load" not in bronze.columns:
        bronze = bronze.withColumn("load", F.lit(load))
    posts = with_month(digests(distinct_posts(bronze.dropna(subset=["text"]))))
    # Written before its row ids are used, so that they cannot change.
    posts = stage(posts.withColumn("_row", F.monotonically_increasing_id()), "distinct")
    ledger = catalog.load("silver", "ledger").filter(F.col("load") < load)
    seen = stage(seen_in(ledger, posts, "SK_post"), "seen")
    again = posts.join(seen.filter("SK_post is not null"), ["day_collect", "h1", "h2"])
    raise_counters(catalog, again.select("SK_post", "day_collect", *COUNTERS))
    numbered = posts.join(seen, ["day_collect", "h1", "h2"], "left_anti")
    ends = numbered.groupBy("load").agg(F.max("created_at").alias("mark")).collect()  # one row per load
    marks = {r.load: r.mark for r in ends if r.mark is not None}
    if not marks and not batches:
        return 0
    text_plan = text_plan or lake_keywords(catalog)
    words = text_plan(numbered.withColumn("created_at", to_minute("created_at")), "_row")
    # Written once, with its keys: the two dimensions and the fact all start from it.
    # Spark moves no filter below a column that is not deterministic; below the cleaning, it would
    # clean every text twice.
    kept = words.withColumn("_at", F.monotonically_increasing_id()).filter(F.trim("yaked") != "")
    batch = assign_keys(kept, "SK_post", last_post + 1, within="load" if len(numbers) > 1 else None).drop("_at")

    time, author = catalog.load("silver", "time"), catalog.load("silver", "author")
    last_time, last_author = high_water(time, "SK_time"), high_water(author, "SK_author")
    times = new_times(batch.select("created_at", "load"), time, (last_time or 0) + 1)
    catalog.append(times, "silver", "time")
    authors = new_authors(batch.select("author", "load"), author, (last_author or 0) + 1)
    catalog.append(authors, "silver", "author")
    time, author = catalog.load("silver", "time"), catalog.load("silver", "author")
    catalog.replace_load(with_keys(batch, time, author), "silver", "posts")
    # The mark and the ledger cover the posts that were read, also those without words.
    listed = numbered.select("_row", "h1", "h2", "month_collect", "day_collect", "load")
    catalog.replace_load(listed.join(batch.select("_row", "SK_post"), "_row", "left"), "silver", "ledger")
    reads = list((batches or {}).items())
    catalog.append(catalog.spark.createDataFrame(reads, TABLES["silver", "reads"]), "silver", "reads")
    counts = {r.load: r["count"] for r in batch.groupBy("load").count().collect()}  # one row per load
    rows, last = [], last_post
    for n in numbers:
        mark = marks.get(n, held)  # without new posts, the mark of the loads before
        held = mark if held is None else max(held, mark)
        last += counts.get(n, 0)
        rows.append((mark, last))
    # One file, so that the loads are finished together or not at all.
    finished = catalog.spark.createDataFrame(rows, TABLES["silver", "loads"]).coalesce(1)
    catalog.append(finished, "silver", "loads")
    return last - last_post


def refresh(catalog: Catalog, text_plan: TextPlan | None = None, until=None, each: bool = False) -> int:
    """Load everything new from bronze, or what was created up to ``until``.

    A batch that was read in part is read again by the next load. With ``each`` every batch is a load of
    its own, in order of their files' dates, but all are done in one pass: the jobs do not grow with
    their number.
    """
    batches = unread_batches(catalog)
    if not batches:
        return 0
    if until is not None:
        return load_posts(catalog, new_posts(catalog, batches, until), text_plan)
    plan = planned_loads(catalog, batches, each)
    return load_posts(catalog, new_posts(catalog, batches, loads=plan), text_plan, plan)
