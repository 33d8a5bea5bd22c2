"""Sources, sinks and the star schema, on posts that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclake.functions import keywords, segment, vectorize
from topiclake.operators.keys import assign_keys
from topiclake.operators.labels import star
from topiclake.operators.words import word_counts
from topiclake.plans import bronze, gold, silver
from topiclake.session import new_path, stage
from topiclake.sources import feed, resources
from topiclake.sources.catalog import Catalog, high_water
from topiclake.streaming import landing as streams
from workload import views as v
from workload.registry import registry

Q, SQL, query = registry()

COUNTERS = silver.COUNTERS
_built: dict = {}


def raw(spark, sf_dir):
    """The seven raw columns."""
    return v.posts(spark, sf_dir).select(
        "author", "text", F.col("created_at").cast("timestamp").alias("created_at"), *COUNTERS
    )


def landing(spark, sf_dir) -> str:
    """CSV files of the posts, one dated folder per day of creation."""
    path = new_path(spark, "landing")
    day = F.date_format("created_at", "yyyy-MM-dd")
    feed.write_csv(raw(spark, sf_dir).withColumn("day", day), path, ["day"])
    return path


def lake(spark, sf_dir) -> Catalog:
    """Bronze, silver and gold after one load per day of files, all days in one pass; built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        catalog = Catalog(spark, new_path(spark, "lake"))
        files = landing(spark, sf_dir)
        bronze.load_backlog(catalog, files)
        silver.refresh(catalog, silver.cleaned_words, each=True)
        gold.refresh(catalog)
        _built[key] = catalog
    return _built[key]


def plain_time(df, column="created_at"):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


RAW_SQL = (
    f"WITH {v.POSTS} SELECT author, text, created_at, {', '.join(COUNTERS)} FROM posts"
)


# ------------------------------------------------------------ sources and sinks
@query("s1_flatten_feed", RAW_SQL)
def _(s, d):
    path = new_path(s, "feed")
    rows = raw(s, d)
    post = F.struct(
        F.struct(F.col("author").alias("handle")).alias("author"),
        F.struct("text", F.col("created_at").cast("string").alias("created_at")).alias("record"),
        *COUNTERS,
    )
    rows.select(post.alias("post")).write.json(path)
    return plain_time(feed.flatten_feed(feed.read_feed(s, path)))


@query("s2_s5_csv_round_trip", RAW_SQL)
def _(s, d):
    path = new_path(s, "csv")
    feed.write_csv(raw(s, d), path)
    return plain_time(feed.read_csv(s, path))


@query(
    "s3_posts_per_file_date",
    "SELECT strftime(ts, '%Y-%m-%d') AS file_date, count(*) AS posts "
    "FROM documents JOIN events ON doc_id = event_id GROUP BY ALL",
)
def _(s, d):
    path = landing(s, d)
    dates = feed.input_files(s, path).select("file_date").distinct()
    posts = feed.read_csv(s, path).select(
        F.regexp_extract(F.col("_metadata.file_path"), feed.DATE, 1).alias("file_date")
    )
    return posts.join(dates, "file_date", "left_semi").groupBy("file_date").agg(
        F.count("*").alias("posts")
    )


@query(
    "s4_oldest_batch",
    RAW_SQL + " WHERE CAST(created_at AS DATE) = (SELECT min(CAST(created_at AS DATE)) FROM posts)",
)
def _(s, d):
    files = [r["file"] for r in feed.oldest_files(feed.input_files(s, landing(s, d))).collect()]
    return plain_time(feed.read_csv(s, files))


@query(
    "s6_p1_bronze_days",
    "SELECT CAST(day(ts) AS INT) AS day_collect, count(*) AS posts "
    "FROM documents JOIN events ON doc_id = event_id GROUP BY ALL",
)
def _(s, d):
    posts = lake(s, d).load("bronze", "posts")
    return posts.groupBy("day_collect").agg(F.count("*").alias("posts"))


@query(
    "s7_loaded_dates",
    "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS file_date "
    "FROM documents JOIN events ON doc_id = event_id",
)
def _(s, d):
    return lake(s, d).load("bronze", "files").select("file_date").distinct()


# Silver rows: each day is one load; blank posts are dropped.
STAR = f"""WITH {v.CLEANED}, batch AS (
    SELECT author, date_trunc('minute', created_at) AS created_at, created_at AS raw_ts,
           CAST(created_at AS DATE) AS load_day, post AS yaked, {', '.join(COUNTERS)},
           CAST(day(created_at) AS INT) AS day_collect FROM cleaned),
  kept AS (SELECT * FROM batch WHERE trim(yaked) <> ''),
  tim AS (SELECT CAST(row_number() OVER (ORDER BY created_at) AS BIGINT) AS "SK_time", created_at
          FROM (SELECT DISTINCT created_at FROM kept)),
  aut AS (SELECT CAST(row_number() OVER (ORDER BY first_day, author) AS BIGINT) AS "SK_author",
                 author
          FROM (SELECT author, min(load_day) AS first_day FROM kept GROUP BY author))"""


@query(
    "s8_p2_a1_load_marks",
    STAR
    + """, n AS (SELECT load_day, count(*) AS n FROM kept GROUP BY load_day)
    SELECT max(raw_ts) AS mark, CAST((SELECT sum(n.n) FROM n WHERE n.load_day <= b.load_day)
      AS BIGINT) AS last_post FROM batch b GROUP BY load_day""",
)
def _(s, d):
    return plain_time(lake(s, d).load("silver", "loads"), "mark")


@query(
    "s9_j1_w2_time_dimension",
    STAR
    + """ SELECT "SK_time", created_at, CAST(month(created_at) AS INT) AS "MES",
    CAST(day(created_at) AS INT) AS "DIA", CAST(hour(created_at) AS INT) AS "HORA",
    CAST(minute(created_at) AS INT) AS "MINUTO", dayname(created_at) AS "DIA_SEMANA" FROM tim""",
)
def _(s, d):
    return plain_time(lake(s, d).load("silver", "time"))


@query("j2_a3_w2_author_dimension", STAR + " SELECT * FROM aut")
def _(s, d):
    return lake(s, d).load("silver", "author")


@query(
    "j3_p6_silver_posts",
    STAR
    + f""" SELECT "SK_time", "SK_author", yaked, {', '.join(COUNTERS)}, day_collect
    FROM kept JOIN tim USING (created_at) JOIN aut USING (author)""",
)
def _(s, d):
    return lake(s, d).load("silver", "posts").drop("SK_post", "load")


@query(
    "w2_post_keys_dense",
    STAR
    + """ SELECT CAST(1 AS BIGINT) AS first_key, count(*) AS last_key, count(*) AS posts,
    count(*) AS different FROM kept""",
)
def _(s, d):
    return lake(s, d).load("silver", "posts").agg(
        F.min("SK_post").alias("first_key"), F.max("SK_post").alias("last_key"),
        F.count("*").alias("posts"), F.count_distinct("SK_post").alias("different"),
    )


@query(
    "w2_event_keys",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS key FROM events",
)
def _(s, d):
    rows = v.table(s, d, "events").select("event_id", "ts")
    return assign_keys(rows, "key", 1, ["ts", "event_id"]).select("event_id", "key")


@query(
    "j4_gold_posts_with_minute",
    STAR + ' SELECT created_at, "SK_author", like_count FROM kept JOIN aut USING (author)',
)
def _(s, d):
    c = lake(s, d)
    posts = gold.with_created_at(c.load("gold", "posts"), c.load("gold", "time"))
    return plain_time(posts.select("created_at", "SK_author", "like_count"))


@query(
    "j5_star_join",
    STAR
    + """ SELECT author, CAST(day(created_at) AS INT) AS "DIA",
    CAST(hour(created_at) AS INT) AS "HORA", count(*) AS posts,
    CAST(sum(like_count) AS BIGINT) AS likes FROM kept GROUP BY ALL""",
)
def _(s, d):
    c = lake(s, d)
    joined = star(*(c.load("silver", t) for t in ("posts", "author", "time")))
    return joined.groupBy("author", "DIA", "HORA").agg(
        F.count("*").alias("posts"), F.sum("like_count").alias("likes")
    )


@query(
    "j9_gold_with_words",
    STAR + " SELECT yaked, like_count, CAST(384 AS INT) AS width FROM kept",
)
def _(s, d):
    c = lake(s, d)
    posts = c.load("gold", "posts").join(c.load("silver", "posts").select("SK_post", "yaked"), "SK_post")
    return posts.select("yaked", "like_count", F.size("embedding").alias("width"))


@query(
    "s10_s11_catalog_counts",
    STAR
    + """, n AS (SELECT 'posts' AS tab, count(*) AS n FROM kept
      UNION ALL SELECT 'author', count(*) FROM aut UNION ALL SELECT 'time', count(*) FROM tim)
    SELECT layer, tab, n AS row_count FROM n, (VALUES ('silver'), ('gold')) AS l(layer)""",
)
def _(s, d):
    c = lake(s, d)
    out = None
    for layer in ("silver", "gold"):
        for t in ("posts", "author", "time"):
            n = c.load(layer, t).agg(F.count("*").alias("row_count")).select(
                F.lit(layer).alias("layer"), F.lit(t).alias("tab"), "row_count"
            )
            out = n if out is None else out.unionByName(n)
    return out


@query(
    "s8_missing_table",
    "SELECT CAST(0 AS BIGINT) AS row_count, min(date_trunc('day', ts)) - INTERVAL 1 SECOND AS mark "
    "FROM events",
)
def _(s, d):
    none = Catalog(s, new_path(s, "nothing")).load("silver", "loads")
    assert high_water(none, "mark") is None
    first = v.table(s, d, "events").agg(
        (F.date_trunc("day", F.min("ts")) - F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz")
        .alias("mark")
    )
    rows = none.agg(F.count("*").alias("row_count")).scalar()
    return first.select(rows.alias("row_count"), "mark")


@query(
    "a2_p4_distinct_posts",
    f"""WITH {v.POSTS} SELECT author, text, created_at, like_count + 2 AS like_count,
    repost_count, quote_count, reply_count FROM posts""",
)
def _(s, d):
    rows = raw(s, d)
    copies = None
    for more in (0, 2, 1):
        again = rows.withColumn("like_count", F.col("like_count") + more)
        copies = again if copies is None else copies.unionByName(again)
    nothing = rows.withColumn("text", F.lit(None).cast("string"))
    posts = silver.distinct_posts(copies.unionByName(nothing).dropna(subset=["text"]))
    return plain_time(posts)


@query(
    "p7_renamed_columns",
    f'WITH {v.POSTS} SELECT "SK_post", author AS handle, like_count AS likes FROM posts',
)
def _(s, d):
    rows = v.posts(s, d).drop("text", "created_at")
    return rows.withColumnsRenamed({"author": "handle", "like_count": "likes"}).drop(
        "repost_count", "quote_count", "reply_count"
    )


STOPS = f"""WITH {v.POSTS}, w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM posts),
  f AS (SELECT word FROM w WHERE regexp_full_match(word, '[a-z]+') GROUP BY word
        HAVING count(*) >= 50),
  p AS (SELECT word FROM f UNION ALL SELECT word || '''s' FROM f)
  SELECT word FROM p UNION SELECT replace(word, '''', '') FROM p
  UNION SELECT upper(word) FROM f"""


@query("s12_u5_stop_words", STOPS)
def _(s, d):
    from topiclake.operators.words import word_counts

    texts = v.posts(s, d).select(F.lower("text").alias("t"))
    often = word_counts(texts, "t").filter(F.col("word").rlike("^[a-z]+$") & (F.col("n") >= 50))
    lists, extra = new_path(s, "stops"), new_path(s, "stops")
    plain = often.select("word").unionByName(
        often.select(F.concat("word", F.lit("'s")).alias("word"))
    )
    plain.agg(F.to_json(F.collect_list("word")).alias("value")).write.text(lists)
    often.agg(
        F.collect_list(F.upper("word")).alias("extra_stopwords"),
        F.collect_list("word").alias("internet_stopwords"),
    ).write.json(extra)
    return resources.load_stopwords(s, lists, extra)


@query(
    "s13_s14_label_file",
    f"""WITH {v.LABELLED} SELECT "SK_post", post, labels FROM labelled WHERE post <> ''""",
)
def _(s, d):
    path = new_path(s, "labels")
    rows = v.labelled(s, d).filter("post <> ''").withColumnRenamed("post", "yaked")
    resources.write_labels(rows, path)
    return resources.read_labels(s, path)


RUNS = """SELECT upper(event_type) || '-' || user_id AS "Name", round(avg(value), 6) AS
    silhouette_avg, round(min(value), 6) AS calinski_harabasz, round(max(value), 6) AS
    davies_bouldin FROM events GROUP BY event_type, user_id"""


@query(
    "u1_x8_w3_f23_layer_table",
    f"""WITH r AS ({RUNS}) SELECT silhouette_avg, calinski_harabasz, davies_bouldin,
    split_part("Name", '-', 1) AS "Model",
    CAST(row_number() OVER (PARTITION BY split_part("Name", '-', 1)
         ORDER BY CAST(split_part("Name", '-', 2) AS INT)) AS INT) AS "Layer" FROM r""",
)
def _(s, d):
    runs = v.table(s, d, "events").groupBy(
        F.concat_ws("-", F.upper("event_type"), "user_id").alias("Name")
    ).agg(
        F.round(F.avg("value"), 6).alias("silhouette_avg"),
        F.round(F.min("value"), 6).alias("calinski_harabasz"),
        F.round(F.max("value"), 6).alias("davies_bouldin"),
    )
    tables = []
    for part in (F.col("Name").startswith("C"), ~F.col("Name").startswith("C")):
        path = new_path(s, "runs")
        resources.write_run_metrics(runs.filter(part), path)
        tables.append(resources.read_run_metrics(s, path))
    return resources.layer_table(tables)


# ------------------------------------------------------------ keywords, segmentation, vectors
TERM_SQL = f"""WITH {v.CLEANED}, d AS (SELECT "SK_post", string_split(trim(post), ' ') AS t
      FROM cleaned WHERE trim(post) <> ''),
  o AS (SELECT "SK_post", unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
  e AS (SELECT "SK_post", term, pos,
          lag(term, 1) OVER w AS l1, lag(term, 2) OVER w AS l2,
          lead(term, 1) OVER w AS r1, lead(term, 2) OVER w AS r2
        FROM o WINDOW w AS (PARTITION BY "SK_post" ORDER BY pos)),
  n AS (SELECT "SK_post", term, pos, unnest([l1, l2]) AS lw, unnest([r1, r2]) AS rw FROM e),
  g AS (SELECT "SK_post", term, count(DISTINCT pos) AS tf,
          count(DISTINCT lw) AS dl, count(lw) AS nl, count(DISTINCT rw) AS dr, count(rw) AS nr
        FROM n GROUP BY ALL),
  s AS (SELECT *, max(tf) OVER p AS mx, avg(tf) FILTER (length(term) >= 3) OVER p AS av,
          stddev_pop(tf) FILTER (length(term) >= 3) OVER p AS sd
        FROM g WINDOW p AS (PARTITION BY "SK_post")),
  r AS (SELECT "SK_post", term, tf, tf / (av + sd) AS fr,
          0.5 + coalesce(dl / nullif(nl, 0), 0) * (tf / mx)
          + 0.5 + coalesce(dr / nullif(nr, 0), 0) * (tf / mx) AS rel
        FROM s WHERE length(term) >= 3),
  scored AS (SELECT "SK_post", term, CAST(tf AS INT) AS tf,
          ln(ln(3.0)) * rel / (fr / rel + 1 / rel) AS score FROM r)"""


@query(
    "x3_term_scores",
    TERM_SQL + ' SELECT "SK_post", term, tf, round(score, 9) AS score FROM scored',
)
def _(s, d):
    scores = keywords.term_scores(v.cleaned(s, d), "SK_post", "post")
    return scores.select("SK_post", "term", "tf", F.round("score", 9).alias("score"))


CANDIDATES = TERM_SQL + """,
  m AS (SELECT e."SK_post", e.pos, e.term, c.score FROM e JOIN scored c USING ("SK_post", term)),
  c1 AS (SELECT "SK_post", pos, term AS keyword, score AS prod, score AS total FROM m),
  c2 AS (SELECT a."SK_post", a.pos, a.keyword || ' ' || b.term AS keyword, a.prod * b.score AS prod,
           a.total + b.score AS total
         FROM c1 a JOIN m b ON a."SK_post" = b."SK_post" AND b.pos = a.pos + 1),
  c3 AS (SELECT a."SK_post", a.pos, a.keyword || ' ' || b.term AS keyword, a.prod * b.score AS prod,
           a.total + b.score AS total
         FROM c2 a JOIN m b ON a."SK_post" = b."SK_post" AND b.pos = a.pos + 2),
  k AS (SELECT "SK_post", keyword, any_value(prod) / ((any_value(total) + 1) * count(*)) AS score,
          CAST(min(pos) AS INT) AS first
        FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3) GROUP BY ALL)"""


@query(
    "x3_x4_keyword_candidates",
    CANDIDATES + ' SELECT "SK_post", keyword, round(score, 9) AS score, first FROM k '
    "WHERE score < 0.05",
)
def _(s, d):
    found = keywords.keyword_candidates(v.cleaned(s, d), "SK_post", "post")
    return found.filter("score < 0.05").select(
        "SK_post", "keyword", F.round("score", 9).alias("score"), "first"
    )


@query(
    "x3_x5_keywords",
    CANDIDATES
    + """, l AS (SELECT "SK_post", list([keyword] ORDER BY round(score, 12), first, keyword) AS k
      FROM k WHERE score < 0.05 GROUP BY "SK_post"),
  t AS (SELECT "SK_post", list_reduce(k, lambda acc, x: CASE WHEN len(acc) < 15 AND
      len(list_filter(acc, lambda y: 1 - levenshtein(y, x[1]) / greatest(length(y), length(x[1]))
          > 0.85)) = 0 THEN list_concat(acc, x) ELSE acc END, CAST([] AS VARCHAR[])) AS taken FROM l),
  u AS (SELECT "SK_post", string_split(array_to_string(taken, ' '), ' ') AS w FROM t)
  SELECT "SK_post", array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')
    AS yaked FROM u""",
)
def _(s, d):
    return keywords.extract_keywords(v.cleaned(s, d), "SK_post", "post")


# Each different word is divided end by end; the cheapest cut of an end is the first of equal ones.
SEGMENTED = f"""WITH RECURSIVE {v.CLEANED},
  tok AS (SELECT "SK_post", unnest(string_split(post, ' ')) AS word,
      unnest(range(len(string_split(post, ' ')))) AS pos FROM cleaned),
  voc AS (SELECT word, count(*) AS n FROM tok WHERE word <> '' GROUP BY word HAVING count(*) >= 2),
  cost AS MATERIALIZED (SELECT word, ln(row_number() OVER (ORDER BY n DESC, word)
      * ln(greatest((SELECT count(*) FROM voc), 3))) AS cost FROM voc),
  w AS MATERIALIZED (SELECT DISTINCT word FROM tok WHERE word <> ''),
  s AS (SELECT word, unnest(range(length(word))) AS start FROM w),
  p AS (SELECT word, start, unnest(range(1, least((SELECT max(length(word)) FROM voc),
      length(word) - start) + 1)) AS size FROM s),
  k AS MATERIALIZED (SELECT p.word, start + size AS fin, list({{'s': start, 'c': cost}} ORDER BY start) AS k
    FROM p JOIN cost c ON c.word = substring(p.word, start + 1, size) GROUP BY ALL),
  best(word, fin, cheapest, cut) AS (
    SELECT word, 0::BIGINT, [0::DOUBLE], [0::BIGINT] FROM w
    UNION ALL
    SELECT word, fin + 1, list_append(cheapest, m),
      list_append(cut, CASE WHEN m = 'inf' THEN 0 ELSE k[list_position(sums, m)].s END)
    FROM (SELECT *, coalesce(list_min(sums), 'inf'::DOUBLE) AS m FROM (
      SELECT b.*, k.k, list_transform(k.k, lambda x: b.cheapest[x.s + 1] + x.c) AS sums
      FROM best b LEFT JOIN k ON k.word = b.word AND k.fin = b.fin + 1 WHERE b.fin < length(b.word)))),
  back(word, cut, fin, divided) AS (
    SELECT word, cut, fin, '' FROM best WHERE fin = length(word) AND cheapest[fin + 1] < 'inf'
    UNION ALL
    SELECT word, cut, cut[fin + 1], substring(word, cut[fin + 1] + 1, fin - cut[fin + 1]) || ' ' || divided
    FROM back WHERE fin > 0),
  new AS (SELECT word, trim(divided) AS divided FROM back WHERE fin = 0),
  texts AS (SELECT "SK_post", string_agg(coalesce(divided, tok.word), ' ' ORDER BY pos) AS post
    FROM tok LEFT JOIN new USING (word) GROUP BY "SK_post")
  SELECT c."SK_post", t.post FROM cleaned c LEFT JOIN texts t USING ("SK_post")"""


@query("x2_segmented_words", SEGMENTED)
def _(s, d):
    rows = v.cleaned(s, d, written=True).select("SK_post", "post")
    counts = stage(word_counts(rows, "post"), "counts")
    return segment.segment_words(rows, "post", segment.frequent(counts), counts)


@query(
    "x2_vocabulary",
    f"""WITH {v.CLEANED}, w AS (SELECT unnest(string_split(post, ' ')) AS word FROM cleaned)
    SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word HAVING count(*) >= 2""",
)
def _(s, d):
    return segment.learn_vocabulary(v.cleaned(s, d), "post")


@query("x1_x5_keyword_words")
def _(s, d):
    return silver.keyword_words(v.posts(s, d).select("SK_post", "text"), "SK_post")


@query("f1_m3_vectors")
def _(s, d):
    rows = v.cleaned(s, d, written=True).select("SK_post", "post")
    return vectorize.vectorize(rows, "post", idf=vectorize.fit_idf(rows, "post")).drop("post")


# ------------------------------------------------------------ streams
@query(
    "r1_stream_to_bronze",
    f"WITH {v.POSTS} SELECT CAST(day(created_at) AS INT) AS day_collect, author, like_count "
    "FROM posts",
)
def _(s, d):
    c = Catalog(s, new_path(s, "lake"))
    streams.start_bronze(c, landing(s, d), new_path(s, "progress"), once=False).awaitTermination()
    return c.load("bronze", "posts").select("day_collect", "author", "like_count")


# The second copy of a post has one like less, as many, or one more.
RECOLLECTED = "greatest(like_count, like_count + like_count % 3 - 1)"


def landed_twice(s, d, silver_too=False):
    """A lake whose posts were landed by two runs of the stream, with other likes in the second."""
    path, out = new_path(s, "landing"), Catalog(s, new_path(s, "lake"))
    marks = new_path(s, "progress"), new_path(s, "progress")
    second = raw(s, d).withColumn("like_count", F.expr("like_count + like_count % 3 - 1"))
    for name, rows in (("first", raw(s, d)), ("second", second)):
        feed.write_csv(rows, f"{path}/{name}")
        streams.start_bronze(out, path, marks[0]).awaitTermination()
        if silver_too:
            streams.start_silver(out, marks[1], silver.cleaned_words).awaitTermination()
    return out


@query(
    "r3_stream_recollected",
    f"""WITH {v.POSTS} SELECT author, text, created_at, CAST({RECOLLECTED} AS INT) AS like_count, repost_count,
    quote_count, reply_count FROM posts""",
)
def _(s, d):
    out = landed_twice(s, d)
    return plain_time(silver.distinct_posts(bronze.posts(out).drop("source_file", "day_collect", "batch")))


@query(
    "r3_stream_counters_in_silver",
    STAR
    + f""" SELECT author, created_at, yaked, CAST({RECOLLECTED} AS INT) AS like_count, repost_count,
    quote_count, reply_count FROM kept""",
)
def _(s, d):
    c = landed_twice(s, d, silver_too=True)
    joined = star(*(c.load("silver", t) for t in ("posts", "author", "time")))
    return plain_time(joined.select("author", "created_at", "yaked", *COUNTERS))


@query(
    "r2_r4_stream_to_silver",
    STAR
    + f""" SELECT author, created_at, yaked, {', '.join(COUNTERS)}, day_collect FROM kept""",
)
def _(s, d):
    c = Catalog(s, new_path(s, "lake"))
    streams.start_bronze(c, landing(s, d), new_path(s, "progress"), once=False).awaitTermination()
    streams.start_silver(c, new_path(s, "progress"), silver.cleaned_words).awaitTermination()
    joined = star(*(c.load("silver", t) for t in ("posts", "author", "time")))
    return plain_time(
        joined.select("author", "created_at", "yaked", *COUNTERS, "day_collect")
    )
