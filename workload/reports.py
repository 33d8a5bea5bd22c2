"""Reports on words, time, authors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclake.functions.calendar import calendar_parts, to_minute
from topiclake.functions.clean import clean_text
from topiclake.functions.words import first_part, is_ascii_alnum, tokens
from topiclake.operators import authors, interactions, labels, temporal, words
from topiclake.plans import silver
from topiclake.session import stage
from workload import views as v
from workload.registry import registry

MIN_FREQ = 150

Q, SQL, query = registry()

W = "unnest(string_split(post, ' '))"


# ------------------------------------------------------------ text
@query(
    "c1_c14_clean_text",
    f'SELECT doc_id, {v.sql_clean("text")} AS cleaned FROM documents',
)
def _(s, d):
    docs = v.spread(v.table(s, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", clean_text("text").alias("cleaned"))


@query(
    "x1_remove_stop_words",
    f'WITH c AS MATERIALIZED (SELECT doc_id, {v.sql_clean("text")} AS c FROM documents) '
    f'SELECT doc_id, {v.sql_drop_words("c")} AS stopped FROM c',
)
def _(s, d):
    docs = v.spread(v.table(s, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", v.words_of("text").alias("stopped"))


@query(
    "p13_plain_ascii_words",
    """SELECT word, regexp_full_match(word, '[A-Za-z0-9]*') AS plain, count(*) AS n
       FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL""",
)
def _(s, d):
    counts = words.word_counts(v.spread(v.table(s, d, "documents")), "text")
    return counts.select("word", is_ascii_alnum("word").alias("plain"), "n")


@query(
    "x6_tokens",
    f'WITH {v.CLEANED} SELECT "SK_post", CAST(len(string_split(post, \' \')) AS INT) AS n_tokens, '
    "string_split(post, ' ')[1] AS head FROM cleaned",
)
def _(s, d):
    t = v.cleaned(s, d).select("SK_post", tokens("post").alias("t"))
    return t.select("SK_post", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("head"))


@query(
    "x7_x8_name_parts",
    """SELECT event_id, split_part('u' || user_id || '.example.social', '.', 1) AS author,
              split_part(upper(event_type) || '-run-' || event_id, '-', 1) AS model FROM events""",
)
def _(s, d):
    e = v.table(s, d, "events")
    handle = F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.social"))
    run = F.concat(F.upper("event_type"), F.lit("-run-"), F.col("event_id"))
    return e.select(
        "event_id", first_part(handle).alias("author"),
        F.split_part(run, F.lit("-"), F.lit(1)).alias("model"),
    )


# ------------------------------------------------------------ words
@query(
    "a4_word_counts",
    f"WITH {v.CLEANED}, w AS (SELECT {W} AS word FROM cleaned) "
    "SELECT word, count(*) AS n FROM w GROUP BY word",
)
def _(s, d):
    return words.word_counts(v.cleaned(s, d), "post")


@query(
    "t1_top_20_words",
    f"WITH {v.CLEANED}, w AS (SELECT {W} AS word FROM cleaned) "
    "SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20",
)
def top_20_words(s, d):
    return words.top_words(v.cleaned(s, d), "post", 20)


@query(
    "x11_m5_word_weights",
    f"WITH {v.CLEANED}, w AS (SELECT {W} AS word FROM cleaned), "
    "c AS (SELECT word, count(*) AS n FROM w GROUP BY word) "
    "SELECT word, n, round(n / (SELECT max(n) FROM c), 9) AS weight FROM c",
)
def _(s, d):
    weights = words.word_weights(v.cleaned(s, d, written=True), "post")
    return weights.withColumn("weight", F.round("weight", 9))


@query(
    "p12_frequent_words",
    f"WITH {v.CLEANED}, w AS (SELECT {W} AS word FROM cleaned) "
    f"SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= {MIN_FREQ}",
)
def _(s, d):
    return words.frequent_words(v.cleaned(s, d), "post", MIN_FREQ)


@query(
    "a9_vocabulary_coverage",
    f"""WITH {v.CLEANED}, w AS (SELECT "SK_post", {W} AS word FROM cleaned),
    c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
    t AS (SELECT count(*) FILTER (n >= {MIN_FREQ}) AS f, count(*) AS voc,
                 CAST(sum(n) AS BIGINT) AS tok,
                 CAST(sum(n) FILTER (n >= {MIN_FREQ}) AS BIGINT) AS ftok FROM c)
    SELECT f AS frequent_words, tok - f AS other_tokens, round(f / voc, 9) AS vocab_share,
           round(ftok / tok, 9) AS token_coverage,
           round((SELECT count(DISTINCT "SK_post") FROM w
                  WHERE word IN (SELECT word FROM c WHERE n >= {MIN_FREQ}))
                 / (SELECT count(*) FROM cleaned), 9) AS post_coverage
    FROM t""",
)
def _(s, d):
    c = words.vocab_coverage(v.cleaned(s, d, written=True), "SK_post", "post", MIN_FREQ)
    return c.select(
        "frequent_words", "other_tokens",
        *[F.round(x, 9).alias(x) for x in ("vocab_share", "token_coverage", "post_coverage")],
    )


PAIRS = f"""WITH {v.CLEANED}, t AS (SELECT string_split(post, ' ') AS t FROM cleaned),
    w AS (SELECT unnest(t) AS word FROM t),
    f AS (SELECT word FROM w GROUP BY word HAVING count(*) >= {MIN_FREQ}),
    p AS (SELECT unnest(list_zip(t[:-2], t[2:])) AS p FROM t WHERE len(t) > 1),
    q AS (SELECT p[1] AS a, p[2] AS b FROM p)"""


@query(
    "w1_cooccurrence",
    PAIRS
    + """ SELECT least(a, b) AS w1, greatest(a, b) AS w2, count(*) AS weight FROM q
    WHERE a <> b AND a IN (FROM f) AND b IN (FROM f) GROUP BY ALL""",
)
def _(s, d):
    return words.cooccurrence(v.cleaned(s, d, written=True), "post", MIN_FREQ)


@query(
    "w1_cooccurrence_directed",
    PAIRS
    + """ SELECT a AS w1, b AS w2, count(*) AS weight FROM q
    WHERE a <> b AND a IN (FROM f) AND b IN (FROM f) GROUP BY ALL""",
)
def _(s, d):
    return words.cooccurrence(v.cleaned(s, d, written=True), "post", MIN_FREQ, directed=True)


TOP_WORDS = f"""WITH {v.LABELLED}, w AS (SELECT labels, {W} AS word FROM labelled),
    c AS (SELECT labels, word, count(*) AS n FROM w GROUP BY ALL),
    top AS (SELECT labels, word, n, CAST(row_number() OVER (PARTITION BY labels
                ORDER BY n DESC, word) AS INT) AS rank FROM c QUALIFY rank <= 5)"""


@query("t2_top_words_per_cluster", TOP_WORDS + " SELECT * FROM top")
def _(s, d):
    return words.top_words_per_cluster(v.labelled(s, d), "labels", "post", 5)


@query(
    "a10_topic_coverage",
    TOP_WORDS
    + """ SELECT labels, CAST(sum(t.n) AS BIGINT) AS covered,
      CAST((SELECT sum(c.n) FROM c WHERE c.labels = t.labels) - sum(t.n) AS BIGINT) AS other
    FROM top t GROUP BY labels""",
)
def _(s, d):
    return words.topic_coverage(v.labelled(s, d, written=True), "labels", "post", 5)


def _medians(names):
    return ", ".join(f"median({n}) AS {n.replace('count', 'median')}" for n in names)


@query(
    "a11_x9_topic_interactions",
    TOP_WORDS
    + f""" SELECT labels, word, count(*) AS posts, {_medians(words.COUNTERS)}
    FROM labelled l JOIN top t USING (labels)
    WHERE list_contains(string_split(l.post, ' '), t.word) GROUP BY labels, word""",
)
def _(s, d):
    return words.topic_interactions(v.labelled(s, d, written=True), "labels", "post", 5)


GROUPS = ["passive_count", "active_count"]


@query(
    "a23_topic_interaction_groups",
    TOP_WORDS
    + f""" SELECT labels, word, count(*) AS posts, {_medians(GROUPS)}
    FROM (SELECT *, like_count + repost_count AS passive_count,
                 quote_count + reply_count AS active_count FROM labelled) l
    JOIN top t USING (labels)
    WHERE list_contains(string_split(l.post, ' '), t.word) GROUP BY labels, word""",
)
def _(s, d):
    rows = interactions.with_interaction_groups(v.labelled(s, d, written=True))
    return words.topic_interactions(rows, "labels", "post", 5, GROUPS)


@query(
    "x9_posts_with_word",
    f"WITH {v.CLEANED} SELECT \"SK_post\", "
    "CAST(list_contains(string_split(post, ' '), 'thonsh') AS INT) AS has_word FROM cleaned",
)
def _(s, d):
    return words.posts_with_word(v.cleaned(s, d), "post", "thonsh").select("SK_post", "has_word")


VOCAB = f"""WITH {v.LABELLED},
    voc AS (SELECT DISTINCT labels, word FROM (SELECT labels, {W} AS word FROM labelled)),
    sz AS (SELECT labels, count(*) AS size FROM voc GROUP BY labels),
    j AS (SELECT x.labels AS a, y.labels AS b, count(*) AS "both" FROM voc x JOIN voc y
          ON x.word = y.word AND x.labels < y.labels GROUP BY ALL),
    r AS (SELECT a, b, "both", p.size + q.size - "both" AS either,
                 "both" / (p.size + q.size - "both") AS jaccard
          FROM j JOIN sz p ON p.labels = a JOIN sz q ON q.labels = b)"""


@query(
    "u3_a18_vocabulary_jaccard",
    VOCAB + ' SELECT a, b, "both", either, round(jaccard, 9) AS jaccard FROM r',
)
def _(s, d):
    pairs = words.vocabulary_jaccard(v.labelled(s, d, written=True), "labels", "post")
    return pairs.withColumn("jaccard", F.round("jaccard", 9))


@query(
    "f20_m4_mean_jaccard",
    VOCAB
    + """ SELECT round(sum(jaccard) / ((SELECT count(*) FROM sz) *
      ((SELECT count(*) FROM sz) - 1) / 2), 9) AS jaccard_mean FROM r""",
)
def _(s, d):
    mean = words.mean_jaccard(v.labelled(s, d, written=True), "labels", "post")
    return mean.select(F.round("jaccard_mean", 9).alias("jaccard_mean"))


@query("a18_vocabulary_sizes", VOCAB + " SELECT labels, size AS words FROM sz")
def _(s, d):
    return words.vocabulary_sizes(v.labelled(s, d), "labels", "post")


# ------------------------------------------------------------ time
PARTS = """CAST(month(ts) AS INT) AS "MES", CAST(day(ts) AS INT) AS "DIA",
    CAST(hour(ts) AS INT) AS "HORA", CAST(minute(ts) AS INT) AS "MINUTO",
    dayname(ts) AS "DIA_SEMANA" """


@query(
    "d1_d2_p5_calendar_parts",
    f"SELECT event_id, date_trunc('minute', ts) AS created_at, {PARTS} FROM events",
)
def _(s, d):
    return v.table(s, d, "events").select(
        "event_id", to_minute("ts").cast("timestamp_ntz").alias("created_at"), *calendar_parts("ts")
    )


@query(
    "d3_p3_first_mark",
    "SELECT date_trunc('day', min(ts)) - INTERVAL 1 SECOND AS mark FROM events",
)
def _(s, d):
    first = F.date_trunc("day", F.min("ts")) - F.expr("INTERVAL 1 SECOND")
    return v.table(s, d, "events").agg(first.cast("timestamp_ntz").alias("mark"))


@query(
    "p1_day_collect",
    'SELECT event_id AS "SK_post", CAST(day(ts) AS INT) AS day_collect FROM events',
)
def _(s, d):
    e = v.event_posts(s, d)
    return e.select("SK_post", F.dayofmonth("created_at").alias("day_collect"))


@query(
    "p14_collection_window",
    """SELECT event_id AS "SK_post", ts AS created_at FROM events
       WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59'""",
)
def _(s, d):
    return labels.in_window(v.event_posts(s, d), "2024-01-15 00:00:00", "2024-01-30 23:59:59")


@query(
    "a5_j10_posts_per_day",
    'SELECT CAST(ts AS DATE) AS "DATA", CAST(day(ts) AS INT) AS "DIA", dayname(ts) AS "DIA_SEMANA", '
    "count(*) AS posts "
    "FROM events GROUP BY ALL",
)
def _(s, d):
    return temporal.posts_per_day(v.event_posts(s, d), "created_at")


@query(
    "a6_posts_per_day_hour",
    'SELECT CAST(ts AS DATE) AS "DATA", CAST(day(ts) AS INT) AS "DIA", '
    'CAST(hour(ts) AS INT) AS "HORA", count(*) AS posts '
    "FROM events GROUP BY ALL",
)
def _(s, d):
    return temporal.posts_per_day_and_hour(v.event_posts(s, d), "created_at")


INTERVAL = """count(*) AS groups, round(avg(posts), 6) AS mean_posts,
    round(avg(posts) - 1.96 * stddev_samp(posts) / sqrt(count(*)), 6) AS low,
    round(avg(posts) + 1.96 * stddev_samp(posts) / sqrt(count(*)), 6) AS high"""


def _rounded(df, cols=("mean_posts", "low", "high")):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "a7_t7_weekday_means",
    f"""WITH t AS (SELECT CAST(ts AS DATE) AS dd, CAST(isodow(ts) - 1 AS INT) AS weekday,
                   dayname(ts) AS "DIA_SEMANA", count(*) AS posts FROM events GROUP BY ALL)
    SELECT weekday, "DIA_SEMANA", {INTERVAL} FROM t GROUP BY ALL ORDER BY weekday""",
)
def _(s, d):
    return _rounded(temporal.weekday_means(v.event_posts(s, d), "created_at"))


@query(
    "a8_hour_means",
    f"""WITH t AS (SELECT CAST(ts AS DATE) AS dd, CAST(hour(ts) AS INT) AS "HORA", count(*) AS posts
                   FROM events GROUP BY ALL)
    SELECT "HORA", {INTERVAL} FROM t GROUP BY ALL""",
)
def _(s, d):
    return _rounded(temporal.hour_means(v.event_posts(s, d), "created_at"))


def _bootstrap_sql(by: str) -> str:
    """Poisson weights by MD5 of seed, date and replicate; percentiles of the weighted means."""
    weight = " + ".join(f"(u >= {p!r})::INT" for p in temporal.POISSON)
    return f"""WITH t AS (SELECT CAST(ts AS DATE) AS dd, {by} AS part, count(*) AS posts FROM events GROUP BY ALL),
    r AS (SELECT dd, i, {weight} AS w FROM (SELECT dd, i,
        ('0x' || substr(md5('0:' || dd || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
        FROM (SELECT DISTINCT dd FROM t), range(1, {temporal.REPLICATES + 1}) x(i))),
    b AS (SELECT part, i, sum(w * posts) / nullif(sum(w), 0) AS m FROM t JOIN r USING (dd) GROUP BY ALL),
    q AS (SELECT part, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM b GROUP BY part)
    SELECT part, round(avg(posts), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
    FROM t JOIN q USING (part) GROUP BY part"""


@query("a7_weekday_bootstrap", _bootstrap_sql("CAST(isodow(ts) - 1 AS INT)"))
def _(s, d):
    posts = v.event_posts(s, d)
    daily = posts.groupBy(
        F.to_date("created_at").alias("DATA"), F.weekday("created_at").alias("part")
    ).agg(F.count("*").alias("posts"))
    return _rounded(temporal.bootstrap_interval(daily, ["part"], "DATA", "posts"), ("mean", "low", "high"))


@query("a8_hour_bootstrap", _bootstrap_sql("CAST(hour(ts) AS INT)"))
def _(s, d):
    hourly = temporal.posts_per_day_and_hour(v.event_posts(s, d), "created_at")
    means = temporal.bootstrap_interval(hourly.withColumn("part", F.col("HORA")), ["part"], "DATA", "posts")
    return _rounded(means, ("mean", "low", "high"))


def _star(s, d):
    """Labelled posts with surrogate keys, joined with the author and time dimensions."""
    rows = labels.clustered(v.labelled(s, d, text=False))
    rows = rows.withColumn("created_at", to_minute(F.col("created_at").cast("timestamp")))
    none = s.createDataFrame([], "created_at timestamp, author string")
    time = stage(silver.new_times(rows.select("created_at"), none, 1), "time")
    author = stage(silver.new_authors(rows.select("author"), none, 1), "author")
    facts = silver.with_keys(rows, time, author, nulls=True).drop("created_at", "author")
    return labels.star(facts, author, time)


@query(
    "a12_j8_hourly_medians",
    f"""WITH {v.LABELLED_ROWS} SELECT labels, CAST(hour(created_at) AS INT) AS "HORA",
    {_medians(words.COUNTERS)} FROM labelled WHERE labels <> -1 GROUP BY ALL""",
)
def _(s, d):
    return temporal.hourly_medians(_star(s, d), "labels", "HORA")


# ------------------------------------------------------------ authors
AUTHORS = f"""WITH {v.LABELLED_ROWS}, a AS (SELECT * EXCLUDE (author),
    split_part(author, '.', 1) AS author FROM labelled WHERE labels <> -1)"""


def _by_author(s, d, text=False, written=False):
    return authors.with_short_author(labels.clustered(v.labelled(s, d, text, written)))


@query(
    "a13_a14_author_activity",
    AUTHORS
    + """ SELECT labels, author, count(*) AS posts, round(avg(like_count), 6) AS mean_likes
    FROM a GROUP BY ALL""",
)
def _(s, d):
    activity = authors.author_activity(_by_author(s, d), "labels")
    return activity.withColumn("mean_likes", F.round("mean_likes", 6))


@query(
    "j7_author_dimension",
    AUTHORS + " SELECT labels, author, count(*) AS posts FROM a GROUP BY ALL",
)
def _(s, d):
    joined = authors.with_short_author(_star(s, d))
    return joined.groupBy("labels", "author").agg(F.count("*").alias("posts"))


@query(
    "t3_top_authors",
    AUTHORS
    + """ SELECT labels, author, count(*) AS posts, CAST(row_number() OVER (PARTITION BY labels
      ORDER BY count(*) DESC, author) AS INT) AS rank FROM a GROUP BY labels, author
      QUALIFY rank <= 10""",
)
def _(s, d):
    return authors.top_authors(_by_author(s, d), "labels")


TOP_LIKED = """top AS (SELECT labels, author, avg(like_count) AS mean_likes,
      CAST(row_number() OVER (PARTITION BY labels ORDER BY avg(like_count) DESC, author) AS INT)
      AS rank FROM a GROUP BY labels, author QUALIFY rank <= 5)"""


@query(
    "t4_top_authors_by_likes",
    AUTHORS
    + f""", {TOP_LIKED} SELECT labels, author, round(mean_likes, 6) AS mean_likes, rank
    FROM top""",
)
def _(s, d):
    top = authors.top_authors_by_likes(_by_author(s, d), "labels")
    return top.withColumn("mean_likes", F.round("mean_likes", 6))


AUTHORS_TEXT = f"""WITH {v.LABELLED}, a AS (SELECT * EXCLUDE (author),
    split_part(author, '.', 1) AS author FROM labelled WHERE labels <> -1), {TOP_LIKED}"""


@query(
    "a15_top_author_posts",
    AUTHORS_TEXT
    + """ SELECT labels, rank, author, "SK_post", post FROM a JOIN top USING (labels, author)""",
)
def _(s, d):
    return authors.top_author_posts(_by_author(s, d, True, True), "SK_post", "labels", "post")


@query(
    "a15_x11_top_author_words",
    AUTHORS_TEXT
    + f""", w AS (SELECT labels, author, {W} AS word FROM a SEMI JOIN top USING (labels, author)),
    c AS (SELECT labels, author, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT *, round(n / max(n) OVER (PARTITION BY labels, author), 9) AS weight FROM c""",
)
def _(s, d):
    out = authors.top_author_words(_by_author(s, d, True, True), "labels", "post")
    return out.withColumn("weight", F.round("weight", 9))


@query(
    "a20_author_overlap",
    AUTHORS
    + """, s AS (SELECT author, bool_or(labels = 0) AS x, bool_or(labels = 1) AS y FROM a
      GROUP BY author)
    SELECT count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b,
           count(*) FILTER (x AND y) AS "both" FROM s""",
)
def _(s, d):
    return authors.author_overlap(_by_author(s, d), "labels")


@query(
    "u2_shared_authors",
    AUTHORS
    + " SELECT author FROM a WHERE labels = 0 INTERSECT SELECT author FROM a WHERE labels = 1",
)
def _(s, d):
    return authors.shared_authors(_by_author(s, d), "labels")


@query(
    "u2_exclusive_authors",
    AUTHORS
    + " SELECT author FROM a WHERE labels = 1 EXCEPT SELECT author FROM a WHERE labels = 0",
)
def _(s, d):
    return authors.exclusive_authors(_by_author(s, d), "labels", a=1, b=0)


@query(
    "a21_cluster_sizes",
    f"WITH {v.LABELLED_ROWS} SELECT labels, count(*) AS posts FROM labelled GROUP BY labels",
)
def _(s, d):
    return authors.cluster_sizes(v.labelled(s, d, text=False), "labels")


# ------------------------------------------------------------ clusters
@query(
    "j6_p8_clustered_posts",
    f"WITH {v.LABELLED_ROWS} SELECT * FROM labelled WHERE labels <> -1",
)
def _(s, d):
    return labels.clustered(v.labelled(s, d, text=False))


@query(
    "p9_p10_one_cluster",
    f'WITH {v.LABELLED_ROWS} SELECT "SK_post", labels + 1 AS cluster FROM labelled '
    "WHERE labels = 1",
)
def _(s, d):
    rows = labels.in_cluster(v.labelled(s, d, text=False), 1)
    return interactions.shift_labels(rows, "labels").select(
        "SK_post", F.col("labels").alias("cluster")
    )


@query(
    "p11_label_all",
    f'WITH {v.LABELLED_ROWS} SELECT "SK_post", labels FROM labelled',
)
def _(s, d):
    return v.labelled(s, d, text=False).select("SK_post", "labels")


@query(
    "a16_box_statistics",
    f"""WITH {v.LABELLED_ROWS}, x AS (
      SELECT labels + 1 AS cluster, counter, val FROM labelled
      UNPIVOT (val FOR counter IN (like_count, repost_count, quote_count, reply_count))
      WHERE labels <> -1),
    q AS (SELECT cluster, counter, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS median,
                 quantile_cont(val, 0.75) AS q3 FROM x GROUP BY ALL)
    SELECT cluster, counter, q1, median, q3,
      min(val) FILTER (val >= q1 - 1.5 * (q3 - q1) AND val <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max(val) FILTER (val >= q1 - 1.5 * (q3 - q1) AND val <= q3 + 1.5 * (q3 - q1)) AS whisker_high
    FROM x JOIN q USING (cluster, counter) GROUP BY ALL""",
)
def _(s, d):
    rows = labels.clustered(v.labelled(s, d, text=False))
    return interactions.box_statistics(rows, "labels")
