"""Column names and types of every table in the lake."""

from __future__ import annotations

COUNTERS = "like_count int, repost_count int, quote_count int, reply_count int"

FEED = (
    "post struct<author: struct<handle: string>, "
    "record: struct<text: string, created_at: timestamp>, like_count: int, repost_count: int, "
    "quote_count: int, reply_count: int>"
)
RAW = f"author string, text string, created_at timestamp, {COUNTERS}"

TIME = (
    "SK_time long, created_at timestamp, MES int, DIA int, HORA int, MINUTO int, DIA_SEMANA string"
)
AUTHOR = "SK_author long, author string"
SILVER_POSTS = f"SK_post long, SK_time long, SK_author long, yaked string, {COUNTERS}, day_collect int"
GOLD_POSTS = (
    f"SK_post long, SK_time long, SK_author long, {COUNTERS}, embedding array<float>, "
    "day_collect int"
)

TABLES = {
    ("bronze", "posts"): f"{RAW}, source_file string, day_collect int, batch string",
    # Files of the finished batches; rows of a batch that is not listed are not read.
    ("bronze", "files"): "file string, file_date string, batch string",
    # Digests and counters of the posts that streams have landed.
    ("bronze", "ledger"): f"h1 long, h2 long, {COUNTERS}, month_collect int, day_collect int, batch string",
    ("silver", "posts"): f"{SILVER_POSTS}, load int",
    ("silver", "time"): TIME,
    ("silver", "author"): AUTHOR,
    # One row per finished load: the greatest raw creation time and the last post key.
    ("silver", "loads"): "mark timestamp, last_post long",
    # Digests of the loaded posts, for late and repeated ones, and their keys if they have words.
    ("silver", "ledger"): "h1 long, h2 long, SK_post long, month_collect int, day_collect int, load int",
    # Days whose posts got higher counters from later copies, one row per day and load that did it.
    ("silver", "revised"): "day_collect int, mark string",
    # Bronze batches that a load has read in full.
    ("silver", "reads"): "batch string, load int",
    # The numbers of the loads that batches are meant for, written before they begin.
    ("silver", "plans"): "batch string, load int",
    # Words of the corpus with their counts, learnt once.
    ("silver", "vocabulary"): "word string, n long",
    ("gold", "posts"): GOLD_POSTS,
    # Marks of the revisions that gold has taken over.
    ("gold", "revised"): "day_collect int, mark string",
    ("gold", "time"): TIME,
    ("gold", "author"): AUTHOR,
    ("results", "labels"): "SK_post long, post string, labels int",
    ("results", "runs"): (
        "run_id string, name string, params map<string,string>, metrics map<string,double>, "
        "tags map<string,string>, artifacts array<string>"
    ),
}
PARTITIONED = {
    ("bronze", "posts"): ["day_collect", "batch"],
    ("bronze", "ledger"): ["day_collect", "batch"],
    ("silver", "posts"): ["day_collect", "load"],
    ("silver", "ledger"): ["day_collect", "load"],
    ("gold", "posts"): ["day_collect"],
}
