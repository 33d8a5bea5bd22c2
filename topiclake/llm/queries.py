"""One query per operator over its whole table, and the SQL that checks it where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclake.llm import (
    bpe, centroids, conversations, cotraining, decontaminate, licenses, mixing, neardup, quality_rules, secrets, shards,
    suffix_tree, warc,
)
from workload.registry import registry

Q, SQL, query = registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


N_SHARDS = 16

# CRC-32 by its table of 256 remainders, one byte of the text after the other.
_CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce(list_prepend(n, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def _winner_sql(n: int) -> str:
    scores = ", ".join(
        f"{{'score': -1.0 / ln((('0x' || substr(md5(k || '/{i}'), 1, 13))::BIGINT + 0.5) "
        f"/ 4503599627370496.0), 'negated': {-i}}}"
        for i in range(n)
    )
    return f"-list_max([{scores}]).negated"


@query(
    "op3_rendezvous_shards",
    f"""
WITH {_CRC},
docs AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS s,
                hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, k, octet_length(encode(s)) + 1 AS size,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
             lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc,
         {_winner_sql(N_SHARDS)} AS shard, {_winner_sql(N_SHARDS + 1)} AS grown
  FROM docs, crc_table
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM sized""",
)
def op3_rendezvous_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shards.assign(sized, "doc_id", [1.0] * N_SHARDS)
    placed = shards.assign(placed, "doc_id", [1.0] * (N_SHARDS + 1), "grown_shard")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return shards.with_slots(placed, "shard", [order, F.col("doc_id")]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def _js_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists in SQL."""
    pair = f"list_zip(list_transform({p}, lambda v: v / list_sum({p})), list_transform({q}, lambda v: v / list_sum({q})))"
    term = "CASE WHEN z[{i}] > 0 THEN z[{i}] * log2(z[{i}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum("
        f"list_transform({pair}, lambda z: {term.format(i=1)} + {term.format(i=2)})) / 2)) END"
    )


_COMMON_SQL = " ".join(
    f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words.split())}]"
    for lang, words in quality_rules.COMMON.items()
)
_N_BINS = max(len(w.split()) for w in quality_rules.COMMON.values()) + 1


@query(
    "op9_divergence_rules",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS s FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(s, '[ \t-\r]+'), lambda x: x <> '') AS words,
         regexp_replace(s, '[ \t-\r]+', '', 'g') AS solid,
         list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines,
         CASE lang {_COMMON_SQL} END AS listed
  FROM d
), windows AS (
  SELECT r, len(words) AS n, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8
), twice AS (
  SELECT r, i FROM (
    SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 7], ' ')) AS k
    FROM windows) WHERE k > 1
), covered AS (
  SELECT r, sum(step) AS c FROM (
    SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS step FROM twice)
  GROUP BY r
), counted AS (
  SELECT w.r, doc_id, lang, len(words)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
         length(regexp_replace(solid, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words,
         [length(regexp_replace(solid, '[^\p{{Ll}}]+', '', 'g'))::DOUBLE,
          length(regexp_replace(solid, '[^\p{{Lu}}]+', '', 'g'))::DOUBLE,
          length(regexp_replace(solid, '[^\p{{Nd}}]+', '', 'g'))::DOUBLE,
          length(regexp_replace(solid, '[^.,;:!?''"()-]+', '', 'g'))::DOUBLE] AS four,
         list_transform(listed, lambda x: len(list_filter(words, lambda y: y = x))::DOUBLE) AS common
  FROM w LEFT JOIN covered USING (r)
), hist AS (
  SELECT *, list_append(four, word_chars - list_sum(four)) AS classes,
         list_append(common, n_words - list_sum(common)) AS bins,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted
), refs AS (
  SELECT lang, [{', '.join(f'sum(classes[{i}])' for i in range(1, 6))}] AS class_ref,
         [{', '.join(f'sum(bins[{i}])' for i in range(1, _N_BINS + 1))}] AS word_ref
  FROM hist WHERE NOT base_failed GROUP BY lang
), scored AS (
  SELECT hist.*, {_js_sql('classes', 'class_ref')} AS class_distance,
         {_js_sql('bins', 'word_ref')} AS word_distance
  FROM hist LEFT JOIN refs ON hist.lang IS NOT DISTINCT FROM refs.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars >= 300 AND coalesce(class_distance > 0.34, false))
       AND NOT (n_words >= 80 AND coalesce(word_distance > 0.31, false)) AS kept
FROM scored""",
)
def op9_divergence_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir, vocabulary: str = "byte_bpe_multi_50k.tiktoken"):
    encoded = bpe.encode(
        table(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path(vocabulary),
        decoded="decoded",
    )
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op2_winnow_decontamination",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_SQL} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM_SQL} AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM (
    SELECT item, words, least(13, len(words)) AS n,
           unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
),
doc_windows AS (
  SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS w FROM (
    SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(words) >= n)
),
hits AS (SELECT r, n, i, item FROM doc_windows JOIN item_windows USING (n, w)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits)
  GROUP BY r
),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""",
)
def op2_winnow_decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op8_bottom_k_near_duplicates",
    rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), {_AZ}), '[ \t-\r]+'), lambda x: x <> '') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT r, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words), 2))) AS i FROM d WHERE len(words) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y
  WHERE 100 * c >= 80 * (m.n + n.n - c)
),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, sides.y FROM reach JOIN sides ON reach.t = sides.x),
least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN sizes USING (r)""",
)
def op8_bottom_k_near_duplicates(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, limit=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', (((('0x' || substr(h, {10 * part + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31) + 1)::INT, 1)"
    for part in range(4)
    for i in range(8)
)


@query(
    "op7_warc_dictionary",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS s FROM pages),
q AS (SELECT page_id, octet_length(encode(s)) AS n, sha1(s) AS h, max(page_id) OVER (PARTITION BY s) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32_SQL} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q""",
)
def op7_warc_dictionary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    read = warc.read_archives(warc.write_archives(pages, folder), folder)
    return read.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op4_secret_network")
def op4_secret_network(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, ["doc_id"], "text", secrets.fit(docs))

    def joined(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(each, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "network")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op5_cotrained_quality")
def op5_cotrained_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model, ["doc_id"])


@query("op1_suffix_tree_scores")
def op1_suffix_tree_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select(
        "doc_id", "text", (F.crc32(name.cast("binary")) % 7 == 2).alias("held_out")
    ).withColumn("learn", ~F.col("held_out"))
    model = suffix_tree.train(docs, "text", "learn")
    return suffix_tree.score(docs, ["doc_id", "held_out"], "text", model)


_SPACE_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"


def _fold_sql(level: int) -> str:
    """Pivotal folds of the blocks of items{level} (rank, pos, p, s), one item more in each step."""
    return f"""
item{level} AS MATERIALIZED (
  SELECT rank, pos // {mixing.BLOCK} AS block, (pos % {mixing.BLOCK})::INTEGER AS i, p, s,
         (('0x' || substr(md5(rank || ':{level}:' || pos), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM items{level}
), fold{level} AS (
  SELECT rank, block, 0 AS n, i, p, s, []::INTEGER[] AS ones FROM item{level} WHERE i = 0
  UNION ALL
  SELECT rank, block, n + 1,
         CASE WHEN rises THEN CASE WHEN a <= b THEN xi ELSE i END WHEN c <= d THEN xi ELSE i END,
         CASE WHEN rises THEN CASE WHEN a <= b THEN xp - up / xs ELSE p + up / s END
              WHEN c <= d THEN xp + down / xs ELSE p - down / s END,
         CASE WHEN rises THEN CASE WHEN a <= b THEN xs ELSE s END WHEN c <= d THEN xs ELSE s END,
         CASE WHEN rises AND a <= b THEN list_append(ones, i)
              WHEN NOT rises AND NOT c <= d THEN list_append(ones, xi) ELSE ones END
  FROM (SELECT *, u * (up + down) < down AS rises FROM (SELECT *, least(a, b) AS up, least(c, d) AS down FROM (
    SELECT f.*, x.i AS xi, x.p AS xp, x.s AS xs, x.u, (1 - f.p) * f.s AS a, x.p * x.s AS b,
           f.p * f.s AS c, (1 - x.p) * x.s AS d
    FROM fold{level} f JOIN item{level} x ON x.rank = f.rank AND x.block = f.block AND x.i = f.n + 1)))
), done{level} AS MATERIALIZED (SELECT * FROM fold{level} QUALIFY n = max(n) OVER (PARTITION BY rank, block))"""


@query(
    "op11_pivotal_mix",
    f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len({_SPACE_WORDS})::BIGINT AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
          FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM sized),
tried AS (
  SELECT weight, lim, rank, (1.5::DOUBLE * (SELECT sum(source_size) FROM sized)
           - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
),
targets AS (
  SELECT source, rank, source_size, least(weight * (SELECT level FROM tried WHERE weight * level <= lim ORDER BY lim / weight, rank LIMIT 1), lim) AS target
  FROM weighed
),
rated AS (
  SELECT doc_id, size, rank, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
),
items0 AS MATERIALIZED (
  SELECT rank, size, doc_id, size::DOUBLE AS s, rate - floor(rate) AS p, row_number() OVER (
           PARTITION BY rank ORDER BY size DESC, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS pos
  FROM rated WHERE rate - floor(rate) > 0 AND size > 0
),{_fold_sql(0)},
items1 AS (SELECT rank, block AS pos, p, s FROM done0),{_fold_sql(1)},
top AS (
  SELECT x.rank, x.i AS block, CASE WHEN x.i = f.i THEN f.p >= 0.5 ELSE list_contains(f.ones, x.i) END AS up
  FROM item1 x JOIN done1 f USING (rank, block)
),
ups AS (
  SELECT z.doc_id, z.rank, z.size, CASE WHEN x.i = f.i THEN top.up ELSE list_contains(f.ones, x.i) END::INTEGER AS up
  FROM items0 z JOIN item0 x ON x.rank = z.rank AND x.block = z.pos // {mixing.BLOCK} AND x.i = z.pos % {mixing.BLOCK}
  JOIN done0 f ON f.rank = x.rank AND f.block = x.block JOIN top ON top.rank = x.rank AND top.block = x.block
  UNION ALL
  SELECT doc_id, rank, size, 0 FROM rated WHERE NOT (rate - floor(rate) > 0 AND size > 0)
)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM (
  SELECT doc_id, size, source_size, target,
         up + CASE WHEN size > 0 AND source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies
  FROM ups JOIN targets USING (rank))""",
)
def op11_pivotal_mix(spark, sf_dir):
    """Copies of every document for a mix of the sources by the weights 5, 2, 1, of 150 % of all words."""
    docs = table(spark, sf_dir, "documents")
    words = F.size(quality_rules.words_of(F.coalesce("text", F.lit(""))))
    return mixing.mix(docs, ["doc_id"], "source", words)


def _kmeans_sql(rounds: int, k: int, width: int) -> str:
    """All vectors against all centroids in each round."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {width}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM v
  QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(v.q) AS q, min({{'d': list_sum(list_transform(list_zip(v.q, c{i}.q),
           lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c{i}.c}}) AS m
  FROM v, c{i} GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range({width})) AS i FROM a{i})
    GROUP BY c, i)
  GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = m.c"""


@query("op12_laesa_centroids", _kmeans_sql(10, 8, 64))
def op12_laesa_centroids(spark, sf_dir):
    """Ten rounds of exact integer k-means over all vectors, from the eight of the least hash."""
    name = F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.sha2(name, 256))
    return centroids.with_inertia(found, "vec_id")


def _edits_sql() -> str:
    """One row more of every conversation: the cheapest (cost, edits, result) for each of four states."""

    def step(state: str, cost: str, edit: str, out: str, when: str = "true") -> str:
        return (
            f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
            f"'t': {state}.t || {out}}} END"
        )

    def turn(state: str, who: str, text: str = "''") -> str:
        return step(state, "3" if text == "''" else "3 + extra", "I" if text == "''" else "R", f"chr(10) || '{who}:' || {text}", "true" if text == "''" else "not gone")

    def twice(state: str) -> str:
        return step(state, "6", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")

    def keep(state: str, initial: str) -> str:
        return step(state, "extra", "K", "chr(10) || role || ':' || text", f"NOT gone AND role LIKE '{initial}%'")

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def gone(state: str) -> str:
        return step(state, "4", "D", "''")

    user = least("s2", turn("s0", "user"), turn("s1", "user"), turn("s3", "user"))
    assistant = least("s3", turn("s2", "assistant"), twice("s0"), twice("s1"))
    to_user = [f(s) for s in ("s0", "s1", "a") for f in (lambda x: turn(x, "user", "text"), lambda x: keep(x, "u"))]
    return f"""
path AS (
  SELECT g, 0 AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM convs
  UNION ALL
  SELECT g, n + 1, {gone("s0")}, {least(gone("s1"), keep("s0", "s"))}, {least(gone("u"), *to_user)},
         {least(gone("a"), turn("u", "assistant", "text"), keep("u", "a"))}
  FROM (SELECT p.*, role, text, gone, extra, {user} AS u, {assistant} AS a
        FROM path p JOIN faults f ON f.g = p.g AND f.n = p.n + 1)
), ends AS (
  SELECT g, {least("s0", "s3", turn("s2", "assistant"), twice("s0"), twice("s1"))} AS e
  FROM path QUALIFY n = max(n) OVER (PARTITION BY g)
)"""


@query(
    "op13_conversation_repair",
    f"""
WITH RECURSIVE {_CRC},
convs AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
source AS (
  SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
  FROM conversations c JOIN convs ON c.conv_id IS NOT DISTINCT FROM convs.conv_id
),
hashed AS (
  SELECT g, turn, role, text, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM source, crc_table
),
once AS (
  SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, kind
  FROM hashed WHERE kind <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS n
  FROM (SELECT * FROM once UNION ALL SELECT * FROM once WHERE kind = 3)
),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^ \\t-\\r]') AS blank,
         row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 AS again,
         regexp_extract(text, '([^ \\t-\\r])[ \\t-\\r]*$', 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY g ORDER BY n) || '-' || left(role, 1) AS two
  FROM numbered
),
faults AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM judged),
{_edits_sql()},
counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT gone) AS truncated,
         count_if(two NOT IN ('s-u', 'u-a', 'a-u')) AS illegal
  FROM faults GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit,
       sha256(substr(e.t, 2)) AS repaired_sha256
FROM convs JOIN ends USING (g) LEFT JOIN counts USING (g)""",
)
def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and hash of the result of every damaged conversation."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
