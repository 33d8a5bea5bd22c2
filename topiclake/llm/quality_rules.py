"""Quality rules on whole texts: plain counts, and divergence from language references.

Two histograms describe a text: shares of character classes, and shares of a language's common
words. Each is compared with the reference of the text's language, the sum over all texts of that
language that pass the plain rules, by Jensen-Shannon distance (the square root of the divergence
in bits, 0 to 1). Only built-in functions run, one pass for the references and one for the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.session import stage

# Common words of the languages that have a word histogram.
COMMON = {
    "de": "der die das und in den von zu mit sich auf ist des im dem nicht ein eine als auch",
    "en": "the of and to in is it that for was on are as with be this by an from or",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
# Character classes, as Java patterns of what they do not hold.
CLASSES = {
    "lower": r"[^\p{Ll}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^\p{Nd}]+",
    "point": r"[^.,;:!?'\"()-]+",
}
SPACE = r"[ \t-\r]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def window_hashes(words: Column, n: Column, width: int) -> Column:
    """Hash of each window of ``width`` words, a power of two, by doubling: a window is two halves."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    half = 1
    while half < width:
        hashes = let(hashes, _doubled(half))
        half *= 2
    return F.slice(hashes, F.lit(1), n - width + 1)


def _doubled(half: int):
    return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + half)))


def repeated_words(words: Column, n: Column, width: int) -> Column:
    """Words in ``width``-word windows that the text holds twice or more, the first included.

    Windows are compared by a 64-bit hash. Starts of repeated windows are sorted; each covers the
    words up to the next start, or ``width``.
    """
    hashes = window_hashes(words, n, width)

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            last = F.size(o) - 1
            twice = F.filter(
                F.transform(
                    o,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(o, i - 1)["h"] == x["h"]))
                        | ((i < last) & (F.get(o, i + 1)["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return F.array_sort(twice)

        def length(s: Column) -> Column:
            gaps = F.transform(
                s, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(s, i + 1) - x, F.lit(width)))
            )
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(order, starts), length)

    whole = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            covered(h)
        ),
    )
    return F.when(n < width, F.lit(0).cast("long")).otherwise(whole)


def plain_counts(df: DataFrame, text: str, keep: list[str], width: int = 8) -> DataFrame:
    """``keep`` columns with the plain counts; null texts count as empty.

    ``_words`` holds the words and ``_rest`` the text without white space and a to z: what is left
    is short, so finer patterns run on it alone.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*keep, clean.alias("_text")).withColumns(
        {"_words": words_of(F.col("_text")), "_solid": F.regexp_replace("_text", SPACE, "")}
    )
    base = base.withColumn("_rest", F.regexp_replace("_solid", "[a-z]+", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_solid").cast("long"),
            "n_symbols": F.length(F.regexp_replace("_rest", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words"), F.size("_words"), width),
        }
    ).withColumn(
        "base_failed",
        (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    )


def class_histogram(solid_chars: Column, rest: Column) -> Column:
    """Word characters of each class, then all that are in none."""
    counts = [F.length(F.regexp_replace(rest, p, "")) for p in CLASSES.values()]
    counts[0] = counts[0] + solid_chars - F.length(rest)
    other = solid_chars - sum(counts[1:], counts[0])
    return F.array(*(c.cast("double") for c in counts), other.cast("double"))


def word_histogram(words: Column, lang: Column) -> Column:
    """Occurrences of the language's common words, then all other words; null for other languages."""

    def bins(listed: list[str]) -> Column:
        def count(common: Column) -> Column:
            each = [F.size(F.filter(common, _equals(w))).cast("double") for w in listed]
            return F.array(*each, (F.size(words) - F.size(common)).cast("double"))

        return let(F.filter(words, lambda w: w.isin(listed)), count)

    out = F.lit(None).cast("array<double>")
    for name, listed in COMMON.items():
        out = F.when(lang == name, bins(listed.split())).otherwise(out)
    return out


def _equals(word: str):
    return lambda w: w == word


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; null if one is empty or null."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(x: Column) -> Column:
        terms = F.zip_with(
            F.transform(p, lambda v: v / x["p"]),
            F.transform(q, lambda v: v / x["q"]),
            lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2),
        )
        return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))

    totals = F.struct(total(p).alias("p"), total(q).alias("q"))
    return let(totals, lambda x: F.when((x["p"] > 0) & (x["q"] > 0), of(x)))


def judge(
    df: DataFrame,
    key: str,
    text: str = "text",
    lang: str = "lang",
    class_limit: float = 0.34,
    word_limit: float = 0.31,
    class_chars: int = 300,
    word_words: int = 80,
) -> DataFrame:
    """Each row's key, plain counts, both distances, and whether it is kept.

    A text is rejected by the plain rules, or if a distance exceeds its limit and the text is long
    enough for that histogram (``class_chars`` word characters, ``word_words`` words). Texts of a
    language without a word list, or of null language, are judged by character classes alone. One
    row out per row in, repeated rows and null keys included; an empty table gives an empty result.
    """
    picked = df.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_raw"))
    counted = plain_counts(picked, "_raw", ["_key", "_lang"])
    measured = counted.withColumns(
        {
            "_classes": class_histogram(F.col("word_chars"), F.col("_rest")),
            "_common": word_histogram(F.col("_words"), F.col("_lang")),
        }
    ).drop("_text", "_words", "_solid", "_rest")
    measured = stage(measured, "histograms")

    width = max(len(w.split()) for w in COMMON.values()) + 1
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"_c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("_common", F.lit(i))).alias(f"_w{i}") for i in range(width)]
    references = (
        measured.filter(~F.col("base_failed"))
        .groupBy("_lang")
        .agg(*sums)
        .select(
            F.col("_lang").alias("_of"),
            F.array(*(f"_c{i}" for i in range(len(CLASSES) + 1))).alias("_class_ref"),
            F.array(*(f"_w{i}" for i in range(width))).alias("_word_ref"),
        )
    )
    joined = measured.join(references, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    scored = joined.withColumns(
        {
            "class_distance": js_distance(F.col("_classes"), F.col("_class_ref")),
            "word_distance": js_distance(F.col("_common"), F.col("_word_ref")),
        }
    )
    diverges = (
        (F.col("word_chars") >= class_chars)
        & F.coalesce(F.col("class_distance") > class_limit, F.lit(False))
    ) | ((F.col("n_words") >= word_words) & F.coalesce(F.col("word_distance") > word_limit, F.lit(False)))
    return scored.select(
        F.col("_key").alias(key),
        F.col("_lang").alias("lang"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance",
        (~F.col("base_failed") & ~diverges).alias("kept"),
    )
