"""Quality rules: divergence of a text's histograms from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Common words of four languages, whose shares make the word histogram.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "as", "it", "on", "be", "at", "by", "this", "from", "are", "or",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ein", "im", "dem", "nicht", "eine", "als", "auch", "es", "an",
    "le", "de", "la", "les", "et", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur",
    "el", "los", "y", "se", "del", "las", "por", "con", "no", "para", "su", "al", "lo", "como", "más",
]
WORDS = list(dict.fromkeys(COMMON_WORDS))
BLANK = r"[\x20\x09-\x0D]+"
#: Character classes: a name and the Java pattern of what does not belong to it. Other characters of words and blanks are two more classes.
CLASSES = {"n_upper": r"[^\p{Lu}]+", "n_digit": r"[^0-9]+", "n_symbols": r"[^#*$%&|<>]+", "n_stop": r"[^.,;:!?]+"}
#: More languages than these are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 2_000
CLASS_NAMES = ["blank", "upper", "digit", "symbol", "stop", "other"]


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Base counts and histograms of every text."""
    grams = "transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    pairs = "array_sort(transform(grams, (g, i) -> struct(g, i)))"
    # first words of the windows that are found twice or more, ascending
    starts = """array_sort(transform(filter(
        transform(pairs, (x, k) -> struct(x.i as i, (k > 0 and get(pairs, k - 1).g = x.g) or coalesce(get(pairs, k + 1).g = x.g, false) as twice)),
        x -> x.twice), x -> x.i))"""
    covered = "aggregate(transform(starts, (s, k) -> least(3, coalesce(get(starts, k + 1) - s, 3))), 0L, (n, x) -> n + x)"
    rest = [
        ("words", F.expr(f"filter(split(text, '{BLANK.replace(chr(92), chr(92) * 2)}'), w -> w <> '')")),
        ("n_words", F.size("words").cast("long")),
        ("n_chars_all", F.length("text").cast("long")),
        ("word_chars", F.length(F.regexp_replace("text", BLANK, "")).cast("long")),
        *((name, F.length(F.regexp_replace("text", other, "")).cast("long")) for name, other in CLASSES.items()),
        ("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
        ("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
        ("grams", F.when(F.col("n_words") >= 4, F.expr(grams))),
        ("pairs", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.expr(pairs))),
        ("starts", F.when(F.col("pairs").isNotNull(), F.expr(starts))),
        ("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))),
        ("common", F.array_sort(F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(WORDS)))),
        ("found", F.array_distinct("common")),
        ("at", F.expr("transform(found, w -> array_position(common, w))")),
        ("times", F.expr("transform(at, (p, k) -> coalesce(get(at, k + 1), size(common) + 1) - p)")),
        ("class_counts", F.array((F.col("n_chars_all") - F.col("word_chars")), "n_upper", "n_digit", "n_symbols", "n_stop", F.col("word_chars") - F.col("n_upper") - F.col("n_digit") - F.col("n_symbols") - F.col("n_stop"))),
    ]
    df = docs.withColumn("text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for name, column in rest:
        df = df.withColumn(name, column)
    return df


def _references(counts: DataFrame) -> DataFrame:
    """For each language: shares of the character classes, and of the common words, over all its texts that pass the base rules."""
    good = counts.where("not base_failed")
    total = good.groupBy("lang").agg(*(F.sum(F.col("class_counts")[k]).cast("double").alias(f"c{k}") for k in range(len(CLASS_NAMES))), F.sum("n_words").cast("double").alias("all_words"))
    classes = total.select("lang", "all_words", F.expr(f"transform(array({', '.join(f'c{k}' for k in range(len(CLASS_NAMES)))}), x -> x / ({' + '.join(f'c{k}' for k in range(len(CLASS_NAMES)))})) as class_shares"))
    one = good.select("lang", F.explode(F.arrays_zip("found", "times")).alias("x")).groupBy("lang", F.col("x.found").alias("word")).agg(F.sum("x.times").cast("double").alias("n"))
    words = one.groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("word_counts"))
    return classes.join(words, "lang", "left").select("lang", "class_shares", F.expr("map_from_entries(transform(coalesce(word_counts, array()), x -> struct(x.word, x.n / all_words))) as word_shares"))


def _term(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = 0.27, max_word_distance: float = 0.13,
    word_noise: float = 2.0, min_words: int = 50, min_common: int = 10, min_reference_words: int = 1000, max_repeat_percent: int = 50,
) -> DataFrame:
    """Judge texts by the Jensen-Shannon distance of two histograms from those of their language.

    Base rules: fewer than `min_words` words, or more than `max_repeat_percent` % of the words
    inside three-word windows found twice, fail. The references of a language are its own texts
    that pass them, all of them. A text is rejected if its character classes (blank, upper case,
    digit, symbol, stop, other) lie further than `max_char_distance` from its language's, or its
    common words, with all other words as one more bin, further than `max_word_distance` plus
    `word_noise` / sqrt(words). Distances are square roots of the divergence in bits, 0 to 1.

    Guards: the word test needs `min_common` common words expected of a text of this length in
    its language; a language with fewer than `min_reference_words` words in its reference judges
    nothing. A null language is a language of its own. A null or empty text has no words and
    fails the base rules. Rows are judged one by one, so repeated rows and ids get equal results.

    :return: one row per row of `docs`: id_col, n_words, word_chars, n_symbols, n_dup_lines,
        n_repeat_words (long), base_failed, kept (boolean), char_distance, word_distance (double,
        6 digits; null where no reference judges).

    Only built-in expressions: counts stay in the row's arrays, and what is shuffled is a
    histogram for each language and task.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "found", "times"]
    counts = _counts(docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text")), "text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = scratch.keep(counts.select("own_id", "lang", *cols).withColumn("base_failed", failed))
    total = counts.where("not base_failed").groupBy("lang").agg(F.sum("n_words").alias("reference_words"))
    reference = scratch.keep(_references(counts).join(total, "lang").where(F.col("reference_words") >= min_reference_words))
    # a row a language and at most one number a common word in it: small, and checked to be
    reference = F.broadcast(reference) if reference.count() <= MAX_BROADCAST_LANGUAGES else reference
    x = counts.join(reference.withColumn("expected", F.expr("aggregate(map_values(word_shares), 0D, (a, v) -> a + v)")), "lang", "left")
    sums = "cast(aggregate(class_counts, 0L, (a, v) -> a + v) as double)"
    x = x.withColumn("p", F.expr(f"transform(class_counts, v -> v / nullif({sums}, 0D))"))
    chars = F.aggregate(F.zip_with("p", "class_shares", _term), F.lit(0.0), lambda a, v: a + v) / 2
    x = x.withColumn("word_p", F.expr("transform(times, v -> v / nullif(cast(n_words as double), 0D))")).withColumn("word_q", F.expr("transform(found, w -> coalesce(word_shares[w], 0D))"))
    seen = F.aggregate("word_q", F.lit(0.0), lambda a, v: a + v)
    other_p = 1 - F.aggregate("word_p", F.lit(0.0), lambda a, v: a + v)
    words = (F.aggregate(F.zip_with("word_p", "word_q", _term), F.lit(0.0), lambda a, v: a + v) + (F.col("expected") - seen) + _term(other_p, 1 - F.col("expected"))) / 2
    x = x.withColumn("char_distance", F.sqrt(F.when(F.expr(f"{sums} > 0"), F.greatest(chars, F.lit(0.0))))).withColumn("word_distance", F.when(F.col("expected") * F.col("n_words") >= min_common, F.sqrt(F.greatest(words, F.lit(0.0)))))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance + word_noise / F.sqrt(F.greatest("n_words", F.lit(1))))
    return x.select(
        F.col("own_id").alias(id_col), *cols[:5], "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
