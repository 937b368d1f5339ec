"""Quality rules by divergence from language references, with Spark functions only.

A text has two histograms: characters of its words by class, and its words among the common
words of the languages below (all others together). Each language's reference is the mean
histogram of its documents that pass the base rules, over the whole table. A text is kept if
it passes the base rules and, for the reference nearest to it, both Jensen-Shannon
distances (square root of the divergence in bits) stay under their limits. A short text's
histogram is noisy, so limits are wider by a guard that shrinks with the square root of its
length; below ``MIN_WORDS`` words the base rules reject it anyway.

Everything up to the references is one pass over the texts that needs no shuffle; the
references are a few numbers for each language in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.operators.distributed import materialize

# White space between words, and signs that count as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Common words of the languages with a reference.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this are from or an not have you he his they".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "le la les de des du et un une en à que qui dans pour pas sur avec est au par il elle ne se plus sont ce".split(),
    "es": "el la los las de del y en un una que por con para no es se su al lo como más pero sus le ya o este".split(),
}

MIN_WORDS = 50
REPEAT_PERCENT = 50
# Limit of a distance: LIMIT + GUARD / sqrt(words). Distances of sound texts of n words
# scatter up to about 2.7 / sqrt(n) for words and 0.1 + 1.4 / sqrt(n) for characters.
CHAR_LIMIT = 0.105
WORD_LIMIT = 0.085
CHAR_GUARD = 1.6
WORD_GUARD = 2.15

_CLASSES = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "symbol": r"[^#*$%&|<>]+",
    "mark": r"""[^!"'()+,\-./:;=?@\[\\\]^_`{}~]+""",
    "other": r"[\x00-\x7F]+",
}


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of words that lie in a window of ``width`` words found twice or more.

    Windows are hashed and sorted, so equal ones are neighbours; their places are sorted
    again and the words they cover counted. No step looks at pairs of windows.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(
                places, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(places, j + 1) - p, F.lit(width)))
            ),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    def places(sorted_windows: Column) -> Column:
        def repeated(window: Column, j: Column) -> Column:
            near = lambda k: F.coalesce(F.get(sorted_windows, k)["h"] == window["h"], F.lit(False))
            return F.when(near(j - 1) | near(j + 1), window["i"])

        return F.sort_array(F.filter(F.transform(sorted_windows, repeated), lambda p: p.isNotNull()))

    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.struct(
                F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i")
            ),
        )
    )
    count = bound(windows, lambda w: bound(places(w), covered))
    return F.when(F.size(words) >= width, count).otherwise(F.lit(0).cast("long"))


def _kept_length(text: Column, removed: str) -> Column:
    return F.length(F.regexp_replace(text, removed, "")).cast("long")


def document_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base measures and both histograms of every row.

    ``chars`` is an array in the order lower, upper, digit, symbol, mark, other; ``common`` maps
    the common words in a text to their counts.
    """
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"),
        text.alias("text"),
        words_of(text).alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(ordered: Column) -> Column:
        """Map from the distinct words of a sorted array to their counts."""

        def run_lengths(distinct: Column) -> Column:
            return F.map_from_arrays(
                distinct,
                F.transform(
                    distinct,
                    lambda w, j: F.coalesce(
                        F.array_position(ordered, F.get(distinct, j + 1)), F.size(ordered).cast("long") + 1
                    )
                    - F.array_position(ordered, w),
                ),
            )

        return bound(F.array_distinct(ordered), run_lengths)

    common = F.sort_array(
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(every))
    )
    measured = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        _kept_length(F.col("text"), SPACES).alias("word_chars"),
        _kept_length(F.col("text"), _CLASSES["symbol"]).alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *[_kept_length(F.col("text"), _CLASSES[c]).alias(c) for c in ("upper", "digit", "mark", "other")],
        bound(common, counts).alias("common"),
    )
    rest = F.col("upper") + F.col("digit") + F.col("n_symbols") + F.col("mark") + F.col("other")
    return measured.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(
            F.greatest(F.col("word_chars") - rest, F.lit(0)), "upper", "digit", "n_symbols", "mark", "other"
        ).alias("chars"),
        "common",
        (
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
        ).alias("base_failed"),
    )


def language_references(measures: DataFrame) -> DataFrame:
    """One row: for each language with a reference its mean histograms, or nulls."""
    sound = measures.where(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS))
    share = lambda count, whole: F.coalesce(count / whole, F.lit(0.0))
    parts = []
    for lang, words in COMMON_WORDS.items():
        mine = F.col("lang") == lang
        chars = [F.avg(F.when(mine, F.get("chars", F.lit(i)) / F.col("word_chars"))) for i in range(6)]
        common = [
            F.avg(F.when(mine, share(F.element_at("common", F.lit(w)), F.col("n_words")))) for w in words
        ]
        parts += [
            F.array(*chars).alias(f"chars_{lang}"),
            F.map_from_arrays(F.array(*[F.lit(w) for w in words]), F.array(*common)).alias(f"words_{lang}"),
            F.count_if(mine).alias(f"n_{lang}"),
        ]
    return sound.agg(*parts)


def _term(p: Column, q: Column) -> Column:
    """Share of one bin in the Jensen-Shannon divergence, in bits."""
    half = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return (half(p) + half(q)) / 2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def char_distance(lang: str) -> Column:
    p = F.transform("chars", lambda n: n / F.col("word_chars"))
    return F.sqrt(F.greatest(_sum(F.zip_with(p, F.col(f"chars_{lang}"), _term)), F.lit(0.0)))


def word_distance(lang: str) -> Column:
    """Bins are the language's common words and one for all other words."""
    reference = F.col(f"words_{lang}")

    def entries(own: Column) -> Column:
        share = lambda w: F.element_at("common", w) / F.col("n_words")
        return F.transform(own, lambda w: F.struct(share(w).alias("p"), F.element_at(reference, w).alias("q")))

    def distance(pairs: Column) -> Column:
        own = _sum(F.transform(pairs, lambda x: x["p"]))
        reached = _sum(F.transform(pairs, lambda x: x["q"]))
        all_common = _sum(F.map_values(reference))
        # A common word that the text lacks adds half of its share in the reference.
        absent = F.greatest(all_common - reached, F.lit(0.0)) / 2
        return _sum(F.transform(pairs, lambda x: _term(x["p"], x["q"]))) + absent + _term(1 - own, 1 - all_common)

    own = F.filter(F.map_keys("common"), lambda w: F.array_contains(F.map_keys(reference), w))
    return F.sqrt(F.greatest(bound(entries(own), distance), F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """Measures, distances and verdict for every row of ``docs``.

    A null text has no words and fails the base rules. A null or empty ``lang``, or no such
    column, keeps a text out of the references only. A text in a language that is not in
    ``COMMON_WORDS`` has nothing to be measured against and is judged by the base rules
    alone. Repeated rows and null ids are rows
    like any other; other columns are ignored. If no language has a reference, texts that
    pass the base rules are kept.
    """
    measures = materialize(document_measures(docs), "measures")
    # One row with a fixed number of columns.
    judged = measures.crossJoin(F.broadcast(language_references(measures)))
    guard = lambda limit, width: limit + width / F.sqrt(F.col("n_words"))
    scored = F.array_min(
        F.array(
            *[
                F.when(
                    (F.col(f"n_{lang}") > 0) & (F.col("n_words") > 0),
                    F.greatest(
                        char_distance(lang) / guard(CHAR_LIMIT, CHAR_GUARD),
                        word_distance(lang) / guard(WORD_LIMIT, WORD_GUARD),
                    ),
                )
                for lang in COMMON_WORDS
            ]
        )
    )
    uncovered = F.coalesce((F.col("lang") != "") & ~F.col("lang").isin(*COMMON_WORDS), F.lit(False))
    return judged.withColumn("excess", scored).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (uncovered | F.coalesce(F.col("excess") <= 1, F.lit(True)))).alias("kept"),
        "excess",
    )


def op7_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("excess")
