"""Benchmark decontamination by template windows, with Spark functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed
placeholders, so a question keeps its template when its parameters are changed. Windows of
``WORDS`` tokens are hashed; a document's windows meet those of the benchmark in a hash join.
An item is found in a document if ``SHARE`` percent of its distinct windows are there and the
slots agree: along one alignment of both, the same value in the item must always stand for
the same value in the document.

A capitalised word that begins a text, sentence, line, quote or bracket is a name or a common
word. Windows that hold one are hashed twice, with the word and with a name in its place, and
count as found by either hash.

Items that are shorter than a window, or have no window with plain words, are also looked for
word by word: by windows of all their words and numbers as they stand, ``WORDS`` or the
item's own length.

The benchmark is broadcast if its measured size allows it; else the windows are shuffled. Per
document work is a scan; only documents that share enough windows are read a second time for
their slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.llm.quality_rules import bound
from companylens.llm.rows import ROW, WHOLE, with_rows, with_whole_rows
from companylens.operators.distributed import fits_broadcast, materialize

WORDS = 5
SHARE = 80
# Windows need so many plain words; others say nothing.
LITERALS = 2

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds "
    "ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro "
    "euros cent cents percent degree degrees mph kmh watt watts volt volts"
).split()

# A marker that texts hold only by accident, then the type: p name, n number, u unit, s word
# with a capital where a sentence may begin.
# A look ahead comes first: most places fail there, before a costlier look behind.
# Groups that repeat are possessive (``*+``, ``++``): the others take stack for each repeat, and a
# text with some thousand names or numbers in a row ends the executor.
MARK = "\x01"
_NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}[\p{L}'’-]*"
# With the names right after it, so that names of different length fit the same slot.
_START = (
    r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}" + MARK + r"])(?<![\p{L}\p{N}]['’-])"
    r"(\p{Lu}\p{Ll}[\p{L}'’-]*)(?: +" + MARK + r"p[\p{L}'’-]+)*+"
)
_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*+"
_UNIT = "(" + MARK + r"n[0-9.,]+) +(" + "|".join(UNITS) + r")\b"
_BETWEEN = r"(?:(?![.,][0-9])[^\p{L}\p{N}" + MARK + "])++"


_S = MARK + "s"
# Code of no token.
_NONE = -1


def template_tokens(text: Column) -> Column:
    """Lower-case tokens; placeholders are MARK, type and value. None for a null.

    Of neighbouring placeholders of one type the first stays, so that names of different
    length fit the same slot. Words where a sentence may begin all stay.
    """
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" ")), _NAME, f" {MARK}p$0 ")
    marked = F.regexp_replace(marked, _START, f" {MARK}s$1 ")
    marked = F.regexp_replace(F.lower(marked), _NUMBER, f" {MARK}n$0 ")
    marked = F.regexp_replace(marked, _UNIT, f"$1 {MARK}u$2")
    tokens = F.filter(F.split(marked, _BETWEEN), lambda t: t != "")

    def once(all_tokens: Column) -> Column:
        def stays(token: Column, i: Column) -> Column:
            same = F.left(F.get(all_tokens, i - 1), F.lit(2)) == F.left(token, F.lit(2))
            return ~(token.startswith(MARK) & ~token.startswith(_S) & F.coalesce(same, F.lit(False)))

        return F.filter(all_tokens, stays)

    return bound(tokens, once)


def _type_code(token: Column) -> Column:
    return -F.ascii(F.substring(token, 2, 1)).cast("long")


def _code(token: Column) -> Column:
    """Number of a token's template: below 0 for a placeholder's type, else hash of the word.

    A word where a sentence may begin is that word.
    """
    word = F.when(token.startswith(_S), F.substring(token, 3, 1 << 30)).otherwise(token)
    hashed = F.shiftrightunsigned(F.xxhash64(word), 1)
    return F.when(~token.startswith(MARK) | token.startswith(_S), hashed).otherwise(_type_code(token))


def _named_code(token: Column, code: Column) -> Column:
    """As ``_code``, but such a word is a name."""
    return F.when(token.startswith(_S), _type_code(F.lit(MARK + "p"))).otherwise(code)


def _enough_words(codes: list[Column], n_tokens: Column) -> Column:
    plain = reduce(lambda a, b: a + b, ((c >= 0).cast("int") for c in codes))
    return plain >= F.least(F.lit(LITERALS), n_tokens)


def _codes_at(codes: str, at: Column, words: int) -> list[Column]:
    """The codes of a window; beyond the end of a shorter text ``_NONE``."""
    return [F.coalesce(F.get(codes, at + k), F.lit(_NONE)) for k in range(words)]


def _begins(words: int) -> Column:
    """Where windows begin. Fewer tokens than a window make one window of all of them."""
    last = F.greatest(F.size("codes") - words, F.lit(0))
    return F.when(F.size("codes") > 0, F.sequence(F.lit(0), last))


def _tokenised(table: DataFrame, key: str) -> DataFrame:
    """key, tokens, and their codes: ``codes``, and ``named`` with names where sentences begin."""
    tokens = table.select(key, template_tokens(F.col("text").cast("string")).alias("tokens"))
    coded = tokens.select(key, "tokens", F.transform("tokens", _code).alias("codes"))
    return coded.select(key, "tokens", "codes", F.zip_with("tokens", "codes", _named_code).alias("named"))


def _places(rows: DataFrame, key: str, at: str, words: int) -> DataFrame:
    """(key, at, window, tokens, hash): a row for each window and hash; ``window`` is its first hash.

    Hashes are taken of rows, one for each window, since Spark compiles these but interprets
    functions over the elements of an array. All that is left of the text in a row that leaves
    this pass are the window's tokens.
    """
    kept = [f"code{k}" for k in range(words)]
    named = [f"named{k}" for k in range(words)]
    rows = rows.select(key, "tokens", "codes", "named", F.explode(_begins(words)).alias(at)).select(
        key,
        at,
        F.slice("tokens", F.col(at) + 1, words).alias("tokens"),
        F.size("codes").alias("n_tokens"),
        *[c.alias(n) for c, n in zip(_codes_at("codes", F.col(at), words), kept)],
        *[c.alias(n) for c, n in zip(_codes_at("named", F.col(at), words), named)],
    )
    changed = reduce(lambda a, b: a | b, (F.col(a) != F.col(b) for a, b in zip(kept, named)))
    first = F.when(_enough_words([F.col(c) for c in kept], F.col("n_tokens")), F.xxhash64(*kept))
    second = F.when(changed & _enough_words([F.col(c) for c in named], F.col("n_tokens")), F.xxhash64(*named))
    rows = rows.select(key, at, "tokens", first.alias("window"), second.alias("named"))
    rows = rows.select(key, at, "window", "tokens", F.explode(F.array("window", "named")).alias("hash"))
    return rows.where(F.col("hash").isNotNull())


def benchmark_windows(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(item, window, hash, at, n_windows, item_tokens) of the benchmark, a row for each window and hash."""
    rows = _places(_tokenised(benchmark, "item"), "item", "at", words).withColumnRenamed("tokens", "item_tokens")
    totals = rows.groupBy("item").agg(F.count_distinct("window").alias("n_windows"))
    return rows.join(totals, "item")


def exact_words(text: Column) -> Column:
    """Lower-case words and numbers as they stand."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda t: t != "")


def _exact_windows(tokens: Column, length: Column | int) -> Column:
    """Hashes of all windows of ``length`` words, with the length."""
    n = F.size(tokens)
    size = F.lit(length) if isinstance(length, int) else length
    hashed = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(size, F.slice(tokens, i + 1, size)))
    return F.when((n >= size) & (size > 0), hashed).otherwise(F.array().cast("array<bigint>"))


def find_exact(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(row, item, n_windows, n_found, n_slots) for items without a full window of two plain words."""
    full = lambda i: _enough_words(_codes_at("codes", i, words), F.size("codes"))
    whole = (F.size("tokens") >= words) & F.exists(_begins(words), full)
    tokens = _tokenised(benchmark, "item").where(~whole).select("item").join(benchmark, "item")
    tokens = tokens.select("item", exact_words(F.col("text").cast("string")).alias("tokens")).where(F.size("tokens") > 0)
    length = F.least(F.size("tokens"), F.lit(words))
    table = materialize(
        tokens.select("item", length.alias("length"), F.array_distinct(_exact_windows(F.col("tokens"), length)).alias("hash"))
        .select("item", "length", F.size("hash").alias("n_windows"), F.explode("hash").alias("hash")),
        "exact-windows",
    )
    # Lengths from 1 to ``words``.
    lengths = sorted(r["length"] for r in table.select("length").distinct().collect())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "row long, item long, n_windows int, n_found long, n_slots int")
    small = fits_broadcast(table)
    scanned = docs.select("row", exact_words(F.col("text").cast("string")).alias("tokens"))
    scanned = scanned.select("row", F.array_distinct(F.concat(*[_exact_windows(F.col("tokens"), n) for n in lengths])).alias("hash"))
    return (
        _meet(scanned.select("row", F.explode("hash").alias("hash")), table, small)
        .groupBy("row", "item", "n_windows")
        .agg(F.count("*").alias("n_found"))
        .where(100 * F.col("n_found") >= share * F.col("n_windows"))
        .select("row", "item", "n_windows", "n_found", F.lit(0).alias("n_slots"))
    )


def _meet(windows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    return windows.join(F.broadcast(table) if small else table, "hash")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: int = SHARE
) -> DataFrame:
    """(row, item, n_windows, n_found, n_slots) for each document row with an item in it.

    ``docs`` has a unique ``row`` and a text, ``benchmark`` a unique ``item`` and a text. Null
    or empty texts hold nothing and are held by nothing. An item with fewer tokens than a
    window, or without two plain words in any, is found where its words and numbers stand,
    and by its template only in texts with just its tokens. One without words is never found.
    """
    exact = find_exact(docs, benchmark, words, share)
    table = materialize(benchmark_windows(benchmark, words), "benchmark-windows")
    small = fits_broadcast(table)
    distinct = table.select("item", "window", "hash", "n_windows").distinct()
    enough = 100 * F.col("n_found") >= share * F.col("n_windows")

    scanned = _places(_tokenised(docs, "row"), "row", "place", words).select("row", "hash")
    candidates = materialize(
        _meet(scanned, distinct, small)
        .groupBy("row", "item", "n_windows")
        .agg(F.count_distinct("window").alias("n_found"))
        .where(enough)
        .select("row", "item"),
        "candidates",
    )

    # Second look: the aligned slots of those documents.
    again = docs.join(candidates.select("row").distinct(), "row")
    places = _places(_tokenised(again, "row"), "row", "place", words).drop("window")
    aligned = _meet(places, table, small).join(candidates, ["row", "item"], "left_semi")
    # A word where a sentence may begin stands for the same as a name elsewhere.
    same = lambda tokens: F.transform(
        tokens, lambda t: F.when(t.startswith(_S), F.concat(F.lit(MARK + "p"), F.substring(t, 3, 1 << 30))).otherwise(t)
    )
    pairs = F.filter(
        F.arrays_zip(same(F.col("item_tokens")).alias("theirs"), same(F.col("tokens")).alias("ours")),
        lambda p: p["theirs"].startswith(MARK) & p["ours"].startswith(MARK),
    )
    aligned = materialize(
        aligned.select("row", "item", "n_windows", "window", (F.col("place") - F.col("at")).alias("shift"), pairs.alias("slots")),
        "aligned",
    )
    conflicts = (
        aligned.select("row", "item", "shift", F.explode("slots").alias("slot"))
        .groupBy("row", "item", "shift", F.col("slot.theirs").alias("theirs"))
        .agg(F.min("slot.ours").alias("low"), F.max("slot.ours").alias("high"))
        .groupBy("row", "item", "shift")
        .agg(
            F.max((F.col("low") != F.col("high")).cast("int")).alias("conflict"),
            F.count("*").alias("n_slots"),
        )
    )
    templates = (
        aligned.select("row", "item", "n_windows", "window", "shift")
        .join(conflicts, ["row", "item", "shift"], "left")
        .where(F.coalesce("conflict", F.lit(0)) == 0)
        .groupBy("row", "item", "n_windows")
        .agg(
            F.count_distinct("window").alias("n_found"),
            F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"),
        )
        .where(enough)
        .select("row", "item", "n_windows", "n_found", "n_slots")
    )
    return templates.unionByName(exact.join(templates.select("row", "item"), ["row", "item"], "left_anti"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_found and n_slots for each item found in a document.

    Rows with null or repeated ids, in either table, are documents or items of their own.
    Other columns are ignored. Empty tables give an empty result.
    """
    docs = with_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    docs = docs.withColumnRenamed(ROW, "row")
    items = with_rows(benchmark.select("item_id", F.col("text").cast("string").alias("text")), "item_id")
    items = items.withColumnRenamed(ROW, "item")
    found = find_contamination(docs.select("row", "text"), items.select("item", "text"))
    return (
        found.join(docs.select("row", "doc_id"), "row")
        .join(items.select("item", "item_id"), "item")
        .select("doc_id", "item_id", "n_windows", "n_found", "n_slots")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any benchmark item, with all their columns."""
    keyed = with_whole_rows(docs)
    items = with_rows(benchmark.select("item_id", "text"), "item_id").withColumnRenamed(ROW, "item")
    found = find_contamination(
        keyed.select(F.col(ROW).alias("row"), "text"),
        items.select("item", "text"),
    )
    gone = found.select(F.col("row").alias(ROW)).distinct()
    return keyed.join(gone, ROW, "left_anti").select(f"{WHOLE}.*")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contaminated_documents(read("documents"), read("benchmark"))
