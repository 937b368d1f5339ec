"""Text expressions: whitespace, accents, match keys, legal markers, labels.

Everything here is ``Column -> Column`` and stays on the JVM side, inside the
same projection as the columns it feeds.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from companylens.schema import NO_SHAREHOLDER_SENTENCE

# Unicode white space, with the four separator controls, wherever it is not
# already one plain space.
WHITESPACE = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]"
NON_ASCII = r"[^\x00-\x7F]"
HANGUL = r"[\x{AC00}-\x{D7A3}]"

# Adverse markers, tested in this order on accent-free upper text;
# status, a word that every match contains, pattern.
LEGAL_MARKERS = [
    ("in_liquidation", "LIQUIDACION", r"(?U)\bEN\s+LIQUIDACION\b"),
    ("in_dissolution", "DISOLUCION", r"(?U)\bEN\s+DISOLUCION\b"),
    ("extinct", "EXTINGUID", r"(?U)\bEXTINGUID[AO]S?\b"),
]
# The same markers, in the order they are cut from match keys.
CUT_MARKERS = [
    r"\bEXTINGUID[AO]S?\b",
    r"\bEN\s+LIQUIDACION\b",
    r"\bEN\s+DISOLUCION\b",
]


def normalize_whitespace(value: Column) -> Column:
    """Collapse white space runs to one space and trim; null stays null."""
    return F.trim(F.regexp_replace(value, WHITESPACE, " "))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, list[str]]:
    """Unicode compatibility decompositions without their combining marks.

    Dropping the marks makes the decomposition a per-character mapping, so it
    can be tabled: one-to-one pairs (with pure marks at the end, which
    ``translate`` deletes) and the few one-to-many ones. Hangul syllables
    follow a rule and are not tabled.
    """
    single, marks, many = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if not plain:
            marks.append(char)
        elif len(plain) == 1:
            single.append((char, plain))
        else:
            many[char] = plain
    source = "".join(c for c, _ in single) + "".join(marks)
    target = "".join(p for _, p in single)
    return source, target, "".join(many), list(many.values())


def _expand_character(char: Column) -> Column:
    """Accent-free form of one character that decomposes into several."""
    _, _, keys, values = _accent_tables()
    # A foldable array literal: position of the character -> its expansion.
    expansions = F.split(F.lit("\u0001".join(values)), "\u0001")
    position = F.instr(F.lit(keys), char)
    # Hangul syllable = 0xAC00 + (lead * 21 + vowel) * 28 + tail.
    leads, vowels, tails = (
        F.lit("".join(map(chr, range(start, start + count))))
        for start, count in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
    )
    offset = F.ascii(char) - 0xAC00
    tail = offset % 28
    hangul = F.concat(
        F.substring(leads, F.floor(offset / 588).cast("int") + 1, F.lit(1)),
        F.substring(vowels, F.floor(offset % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(tail > 0, F.substring(tails, tail, F.lit(1))).otherwise(""),
    )
    return (
        F.when(char.rlike(HANGUL), hangul)
        .when(position > 0, F.element_at(expansions, position))
        .otherwise(char)
    )


def remove_accents(value: Column) -> Column:
    """NFKD without combining marks.

    Plain ASCII text, the common case, only pays one pattern test.
    """
    source, target, expandable, _ = _accent_tables()
    translated = F.translate(value, source, target)
    expanded = F.array_join(F.transform(F.split(translated, ""), _expand_character), "")
    has_expandable = (F.translate(value, expandable, "") != value) | value.rlike(HANGUL)
    return F.when(
        value.rlike(NON_ASCII),
        F.when(has_expandable, expanded).otherwise(translated),
    ).otherwise(value)


def _letters_and_digits(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[^A-Z0-9]+", " "))


def normalize_company_name(value: Column) -> Column:
    """Upper-case, accent-free name with punctuation turned into spaces."""
    return name_key(plain_upper(value))


def plain_upper(value: Column) -> Column:
    """White-space normalised, accent-free, upper-case text."""
    return F.upper(remove_accents(normalize_whitespace(value)))


def name_key(plain: Column) -> Column:
    """Normalised name from ``plain_upper`` text."""
    return _letters_and_digits(plain)


def legal_status(plain: Column) -> Column:
    """First adverse marker in ``plain_upper`` text; null gives ``unknown``."""
    status = F.when(plain.isNull(), "unknown")
    for label, word, pattern in LEGAL_MARKERS:
        status = status.when(plain.contains(word) & plain.rlike(pattern), label)
    return status.otherwise("no_adverse_marker")


def extract_legal_status(value: Column) -> Column:
    """Legal status marker carried by a raw company name."""
    return legal_status(plain_upper(value))


def strip_legal_markers(key: Column) -> Column:
    """Normalised name without adverse markers.

    The markers are cut one after the other: a cut can join words into the
    next marker. Names without any marker word stay as they are.
    """
    marked = F.lit(False)
    for _, word, _ in LEGAL_MARKERS:
        marked = marked | key.contains(word)
    cut = key
    for pattern in CUT_MARKERS:
        cut = F.regexp_replace(cut, pattern, " ")
    return F.when(marked, F.trim(F.regexp_replace(cut, " {2,}", " "))).otherwise(key)


def create_company_match_key(value: Column) -> Column:
    """Duplicate-candidate key of a raw company name."""
    return strip_legal_markers(normalize_company_name(value))


def clean_shareholder(value: Column) -> Column:
    """Shareholder text, with the register's placeholder turned into null."""
    return F.nullif(normalize_whitespace(value), F.lit(NO_SHAREHOLDER_SENTENCE))


def normalize_geographic_text(value: Column) -> Column:
    """Upper-case place label with accents kept; blank becomes null."""
    return F.upper(F.nullif(normalize_whitespace(value), F.lit("")))


def create_municipality_match_key(value: Column) -> Column:
    """Accent-free, punctuation-free comparison key of a place label."""
    return municipality_key(normalize_geographic_text(value))


def municipality_key(label: Column) -> Column:
    """Comparison key from an already normalised place label."""
    return _letters_and_digits(remove_accents(label))


def percent_label(value: Column, signed: bool = False) -> Column:
    """``0.12`` as ``12.0%`` or ``+12.0%``."""
    return F.format_string("%+,.1f%%" if signed else "%,.1f%%", value * 100)


def thousands_label(value: Column) -> Column:
    """``1234.5`` as ``€1,234.5k``."""
    return F.format_string("€%,.1fk", value)


def percentile_label(value: Column) -> Column:
    """``0.95`` as ``P95``; the percentage is truncated, not rounded."""
    return F.concat(F.lit("P"), (value * 100).cast("int").cast("string"))
