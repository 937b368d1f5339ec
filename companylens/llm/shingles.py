"""Word shingles of texts as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from companylens.llm.kernels import LOWER, mix, powers, prefix_sums, span_hashes, word_spans

WORDS = 5
_STEP = 0xD6E8FEB86659FD93


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, words: int = WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct shingles, ascending by row and hash.

    A-Z are lower-cased. A text with fewer words than a shingle has its whole word
    sequence as its only one; a text without words has none.
    """
    n = len(offsets) - 1
    lowered = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(prefix_sums(lowered), starts, ends)
    weights = powers(_STEP, words)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]

    at = np.arange(len(rows)) - first[rows]
    whole = np.flatnonzero(at + words <= count[rows])
    values = np.zeros(len(whole), np.uint64)
    for k in range(words):
        values += hashes[whole + k] * weights[k]
    short = np.flatnonzero((count > 0) & (count < words))
    extra = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        has = count[short] > k
        extra[has] += hashes[first[short[has]] + k] * weights[k]
    # The number of words keeps a short sequence apart from a full shingle.
    extra += count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)

    owner = np.concatenate((rows[whole], short))
    values = mix(np.concatenate((values, extra)))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def common_counts(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int
) -> np.ndarray:
    """Size of the intersection of left and right sets with the same row number."""
    rows = np.concatenate((left[0], right[0]))
    values = np.concatenate((left[1], right[1]))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    same = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
    return np.bincount(rows[1:][same], minlength=n)
