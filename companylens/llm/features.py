"""Text features for the classifiers, computed for a block of texts at a time."""

from __future__ import annotations

import numpy as np

from companylens.llm.kernels import LOWER, mix, prefix_sums, span_hashes, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FIRST = np.ones(256, bool)  # first byte of a character
_FIRST[0x80:0xC0] = False
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?"]] = True

QUALITY_FEATURES = [
    "log_words",
    "word_length",
    "upper_share",
    "digit_share",
    "sign_share",
    "sentence_marks",
    "distinct_words",
    "repeated_pairs",
    "top_word",
    "adjacent_repeats",
    "words_per_line",
    "repeated_lines",
    "non_ascii_share",
    "decorated_words",
    "long_words",
    "bare_signs",
]


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and rows of the runs of letters (ASCII letters and all of non-ASCII)."""
    inside = _LETTER[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashed_terms(
    data: np.ndarray,
    offsets: np.ndarray,
    buckets: int,
    stems: tuple[int, ...],
    in_use: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct terms of each text, ascending; only buckets in use.

    Terms are lower-cased runs of letters and, for longer ones, their first ``stems`` bytes,
    so that inflected forms share terms.
    """
    lowered = LOWER[data]
    starts, ends, rows = letter_runs(lowered, offsets)
    sums = prefix_sums(lowered)
    owners, terms = [rows], [span_hashes(sums, starts, ends)]
    for kind, stem in enumerate(stems):
        longer = ends - starts > stem
        owners.append(rows[longer])
        stemmed = span_hashes(sums, starts[longer], starts[longer] + stem)
        terms.append(mix(stemmed + np.uint64(0x5851F42D4C957F2D * (kind + 1) % (1 << 64))))
    owner = np.concatenate(owners)
    bucket = (np.concatenate(terms) >> np.uint64(20)).astype(np.int64) % buckets
    if in_use is not None:
        keep = in_use[bucket]
        owner, bucket = owner[keep], bucket[keep]
    both = np.unique(owner * buckets + bucket)
    return both // buckets, both % buckets


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def quality_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of QUALITY_FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda mask: np.bincount(row_of[mask], minlength=n)
    inked = ~_SPACE[data]
    first = _FIRST[data] & inked
    chars = count(first)
    letters = count(_LETTER[data] & first)
    lowered = LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets)
    words = np.bincount(rows, minlength=n)
    sums = prefix_sums(lowered)
    hashes = span_hashes(sums, starts, ends)

    def repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each row, and the count of its most frequent one."""
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(v)))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, o[at], runs)
        return np.bincount(o[at], minlength=n), top

    distinct, top = repeats(hashes, rows)
    inner = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, np.int64)
    pair_hashes = mix(hashes[inner] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[inner + 1])
    pairs = np.bincount(rows[inner], minlength=n)
    distinct_pairs, _ = repeats(pair_hashes, rows[inner])
    adjacent = np.bincount(rows[inner][hashes[inner] == hashes[inner + 1]], minlength=n)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    used = line_ends - line_starts > 1
    lines = np.bincount(line_rows[used], minlength=n)
    line_hashes = span_hashes(sums, line_starts[used], line_ends[used])
    distinct_lines, _ = repeats(line_hashes, line_rows[used])

    alpha_starts, alpha_ends, alpha_rows = letter_runs(lowered, offsets)
    signs = inked & ~_LETTER[data] & ~_DIGIT[data]
    sign_sums = np.concatenate(([0], np.cumsum(signs)))
    in_word = sign_sums[ends] - sign_sums[starts]
    decorated = np.bincount(rows[in_word >= 2], minlength=n)
    bare = np.bincount(rows[in_word == ends - starts], minlength=n)
    long_words = np.bincount(rows[ends - starts > 15], minlength=n)
    marks = count(_SENTENCE[data])
    return np.column_stack(
        [
            np.log1p(words),
            _share(chars, words),
            _share(count(_UPPER[data]), letters),
            _share(count(_DIGIT[data]), chars),
            _share(count(signs), chars),
            _share(marks, words),
            _share(distinct, words),
            1 - _share(distinct_pairs, pairs) * (pairs > 0) - (pairs == 0),
            _share(top, words),
            _share(adjacent, words),
            np.log1p(_share(words, lines)),
            1 - _share(distinct_lines, lines) * (lines > 0) - (lines == 0),
            _share(count((data >= 0xC0)), chars),
            _share(decorated, words),
            _share(long_words, words),
            _share(bare, words),
        ]
    ).astype(np.float64)
