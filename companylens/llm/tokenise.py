"""Token ids of whole texts with a vocabulary file of the tokenizers library.

The vocabulary's normaliser and pre-tokeniser never join characters across ASCII white
space, nor across a change between a letter (ASCII or U+00C0 to U+00FF) and another ASCII
character that is no apostrophe. Texts are therefore cut there, each distinct piece of a block is encoded
once by the library, and the ids are gathered for all its occurrences. Texts that could
hold a special token (``<|``) are encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import public_tokenizers

from companylens.llm.kernels import IS_SPACE, LOWER, prefix_sums, ragged, span_hashes

VOCABULARY = "word_bpe_49k.json"
# Pieces remembered by a worker; beyond that it starts anew.
REMEMBERED = 1_200_000
# Pieces that are encoded in one call of the library.
JOINED = 512

_KIND = np.full(256, 2, np.uint8)
_KIND[IS_SPACE] = 0
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[128:] = 3
_KIND[ord("'")] = 3


def _is_plain(piece: str) -> bool:
    """Surely one word or one run of signs to the pre-tokeniser."""
    return piece.isalpha() or not any(c.isalnum() or c.isnumeric() or c == "'" for c in piece)


def _kinds(data: np.ndarray) -> np.ndarray:
    """0 white space, 1 letter, 2 another ASCII character, 3 anything else."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # the signs for times and divided by
    kind[lead] = 1
    kind[lead + 1] = 1
    return kind


def vocabulary_path(name: str = VOCABULARY) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


class PieceEncoder:
    """Encodes blocks of texts and remembers the ids of pieces between blocks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        if suffix:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.array([i for ids in found for i in ids], np.int32)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of plain pieces, encoded as one text."""
        ids = np.array(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, np.int32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        # Each piece holds one closing token at least, so equal numbers mean one each.
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._one_by_one(pieces)
        return np.diff(ends, prepend=0), ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        kind = _kinds(data)
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = 0
        turn = (kind != before) & (kind + before == 3) & (kind != 3) & (before != 3)
        begins = (kind != 0) & ((before == 0) | turn)
        stops = np.zeros(len(data) + 1, bool)
        stops[:-1] = (before != 0) & ((kind == 0) | turn)
        # A text's last byte ends a piece, although the next text's first one has no "before".
        closing = offsets[1:][offsets[1:] > offsets[:-1]]
        stops[closing[kind[closing - 1] != 0]] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        rows = np.searchsorted(offsets, starts, side="right") - 1

        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        special = np.unique(np.searchsorted(offsets, marks, side="right") - 1)
        if len(special):
            keep = ~np.isin(rows, special)
            starts, ends, rows = starts[keep], ends[keep], rows[keep]

        lowered = LOWER[data]
        hashes = span_hashes(prefix_sums(lowered), starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(lowered, unique, starts[index], ends[index])
        place = np.searchsorted(self.keys, unique)
        first, count = self.first[place][inverse], self.count[place][inverse]
        ids = self.ids[ragged(first, count)]
        sizes = np.bincount(rows, weights=count, minlength=n).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        if not len(special):
            return ids, bounds
        parts = np.split(ids, bounds[1:-1])
        raw = data.tobytes()
        for i in special:
            text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
            parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _learn(self, data, unique, starts, ends) -> None:
        if len(self.keys) + len(unique) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~np.isin(unique, self.keys, assume_unique=True))
        if not len(new):
            return
        raw = data.tobytes()
        pieces = [
            raw[a:b].decode("utf-8", "replace")
            for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)
        ]
        plain = [i for i, p in enumerate(pieces) if _is_plain(p)]
        rest = sorted(set(range(len(pieces))) - set(plain))
        parts = [
            self._together([pieces[i] for i in plain[low : low + JOINED]])
            for low in range(0, len(plain), JOINED)
        ]
        parts.append(self._one_by_one([pieces[i] for i in rest]))
        counts = np.concatenate([x[0] for x in parts])
        keys = np.concatenate((self.keys, unique[new][np.array(plain + rest, np.int64)]))
        first = np.concatenate((self.first, len(self.ids) + np.cumsum(counts) - counts))
        count = np.concatenate((self.count, counts))
        ids = np.concatenate([x[1] for x in parts])
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], first[order], count[order]
        self.ids = np.concatenate((self.ids, ids))


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)
