"""Subword lattice of words: all segmentations into vocabulary pieces, weighted by unigram scores.

A word is read with a leading word-start mark. Forward sums (in log space) give the marginal
probability of the word over its segmentations; forward and backward sums give expected piece
counts. A character outside the vocabulary is spelt in byte pieces. Words of one length are
worked on together, one numpy operation per (end, piece length).
"""

from __future__ import annotations

import numpy as np

MARK = "▁"
LONGEST = 16  # characters of the longest piece used
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BITS = 21
NONE = -np.inf


class Vocabulary:
    """Pieces of a sentencepiece model: hash table, byte pieces, and rank-based initial scores."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.end = pieces.index("</s>")
        self.bytes = np.array([pieces.index(f"<0x{i:02X}>") for i in range(256)])
        special = {0, 1, 2, *self.bytes.tolist()}
        usable = [i for i, p in enumerate(pieces) if i not in special and 0 < len(p) <= LONGEST]
        self.size = len(pieces)
        keys = np.array([self._key(pieces[i]) for i in usable], np.uint64)
        slots = 1 << _BITS
        self.slot_key, self.slot_piece = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        for k, i in zip(keys, usable, strict=True):
            at = self._slot(k)
            while self.slot_piece[at] >= 0:  # the next free place; lookups try as many
                at = (at + 1) % slots
            self.slot_key[at], self.slot_piece[at] = k, i
        # the existing scores are ranks: a piece of rank r starts with weight 1 / (r + 100)
        weight = 1.0 / (np.arange(self.size) + 100.0)
        self.start = np.log(weight / weight.sum())

    @classmethod
    def load(cls, file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())])

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = 0
        for ch in piece:
            h = (h * int(_BASE) + ord(ch) + 1) % (1 << 64)
        return np.uint64(h)

    @staticmethod
    def _slot(keys):
        with np.errstate(over="ignore"):
            return ((keys * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece per key, -1 for none."""
        at = self._slot(keys)
        out = self.slot_piece[at]
        wrong = np.flatnonzero((out >= 0) & (self.slot_key[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slot_piece)
            out[wrong] = self.slot_piece[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.slot_key[at[wrong]] != keys[wrong])]
        return out


class _Group:
    """Words of one length: pieces and scores of every (start, length)."""

    def __init__(self, vocabulary: Vocabulary, letters: np.ndarray, scores: np.ndarray):
        m, n = letters.shape
        self.m, self.n = m, n
        up = np.ones(n + 1, np.uint64)
        up[1:] = _BASE
        up = np.cumprod(up, dtype=np.uint64)
        h = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            h[j + 1] = h[j] * _BASE + letters[:, j].astype(np.uint64) + np.uint64(1)
        self.pieces, self.scores, self.spelt = [], [], None
        for size in range(1, min(n, LONGEST) + 1):
            found = vocabulary.find((h[size:] - h[:-size] * up[size]).ravel()).reshape(n - size + 1, m)
            score = np.where(found >= 0, scores[found], NONE)
            if size == 1:
                score = self._spell(vocabulary, letters.T, found, score, scores)
            self.pieces.append(found)
            self.scores.append(score)

    def _spell(self, vocabulary, letters, found, score, scores):
        missing = found < 0
        if missing.any():
            chars, back = np.unique(letters[missing], return_inverse=True)
            spelt = [vocabulary.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
            score[missing] = np.array([scores[s].sum() for s in spelt])[back]
            self.spelt = (missing, back, spelt)
        return score

    def forward(self) -> np.ndarray:
        a = np.full((self.n + 1, self.m), NONE)
        a[0] = 0
        for end in range(1, self.n + 1):
            for size in range(1, min(end, LONGEST) + 1):
                np.logaddexp(a[end], a[end - size] + self.scores[size - 1][end - size], out=a[end])
        return a

    def expected(self, weights: np.ndarray, total: np.ndarray, vocabulary: Vocabulary) -> None:
        """Add the expected piece counts of words with these weights to ``total``."""
        a = self.forward()
        b = np.full((self.n + 1, self.m), NONE)
        b[self.n] = 0
        for start in range(self.n - 1, -1, -1):
            for size in range(1, min(self.n - start, LONGEST) + 1):
                np.logaddexp(b[start], b[start + size] + self.scores[size - 1][start], out=b[start])
        for size, (found, score) in enumerate(zip(self.pieces, self.scores, strict=True), 1):
            share = np.exp(a[: self.n - size + 1] + score + b[size:] - a[self.n]) * weights
            use = found >= 0
            total += np.bincount(found[use], share[use], minlength=len(total))
            if size == 1 and self.spelt:
                missing, back, spelt = self.spelt
                per_char = np.bincount(back, share[missing], minlength=len(spelt))
                for pieces, s in zip(spelt, per_char, strict=True):
                    np.add.at(total, pieces, s)


def _groups(words: list[str]):
    """(indices, code points with the mark) of words of one length, at most 20,000 at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for index in np.split(order, cuts):
        if not len(index):
            continue
        n = int(sizes[index[0]])
        step = max(1, min(20_000, 400_000 // (n + 1)))
        for at in range(0, len(index), step):
            part = index[at : at + step]
            text = "".join(words[i] for i in part.tolist())
            letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), ord(MARK), np.uint32), letters], axis=1)


def log_probabilities(words: list[str], vocabulary: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    for index, letters in _groups(words):
        out[index] = _Group(vocabulary, letters, scores).forward()[-1]
    return out


def expected_counts(words: list[str], weights: np.ndarray, vocabulary: Vocabulary, scores: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in the words, each seen ``weights`` times."""
    total = np.zeros(vocabulary.size)
    for index, letters in _groups(words):
        _Group(vocabulary, letters, scores).expected(weights[index], total, vocabulary)
    return total
