"""BM25 index of short reference texts, searched with block-max WAND.

A query is the set of words of a passage. Impacts are BM25 term scores divided by the score
the entry gives itself, so one threshold fits entries of any length. ``search`` returns every
entry at or above the threshold. ``candidates`` decides for many passages at once, in numpy,
which of them can reach it at all, by the same block bounds. An entry of which a number of
words must be there has the least score of so many words as its threshold, if that is more;
its impacts are scaled to the common threshold. In ``candidates`` words whose total impact stays
below a part of the threshold in every entry are left out, and the block maxima of the others
must make up the rest.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np

from ledgerwatch.llm.words import distinct

K1, B = 1.2, 0.75
BLOCK = 2  # entries per block
SLACK = 0.4  # share of the threshold that left-out words may reach in any entry


def document_frequency(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted hashes) and in how many entries each occurs."""
    if not entries:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.unique(e) for e in entries]), return_counts=True)


class BlockMaxIndex:
    """Postings of ``entries`` (word hashes each), with statistics of the whole reference set."""

    def __init__(self, entries: list[np.ndarray], terms: np.ndarray, frequency: np.ndarray, n_all: int, mean_length: float, threshold: float, least_words: list[int] | None = None):
        self.threshold, self.n_entries = threshold, len(entries)
        self.share: list[float] = []  # of its own score that each entry asks for
        df = dict(zip(terms.tolist(), frequency.tolist(), strict=True))
        found: dict[int, list[tuple[int, float]]] = {}
        for number, words in enumerate(entries):
            own, tf = np.unique(words, return_counts=True)
            norm = K1 * (1 - B + B * len(words) / max(mean_length, 1e-9))
            score = [math.log(1 + (n_all - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in zip(own.tolist(), tf.tolist(), strict=True)]
            whole = sum(score) or 1.0
            lowest = np.sort(np.repeat(np.array(score) / tf, tf))[: least_words[number] if least_words else 0]
            self.share.append(max(threshold, float(lowest.sum()) / whole * (1 - 1e-9)))
            for t, s in zip(own.tolist(), score, strict=True):
                found.setdefault(t, []).append((number, s / whole * threshold / self.share[-1]))
        self.terms = np.array(sorted(found), np.uint64)
        lists = [found[t] for t in self.terms.tolist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.entry = np.array([e for x in lists for e, _ in x], np.int64)
        self.impact = np.array([s for x in lists for _, s in x], np.float64)
        self._blocks(sizes)
        self._essential(lists)
        # the search walks one query at a time: plain lists are faster than arrays there
        self._plain = tuple(x.tolist() for x in (self.entry, self.impact, self.term_max, self.starts))
        self._plain_blocks = tuple(x.tolist() for x in (self.block, self.block_max, self.block_starts))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def _blocks(self, sizes: np.ndarray) -> None:
        """Per term its blocks (entry number // BLOCK) and the largest impact in each."""
        term = np.repeat(np.arange(len(sizes)), sizes)
        self.n_blocks = self.n_entries // BLOCK + 1
        place = term * self.n_blocks + self.entry // BLOCK
        lead = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        self.block = (self.entry // BLOCK)[lead]
        self.block_max = np.maximum.reduceat(self.impact, lead) if len(lead) else np.zeros(0)
        self.block_starts = np.searchsorted(term[lead], np.arange(len(sizes) + 1))
        self.term_max = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(sizes) else np.zeros(0)

    def _essential(self, lists: list[list[tuple[int, float]]]) -> None:
        """The most frequent words are left out while they cannot matter much in any entry."""
        out, total = np.zeros(len(lists), bool), np.zeros(self.n_entries)
        for t in sorted(range(len(lists)), key=lambda t: -len(lists[t])):
            e, s = self.entry[self.starts[t] : self.starts[t + 1]], self.impact[self.starts[t] : self.starts[t + 1]]
            if len(e) > 1 and (total[e] + s <= SLACK * self.threshold).all():
                total[e] += s
                out[t] = True
        self.essential = ~out
        rest = np.zeros(self.n_blocks * BLOCK)
        rest[: self.n_entries] = total
        self.rest = rest.reshape(self.n_blocks, BLOCK).max(axis=1)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number per word, -1 for words outside the index."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.terms):
            maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == hashes[maybe], at, -1)
        return out

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages that may reach the threshold with some entry; one row per word of a passage.

        First by the essential words alone, then, for the passages left, by all words.
        """
        known = term >= 0
        passage, term = passage[known], term[known]
        use = self.essential[term]
        left = self._reach(passage[use], term[use], self.rest)
        use = np.isin(passage, left)
        return self._reach(passage[use], term[use], np.zeros(self.n_blocks))

    def _reach(self, passage: np.ndarray, term: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Passages with a block whose summed maxima and ``rest`` reach the threshold."""
        if not len(term):
            return np.zeros(0, np.int64)
        n = len(self.terms)
        pair = distinct(passage * n + term)
        p, t = pair // n, pair % n
        counts = self.block_starts[t + 1] - self.block_starts[t]
        owner = np.repeat(np.arange(len(t)), counts)
        at = self.block_starts[t][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = p[owner] * self.n_blocks + self.block[at]
        order = np.argsort(place, kind="stable")
        place, bound = place[order], self.block_max[at][order]
        lead = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        most = np.add.reduceat(bound, lead) + rest[place[lead] % self.n_blocks]
        return distinct(place[lead][most >= self.threshold - 1e-9] // self.n_blocks)

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Every entry whose score for the query (term numbers) reaches the threshold: block-max WAND."""
        entry, impact, term_max, starts = self._plain
        cursors = [[entry[starts[t]], starts[t], starts[t + 1], t] for t in np.unique(terms[terms >= 0]).tolist()]
        least, hits = self.threshold - 1e-9, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += term_max[c[3]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            lists = cursors[: pivot + 1]
            if sum(self._block_bound(c[3], target // BLOCK) for c in lists) < least:
                # nothing before the end of this block, or before the next list begins, can reach it
                skip = (target // BLOCK + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    skip = min(skip, cursors[pivot + 1][0])
                target = max(skip, target + 1)
            elif cursors[0][0] == target:
                score = sum(impact[c[1]] for c in lists)
                if score >= least:
                    hits.append((target, score))
                target += 1
            ended = False
            for c in lists:
                c[1] = bisect_left(entry, target, c[1], c[2])
                if c[1] < c[2]:
                    c[0] = entry[c[1]]
                else:
                    ended = True
            if ended:
                cursors = [c for c in cursors if c[1] < c[2]]
        return hits

    def _block_bound(self, term: int, block: int) -> float:
        blocks, most, starts = self._plain_blocks
        i = bisect_left(blocks, block, starts[term], starts[term + 1])
        return most[i] if i < starts[term + 1] and blocks[i] == block else 0.0
