"""Quality rules by repetition coverage (operator 4).

Rolling hashes of word windows of several lengths, in numpy, tell which windows of a text
occur twice; the characters of words inside such windows, and of repeated lines, are
measured against all characters in words. A text is rejected when any share is too high.

Defined cases: null and blank texts have no words and every measure 0, and fail the base
rule; rows with equal ids or texts are judged one by one; an empty table gives no rows;
columns other than the text are carried along or ignored. Texts are read whole: the work
is split at rows of about 4 MB, a longer text is a piece of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerwatch.llm.frames import per_slice
from ledgerwatch.llm.words import BLANK, Words, by_row, repeated, span_hashes, words_of

MIN_WORDS = 50
MAX_REPEAT = 0.5  # words in repeated 3-word windows
#: window length -> largest share of word characters inside windows that occur twice
MAX_COVERAGE = {5: 0.35, 6: 0.33, 8: 0.30, 10: 0.27}
MAX_LINE_CHARS = 0.30  # characters of words on lines that occur before
MAX_LINES = 0.35  # lines that occur before
MAX_SYMBOLS = 0.10  # symbols per word

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def covered(words: Words, n: int) -> np.ndarray:
    """For each word whether it lies in a window of ``n`` words that its text holds twice."""
    first, keys = words.windows(n)
    twice = first[repeated(by_row(keys, words.rows[first]))]
    change = np.zeros(len(words.rows) + 1, np.int32)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + n, -1)
    return np.cumsum(change[:-1]) > 0


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, repeated-or-not and line number per word, of the lines that hold a word."""
    breaks = np.flatnonzero(words.data == 10)
    edges = np.unique(np.concatenate([words.offsets, breaks, breaks + 1]))
    owner = np.searchsorted(edges, words.starts, "right") - 1  # the line of each word
    lines, line_of_word = np.unique(owner, return_inverse=True)
    starts = edges[lines]
    ends = edges[lines + 1] if len(lines) else starts
    rows = np.searchsorted(words.offsets, starts, "right") - 1
    keys = by_row(span_hashes(words.data, starts, ends), rows)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return rows, again, line_of_word


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text of a column."""
    w = words_of(column)
    n_rows = w.n_rows
    letters = (w.data & 0xC0) != 0x80  # first byte of each code point
    chars_before = np.concatenate([[0], np.cumsum(letters & ~BLANK[w.data])])
    symbols_before = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    word_chars = np.diff(chars_before[w.offsets])
    size = chars_before[w.ends] - chars_before[w.starts]
    rows, again, line_of_word = lines_of(w)
    out = {
        "n_words": w.per_row().astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": np.diff(symbols_before[w.offsets]),
        "n_lines": np.bincount(rows, minlength=n_rows),
        "n_dup_lines": np.bincount(rows, again, minlength=n_rows).astype(np.int64),
        "dup_line_chars": w.per_row(size * again[line_of_word]).astype(np.int64),
        "n_repeat_words": w.per_row(covered(w, 3)).astype(np.int64),
    }
    for n in MAX_COVERAGE:
        out[f"dup_{n}gram_chars"] = w.per_row(size * covered(w, n)).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rule, and which are kept."""
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
    bad = (m["dup_line_chars"] > MAX_LINE_CHARS * m["word_chars"]) | (m["n_dup_lines"] > MAX_LINES * m["n_lines"])
    bad |= m["n_symbols"] > MAX_SYMBOLS * m["n_words"]
    for n, most in MAX_COVERAGE.items():
        bad |= m[f"dup_{n}gram_chars"] > most * m["word_chars"]
    return failed, ~failed & ~bad


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "dup_line_chars", *[f"dup_{n}gram_chars" for n in MAX_COVERAGE]]


def repetition_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, measures, ``base_failed``, ``kept``, then the method's own measures."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(1))
        failed, kept = judge(m)
        names = [key, *MEASURES, "base_failed", "kept", *EXTRA]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(m[c]) for c in MEASURES], pa.array(failed), pa.array(kept), *[pa.array(m[c]) for c in EXTRA]], names
        )

    slim = docs.select(docs[key], docs[text].cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    longs = lambda names: ", ".join(f"{c} bigint" for c in names)
    return slim.mapInArrow(per_slice(work, "_text"), f"`{key}` {kind}, {longs(MEASURES)}, base_failed boolean, kept boolean, {longs(EXTRA)}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(measure(batch.column(batch.schema.get_field_index(text))))[1]))

    return docs.mapInArrow(per_slice(work, text), docs.schema)
