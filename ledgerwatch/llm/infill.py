"""Fill-in-the-middle transformation by a wavelet matrix over character classes (operator 13).

A text of n units is cut after two counts of units into prefix, middle and suffix, which are put together
with marks in an order that lets a model learn to fill in. Units are code points
(``char``) or words (``word``). Every byte of the texts gets a class that tells the byte's part in a
character and the character's place in a word; a wavelet matrix over the classes of a slice
of rows answers how many bytes of a class lie before any place. Ranks of the classes that begin a unit
add up to the count of units; bisection on it finds both cuts of all rows at once, as
byte offsets, and the texts are cut there without decoding.

Which cut, and which form, comes from a hash of the key alone (and of a seed), so a row is
transformed alike wherever it is computed.

Defined cases: null and empty texts stay empty, in the form ``plain``; a text that holds a
mark stays plain, as it could not be restored; null keys count as an empty name; rows with
equal keys get the same hash; an empty table gives no rows; other columns are left out.
Texts are cut whole: a row of over 4 MB is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.wavelet import WaveletMatrix
from ledgerwatch.llm.words import BLANK, slices, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
TRANSFORMED, SUFFIX_FIRST = 90, 20  # in 100

#: classes of bytes: inside a character; white space; in a word, one byte or the first of several; the same at a word's start
INSIDE, SPACE, LETTER, WIDE, FIRST_LETTER, FIRST_WIDE = range(6)
#: classes whose bytes begin a unit
UNITS = {"char": (SPACE, LETTER, WIDE, FIRST_LETTER, FIRST_WIDE), "word": (FIRST_LETTER, FIRST_WIDE)}

_KIND = np.array([INSIDE if 0x80 <= i < 0xC0 else SPACE if BLANK[i] else LETTER if i < 0x80 else WIDE for i in range(256)], np.uint8)


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that lie one after another."""
    kind = _KIND[data]
    fresh = np.ones(len(kind) + 1, bool)  # a text begins, or white space is before
    fresh[1:-1] = kind[:-1] == SPACE
    fresh[offsets] = True
    return np.where(fresh[:-1] & (kind >= LETTER), kind + 2, kind).astype(np.uint8)


def cut_places(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the byte offsets of its two cuts.

    ``first`` and ``second`` are hashes: the cuts come after ``hash % (units + 1)`` units each, the smaller first.
    """
    kinds, tree = UNITS[unit], WaveletMatrix(byte_classes(data, offsets))
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    units = tree.ranks(kinds, start, stop)
    cuts = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    low, high = (np.where(c > 0, tree.furthest(kinds, start, stop, c), start) for c in cuts)
    return units, low, high


def key_hashes(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "char") -> DataFrame:
    """key, n (units), form, prefix_units, middle_units (null if plain), output (the text as it is trained on)."""
    slim = docs.select(docs[key], F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(key_hashes(docs[key], seed))])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                data, offsets = text_buffers(texts)
                h = [part.column(i).to_numpy() for i in range(2, 6)]
                units, low, high = cut_places(data, offsets, h[0], h[1], unit)
                plain = (units == 0) | (h[2] % 100 >= TRANSFORMED) | (offsets[1:] == offsets[:-1])
                for mark in marks:
                    plain |= pc.match_substring(texts, mark.decode()).to_numpy(zero_copy_only=False)
                suffix_first = h[3] % 100 < SUFFIX_FIRST
                body, out = data.tobytes(), []
                for i, (s, x, y, e) in enumerate(zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True)):
                    pre, mid, suf = body[s:x], body[x:y], body[y:e]
                    if plain[i]:
                        out.append(body[s:e])
                    elif suffix_first[i]:
                        out.append(b"".join((marks[1], suf, marks[0], pre, marks[2], mid)))
                    else:
                        out.append(b"".join((marks[0], pre, marks[1], suf, marks[2], mid)))
                first, both = np.sort(np.stack([h[0] % (units + 1), h[1] % (units + 1)]), axis=0)
                form = np.where(plain, PLAIN, np.where(suffix_first, SPM, PSM))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(units), pa.array(form.tolist(), pa.string()), pa.array(first, mask=plain), pa.array(both - first, mask=plain), pa.array(out, pa.binary()).view(pa.string())],
                    [key, "n", "form", "prefix_units", "middle_units", "output"],
                )

    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation. No text that was transformed holds a mark, so the marks part it exactly."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)
