"""Repeated passages of words, found by super-k-mer partitioning.

Consecutive windows of words that share a minimiser travel as one packed string
to the minimiser's bucket; there the windows are sorted and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loometry.llm.arrays import NOT_SPACE, covered, ranges, span_hashes, tidy, words
from loometry.llm.repeats import Bucket, Scheme, original_columns, unzipped, window_starts, with_windows

WINDOW = 35
#: Words of a minimiser.
K = 6


def word_symbols(raw: np.ndarray, borders: np.ndarray):
    starts, ends, cuts = words(raw, borders, NOT_SPACE)
    return span_hashes(raw, starts, ends), cuts, starts, ends


def count_windows(bucket: Bucket, size: int = WINDOW) -> np.ndarray:
    """Sort all windows of a bucket; those that occur more than once repeat."""
    symbols, cuts, _, _ = word_symbols(bucket.raw, bucket.borders)
    first = ranges(cuts[:-1], bucket.counts)
    d1, d2 = (span_hashes(symbols, first, first + size, i) for i in (0, 1))
    weight = np.repeat(1 + bucket.multi, bucket.counts)
    order = np.lexsort((d2, d1))
    new = np.ones(len(order), bool)
    new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], at)
    again = np.empty(len(order), bool)
    again[order] = np.repeat(total > 1, np.diff(np.append(at, len(order))))
    return again


SCHEME = Scheme(WINDOW, K, True, word_symbols, count_windows)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """All columns plus ``_kept``: ``n_words``, ``n_removed``, ``text`` (the kept words
    joined by one space) and ``sha256`` of that text.

    A word goes if a window of 35 words that covers it starts anywhere else too, in
    another document or in this one. All copies of a text of 35 words or more go, the
    first included. Shorter texts, null and empty ones lose nothing. Repeated rows are
    copies of each other.
    """
    both = with_windows(documents, SCHEME)

    def cut(batches):
        for batch in batches:
            empty, copies, cells = (batch.column(i).to_pylist() for i in (1, 3, 4))
            for lo, hi, raw, borders in unzipped(batch.column(2)):
                starts, ends, cuts = words(raw, borders, NOT_SPACE)
                total, gone, texts, digests = [], [], [], []
                data = raw.tobytes()
                for i in range(hi - lo):
                    a, b = int(cuts[i]), int(cuts[i + 1])
                    j = lo + i
                    if copies[j] == 1:
                        first = window_starts(cells[j])
                        out = covered(b - a, first, first + WINDOW)
                    else:
                        out = np.full(b - a, b - a >= WINDOW)
                    stay = np.flatnonzero(~out) + a
                    text = b" ".join(data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True))
                    total.append(b - a)
                    gone.append(int(out.sum()))
                    texts.append(text)
                    digests.append(hashlib.sha256(text).hexdigest())
                kept = pa.StructArray.from_arrays(
                    [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                    ["n_words", "n_removed", "text", "sha256"],
                )
                given = [None if empty[lo + i] else data[borders[i] : borders[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(given, pa.binary()).cast(pa.string()), kept], ["row", "text", "kept"]
                )

    schema = f"row {both.schema['row'].dataType.simpleString()}, text string, kept struct<n_words:long,n_removed:long,text:string,sha256:string>"
    return both.mapInArrow(tidy(cut), schema).select(*original_columns(documents), F.col("kept").alias("_kept"))
