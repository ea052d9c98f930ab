"""Ranked lexical search: every item of a table is a query against all documents.

Two passes. The first cuts the documents into slices and writes, per slice, the posting
lists of the queries' terms (document and frequency) and the documents' lengths; the
statistics of the corpus are sums over it. The second ranks every query in every slice by
a mix of two ways: the short lists are added up term at a time into accumulators; these,
as one iterator with their largest sum as its bound, and the long lists, each with its
largest contribution as bound, are then walked document at a time. Iterators whose
bounds together stay below the score to beat produce no candidates; they are only looked
up for candidates that can still get there, so that most of a long list is skipped. The
score to beat is carried from slice to slice of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loometry.llm.arrays import ALNUM, LOWER, span_hashes, text_slices, words
from loometry.session import cut_lineage

#: Bytes of query text that one pass over the documents looks for.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a slice of the index, and of words hashed at once.
SLICE = 2 << 20
#: A list is short if it holds at most this share of a slice's documents.
SHORT_SHARE = 16
#: Documents walked between two looks at the score to beat.
WALK = 512


class Queries:
    """Items with their terms. ``terms`` are sorted by hash; the terms of item ``i`` are
    ``cells[cuts[i]:cuts[i + 1]]``, as places in ``terms``."""

    def __init__(self, ids: list, texts: list):
        raw, borders = _bytes(texts)
        starts, ends, cuts = words(raw, borders, ALNUM)
        hashes = span_hashes(raw, starts, ends)
        self.ids = ids
        self.hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        data = raw.tobytes()
        self.terms = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        own = [np.unique(inverse[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.cells = np.concatenate([np.zeros(0, np.int64), *own])
        self.cuts = np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64)


def _bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    cells = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"".join(cells), np.uint8)
    return LOWER[raw], np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)


def query_blocks(items: DataFrame, block_bytes: int) -> Iterator[Queries]:
    """The items in blocks of bounded size; only one block is held at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        size = len((row.text or "").encode())
        if ids and held + size > block_bytes:
            yield Queries(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += size
    if ids:
        yield Queries(ids, texts)


def _found(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, queries: Queries) -> np.ndarray:
    """For each word its place among the queries' terms, or -1. Words are hashed in
    stretches of bounded size, however long a text is."""
    out = np.full(len(starts), -1, np.int64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        hashes = span_hashes(raw[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        at = np.minimum(np.searchsorted(queries.hashes, hashes), len(queries.hashes) - 1)
        same = np.flatnonzero(queries.hashes[at] == hashes)
        # The first word of each hash is compared letter by letter.
        terms, first = np.unique(at[same], return_index=True)
        for term, i in zip(terms.tolist(), (lo + same[first]).tolist(), strict=True):
            if raw[starts[i] : ends[i]].tobytes() != queries.terms[term]:
                raise ValueError("two words have the same hash")
        out[lo + same] = at[same]
        lo = hi
    return out


def _write_index(documents: DataFrame, shared) -> DataFrame:
    """One row per slice. ``ids`` and ``n`` (terms of each document) list the documents
    that hold a term of a query; list ``i`` is the next ``df[i]`` entries of ``docs``
    and ``tf`` and belongs to ``terms[i]``. ``n_docs`` and ``n_terms`` count all
    documents with a term, and their terms."""
    kind = documents.schema["doc_id"].dataType

    def run(batches):
        queries = shared.value
        for batch in batches:
            for lo, hi, raw, borders in text_slices(batch.column(1), SLICE):
                raw = LOWER[raw]
                starts, ends, cuts = words(raw, borders, ALNUM)
                n = np.diff(cuts)
                place = _found(raw, starts, ends, queries)
                at = np.flatnonzero(place >= 0)
                key, tf = np.unique(place[at] * (hi - lo) + (np.searchsorted(cuts, at, "right") - 1), return_counts=True)
                listed, docs = np.divmod(key, hi - lo)
                held, docs = np.unique(docs, return_inverse=True)
                terms, df = np.unique(listed, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(np.count_nonzero(n))], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), batch.column(0).take(pa.array(lo + held))),
                    *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((n[held], "<i8"), (terms, "<i4"), (df, "<i4"), (docs, "<i4"), (tf, "<i4"))],
                ], ["n_docs", "n_terms", "ids", "n", "terms", "df", "docs", "tf"])

    schema = f"n_docs long, n_terms long, ids array<{kind.simpleString()}>, n binary, terms binary, df binary, docs binary, tf binary"
    return cut_lineage(documents.select("doc_id", "text").mapInArrow(run, schema), "postings")


def _frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the queries stands."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(terms, "<i4")] += np.frombuffer(df, "<i4")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    counts = index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    return out


class _Slice:
    """The lists of one slice with the contribution of every entry."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        n, terms, df, docs, tf = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("n", "<i8"), ("terms", "<i4"), ("df", "<i4"), ("docs", "<i4"), ("tf", "<i4")))
        length = 10 + (90 * n * n_docs) // max(1, n_terms)
        self.score = np.repeat(weights[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[docs]))
        self.docs = docs
        self.end = np.cumsum(df)
        self.start = self.end - df
        self.bound = np.maximum.reduceat(self.score, self.start) if len(df) else np.zeros(0, np.int64)
        self.terms = terms
        self.size = len(n)
        self.edges = np.arange(0, self.size + WALK, WALK)

    def best(self, lists: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the ``k`` best of this slice
        and reach ``least``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if int(self.bound[lists].sum()) < least:
            return none
        count = self.end[lists] - self.start[lists]
        short = count * SHORT_SHARE <= self.size
        # Term at a time: the short lists become one iterator.
        sums = np.zeros(self.size, np.int64)
        for i in lists[short].tolist():
            sums[self.docs[self.start[i] : self.end[i]]] += self.score[self.start[i] : self.end[i]]
        iterators = [(int(self.bound[i]), i) for i in lists[~short].tolist()]
        if short.any():
            iterators.append((int(sums.max()), -1))
        iterators.sort()
        bounds = np.cumsum([b for b, _ in iterators])
        if bounds[-1] < least:
            return none
        edges = {i: self.start[i] + np.searchsorted(self.docs[self.start[i] : self.end[i]], self.edges) for _, i in iterators if i >= 0}
        docs_out, scores_out = none
        for w in range(len(self.edges) - 1):
            lo, hi = int(self.edges[w]), min(int(self.edges[w + 1]), self.size)
            # Those before `first` can not reach `least` even together.
            first = int(np.searchsorted(bounds, least))
            if first == len(iterators):
                break
            total = np.zeros(hi - lo, np.int64)
            for _, i in iterators[first:]:
                if i < 0:
                    total += sums[lo:hi]
                else:
                    a, b = edges[i][w], edges[i][w + 1]
                    total[self.docs[a:b] - lo] += self.score[a:b]
            docs = np.flatnonzero(total)
            total = total[docs]
            docs += lo
            for j in range(first - 1, -1, -1):
                keep = total + bounds[j] >= least
                docs, total = docs[keep], total[keep]
                if not len(docs):
                    break
                i = iterators[j][1]
                if i < 0:
                    total = total + sums[docs]
                else:
                    a, b = edges[i][w], edges[i][w + 1]
                    if a < b:
                        at = np.minimum(a + np.searchsorted(self.docs[a:b], docs), b - 1)
                        total = total + np.where(self.docs[at] == docs, self.score[at], 0)
            keep = total >= least
            docs_out, scores_out = np.concatenate([docs_out, docs[keep]]), np.concatenate([scores_out, total[keep]])
            if len(scores_out) >= k:
                least = max(least, int(np.partition(scores_out, -k)[-k]))
        keep = scores_out >= least
        return docs_out[keep], scores_out[keep]


def rank(documents: DataFrame, items: DataFrame, k: int = 10, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII in
    the whole text. With N documents that hold a term, L terms in all, n terms of a
    document, df documents that hold a term tf times: a term weighs
    ``floor(1000 ln((2N+2)/(2df+1)))``; a document's ``m`` is ``10 + 90nN div L``; a score
    sums ``weight * (10^9 tf div (1000 tf + 8m))`` over the item's distinct terms.

    Scores of 0 are left out, so items without terms (or null) have no row. Equal scores
    go by ascending doc_id, nulls last; ids that repeat stand for documents (items) of
    their own, ranked each on its own. Other columns are ignored. Empty tables give no
    rows. Items are read in blocks of ``block_bytes``, each of which is a pass over the
    documents; documents are never collected.
    """
    spark = documents.sparkSession
    kinds = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"query long, item_id {kinds[1].simpleString()}, doc_id {kinds[0].simpleString()}, score long"
    ranked = None
    base = 0
    for queries in query_blocks(items.select("item_id", "text"), block_bytes):
        first = base
        base += len(queries.ids)
        if not queries.terms:
            continue
        shared = spark.sparkContext.broadcast(queries)
        index = _write_index(documents, shared)
        n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = _frequencies(index, len(queries.terms)).tolist()
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64))
        found = index.mapInArrow(_search(shared, weights, first, n_docs, n_terms, k, kinds), schema)
        ranked = found if ranked is None else ranked.unionAll(found)
    if ranked is None:
        ranked = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search(shared, weights, first: int, n_docs: int, n_terms: int, k: int, kinds):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        queries, weight = shared.value, weights.value
        # Best first: (-score, id is null, id).
        best: list[list[tuple]] = [[] for _ in queries.ids]
        where = np.full(len(queries.terms), -1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                part = _Slice(row, weight, n_docs, n_terms)
                where[part.terms] = np.arange(len(part.terms))
                lists = where[queries.cells]
                for q in range(len(queries.ids)):
                    own = lists[queries.cuts[q] : queries.cuts[q + 1]]
                    own = own[own >= 0]
                    if not len(own):
                        continue
                    mine = best[q]
                    docs, scores = part.best(own, -mine[-1][0] if len(mine) == k else 1, k)
                    if len(docs):
                        ids = [part.ids[d] for d in docs.tolist()]
                        mine += [(-s, i is None, 0 if i is None else i) for s, i in zip(scores.tolist(), ids, strict=True)]
                        mine.sort()
                        del mine[k:]
                where[part.terms] = -1
        rows = [(q, *entry) for q, mine in enumerate(best) for entry in mine]
        yield pa.RecordBatch.from_arrays([
            pa.array([first + r[0] for r in rows], pa.int64()), pa.array([queries.ids[r[0]] for r in rows], to_arrow_type(kinds[1])),
            pa.array([None if r[2] else r[3] for r in rows], to_arrow_type(kinds[0])), pa.array([-r[1] for r in rows], pa.int64()),
        ], ["query", "item_id", "doc_id", "score"])

    return run
