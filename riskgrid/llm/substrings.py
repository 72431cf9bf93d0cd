"""Repeated-passage removal across documents.

Method: De Bruijn compaction of a sparse token graph. Minimizers pick token
k-mers by content so that each ``window`` of words holds one; the k-mers are
nodes and the stretches of words from one to the next are edges. Nodes that only
one document has are dropped. Where a node's stretch to the next node is the
same at all its occurrences the path doesn't branch, and such runs compact to
one path, whose windows all start in the same documents. So one row a path, and
one a window only where paths begin, branch and end, go into the search for the
smallest document. Each repeat is verified against its source by a hash of
another family over the words at both coordinates; fetching the source's words
themselves would move all texts a third time, which the disk bound rules out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, documents, drop, save, table

WINDOW = 50
#: Words of a node.
NODE = 8

_ODD = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_HEAD, _TAIL = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as many as the longest text so far needs."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)]))
        return self.up, self.down


_POWERS = _Powers(_ODD)


class Hashed:
    """Word hashes of a text with hashes of any stretch of its words."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        self.text = words
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        up, self._down = _POWERS.upto(self.n + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * up[: self.n])])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for arrays of starts and ends, from prefix sums."""
        return _mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64) * np.uint64(_MIX[0]))

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XXH3 of the words themselves, joined by one space."""
        joined, at, xxh3 = b" ".join(self.text), np.zeros(self.n + 1, np.int64), xxhash.xxh3_64_intdigest
        np.cumsum(np.fromiter(map(len, self.text), np.int64, self.n) + 1, out=at[1:])
        return np.fromiter((xxh3(joined[a:b]) for a, b in zip(at[start].tolist(), (at[end] - 1).tolist())), np.uint64, len(start))


def _slid(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    best, have = x, 1
    pick = np.minimum if least else np.maximum
    while have < width:
        step = min(have, width - have)
        best = pick(best[: len(best) - step], best[step:])
        have += step
    return best


def nodes(text: Hashed, window: int = WINDOW, node: int = NODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are smallest in a window, and each window's smallest; none in texts below a window."""
    if text.n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.arange(text.n - node + 1)
    h = text.stretch(at, at + node)
    width = window - node + 1
    low = _slid(h, width, True)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_slid(padded, width, False) == h)
    return chosen, h[chosen], low


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


NODES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("node", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("check", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _row():
    """Tells rows of a repeated doc_id with different texts apart."""
    return F.xxhash64("text")


def graph_nodes(docs: DataFrame, window: int, node: int) -> DataFrame:
    """One row for each node of each text with the hashes of the stretches before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, found = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False), []
            for k, text in enumerate(batch.column("text").to_pylist()):
                hashed = Hashed(_split(text))
                at, h, _ = nodes(hashed, window, node)
                if len(at):
                    starts, ends = np.concatenate([[0], at]), np.concatenate([at + node, [hashed.n]])
                    between = hashed.stretch(starts, ends)
                    between[0] ^= _HEAD
                    between[-1] ^= _TAIL
                    found.append((k, at, h, between[:-1], between[1:]))
            if found:
                of = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                at, h, before, after = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3, 4))
                yield table(NODES, [pa.array(ids[of], pa.int64()), pa.array(rows[of], pa.int64()), pa.array(at.astype(np.int32)), *(pa.array(_signed(x)) for x in (h, before, after))])

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", _row().alias("row"), "text").mapInArrow(run, "doc_id long, row long, at int, node long, before long, after long")


def compacted(at: np.ndarray, goes_on: np.ndarray, came_from: np.ndarray, follows: np.ndarray, n: int, node: int) -> list[tuple[int, int]]:
    """Spans (start, end) of nonbranching paths over a text's repeated nodes in order of position.

    ``follows`` says that a node is the next one of the text after the one
    before it, ``goes_on`` and ``came_from`` that its stretch after and before
    is the same wherever it occurs. A path that no branch ends reaches to the
    text's own begin or end.
    """
    spans, first = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or not (follows[k] and goes_on[k - 1] and came_from[k]):
            spans.append((int(at[first]), int(at[k - 1]) + node))
            first = k
    return spans


def spans_of(hashed: Hashed, at: np.ndarray, flags: np.ndarray, window: int, node: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of what one text looks up: its paths, and the windows outside them whose smallest node is repeated.

    A window's smallest k-mer is a node wherever the window stands, while its
    other nodes also depend on the words around it.
    """
    chosen, hashes, low = nodes(hashed, window, node)
    order = np.searchsorted(chosen, at)
    follows = np.concatenate([[False], np.diff(order) == 1])
    paths = compacted(at, (flags & 1) > 0, (flags & 2) > 0, follows, hashed.n, node)
    if len(at) and order[0] == 0 and flags[0] & 2:
        paths[0] = (0, paths[0][1])
    if len(at) and order[-1] == len(chosen) - 1 and flags[-1] & 1:
        paths[-1] = (paths[-1][0], hashed.n)
    paths = [(a, b) for a, b in paths if b - a >= window]
    starts = np.arange(hashed.n - window + 1)
    open_ = np.isin(low, hashes[order])
    for a, b in paths:
        open_[a : b - window + 1] = False
    single = starts[open_]
    begin = np.concatenate([np.array([a for a, _ in paths], np.int64), single])
    size = np.concatenate([np.array([b - a for a, b in paths], np.int64), np.full(len(single), window)])
    return begin, size


def lookups(docs: DataFrame, marked: DataFrame, window: int, node: int) -> DataFrame:
    """Rows (doc_id, row, start, size, key, check) of the texts that hold repeated nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, row, text, at, flags in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "at", "flags"))):
                hashed = Hashed(_split(text))
                order = np.argsort(at)
                begin, size = spans_of(hashed, np.array(at)[order], np.array(flags)[order], window, node)
                if len(begin):
                    found.append((np.full(len(begin), doc_id), np.full(len(begin), row), begin.astype(np.int32), size.astype(np.int32), _signed(hashed.stretch(begin, begin + size)), _signed(hashed.digest(begin, begin + size))))
            if found:
                yield table(SPANS, [pa.array(np.concatenate([f[i] for f in found])) for i in range(6)])

    return docs.select("doc_id", _row().alias("row"), "text").join(marked, ["doc_id", "row"]).select("doc_id", "row", "text", "at", "flags").mapInArrow(run, "doc_id long, row long, start int, size int, key long, check long")


def repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """Spans of words that also stand in a document with a smaller doc_id: doc_id, row, spans array<struct<start, size, source>>, source that doc_id."""
    arrow_batches(docs.sparkSession)
    found = save(graph_nodes(docs, window, node))
    seen = found.groupBy("node").agg(*(f(c).alias(f"{c}_{n}") for c in ("doc_id", "before", "after") for f, n in ((F.min, "a"), (F.max, "b"))))
    same = lambda c, bit: F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), bit).otherwise(0)
    repeated = save(seen.filter(F.col("doc_id_a") < F.col("doc_id_b")).select("node", (same("after", 1) + same("before", 2)).alias("flag")))
    marked = save(
        found.select("doc_id", "row", "at", "node").join(repeated, "node").groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("at", "flag")).alias("x")).select("doc_id", "row", F.col("x.at").alias("at"), F.col("x.flag").alias("flags"))
    )
    drop(found)
    wanted = save(lookups(docs, marked, window, node))
    first = wanted.groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last"))
    source = save(first.drop("last"))
    return (
        wanted.join(source, ["key", "check"]).filter(F.col("first") < F.col("doc_id"))
        .groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "size", F.col("first").alias("source"))).alias("spans"))
    )


def _covered(n: int, spans: list[dict] | None) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["start"]] += 1
        change[s["start"] + s["size"]] -= 1
    return np.cumsum(change[:n]) > 0


def with_repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """Each document's row as a struct ``r``, so that its columns may have any names, with the ``spans`` of words to remove (null: none)."""
    found = save(repeats(docs, window, node)).select(F.col("doc_id").alias("d"), F.col("row").alias("h"), "spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    return rows.join(found, (F.col("r.doc_id") == F.col("d")) & (F.xxhash64("r.text") == F.col("h")), "left").select("r", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """Remove each word of a window that also starts in a smaller doc_id: doc_id, n_words, n_removed, kept_sha256.

    Null texts have no words. Rows without doc_id keep all words and are no
    source; rows of equal doc_id are no source of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = _split(text)
                gone = _covered(len(words), spans)
                kept = b" ".join(w for w, x in zip(words, gone.tolist()) if not x) if spans else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield table(RESULT, [batch.column("doc_id"), *(zip(*rows) if rows else [[]] * 3)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_repeats(docs, window, node).select("r.doc_id", "r.text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """The documents' rows with repeated passages cut out of ``text``.

    A text that loses words is its kept words joined by one space (empty if
    none is left); all other texts, null among them, stay as they are.
    """
    n, at = len(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                if spans:
                    words = _split(text)
                    text = b" ".join(w for w, x in zip(words, _covered(len(words), spans).tolist()) if not x).decode()
                out.append(text)
            yield batch.select(list(range(n))).set_column(at, "text", pa.array(out, pa.string()))

    spans = "spans"
    while spans in map(str.lower, docs.columns):
        spans += "_"
    return with_repeats(docs, window, node).select("r.*", F.col("spans").alias(spans)).mapInArrow(run, docs.schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


ORACLE_OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT g.doc_id, g.i FROM g JOIN f USING (k) WHERE f.first < g.doc_id), unnest(range(0, 50)) AS t(o)),
a AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT a.doc_id, string_agg(a.words[a.i], ' ' ORDER BY a.i) AS kept, count(*) AS n FROM a ANTI JOIN r ON a.doc_id = r.doc_id AND a.i = r.i GROUP BY a.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
