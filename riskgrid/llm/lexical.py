"""Ranked lexical search over all documents.

Method: hybrid of term-at-a-time and document-at-a-time. Documents are taken in
segments; in each, the lists of a query's rare terms are summed into
accumulators, which then act as one more iterator with a bound, and the long
lists are walked beside it block of documents by block. A block whose bounds
can't reach the query's lowest kept score is skipped; in the others only the
lists that can still lift a document over that score bring candidates, and the
rest are looked up for candidates that may still get there.

The texts are read once for each block of queries (QUERY_BYTES of text; the
terms of one block go to every task): every document leaves the counts of the
queries' terms, and the statistics cover all documents. Each task keeps the best
of each query, and the tasks' results meet by query.

A null text, or one without a term, is no document; such a query has no result.
Rows with equal or null ids rank separately (null ids last among equal scores);
equal or null item ids are separate queries. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, documents, numbered, save, table, texts

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TOP = 20
#: Bytes of query texts in a block.
QUERY_BYTES = 4 << 20
#: Counts of terms and documents that a segment holds, about; documents of a block.
POSTINGS, SEGMENT, BLOCK = 2_000_000, 65_536, 2_048
#: A list is short up to this part of the segment's documents.
SHORT_PART = 32
#: Bytes from which a text's terms are counted one by one instead of listed first.
LONG_TEXT = 4 << 20
#: Stands for a null id in the ranking.
LAST = np.iinfo(np.int64).max


def terms(text: str) -> Counter[bytes]:
    """Counts of the terms: ASCII letters and digits and all other code points above ASCII; only A-Z are lower-cased."""
    data = text.encode().lower()
    return Counter(TERM.findall(data) if len(data) < LONG_TEXT else (m.group() for m in TERM.finditer(data)))


class Segment:
    """Inverted lists of some documents, in the order of their ids, with the largest share of each list in each block."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.ids, n = ids, len(ids)
        share = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[owner])
        order = np.lexsort((owner, term))
        term, self.docs, self.share = term[order], owner[order], share[order]
        self.blocks = -(-n // BLOCK)
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        self.span = dict(zip(term[at].tolist(), zip(at.tolist(), np.r_[at[1:], len(term)].tolist())))
        self.edges = np.arange(self.blocks + 1) * BLOCK
        self.tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a list's blocks begin, and the largest share in each."""
        if term not in self.tops:
            a, b = self.span[term]
            at = a + np.searchsorted(self.docs[a:b], self.edges)
            top = np.zeros(self.blocks, np.int64)
            full = np.flatnonzero(at[:-1] < at[1:])
            top[full] = np.maximum.reduceat(self.share[a:b], at[:-1][full] - a)
            self.tops[term] = at, top
        return self.tops[term]

    def search(self, query: list[tuple[int, int]], best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``best`` and this segment for a query of (term, weight)."""
        n = len(self.ids)
        found = [(t, w) for t, w in query if w > 0 and t in self.span]
        short = {t for t, _ in found if self.span[t][1] - self.span[t][0] <= max(1, n // SHORT_PART)}
        summed = np.zeros(self.blocks * BLOCK, np.int64)
        for t, w in found:
            if t in short:
                a, b = self.span[t]
                summed[self.docs[a:b]] += w * self.share[a:b]
        long = [(t, w, *self.bounds(t)) for t, w in found if t not in short]
        tops = np.array([summed.reshape(-1, BLOCK).max(axis=1), *(w * top for _, w, _, top in long)])
        least = best[0][-1] if len(best[0]) >= k else 1
        for block in np.flatnonzero(tops.sum(axis=0) >= least).tolist():
            top = tops[:, block]
            if top.sum() < least:
                continue
            rank = np.argsort(top, kind="stable")
            reach = np.cumsum(top[rank])
            passive = int(np.searchsorted(reach, least))  # lists that together stay below the lowest kept score
            base, part = block * BLOCK, np.zeros(BLOCK, np.int64)
            for i in rank[passive:].tolist():
                if i == 0:
                    part += summed[base : base + BLOCK]
                else:
                    _, w, at, _ = long[i - 1]
                    a, b = at[block], at[block + 1]
                    part[self.docs[a:b] - base] += w * self.share[a:b]
            near = np.flatnonzero(part)
            for i in rank[:passive][::-1].tolist():
                near = near[part[near] + reach[np.flatnonzero(rank == i)[0]] >= least]
                if not len(near):
                    break
                if i == 0:
                    part[near] += summed[base + near]
                else:
                    _, w, at, _ = long[i - 1]
                    a, b = at[block], at[block + 1]
                    if a < b:
                        place = np.minimum(a + np.searchsorted(self.docs[a:b], base + near), b - 1)
                        part[near] += np.where(self.docs[place] == base + near, w * self.share[place], 0)
            near = near[part[near] >= least]
            if len(near):
                scores, ids = np.r_[best[0], part[near]], np.r_[best[1], self.ids[base + near]]
                keep = np.lexsort((ids, -scores))[:k]
                best = scores[keep], ids[keep]
                least = best[0][-1] if len(keep) >= k else 1
        return best


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Counts of the vocabulary's terms in each document with a term: doc_id, n (all its terms), term, tf (arrays)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                counts = terms(text)
                if counts:
                    hit = counts.keys() & known
                    out.append((key, counts.total(), [vocabulary[t] for t in hit], [counts[t] for t in hit]))
            yield table(schema, list(zip(*out)) if out else [[], [], [], []])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int, int | None, str]]]:
    """The queries as (number, item_id, text) in blocks of about QUERY_BYTES of text, each of which fits on the driver."""
    sized = items.select(F.col("item_id").cast("long"), "text").withColumn("_size", (F.octet_length("text") + 64).cast("long"))
    placed = save(numbered(sized, "item_id", "text", size="_size")).withColumn("_block", F.floor(F.col("_before") / QUERY_BYTES))
    for block in range((placed.agg(F.max("_block")).first()[0] or 0) + 1):
        yield [(r["_at"], r["item_id"], r["text"] or "") for r in placed.filter(F.col("_block") == block).collect()]


def _ranked(docs: DataFrame, block: list[tuple[int, int | None, str]], k: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of the block's queries."""
    asked = [(number, terms(text)) for number, _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, q in asked for t in q}))}
    counted = save(postings(docs, vocabulary))
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(map(tuple, counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect()))
    weight = {i: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for i, c in df.items()}
    queries = [(number, [(vocabulary[t], weight[vocabulary[t]] * c) for t, c in q.items() if vocabulary[t] in weight]) for number, q in asked]
    queries = [(number, q) for number, q in queries if q]
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: (np.empty(0, np.int64), np.empty(0, np.int64)) for number, _ in queries}
        held: list[tuple] = []

        def close() -> None:
            ids, lengths = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            sizes = np.concatenate([x[2] for x in held])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = 75 + (25 * lengths * n) // total
            segment = Segment(ids[order], np.repeat(place, sizes), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), m[order])
            for number, q in queries:
                best[number] = segment.search(q, best[number], k)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                term, tf = batch.column("term"), batch.column("tf")
                held.append((
                    np.array(batch.column("doc_id").fill_null(int(LAST)), np.int64), np.array(batch.column("n"), np.int64), np.array(term.value_lengths(), np.int64),
                    np.array(term.flatten(), np.int64), np.array(tf.flatten(), np.int64),
                ))
            if sum(len(x[3]) for x in held) >= POSTINGS or sum(len(x[0]) for x in held) >= SEGMENT:
                close()
        if held:
            close()
        for number, (scores, ids) in best.items():
            if len(scores):
                yield table(schema, [np.full(len(ids), number), pa.array(ids, pa.int64(), mask=ids == LAST), scores])

    return counted.mapInArrow(search, "query long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents (doc_id, text) of every item (item_id, text): item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    out = None
    for block in query_blocks(items):
        names = spark.createDataFrame([(number, item) for number, item, _ in block], "query long, item_id long")
        top = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        part = _ranked(docs, block, k).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        part = part.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_OP12 = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low WHERE text IS NOT NULL),
worded AS (SELECT d, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM worded),
tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM worded) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT q.item_id, s.doc_id, sum(q.times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * s.n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN dfs USING (term) JOIN tfs USING (term) JOIN worded s USING (d) CROSS JOIN stats GROUP BY q.item_id, s.d, s.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
