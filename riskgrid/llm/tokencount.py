"""Token counts of documents without encoding documents.

Method: the corpus' distinct pre-tokens are encoded once each and only their
piece counts kept; documents become pre-token frequencies, which join the piece
counts and sum. The most frequent pre-tokens, a bounded number, go to the tasks
as a broadcast table; all others join through a shuffle, so the work is exact
whatever the vocabulary's size.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches, documents, save, table

LIMIT = 512
#: Most entries of the broadcast table, and characters from which a pre-token stands in it by its MD5: its size is bounded whatever the corpus.
HEAD_ROWS = 250_000
HEAD_CHARS = 64
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 150_000

_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Outside these ranges Unicode versions may class a character differently, and the library itself splits the text.
_UNUSUAL = re.compile("[^\u0000-ԯḀ-ỿ‐-⁞₠-₿←-⏳─-⛿ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]")


def pre_tokens(text: str, tokenizer: str = tokens.DEFAULT) -> list[str]:
    """Pre-tokens of a text that holds no special string, as the library splits it."""
    if text.isascii() or not _UNUSUAL.search(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in tokens.library(tokenizer).pre_tokenizer.pre_tokenize_str(text)]


def counted(text: str, tokenizer: str = tokens.DEFAULT) -> tuple[Counter, int]:
    """Pre-token frequencies of a text and the number of special strings in it."""
    special = [x for x in tokens.special_tokens(tokenizer) if x in text]
    if not special:
        return Counter(pre_tokens(text, tokenizer)), 0
    parts = re.split("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text)
    found: Counter = Counter()
    for part in parts:
        found.update(pre_tokens(part, tokenizer))
    return found, len(parts) - 1


SEEN = pa.schema([("token", pa.string()), ("n", pa.int64())])
PIECES = pa.schema([("token", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])
ROWS = pa.schema([("row", pa.int64()), ("token", pa.string()), ("n", pa.int64()), ("known", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])


def vocabulary(docs: DataFrame, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Distinct pre-tokens of all texts with their frequency and number of pieces: token, n, pieces."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(counted(text, tokenizer)[0] if text else ())
                if len(found) > HELD:
                    yield table(SEEN, [list(found), list(found.values())])
                    found = Counter()
        yield table(SEEN, [list(found), list(found.values())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokens.library(tokenizer).encode_batch_fast
        for batch in batches:
            made = encode(batch.column(0).to_pylist(), add_special_tokens=False)
            yield table(PIECES, [batch.column(0), batch.column(1), [len(x.ids) for x in made]])

    distinct = docs.select("text").mapInArrow(seen, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(encoded, "token string, n long, pieces long")


def _short(token: str) -> str:
    """A pre-token as the broadcast table knows it."""
    return token if len(token) <= HEAD_CHARS else "\0" + hashlib.md5(token.encode()).hexdigest()


def head(vocab: DataFrame, rows: int = HEAD_ROWS) -> tuple[dict[str, int], DataFrame]:
    """(piece counts of the most frequent pre-tokens, at most ``rows`` of them; the rest of the vocabulary).

    Long pre-tokens, such as a line of dashes that every document has, stand in
    the table by a digest, so frequent ones never go through the join.
    """
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in vocab.groupBy(step.alias("step")).count().collect()}
    least, total = math.inf, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > rows:
            break
        least = at
    if least == math.inf:
        return {}, vocab
    short = F.when(F.length("token") <= HEAD_CHARS, F.col("token")).otherwise(F.concat(F.lit("\0"), F.md5(F.encode("token", "UTF-8"))))
    return {r["token"]: r["pieces"] for r in vocab.filter(step >= int(least)).select(short.alias("token"), "pieces").collect()}, vocab.filter(step < int(least))


def count_tokens(docs: DataFrame, tokenizer: str = tokens.DEFAULT, limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text (doc_id, text; null: empty): doc_id, n_bytes, n_tokens, over_limit.

    Rows are counted one by one, so equal or null doc_ids stay apart.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent, rest = head(save(vocabulary(docs, tokenizer)))
    known_pieces = spark.sparkContext.broadcast(frequent)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known_pieces.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                found, known = counted(text or "", tokenizer)
                names, numbers = [], []
                for token, n in found.items():
                    if (k := pieces.get(token if len(token) <= HEAD_CHARS else _short(token))) is None:
                        names.append(token)
                        numbers.append(n)
                    else:
                        known += n * k
                if not names:
                    names, numbers = [f"\0{row}"], [0]  # no pre-token mixes these, so it joins with nothing
                more = [None] * (len(names) - 1)
                for column, values in zip(out, ([row] * len(names), names, numbers, [known, *more], [doc_id, *more], [len((text or "").encode()), *more])):
                    column += values
            yield table(ROWS, list(out))

    rows = docs.mapInArrow(frequencies, "row long, token string, n long, known long, doc_id long, n_bytes long")
    n = F.coalesce("known", F.lit(0)) + F.col("n") * F.coalesce("pieces", F.lit(0))
    summed = rows.join(rest.select("token", "pieces"), "token", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
