"""Merkle manifest of a dataset with a proof for every row.

Method: pointer jumping. Every node below a root holds the sibling on its way to
its parent; joining the table of nodes with itself doubles the distance to the
ancestor that a node knows and concatenates the two segments of siblings, until
every leaf reaches its root. After the step that reaches 2d levels only nodes on
levels that 2d divides are read again, so the table shrinks to the leaves.

Rows of a group (lang) form a tree, the groups' roots form one above them. Leaves
are placed by a total order in ranges, so a group of any size is spread. Ties of
the key follow the leaf's digest; equal rows are equal leaves. A null key comes
first in its group and is never tampered with; the null group comes first. An
empty table has an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, save, ship_package

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one task climbs within a block of nodes.
HEIGHT = 8
#: Bytes of ancestors' segments up to which they go to every task.
SENT_BYTES = 16 << 20


def row_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and the value; ``-`` where it is null."""
    one = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*one), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def climber(height: int):
    """Nodes of each block's ``height`` levels with their siblings, and the node on top of it (``top``)."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                g, level, n, first, digests = row["g"], row["level"], row["n"], row["block"] << height, row["digests"]
                for _ in range(height):
                    if n == 1:
                        break
                    out += ((g, level, first + i, n, digests[i ^ 1] if i ^ 1 < len(digests) else None, False) for i in range(len(digests)))
                    pairs = [b"".join(x.hex().encode() for x in digests[i : i + 2]) for i in range(0, len(digests), 2)]
                    digests, level, first, n = [sha(x).digest() for x in pairs], level + 1, first >> 1, (n + 1) >> 1
                out.append((g, level, first, n, digests[0], True))
            names, types = ("g", "level", "idx", "n", "digest", "top"), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    return climb


def tree(leaves: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots (g, level, idx, segment: their sibling, null for a lone one) and roots (g, root).

    ``leaves`` has g, pos, n (leaves of the group) and digest; ``largest`` is
    the largest n. A block is at most 2^HEIGHT nodes.
    """
    at = leaves.select("g", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", "digest")
    schema = "g string, level int, idx long, n long, digest binary, top boolean"
    found = []
    while True:
        blocks = at.groupBy("g", "level", "n", F.shiftright("idx", HEIGHT).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).getField("digest").alias("digests"))
        climbed = save(blocks.mapInArrow(climber(HEIGHT), schema))
        found.append(climbed)
        largest = math.ceil(largest / 2**HEIGHT)
        if largest <= 1:
            break
        at = climbed.filter("top and n > 1").drop("top")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.filter("not top").select("g", "level", "idx", F.array("digest").alias("segment")), every.filter("top and n = 1").select("g", F.col("digest").alias("root"))


def jump(nodes: DataFrame, leaves: int, largest: int) -> DataFrame:
    """Siblings from every leaf to its root (g, idx, segment), by doubling; ``leaves`` is the number of all leaves."""
    height, d = max(0, math.ceil(math.log2(max(1, largest)))), 1
    while d < height:
        above = nodes.filter(F.col("level") % (2 * d) == d).select("g", (F.col("level") - d).alias("level"), F.col("idx").alias("_up"), F.col("segment").alias("_rest"))
        if (leaves / 2**d * 1.5 + height) * (32 * d + 64) <= SENT_BYTES:  # no more nodes than that stand on these levels
            above = F.broadcast(above)
        here = nodes.filter(F.col("level") % (2 * d) == 0).withColumn("_up", F.shiftright("idx", d) if d < 63 else F.lit(0).cast("long"))
        joined = here.join(above, ["g", "level", "_up"], "left")
        nodes = save(joined.select("g", "level", "idx", F.concat("segment", F.coalesce("_rest", F.array().cast("array<binary>"))).alias("segment")))
        d *= 2
    return nodes.filter("level = 0").select("g", "idx", "segment")


def prove(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (g, digest and others) with their place in their group (pos) and the siblings up to its root (segment), and the roots (g, root)."""
    ship_package(rows.sparkSession)
    placed = numbered(rows, "g", *order)
    groups = save(placed.groupBy("g").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("n")))
    largest, leaves, count = groups.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    few = F.broadcast(groups) if count <= 10_000 else groups
    located = placed.join(few, "g").withColumn("pos", F.col("_at") - F.col("_start")).drop("_at", "_before", "_part", "_start")
    nodes, roots = tree(located, largest or 0)
    found = jump(nodes, leaves or 0, largest or 0).withColumnRenamed("idx", "pos")
    return located.join(found, ["g", "pos"], "left").withColumn("segment", F.coalesce("segment", F.array().cast("array<binary>"))).drop("n"), save(roots)


def fold(digest: Column, segment: Column, pos: Column) -> Column:
    """Hex digest that a leaf's hex digest and its siblings lead to."""
    steps = F.transform(segment, lambda s, i: F.struct(hexed(s).alias("s"), F.getbit(pos, i).alias("right")))
    own = lambda a, x: F.when(x["s"].isNull(), a).when(x["right"] == 1, F.concat(x["s"], a)).otherwise(F.concat(a, x["s"]))
    return F.aggregate(steps, digest, lambda a, x: F.sha2(own(a, x), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row: doc_id, leaf, changed (digest of the tampered row, else null), subroot, root, siblings (array of hex), pos, segment, group_pos, group_segment."""
    doc, n = F.col("doc_id"), F.col("n_chars")
    fields = [F.col(c) for c in FIELDS]
    tampered = [(n.cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = (F.crc32(doc.cast("string").cast("binary")) % 7 == 0) & n.isNotNull()
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), row_digest(*fields).alias("digest"), F.when(hit, row_digest(*tampered)).alias("changed"))
    proved, subroots = prove(rows, "doc_id", "digest")
    above, root = prove(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("root").alias("digest")), "group")
    few = save(above.select(F.col("group").alias("g"), F.col("digest").alias("subroot"), F.col("pos").alias("group_pos"), F.col("segment").alias("group_segment")))
    few = F.broadcast(few) if few.count() <= 10_000 else few
    joined = proved.join(few, "g").crossJoin(F.broadcast(root.select("root")))
    siblings = F.transform(F.filter(F.concat("segment", "group_segment"), lambda s: s.isNotNull()), hexed)
    return joined.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("changed")).alias("changed"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), siblings.alias("siblings"), "pos", "segment", "group_pos", "group_segment")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(documents(spark, sf_dir))
    folded = fold(fold(F.coalesce("changed", "leaf"), F.col("segment"), F.col("pos")), F.col("group_segment"), F.col("group_pos"))
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_OP13 = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM f),
places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
lv AS (
  SELECT g, 0 AS level, pos AS idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM places
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2) FROM lv WHERE n > 1 GROUP BY g, level, idx // 2),
sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM lv WHERE n = 1),
top AS (
  SELECT 0 AS level, pos AS idx, subroot AS digest, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, idx // 2),
crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT)), lambda c, x:
    list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
walk AS (
  SELECT p.doc_id, p.g, p.leaf, p.pos, 0 AS k, coalesce(CASE WHEN xor(c.v, 4294967295::BIGINT) % 7 = 0 THEN p.changed END, p.leaf) AS cur, '' AS proof FROM places p LEFT JOIN crc c USING (doc_id)
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.pos, w.k + 1,
    sha256(CASE WHEN s.digest IS NULL THEN cur WHEN (w.pos >> w.k) % 2 = 1 THEN s.digest || cur ELSE cur || s.digest END), proof || coalesce(s.digest, '')
  FROM walk w JOIN lv o ON o.g = w.g AND o.level = w.k AND o.idx = w.pos >> w.k AND o.n > 1 LEFT JOIN lv s ON s.g = w.g AND s.level = w.k AND s.idx = xor(w.pos >> w.k, 1)),
reached AS (SELECT w.*, h.subroot, h.pos AS gpos FROM walk w JOIN (SELECT g, max(level) AS height FROM lv GROUP BY g) x ON x.g = w.g AND x.height = w.k JOIN sub h ON h.g = w.g),
walk2 AS (
  SELECT doc_id, g, pos, leaf, subroot, gpos, 0 AS k, cur, proof FROM reached
  UNION ALL
  SELECT w.doc_id, w.g, w.pos, w.leaf, w.subroot, w.gpos, w.k + 1,
    sha256(CASE WHEN s.digest IS NULL THEN cur WHEN (w.gpos >> w.k) % 2 = 1 THEN s.digest || cur ELSE cur || s.digest END), proof || coalesce(s.digest, '')
  FROM walk2 w JOIN top o ON o.level = w.k AND o.idx = w.gpos >> w.k AND o.n > 1 LEFT JOIN top s ON s.level = w.k AND s.idx = xor(w.gpos >> w.k, 1))
SELECT w.doc_id, w.leaf, w.subroot, r.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.digest AS verified
FROM walk2 w JOIN (SELECT * FROM top WHERE n = 1) r ON r.level = w.k
"""
