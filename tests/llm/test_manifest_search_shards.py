"""Resharding, ranked search and the Merkle manifest against plain versions, with hostile rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskgrid.llm import common, lexical, manifest, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (7, "Ba ba black sheep", "en", "a", 17), (7, "other text of the same id", "en", "a", 25), (None, "no id", None, None, None), (None, "no id", None, None, None),
    (1, None, "en", "b", None), (2, "", "fr", None, 0), (3, "été Été É1 ба Ба", "fr", "b", 16), (14, "x " * 5000, "en", "a", 10000), (21, "Ba ba black sheep", "de", "a", 17),
    *((k, "the same copy", "en", "hot", 13) for k in range(100, 160)),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], f"{SCHEMA}, segment string, shard int").repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(digests):
    """Root and the siblings of every leaf, None for a lone one."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (doc, source, lang, n, text))))
        hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups[lang].append((doc is not None, doc or 0, leaf, doc, sha("".join(map(field, (doc, source, lang, n + 1, text)))) if hit else leaf))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, above):
        for (_, _, leaf, doc, now), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            for s, right in path + top:
                now = sha("".join([s, now] if right else [now, s] if s else [now]))
            out.append((doc, leaf, trees[g][0], root, sha("".join(s for s, _ in path + top if s)), now, now == root))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


@pytest.mark.parametrize("height, sent", [(8, 16 << 20), (1, 0), (2, 0)])
def test_manifest(spark, rows, monkeypatch, height, sent):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "SENT_BYTES", sent)
    monkeypatch.setattr(manifest, "documents", lambda *_: rows)
    assert as_rows(manifest.op13_merkle_manifest(spark, "")) == sorted(plain_manifest(ROWS), key=str)


@pytest.mark.parametrize("some", [[], [(None, None, None, None, None)], [(5, "a", "b", "c", 1)], [(k, "t", "l", None, k) for k in range(17)]])
def test_small_manifests(spark, monkeypatch, some):
    monkeypatch.setattr(manifest, "documents", lambda *_: spark.createDataFrame(some, SCHEMA))
    assert as_rows(manifest.op13_merkle_manifest(spark, "")) == sorted(plain_manifest(some) if some else [], key=str)


def test_numbered_is_a_total_order(spark, rows):
    got = common.numbered(rows.select("text", "n_chars"), "text", size="n_chars").orderBy("_at").collect()
    assert [r._at for r in got] == list(range(len(ROWS)))
    want = sorted((x[1] for x in ROWS), key=lambda x: (x is not None, (x or "").encode()))
    assert [r.text for r in got] == want
    assert [r._before for r in got] == list(itertools.accumulate([0, *(r.n_chars or 0 for r in got)]))[:-1]


def plain_search(docs, items, k=20):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := term(t))]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, size in held:
            m = 75 + (25 * size * n) // total
            scored.append((-sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in Counter(term(text)).items() if t in counts), doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k]) if x[0] < 0]
    return sorted(out, key=str)


ITEMS = [(1, "the same black SHEEP x"), (1, "x x x été"), (2, None), (3, "no such wrd ба"), (None, "BA no id of the"), (4, "--"), (5, "copy " * 3)]


def test_search_with_hostile_rows(spark, rows):
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, score string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(rows, items).collect()), key=str)
    assert got == plain_search([(r[0], r[1]) for r in ROWS], ITEMS)
    assert lexical.rank(rows.limit(0), items).count() == 0 == lexical.rank(rows, items.limit(0)).count()


def test_search_in_small_blocks_and_segments(spark, small, monkeypatch):
    for name, value in (("QUERY_BYTES", 2000), ("LONG_TEXT", 100)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(docs, items, 5).collect()), key=str)
    assert got == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)


def test_skipping_loses_nothing(monkeypatch):
    """A segment of many small blocks gives the scores of a full sum, ties by id."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "SHORT_PART", 8)
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 300))
        tf = rng.integers(0, 4, (n, 12)) * (rng.random((n, 12)) < rng.random(12))
        owner, term = np.nonzero(tf)
        m = rng.integers(75, 200, n)
        ids = np.arange(n) * 3
        query = [(int(t), int(w)) for t, w in zip(rng.permutation(12)[:8], rng.integers(0, 3000, 8))]
        got = lexical.Segment(ids, owner, term, tf[owner, term].astype(np.int64), m).search(query, (np.array([900_000]), np.array([1])), 10)
        full = sum((w * ((10**9 * tf[:, t]) // (1000 * tf[:, t] + 12 * m)) for t, w in query), np.zeros(n, np.int64))
        want = sorted([(-900_000, 1), *((-int(s), int(i)) for s, i in zip(full, ids) if s > 0)])[:10]
        assert list(zip((-got[0]).tolist(), got[1].tolist())) == want


def test_transfers_cost_least():
    rng = np.random.default_rng(3)
    for _ in range(40):
        have = rng.integers(0, 5, 3).tolist()
        want = np.bincount(rng.integers(0, 3, sum(have)), minlength=3).tolist()
        cost = rng.integers(0, 4, (3, 3)).astype(float)
        flow = sharding.transfers(have, want, cost)
        assert flow.sum(1).tolist() == have and flow.sum(0).tolist() == want and (flow >= 0).all()
        units = [i for i, x in enumerate(have) for _ in range(x)]
        slots = [j for j, x in enumerate(want) for _ in range(x)]
        if len(units) <= 7:
            assert (flow * cost).sum() == min(sum(cost[i, j] for i, j in zip(units, p)) for p in set(itertools.permutations(slots)))
    assert sharding.transfers([10, 0, 2], [4, 4, 4]).tolist() == [[4, 4, 2], [0, 0, 0], [0, 0, 2]]
    with pytest.raises(ValueError):
        sharding.transfers([1], [2])


def check_shards(got, shards, largest):
    sizes = {s: 0 for s in range(shards)}
    by = defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(sizes.values()) - min(sizes.values()) <= largest
    return sizes


def test_resharding(spark, small):
    got = sharding.op11_resharding(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    check_shards(got, 24, max(r["size"] for r in got))
    olds, total = Counter(), sum(r["size"] for r in got)
    for r in got:
        olds[r.old_shard] += r["size"]
    surplus = sum(max(0, n - total / 24) for n in olds.values())
    assert sum(r["size"] for r in got if r.shard != r.old_shard) <= surplus + 24 * 2 * total / 24 / 100


@pytest.mark.parametrize("part", [1, 256])
def test_small_rows_flow_in_blocks(spark, part, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_PART", part)
    rows = spark.range(5000).selectExpr("id", "cast(if(id < 3000, 0, id % 5) as int) as old_shard", "cast(10 + id % 7 as long) as size")
    got = sharding.reshard(rows, 4, order=("id",)).collect()
    sizes = check_shards(got, 4, 40)
    olds = Counter()
    for r in got:
        olds[r.old_shard] += r["size"]
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    assert abs(moved - sum(max(0, n - (sizes[s] if s < 4 else 0)) for s, n in olds.items())) <= 100


def test_resharding_of_hostile_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "documents", lambda *_: rows)
    got = sharding.op11_resharding(spark, "").collect()
    assert len(got) == len(ROWS)
    check_shards(got, 24, 10_008)
    monkeypatch.setattr(sharding, "documents", lambda *_: rows.limit(0))
    assert sharding.op11_resharding(spark, "").count() == 0


def test_rewrite_touches_only_files_that_lose_rows(spark, tmp_path):
    folder = str(tmp_path / "shards")
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text", "if(id % 3 = 2, 1, 0) as shard")
    docs.repartition(6).write.partitionBy("shard").parquet(folder)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before, want = files(), sorted(map(tuple, spark.read.parquet(folder).drop("shard").collect()))
    moves = {(r.old_shard, r.shard): r.bytes for r in sharding.rewrite(spark, folder, 2).collect()}
    after = files()
    assert sorted(map(tuple, spark.read.parquet(folder).drop("shard").collect())) == want
    assert all(k in after for k in before if "shard=1" in k) and any(after.get(k) == v for k, v in before.items() if "shard=0" in k) and set(before) - set(after)
    assert set(moves) == {(0, 0), (0, 1), (1, 1)} and abs(moves[0, 0] - moves[0, 1] - moves[1, 1]) < 400


def test_registered():
    assert {"op11_resharding", "op12_lexical_search", "op13_merkle_manifest"} <= set(queries.QUERIES)
    assert {"op12_lexical_search", "op13_merkle_manifest"} <= set(queries.ORACLES)
