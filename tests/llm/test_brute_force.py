"""Operators on the smallest tables against plain versions of their contracts."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from riskgrid.llm import embeddings, language, packing, parsing, pieces, privacy, queries, simhash, substrings, tokencount, tokens


@pytest.fixture(scope="module")
def docs(small):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_ids(spark, small, docs, library):
    by = {}
    for r in packing.op2_best_fit_packing(spark, small).collect():
        by.setdefault(r.doc_id, []).append(r)
    for k, text in docs.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert [(r.start, r.ids_crc32) for r in sorted(by[k], key=lambda r: r.piece)] == [(s, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut(ids)]


def test_quick_encoder_equals_the_library(library):
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [0x1F600, 0x20000, 0xFEFF, 0xAC00]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}!{chr(c)} " for c in points] + ["", " ", "  x", "<|endoftext|>a<|endoftext|>", "it's 'S'll"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(tokens.quick(tokens.DEFAULT).encode_to_numpy(text, allowed_special="all")) == want.ids


def test_pre_tokens_equal_the_library(library):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F650)) + [0x20000, 0x10FFFF]
    for c in points:
        text = f"a{chr(c)}b 1{chr(c)} {chr(c)}!"
        assert tokencount.pre_tokens(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_token_counts(spark, small, docs, library):
    for r in tokencount.op9_token_counts(spark, small).collect():
        text = docs[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_counts_without_a_broadcast_table(spark, docs, library, monkeypatch):
    monkeypatch.setattr(tokencount, "head", lambda vocab: ({}, vocab))
    df = spark.createDataFrame([(k, docs[k]) for k in sorted(docs)[:20]], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df).collect()} == {k: len(library.encode(docs[k] or "", add_special_tokens=False).ids) for k in sorted(docs)[:20]}


def test_sentencepiece(spark, small, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in pieces.op6_sentencepiece(spark, small).collect():
        ids = sp.encode(docs[r.doc_id] or "") + [sp.eos_id()]
        assert r.agrees and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b ", " a", "▁", "a▁b", "▁ x", "x" * 500, "ab" * 60, "\t\n\r", "\x00a", "中文字", "😀 é ñ", "<s> </s> <0x0A>", "it's (a) [test]...", "1234567890" * 9])
def test_agenda_equals_the_library(text):
    vocab = pieces.MergeVocabulary()
    assert pieces.encode(text, vocab) == vocab.library.encode(text)


def test_simhash(spark, small, docs):
    prints = {}
    for k, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, small).collect()} == {k: (f"{p:016x}", group[k]) for k, p in prints.items()}


def test_substrings_equal_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, substrings.op10_substring_dedup(spark, small).collect())) == sorted(con.execute(queries.ORACLES["op10_substring_dedup"]).fetchall())


def test_substrings_of_branching_copies(spark):
    rng = np.random.default_rng(3)
    text = [f"w{x}" for x in rng.integers(0, 400, 500)]
    rows = []
    for k in range(25):
        words = list(text[rng.integers(0, 80) : 500 - rng.integers(0, 80)])
        for at in rng.integers(0, len(words), k % 6):
            words[at] = f"x{at}"
        rows.append((k, " ".join(words + [f"tail{k}"] * (k % 3))))
    first, want = {}, {}
    for k, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    for k, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        want[k] = (len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect()} == want


def test_embeddings_with_a_dense_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre + 0.12 * rng.standard_normal((700, 64)), rng.standard_normal((300, 64))]).astype(np.float32)
    x[650:] = np.where(rng.random((350, 1)) < 0.1, x[0], x[650:])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    true = near.sum(axis=1)
    assert sum(found.values()) >= 0.999 * true.sum() and all(found[k] <= true[k] for k in found)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, kind in enumerate(privacy.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and privacy.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("word", ["▁▁b", "▁", "▁▁▁", "▁▁▁▁▁x"])
def test_words_after_runs_of_spaces_are_compared(word):
    vocab, fresh = pieces.MergeVocabulary(), {}
    for text in ("one  b two", " a", "a ", "a   ", "    x y", "   ", "▁▁▁b▁", "\t  \n  z"):
        pieces.encode(text, vocab, fresh)
    assert word in fresh and pieces.agrees(fresh, vocab)
    assert not pieces.agrees(fresh | {word: (*fresh[word], 5)}, vocab)
    assert pieces.agrees({}, vocab)


@pytest.mark.parametrize("text", [
    "a@b.c a@@b.c x.y@z.w.v..u a@b a@b. @b.c é@b.c aé@b.cé q@w.e@r.t", "1.2.3.4 1.2.3.4.5 300.1.1.1 01.002.3.255 1..2.3.4 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (743) 555-3824 ++12 345 678 90 +123 +12345678901234567 +1-2.3(4)5 6 7 8 9.", "+4111111111111111 10.0.0.1-4111111111111111 (1.2.3.4)", "9" * 3000 + "." + "1" * 50,
])
def test_base_spans_by_plain_patterns(text):
    assert [tuple(s) for s in privacy.base_spans(text)] == plain_spans(text)


def test_personal_data(spark, small, docs):
    for r in privacy.op8_personal_data(spark, small).collect():
        want = plain_spans(docs[r.doc_id] or "")
        listed = ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_language_accuracy(spark, small):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{small}/documents.parquet'").fetchall())
    rows = language.op4_language_id(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9


def test_fingerprints(spark, small, docs):
    ids = sorted(docs)
    rows = {r.doc_id: r for r in parsing.op7_fingerprints(spark, small).collect()}
    better = []
    for k, nxt in zip(ids, [*ids[1:], ids[0]]):
        changed = parsing.edited(docs[k] or "", docs[nxt] or "")
        assert rows[k].n_chars == len(docs[k] or "") and rows[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[k].edited_fingerprint == parsing.hexed(parsing.fingerprints([changed]))[0]
        better.append(rows[k].near_edited > rows[k].near_next or docs[k] == docs[nxt])
    assert np.mean(better) > 0.95


def test_fingerprints_do_not_depend_on_offset():
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdefghij klmnop"), 4000))
    a, b, c = parsing.fingerprints([body, "some other head " + body, "".join(rng.choice(list("abcdefghij klmnop"), 4000))])
    assert parsing.likeness(a[None], b[None])[0] > 0.9 and parsing.likeness(a[None], c[None])[0] < 0.2


WRAP = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WRAP
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WRAP
    return x ^ x >> 31


def plain_toss(symbols):
    out = [0]
    for a, b in zip(symbols, symbols[1:]):
        bit = ((a ^ b) & -(a ^ b)).bit_length() - 1
        out.append(2 * bit + (b >> bit & 1) if a != b else 0)
    return out


def plain_level(symbols, rounds):
    """Collapse runs, toss coins ``rounds`` times, cut at local maxima and name the phrases."""
    kept, values = [], []
    for k, x in enumerate(symbols):
        if not k or x != symbols[k - 1]:
            long_run = k + 1 < len(symbols) and symbols[k + 1] == x
            kept.append(x)
            values.append(plain_mix((x + pow(0x9E3779B97F4A7C15, 3, 1 << 64)) & WRAP) if long_run else x)
    labels = kept
    for _ in range(rounds):
        labels = plain_toss(labels)
    starts = [0] + [k for k in range(1, len(labels) - 1) if labels[k - 1] < labels[k] > labels[k + 1]]
    names = []
    for a, b in zip(starts, [*starts[1:], len(labels)]):
        total = sum(values[k] * pow(0x9E3779B97F4A7C15, (k - a) % 256, 1 << 64) for k in range(a, b)) + b - a
        names.append(plain_mix(total & WRAP))
    return names


def plain_fingerprint(text):
    names, out = list(text.encode()), []
    for level in range(1, 5):
        names = plain_level(names, 3 if level == 1 else 4) if names else []
        if slots := parsing.SLOTS.get(level):
            drawn = [plain_mix(x ^ level) for x in names]
            for k in range(slots):
                own = [d >> 24 for d in drawn if d % slots == k]
                out.append(1 + min(own) % 65535 if own else 0)
    return "".join(f"{x:04x}" for x in out)


def test_fingerprints_by_plain_parsing(docs):
    texts = [x or "" for x in list(docs.values())[:25]] + ["", "a", "aa", "aaaa", "abab" * 50, "x" * 700 + "yz", "ß😀" * 40, "a b " * 300]
    texts = [x[:3000] for x in texts]
    assert parsing.hexed(parsing.fingerprints(texts)) == [plain_fingerprint(x) for x in texts]


def followed(rows, count):
    """(doc_id, edited hash) rows of a table by a plain sort."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1]).encode(), 42))))
    out = []
    for k, (doc_id, text) in enumerate(order):
        changed = parsing.edited(text, order[(k + 1) % len(order)][1])
        out.append((str(doc_id), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("case", ["null ids", "one id", "equal rows", "uneven ids", "one row", "two rows"])
def test_next_documents_of_hot_ids(spark, monkeypatch, case):
    text = lambda k: f"text number {k} of the table " + "x" * (k % 37)
    rows = {
        "null ids": [(None if k % 2 else k, text(k)) for k in range(1200)], "one id": [(7 if k % 3 else k, text(k)) for k in range(1200)],
        "equal rows": [(7, "the same") if k % 3 else (k, text(k)) for k in range(1200)], "uneven ids": [(k if k % 50 else k * 10**14, text(k)) for k in range(1200)],
        "one row": [(5, "alone here")], "two rows": [(5, "alone here"), (-5, "")],
    }[case]
    monkeypatch.setattr(parsing, "RANGE_BYTES", 2_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chain, heavy = parsing.neighbours(df)
    sizes = [r["count"] for r in chain.filter("not _copy").groupBy("_range").count().collect()]
    assert max(sizes) <= 150 and (heavy is not None) == (case == "equal rows")
    found = parsing.fingerprint_documents(df).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in found) == followed(rows, len(rows))


def test_languages_by_plain_compression(spark, small, docs):
    import zstandard

    learned = language.learn(spark.read.parquet(f"{small}/documents.parquet"))
    how = zstandard.ZstdCompressionParameters(**language.SETTINGS, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
    found = {r.doc_id: r for r in language.op4_language_id(spark, small).collect()}
    for k, text in docs.items():
        if not text or not any(c.isalpha() for c in text):
            assert (found[k].lang_pred, found[k].score) == ("und", 0.0)
            continue
        kept = "".join(c if ord(c) > 127 or c.isalpha() else " " if ord(c) < 33 or ord(c) == 127 else "" for c in text.lower()).encode()
        sizes = {}
        for lang, raw in learned.items():
            size = 0
            for at in range(0, len(kept), language.BLOCK_BYTES):
                known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size += len(zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress(kept[at : at + language.BLOCK_BYTES]))
            sizes[lang] = size
        assert found[k].lang_pred == min(sizes, key=sizes.get)


def test_packing_uses_few_sequences(spark, small):
    """Never more than first-fit decreasing piece by piece, nor the bound by total length and by pieces over half."""
    rows = packing.op2_best_fit_packing(spark, small).collect()
    open_ = []
    for n in sorted((r.length for r in rows), reverse=True):
        at = next((k for k, left in enumerate(open_) if left >= n), None)
        if at is None:
            open_.append(2048 - n)
        else:
            open_[at] -= n
    used = len({r.sequence_id for r in rows})
    assert max(-(-sum(r.length for r in rows) // 2048), sum(r.length > 1024 for r in rows)) <= used <= len(open_)
