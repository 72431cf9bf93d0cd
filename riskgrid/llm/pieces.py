"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

Method: a score-ordered agenda of adjacent symbol pairs. A text is cut where no
piece of the vocabulary could reach across (before a run of space marks, and
between two characters that no piece holds side by side), each part is merged
through its agenda once and kept in a bounded cache, and within each Arrow
batch every newly merged word, runs of spaces included, is compared with the
sentencepiece library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, documents, table, texts

DEFAULT = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes, about, of the words that a worker keeps in a generation; beyond it they become the old generation, from which words in use move back.
CACHE_BYTES = 100 << 20
#: Longer words (text without spaces is one word) aren't kept, only their parts.
CACHED_CHARS = 32
#: Symbols up to which the agenda is a list searched for its minimum; beyond, a heap.
SHORT = 40
_NONE = 1 << 30

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())])


class MergeVocabulary:
    """Pieces, their order of merging and the pairs of characters that pieces hold."""

    def __init__(self, name: str = DEFAULT) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in size if sp.is_byte(i)}
        plain = [i for i in size if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        by_score = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.order = {sp.id_to_piece(i): k for k, i in enumerate(by_score)}
        self.by_order = [sp.id_to_piece(i) for i in by_score]
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.end = sp.eos_id()
        self.unknown = sp.unk_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError(f"{name}: a piece reaches across a space mark")
        self.words: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.parts: dict[str, tuple[int, ...]] = {}
        self.parts_held = 0

    @staticmethod
    def weight(word: str, ids: tuple[int, ...]) -> int:
        """Bytes of a kept word, about: its characters, its ids and what the dictionary needs."""
        return 200 + 4 * len(word) + 36 * len(ids)

    def keep(self, word: str, ids: tuple[int, ...]) -> None:
        """Keep a word's ids unless it is long; a full generation becomes the old one."""
        if len(word) <= CACHED_CHARS:
            self.words[word] = ids
            self.held += self.weight(word, ids)
            if self.held >= CACHE_BYTES:
                self.old, self.words, self.held = self.words, {}, 0

    def forget(self) -> None:
        self.words, self.old, self.held = {}, {}, 0

    def merge(self, part: str) -> list[str]:
        """Symbols of ``part`` after all merges, best score first and leftmost among equals."""
        if len(part) <= SHORT:
            return self._merge_short(part)
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = self.order
        agenda = [(k, i) for i in range(n - 1) if (k := order.get(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            k, i = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n:
                continue
            joined = left + symbols[j]
            if joined != self.by_order[k]:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = m = after[j]
            if m < n:
                before[m] = i
                if (k := order.get(joined + symbols[m])) is not None:
                    heapq.heappush(agenda, (k, i))
            if (h := before[i]) >= 0 and (k := order.get(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (k, h))
        return [x for x in symbols if x is not None]

    def _merge_short(self, part: str) -> list[str]:
        symbols, order, pieces = list(part), self.order.get, self.by_order
        agenda = [order(part[i : i + 2], _NONE) for i in range(len(part) - 1)]
        while agenda:
            k = min(agenda)
            if k == _NONE:
                break
            i = agenda.index(k)
            symbols[i : i + 2] = (joined := pieces[k],)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(joined + symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + joined, _NONE)
        return symbols

    def ids_of(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        ids = self.ids
        for x in self.merge(part):
            if x in ids:
                out.append(ids[x])
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def part_ids(self, part: str) -> tuple[int, ...]:
        known = self.parts.get(part)
        if known is None:
            known = self.ids_of(part)
            if len(part) <= CACHED_CHARS:
                if self.parts_held >= CACHE_BYTES:
                    self.parts, self.parts_held = {}, 0
                self.parts[part] = known
                self.parts_held += self.weight(part, known)
        return known

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a run of space marks and what follows it, up to the next one."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        if not cuts:
            return self.ids_of(word)
        out, at = (), 0
        for k in (*cuts, len(word)):
            out += self.part_ids(word[at:k])
            at = k
        return out


@functools.lru_cache(2)
def vocabulary(name: str) -> MergeVocabulary:
    return MergeVocabulary(name)


def _cut(text: str) -> list[str]:
    """Words of a normalised text, each with its run of space marks in front."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] if len(w) > 1 and w[0] == MARK != w[1] else w for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))]


def encode(text: str, vocab: MergeVocabulary, fresh: dict[str, tuple[int, ...]] | None = None) -> list[int]:
    """Ids of a text without the end id; words met for the first time are put into ``fresh``."""
    out: list[int] = []
    known, extend = vocab.words.get, out.extend
    for word in _cut(text):
        ids = known(word)
        if ids is None:
            ids = vocab.old.get(word)
            if ids is None:
                ids = vocab.word_ids(word if word[0] == MARK else MARK + word)
                if fresh is not None:
                    fresh[word] = ids
            vocab.keep(word, ids)
            known = vocab.words.get
        extend(ids)
    return out


def agrees(fresh: dict[str, tuple[int, ...]], vocab: MergeVocabulary) -> bool:
    """Whether the library gives the same ids for all these words.

    Words are laid in one text in their own spacing. Runs of marks alone would
    join the word after them, so each ends a text of its own.
    """
    bare = {w: ids for w, ids in fresh.items() if not w.strip(MARK)}
    laid = {w: ids for w, ids in fresh.items() if w not in bare}
    whole = "".join(w if w[0] == MARK else MARK + w for w in laid)
    if vocab.library.encode(whole[1:].replace(MARK, " ")) != [i for ids in laid.values() for i in ids]:
        return False
    front = vocab.library.encode("a")
    return all(vocab.library.encode("a" + " " * len(w)) == [*front, *ids] for w, ids in bare.items())


def encode_documents(docs: DataFrame, model: str = DEFAULT) -> DataFrame:
    """Encode and decode whole texts (doc_id, text): n_tokens, ids_sha256, decoded_sha256, agrees.

    Null is the empty text, whose only id is the end id. ``agrees`` is false
    where a word of the row's Arrow batch came out other than in the library;
    the batch is then encoded by the library, so the ids are right either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            whole, fresh = texts(batch), {}
            encoded = [encode(x, vocab, fresh) for x in whole]
            wrong = not agrees(fresh, vocab)
            if wrong:
                vocab.forget()
                encoded = [vocab.library.encode(x) for x in whole]
            rows = []
            for ids in encoded:
                ids.append(vocab.end)
                decoded = vocab.library.decode(ids)
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), not wrong))
            yield table(ENCODED, [batch.column("doc_id"), *(zip(*rows) if rows else [[]] * 4)])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
