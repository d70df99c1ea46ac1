"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of a word. A proposal is the exact encoding if and only if each proposed token
is its own encoding and each adjacent pair is compatible, that is, no merge across the border of the two would have been
taken before the merges that made them. The pair test walks back through the merges that made the two border tokens and
runs on numpy arrays over every adjacent pair of a batch of new words. Only the words that fail are merged exactly.

Undefined inputs get defined results: a null text is the empty text, which has no tokens; the strings of the added tokens
are those tokens, as in the tokenizer file; repeated rows are encoded alike; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, documents, slices, tidied

#: Fixed values of the tokenizer's definition.
END_OF_WORD = "</w>"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
NEVER = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.intc)


class _Entries(dict):
    """Ids by word, packed: a worker remembers many words. An item taken by [] is unpacked: ids as text, tokens as text, count, ids."""

    def __init__(self, name: dict[int, str]):
        super().__init__()
        self.name = name

    def __getitem__(self, word: str) -> tuple[str, str, int, tuple[int, ...]]:
        ids = tuple(_ids(super().__getitem__(word)).tolist())
        return " ".join(map(str, ids)), " ".join([self.name[i] for i in ids]), len(ids), ids


class SpeculativeBpe:
    """Encoder for a word-ended byte-level BPE given as the JSON text of a tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.vocab = vocab
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.name = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        size = max(vocab.values()) + 1
        # left, right: the parts of a merged token; made: when it was merged, -1 for single symbols
        self.left, self.right, self.made = np.arange(size), np.arange(size), np.full(size, -1, dtype=np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.rank:
                self.rank[x, y] = (r, z)
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, r
        codes = np.array([x * size + y for x, y in self.rank], dtype=np.int64)
        order = np.argsort(codes)
        self.size, self.pair_codes = size, codes[order]
        self.pair_ranks = np.array([r for r, _ in self.rank.values()], dtype=np.int64)[order]
        self.longest = max(len(t.removesuffix(END_OF_WORD)) for t in vocab)
        self.whole = self._self_consistent()
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.cache = _Entries(self.name)
        self.exact_words = 0
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        letters, numbers = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.latin = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^\\t-\\r \x85\xa0{letters}{numbers}]+")
        self.any = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    # -- the pair test -------------------------------------------------------------------------------------------------
    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER) if len(self.pair_codes) else np.full(len(code), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether exact merging of its characters ends (or, with `limit`, stands before that merge) at it."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64).copy()
        good, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            crossed = self._merge_rank(x, y) < limit[open_]
            good[open_[crossed]] = False
            made_x, made_y = self.made[x], self.made[y]
            # The later of the two was made last; of equal ones the left was made first. A merge across the border that
            # lies left of the one undone wins a tie, one that lies right of it loses.
            undo_x = made_x > made_y
            limit[open_] = np.where(undo_x, made_x, made_y + 1)
            a[open_], b[open_] = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            open_ = open_[~crossed & (np.maximum(made_x, made_y) >= 0)]
        return good

    def _self_consistent(self) -> np.ndarray:
        """Tokens that exact merging makes from their own characters."""
        good = self.made < 0
        merged = np.flatnonzero(self.made >= 0)
        merged = merged[np.argsort(self.made[merged], kind="stable")]
        pairs = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        for token, fits in zip(merged.tolist(), pairs.tolist()):
            good[token] = fits and good[self.left[token]] and good[self.right[token]]
        return good

    # -- words ---------------------------------------------------------------------------------------------------------
    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over a word of byte characters; None if some place matches nothing."""
        vocab, longest, n, at, out = self.vocab, self.longest, len(word), 0, []
        while at < n:
            if n - at <= longest and (token := vocab.get(word[at:] + END_OF_WORD)) is not None:
                out.append(token)
                return out
            for end in range(min(at + longest, n - 1), at, -1):
                if (token := vocab.get(word[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost. Long words use a heap over linked symbols."""
        symbols = [*word[:-1], word[-1] + END_OF_WORD]
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        n, rank = len(ids), self.rank
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = rank[x, y][1], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (p := (ids[k], ids[m])) in rank:
                    heapq.heappush(heap, (rank[p][0], k, *p))
        return [t for t, live in zip(ids, alive) if live]

    def learn(self, words: list[str]) -> None:
        """Put new words into the cache: propose all, test all adjacent pairs at once, merge what fails."""
        shown = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) for w in words]
        proposed = [self.propose(w) or [] for w in shown]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        fails = lengths == 0
        fails[owner[~self.whole[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, dtype=np.int64)
        pair, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = self.compatible(pair // self.size, pair % self.size)
        fails[owner[inside[~fits[back]]]] = True
        for i in np.flatnonzero(fails).tolist():
            proposed[i] = self.merge(shown[i])
        self.exact_words += int(fails.sum())
        for word, ids in zip(words, proposed):
            self.cache[word] = array("i", ids).tobytes()

    # -- texts ---------------------------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Pieces of a text in order; an added token's own string is a piece of its own."""
        if self.splitter is None or "<" not in text:
            return self._pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.splitter.split(text)):
            out += [part] if i % 2 else self._pieces(part)
        return out

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, packed."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for content, i in self.added.items():
            self.cache[content] = array("i", [i]).tobytes()
        split = [self.words(t) for t in texts]
        fresh = {w for ws in split for w in ws if w not in self.cache}
        if fresh:
            self.learn(list(fresh))
        get = self.cache.get
        return [b"".join(map(get, ws)) for ws in split]

    def encode(self, text: str) -> list[int]:
        return _ids(self.encode_batch([text])[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokenizer names no decoder, so tokens are joined by single spaces; unknown ids are left out."""
        return " ".join([self.name[i] for i in ids if i in self.name])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[int, SpeculativeBpe] = {}


def _encoder(definition) -> SpeculativeBpe:
    """One encoder for each worker process and tokenizer."""
    text = definition.value
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SpeculativeBpe(text)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, null unless keep_ids), decoded text's and ids' SHA-256.

    One map over the texts, no shuffle. The driver reads the tokenizer file, whose size the vocabulary bounds. At a task's end
    its worker forgets the words, for other stages need the memory while it is idle."""
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = broadcast_value(docs.sparkSession, f.read())

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(definition)
        for batch in slices(batches):
            packed, id_digests, decoded = bpe.encode_batch(batch.column("text").to_pylist()), [], []
            for ids in map(np.ndarray.tolist, map(_ids, packed)):
                id_digests.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(map(bpe.name.__getitem__, ids)).encode()).hexdigest())
            counts = np.fromiter(map(len, packed), np.int64, len(packed)) // np.intc().itemsize
            ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(_ids(b"".join(packed)), pa.int32())) if keep_ids else pa.nulls(len(packed), schema.field("ids").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), lists.cast(schema.field("ids").type), pa.array(id_digests, pa.string()), pa.array(decoded, pa.string())], schema=schema)
        bpe.cache.clear()

    return documents(docs).mapInArrow(tidied(run, definition), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text: the decoded texts of a table with doc_id and ids; null ids give an empty text."""
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = broadcast_value(encoded.sparkSession, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(definition)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
