"""Secret scans by dictionary-primed zstandard novelty.

Base rules find assignments, access keys and long hexadecimal runs. The method adds spans of kind `novel`: a run of
key-like characters near a sensitive word is a candidate; it is compressed together with the code around it by a zstandard
compressor that is primed with the identifiers most frequent in the whole corpus. The bytes that the candidate adds beyond
the compressed surroundings are its novelty; only strings that hardly compress, NOVEL_SHARE bytes for each character at
least, are reported. Words, paths and names that the code or the corpus knows add few bytes.

Every candidate is measured, whether or not a base rule found it too: a novel span may lie over a base span and then confirms
it. A candidate has LEAST characters of the key alphabet or more (fewer could be guessed, and headers of the compressed form
outweigh them) and mixes two of small letters, capitals behind the first letter, and digits: a plain word, which the dictionary
may lack because it is rare, is as new to a compressor as a key is.

An identifier must have been met twice to be known. Inside candidates it counts once for each different text before it, so a
key in a text with a thousand copies makes itself no more known. Identifier counts cover every text (counted in each task, summed by Spark; the driver receives the IDENTIFIERS most
frequent ones). Scanning is one map without a shuffle. Offsets are code points, ends exclusive.

Defined results: null text counts as empty and gives zero counts, the digest of the empty string and no spans; repeated
rows are scanned alike; ties of frequency go to the smaller identifier; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, documents, slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|pwd|auth|bearer|credential|private|signature|session|cookie|login", re.ASCII | re.IGNORECASE)
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|(?=.*[a-z])(?=.+[A-Z])", re.DOTALL)
#: Characters before a candidate in which a sensitive word must stand; characters of surroundings on each side.
REACH, AROUND = 48, 256
NOVEL_SHARE = 0.75
IDENTIFIERS = 4096
SHORT, LONG = 4, 64
NOT_IDENTIFIER = bytes(b if chr(b).isascii() and (chr(b).isalnum() or b == 0x5F) else 0x20 for b in range(256))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """start and end of the key-like strings in sensitive surroundings."""
    for m in CANDIDATE.finditer(text):
        if MIXED.match(m[0]) and SENSITIVE.search(text, max(0, m.start() - REACH), m.start()):
            yield m.span()


def _words(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(NOT_IDENTIFIER).split() if SHORT <= len(w) <= LONG and w[0] > 0x39]


def identifiers(docs: DataFrame) -> list[str]:
    """The most frequent identifiers of all texts, the most frequent last (zstandard reaches the end most cheaply)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[bytes, int]] = Counter()

        def emit():
            words, before = zip(*total) if total else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(list(total.values()), pa.int64())], names=["word", "before", "n"])

        for batch in slices(batches):
            plain: list[str] = []
            for text in batch.column("text").to_pylist():
                at = 0
                for start, end in candidates(text):
                    before = xxhash.xxh3_64_intdigest(text[max(0, start - AROUND // 16) : start].encode("utf-8", "surrogatepass")) >> 1 | 1
                    for w in _words(text[start:end]):
                        total[w, before] = 1
                    plain.append(text[at:start])
                    at = end
                plain.append(text[at:])
            for w, n in Counter(_words(" ".join(plain))).items():
                total[w, 0] += n
            if len(total) > 400_000:
                yield emit()
                total.clear()
        yield emit()

    found = documents(docs).select("text").mapInArrow(count, "word string, before long, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    found = found.groupBy("word").agg(F.sum(F.when(F.col("before") == 0, F.col("n")).otherwise(1)).alias("n")).filter("n > 1")
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()][::-1]


class Scanner:
    def __init__(self, known: list[str]):
        self.known = "\n".join(known).encode()

    def __getstate__(self):
        return {"known": self.known}

    def _size(self, data: bytes) -> int:
        if "press" not in self.__dict__:
            primed = None
            if len(self.known) >= 8:
                primed = zstandard.ZstdCompressionDict(self.known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                primed.precompute_compress(level=3)
            self.press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(self.press.compress(data))

    def novelty(self, text: str, start: int, end: int) -> int:
        """Bytes that text[start:end] adds to its compressed surroundings, from which its other occurrences are taken out."""
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).replace(text[start:end], "").encode("utf-8", "surrogatepass")
        return self._size(around + text[start:end].encode()) - self._size(around)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base rules."""
        out = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def novel(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the strings in sensitive surroundings that hardly compress."""
        return [(start, 3, end) for start, end in candidates(text) if self.novelty(text, start, end) >= NOVEL_SHARE * (end - start)]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans for each row. `known`: from identifiers()."""
    shared = broadcast_value(docs.sparkSession, Scanner(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in slices(batches):
            counts, base, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                found = scanner.base(text)
                more = scanner.novel(text)
                for k in range(3):
                    counts[k].append(sum(1 for f in found if f[1] == k))
                counts[3].append(len(more))
                base.append(_said(found))
                spans.append(_said(sorted(found + more)) if more else base[-1])
            digest = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
