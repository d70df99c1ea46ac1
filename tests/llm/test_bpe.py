import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphvec.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    OURS = bpe.SpeculativeBpe(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdeghilnorstuwy '0129.,!-_<|>éñßÀΣİſ½中😀\n\t\x85\xa0", max_size=60))
def test_same_as_library(text):
    found = LIBRARY.encode(text, add_special_tokens=False)
    assert OURS.encode(text) == found.ids
    assert OURS.decode(found.ids) == LIBRARY.decode(found.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "the" * 2000, "ab" * 777, "<|startoftext|>Hi<|endoftext|><|ENDOFTEXT|>", "it's we'll don't 'twas", "x\x00y\x1cz"])
def test_hard_words(text):
    assert OURS.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_speculation_is_verified():
    """Greedy proposals that the pair test accepts are exact, and some need no merging."""
    fresh = bpe.SpeculativeBpe(open(PATH, encoding="utf-8").read())
    words = ["hello", "restaurants", "thnterononshth", "erouinanedth", "onreandthat", "tionereheing", "andeahearation"]
    fresh.learn(words)
    assert 0 < fresh.exact_words < len(words)
    for w in words:
        assert list(fresh.cache[w][3]) == LIBRARY.encode(w, add_special_tokens=False).ids == fresh.merge(w)


def test_table(docs, awkward):
    out = {r["doc_id"]: r for r in bpe.encode(docs(awkward)).collect()}
    for i, t in enumerate(awkward):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs([])).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(awkward))).collect()}
    assert back[3] == "word</w>" and back[0] == ""


def test_remembered_words_are_small():
    """A worker remembers up to CACHE_WORDS words, so each has to take little."""
    fresh = bpe.SpeculativeBpe(open(PATH, encoding="utf-8").read())
    words = [hashlib.sha256(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:9] for i in range(20_000)]
    tracemalloc.start()
    fresh.learn(words)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / len(words) < 200
    assert [fresh.encode(w) for w in words[:200]] == [e.ids for e in LIBRARY.encode_batch(words[:200], add_special_tokens=False)]


def test_workers_forget_words(docs, spark):
    """A worker lives on between stages: what it has learned for one task does not stay."""
    assert bpe.encode(docs([f"word{i} other{i}" for i in range(300)])).count() == 300
    bpe.encode(docs([f"word{i} other{i}" for i in range(300)])).write.format("noop").mode("overwrite").save()

    def kept(batches):
        from graphvec.llm import bpe as module

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.cache) for e in module._loaded.values())], pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()} == {0}
