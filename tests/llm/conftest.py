import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Texts to a documents table with ids from 0, or from (id, text) pairs, and a clashing extra column."""

    def make(texts, lang=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang[k] if lang else "en", f"s{k % 3}", None if t is None else len(t), "x") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts that any operator must take: null, empty, white space, other scripts, controls, one word, a long run, repeats."""
    return [None, "", " \t\n", "word", "Ünïcödé ΣΑΣ İstanbul 中文字 😀 \x1c\x00x", "a" * 50_000, "1" * 20_000, "x@" * 5_000, "1.2." * 5_000, "+1 " * 5_000, "the cat sat on the mat " * 2_000, "same text here", "same text here"]
