import re

from tallyspark.llm.tokencount import VOCABULARY, Automaton, count_tokens, read_vocabulary, token_counts

from .common import documents, table


def greedy(text, vocabulary, longest):
    """(words, tokens) by building every piece."""
    n_words = n_tokens = 0
    for word in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]|[^A-Za-z0-9\x00-\x20\x7f\x80-\xff]+", text):
        n_words += 1
        symbols = list(word.lower())
        symbols[-1] += 256
        while symbols:
            n = next(k for k in range(min(longest, len(symbols)), 0, -1) if tuple(symbols[:k]) in vocabulary)
            symbols = symbols[n:]
            n_tokens += 1
    return n_words, n_tokens


def test_equals_greedy_pieces(spark):
    vocabulary = read_vocabulary(VOCABULARY)
    known, longest = set(vocabulary), max(map(len, vocabulary))
    texts = [(r["text"] or "").encode() for r in table(spark, "documents").collect()] + [b"", b"   ", b"a" * 5000, bytes(range(256)) * 3, "日本語 Ünïcode 12345 don't!!".encode()]
    words, tokens = count_tokens(texts, Automaton(vocabulary))
    assert list(zip(words.tolist(), tokens.tolist(), strict=True)) == [greedy(t, known, longest) for t in texts]


def test_columns(spark):
    docs = documents(spark, [None, "", "two words", "two words"]).selectExpr("*", "7 as n_words", "'x' as extra")
    rows = token_counts(docs).orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows] == [0, 0, 2, 2] and rows[0]["n_tokens"] == 0 and rows[2]["n_tokens"] == rows[3]["n_tokens"] >= 2
    assert all(r["extra"] == "x" for r in rows)
    assert token_counts(documents(spark, [])).count() == 0
