import pytest

#: Nulls, empty and long texts, ties, repeats.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs far away from here today"),
    (2, "The quick brown fox jumps over the lazy dog and then it runs far away from here today"),
    (3, ""), (4, None), (5, "one"), (6, "  \n\n \t "), (7, "a b c d e f g h i j k l " * 40),
    (8, "Long line that is shared\nanother one of its own\nLONG LINE that is shared  \nx"),
    (9, "long line that is shared\r\nŒuvre ÉTÉ naïve ünïcode 漢字かな 🙂🙂 é\nlast words"),
    (None, "null id text of some words"), (8, "Long line that is shared\nanother one of its own\nLONG LINE that is shared  \nx"),
    (10, "word " * 30000), (11, "x" * 70000), (12, "\n" * 3000 + " " * 20000 + "end"), (13, "it's we're I'll 123 456!!! ,,,   mixed　spaces 'tis <|endoftext|> l'été"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", f"src{n % 3}" if n % 4 else None, len(t or ""), n, "kept") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, ids string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
