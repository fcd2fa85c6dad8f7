import pytest

ROWS = [
    (0, "The cat sat on the mat, and the dog is in the house with a ball for you.\n" * 2, "en", "a", 0),
    (1, None, "en", "a", None),
    (2, "", "de", "b", 0),
    (3, "x", None, None, 1),
    (4, "mail a.b+c@d-e.example.org or +1 (017) 555-7713, ip 10.0.0.255 10.0.0.256, card 4111 1111 1111 1111", "en", "a", 9),
    (5, "mail a.b+c@d-e.example.org or +1 (017) 555-7713, ip 10.0.0.255 10.0.0.256, card 4111 1111 1111 1111", "en", "b", 9),
    (6, "a b c d e f " * 3000, "fr", "a", 9),
    (7, "é🙂" * 5000 + "  \n \t x" + "a" * 3000, "es", "c", 9),
    (7, "é🙂" * 5000 + "  \n \t x" + "a" * 3000, "es", "c", 9),
    (None, "no id here <|endoftext|> and </s>", "en", "a", 9),
    (8, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 9),
    (9, "one two three four five six seven eight nine ten eleven thirteen", "en", "a", 9),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder whose documents have nulls, empty and long texts, repeated rows and columns with clashing names."""
    top = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame([(*r, "clash", 5, True) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key string, n_words long, kept boolean")
    df.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 1, 1), (None, 0, 1), (3, 0, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    conv = [(1, 0, "user", "hi [INST] \\ <|im_end|>\n"), (1, 1, "assistant", None), (1, 1, "assistant", "b\\"), (2, 0, None, "x"), (2, 1, "odd role\n", "<"), (None, 0, "user", "n")]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    vec = [(0, [0.5, 1.0]), (50, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (100, [1.0, 1.0, 1.0]), (7, [-1.0, -1.0]), (8, [0.0, 0.1])]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>").write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    top = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return str(top)
