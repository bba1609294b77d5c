import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, id string, `key` int, __tag string"
BENCH = "one two three four five six seven eight nine ten eleven twelve"
STORY = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bend "
         "and a small boat drifts slowly past the mill where nobody has worked since the long winter ended ")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

#: Nulls, empty and blank texts, a very long one, ties and repeated rows, repeated ids, odd characters.
TEXTS = [
    (1, STORY), (2, STORY), (3, STORY.upper()), (4, STORY + "indeed"), (5, None), (6, ""), (7, " \n\t "), (8, "Two words"), (9, "two WORDS"),
    (10, LONG), (11, LONG + " end"), (12, f"before {BENCH} after"), (13, "héé ÀÉ 的 字 🙂" * 9), (None, STORY), (None, None), (2, STORY),
    (14, "x" * 400), (15, "x" * 49), (16, "y" + "x" * 60), (8, "another text under a used id"), (17, "a  b   c \n d\n\n e \xa0 f  \u2581 g  "),
    (18, "One, Two; THREE four-five"), (19, "<|endoftext|> inside <s> a text </s>"), (20, "end" + STORY[:70]),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None, "s", None, 7, "clash", 3, "tag") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3, F.col("text"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def same(df, want, columns):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want, key=repr)
