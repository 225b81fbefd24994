import pytest

ODD = [
    "", "  ", None, "a", "a b", "  \x0b\x0c a", "á É\nΣΑΣ <|endoftext|>x<|ENDOFTEXT|> don't  I'LL b c\x1cd 12² \U0001f600\U0001f600!!", "İstanbul Å", "x\x85y", "가 ᅡ", "it's 's", "<|startoftext|>", "\x00",
    "ﬁ ①", "a  b\n\n c\n\nd \n e   ", "foo <|endoftext|> bar", "\x1c \x1d a\x1eb", "a" * 3000, "日本語 テスト", "x " * 40000, "a", "a",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts beside columns whose names clash with results."""
    rows = [(i, t, "keep", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
