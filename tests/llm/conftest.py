import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 997} other" for i in range(30_000))
    rows = [
        (0, "the cat sat on the mat and the dog sat on the rug", "en", "a", 1.0, "x", 5), (1, None, None, None, None, None, None),
        (2, "", "en", "a", 2.0, "y", 6), (None, "the cat sat on the mat and the dog sat on the rug", None, "b", None, None, 1),
        (3, long, "en", "b", 1.0, "z", 2), (4, "   \t\n", "de", None, 1.0, "z", 2), (5, "12 34 %%", "fr", "c", 1.0, "z", 2),
        (6, "the cat sat on the mat and the dog sat on the rug", "en", "a", 1.0, "x", 5),
        (6, "the cat sat on the mat and the dog sat on the rug", "en", "a", 1.0, "x", 5), (7, "é" * 5000 + " 𝄞 ende", "de", "a", 1.0, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, fp string, size int")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture()
def shared_files(spark):
    def files(part):
        return glob.glob(os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), f"*{part}*"))

    return files
