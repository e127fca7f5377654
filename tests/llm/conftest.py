import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: The columns of documents, and others whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, `__text` string, `__id` string, item_ids string, `__items` string, toxicity string, word string, tie string, pii_spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with ids 0.. and columns that clash with the operators' names."""

    def make(texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, None, None, None, *["clash"] * 9) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make
