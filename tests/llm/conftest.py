import pytest

# Nulls, empty and very long texts, ties, repeated rows, and extra columns with the names that operators use.
LONG = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
EDGES = [
    (1, "the same text of nine words that comes twice\nand a second line that has some more words", "x", 1),
    (2, "the same text of nine words that comes twice\nand a second line that has some more words", "x", 1),
    (2, "the same text of nine words that comes twice\nand a second line that has some more words", "x", 1),
    (None, "the same text of nine words that comes twice\nand a second line that has some more words", None, None),
    (3, None, None, None),
    (4, "", "y", 2),
    (5, " \t\n\v\f\r ", "y", 2),
    (6, LONG, "z", 3),
    (7, "one", "z", 3),
    (7, "two of one id", "z", 3),
    (None, None, None, None),
    (8, "Üñí 中文 😀 \x00 ▁▁   end", "z", 3),
]


@pytest.fixture
def edges(spark, tmp_path):
    """Read from files, so that the order of rows is the same each time."""
    path = str(tmp_path / "edges")
    rows = [(*r, "k", "l", 1, 2, 3) for r in EDGES]
    spark.createDataFrame(rows, "doc_id bigint, text string, digest string, fp bigint, line_id string, spans string, mix int, bucket int, hit int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def none(edges):
    return edges.where("doc_id > 1000")
