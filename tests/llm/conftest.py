import pytest
from pyspark.sql import functions as F

EDGES = [
    (9001, None, None, None), (9002, "", "", ""), (9003, " \t\n\x0b\x0c\r ", "en", "src0"), (9004, "one", "en", None),
    (9005, "a b", "en", "x.y"), (9006, "a b c d e " * 4000, "en", "src0"), (9007, "w" * 70000, "en", "src1"),
    (9008, "Ünïcode ß 漢字 \U0001f600 text <|endoftext|> end", "de", "src2"), (9009, "same line here ok\nsame line here ok\nother", "en", "src2"),
    (9010, "SAME LINE HERE OK  \nunique thing in ten\n\n", "en", "src2"), (None, "same line here ok\nnobody", "en", "src3"),
    (9011, "repeated row text that is long enough to matter for every operator here", "en", "src3"),
    (9011, "repeated row text that is long enough to matter for every operator here", "en", "src3"),
]


@pytest.fixture(scope="session")
def docs(spark, sf, tmp_path_factory):
    """The smallest documents with odd rows, a null id, repeated rows and a clashing extra column."""
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    base.unionByName(odd).withColumn("rid", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("size", F.lit(2)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
