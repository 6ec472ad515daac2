"""A small folder of tables: those of the smallest size, with rows for every odd case."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) of null, empty, very short, repeated and other unusual rows."""
    long = "the very long text goes on and on with new words " * 30 + "until it ends. " + "x" * 3000
    return [(None, None), (None, "some text without a key"), (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one"), (900_005, "É ß 漢字 😀 ＡＢ"), (900_006, long), (900_006, long), (900_006, "another text of the same key"), (900_007, long)]


@pytest.fixture(scope="session")
def docs(spark, sf_dir, odd_rows):
    """documents with the odd rows and columns that clash with names used inside."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = given.unionByName(spark.createDataFrame(odd_rows, "doc_id long, text string"))
    return both.withColumns({c: F.lit(7) for c in ("key", "score", "label", "n", "h", "d", "t", "i", "media", "class", "piece", "bucket", "host")})


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def small_dir(spark, sf_dir, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 0), (900_004, None, None), (900_002, 0, 0)], labels.schema)
    labels.unionByName(odd).write.parquet(str(folder / "labels.parquet"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = spark.createDataFrame([(None, "very long text goes"), (90_001, None), (90_002, ""), (90_003, "one"), (90_003, "One!"), (90_004, "on and on with new words")], bench.schema)
    bench.unionByName(odd).write.parquet(str(folder / "benchmark.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = [(None, None), (9001, ""), (9002, "no scheme"), (9003, "http://"), (9004, "HTTP://WWW.Example.COM/en/x?y#z"), (9005, "http://example.com"), (9006, "http://a.net/es/"), (9007, "http://notexample.com/en/"), (9008, "x://y://example.com/en/?a://b"), (9009, "http://com/")]
    pages.unionByName(spark.createDataFrame(odd, "page_id long, url string")).withColumn("rule", F.lit(1)).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(spark, small_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").limit(0).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)
