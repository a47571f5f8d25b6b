import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder like the driver's, with a few dozen documents: near copies among them."""
    out = tmp_path_factory.mktemp("small")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.where("doc_id < 40").union(docs.where("doc_id < 6").withColumn("doc_id", docs["doc_id"] + 1000))
    for name, df in {"documents": few, **{t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels", "pages", "conversations", "embeddings")}}.items():
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def rows(df_rows, columns):
    """Rows as sorted text, for comparison between engines."""
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(r[c]) for c in columns]) for r in df_rows)


@pytest.fixture(scope="session")
def same(spark):
    import duckdb

    def check(query, sql, sf_dir):
        df = query(spark, sf_dir)
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            path = f"{sf_dir}/{f}"
            con.execute(f"create view {f.split('.')[0]} as from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {f.split('.')[0]} as from read_parquet('{path}')")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
        assert sorted(names) == sorted(df.columns)
        have = [r.asDict() for r in df.collect()]
        assert rows(have, sorted(names)) == rows(want, sorted(names))
        return have

    return check
