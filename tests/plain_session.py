"""Run by test_plain_session: queries and table changes in a plain session; prints one JSON line."""

import json
import os

import duckdb
from pyspark.sql import SparkSession

from runledger.operators.tables import delete_rows, update_rows, upsert
from runledger.sources import store
from workload import QUERIES
from workload.check import TABLES, compare

SF = "/root/testdata/sf0.001"


def main():
    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", f"{os.getcwd()}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}

    def rows(name="t", columns=("k", "v", "p")):
        cells = [[str(c) if hasattr(c, "isoformat") else c for c in r] for r in spark.table(name).select(*columns).collect()]
        return sorted(cells, key=lambda r: r[0])

    data = [(1, "a", None), (2, "b", None), (3, "c", "x"), (4, "d", "x"), (5, "e", "it's \\ 1/2=%"), (6, "f", "y")]
    spark.createDataFrame(data, "k int, v string, p string").write.partitionBy("p").saveAsTable("t")
    out["start"] = rows()

    def put(*changes, name="t"):
        new = spark.createDataFrame([(*c, 1) for c in changes], "k int, v string, p string, seq int")
        store.change_table(spark, name, "p", new, ["k"], lambda r: upsert(r, new, ["k"], "seq"))
        return rows(name)

    def remove(*keys):
        gone = spark.createDataFrame([(k,) for k in keys], "k int")
        store.change_table(spark, "t", "p", gone, ["k"], lambda r: delete_rows(r, gone, ["k"]))
        return rows()

    out["upserted"] = put((1, "A", "x"), (5, "E", "it's \\ 1/2=%"), (9, "n", None), (10, "e", ""))
    out["emptied"] = remove(6, None, 77)
    out["null_emptied"] = remove(2, 9, 10)
    out["null_again"] = put((11, "z", None), (2, "moved", "new"))[1:]
    remove(1)
    out["null_again"] = rows()
    out["removed"] = store.remove_unused(spark, "t")
    spark.catalog.refreshTable("t")
    out["cleaned"] = rows()

    # Two partitions, and a catalog that fails after the first.
    spark.createDataFrame([(1, "old", "a"), (2, "old", "b"), (3, "old", None)], "k int, v string, p string").write.partitionBy("p").saveAsTable("u")
    out["before_failure"] = rows("u")
    out["torn"], sql = False, type(spark).sql

    def failing(self, text, *args, **kwargs):
        if text.startswith("ALTER TABLE u PARTITION") and out["torn"] is False:
            out["torn"] = True
            raise RuntimeError("lost")
        return sql(self, text, *args, **kwargs)

    type(spark).sql = failing
    try:
        put((1, "new", "a"), (2, "new", "b"), (3, "new", None), name="u")
    except RuntimeError:
        pass
    finally:
        type(spark).sql = sql
    out["after_failure"] = rows("u")
    out["repeated"] = sorted(put((1, "new", "a"), (2, "new", "b"), (3, "new", None), name="u"))

    spark.sql("CREATE TABLE w (k INT, v STRING, n INT, d DATE) USING parquet PARTITIONED BY (n, d)")
    spark.sql("DROP TABLE w")
    spark.sql("CREATE TABLE w (k INT, v STRING, d STRING, n INT) USING parquet PARTITIONED BY (n)")
    spark.sql("INSERT INTO w VALUES (1, 'a', NULL, 3), (2, 'b', '2024-01-01', NULL)")
    new = spark.createDataFrame([(1, "c", 7, 1)], "k int, v string, n int, seq int")
    store.change_table(spark, "w", "n", new, ["k"], lambda r: update_rows(r, new, ["k"], "seq"))
    out["numbers"] = rows("w", ("k", "v", "n", "d"))

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    out["queries"] = {}
    for name in sorted(QUERIES):
        try:
            out["queries"][name] = compare(spark, con, name, SF)[2]
        except Exception as error:  # noqa: BLE001 - the test shows it
            out["queries"][name] = f"ERROR {str(error)[:500]}"
    print(json.dumps(out, default=str))


main()
