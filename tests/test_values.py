"""Sources and value functions over small fixtures."""

import base64
import zipfile

from pyspark.sql import functions as F

from tessera.functions import values
from tessera.sources import files
from tessera.sources.datastore import Datastore


def test_zipped_csv_and_uploads(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", 'k,v\n1,"a,\nb"\n2,\n')
        z.writestr("note.txt", "no rows")
        z.writestr("y.csv", "v,k,more\nz,3,9\n")
    df = files.read_zipped_csv(spark, str(tmp_path / "a.zip"), spark.createDataFrame([], "k long, v string").schema)
    assert sorted(map(tuple, df.collect())) == [(1, "a,\nb"), (2, None), (3, "z")]
    up = "data:text/csv;base64," + base64.b64encode(b'k,v\r\n1,"a\r\nb"\r\n\r\n2,"c ""d"""\r\n').decode()
    assert sorted(r.line for r in files.upload_rows(spark.createDataFrame([(up,)], "c string"), "c").collect()) == ['1,"a\r\nb"', '2,"c ""d"""']


def test_process_goes_on_where_it_stopped(spark, tmp_path):
    store = Datastore(spark, f"{tmp_path}/s", "k", 7)
    store.stage(spark.range(50).select(F.col("id").cast("string").alias("k")))
    store.promote()
    n, calls = store.df.select("chunk_key").distinct().count(), []

    def make(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df.withColumn("size", F.length("k"))

    try:
        store.process(make, f"{tmp_path}/out", batch=3)
    except RuntimeError:
        pass
    assert store.process(make, f"{tmp_path}/out", batch=3) == n - 3
    assert store.process(make, f"{tmp_path}/out", batch=3) == 0
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 50
    first = [r.k for r in store.sampled(5, 3).collect()]
    assert len(first) == 5 and first == [r.k for r in store.sampled(5, 3).collect()]


def test_odd_values(spark):
    rows = [("0x" + "f" * 31, "Ångström é", "true"), ("f" * 32, None, "x"), (None, "", "-7"), ("0x0", "straße ﬁ", "1e3")]
    df = spark.createDataFrame(rows, "h string, a string, t string").select(values.wide_hex(F.col("h")).alias("h"), values.folded(F.col("a")).alias("a"), values.typed(F.col("t")).alias("t"), values.repaired_encoding(F.col("a")).alias("e"))
    got = df.collect()
    assert [None if r.h is None else int(r.h) for r in got] == [(1 << 124) - 1, None, None, 0]
    assert [r.a for r in got] == ["Angstrom e", None, "", "straße ﬁ"]
    assert [tuple(r.t) for r in got] == [(None, None, True), (None, None, None), (-7, None, None), (None, 1000.0, None)]
    assert [r.e for r in got] == [r[1] for r in rows]
