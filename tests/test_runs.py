"""Runs in folders and archives, whole and failed."""

import zipfile

from pyspark.sql import types as T

from tessera.sources import runs

SCHEMA = T.StructType([T.StructField("energy", T.DoubleType()), T.StructField("sites", T.ArrayType(T.StringType()))])
META = "workflow: relax\nrun_id: \"r-1\"\nsource: 'a: b'\nextra: [1, 2]\n"


def test_failed_runs_hold_up_no_others(spark, tmp_path):
    def folder(name, **files):
        (tmp_path / name).mkdir(parents=True)
        for n, text in files.items():
            (tmp_path / name / n.replace("_", ".")).write_text(text)

    good = '{"energy": -1.5, "sites": ["x", "y"], "more": 1}'
    folder("my-task-1", metadata_yaml=META, results_json=good)
    folder("deep/x-task-2", metadata_yaml=META.replace("run_id", "id"), results_json=good)
    folder("task-3", metadata_yaml=META)
    folder("task-4", metadata_yaml=META, results_json='{"energy": ')
    folder("task-5", metadata_yaml=META, results_json='{"energy": "none"}')
    folder("task-6", results_json=good)
    folder("task-7", notes_txt="empty")
    folder("other-8", metadata_yaml=META, results_json=good)
    folder("task-9", metadata_yaml=META.replace("\n", "\r\n"), results_json="{}")
    for name, energy in (("task-10", 2.0), ("my-task-1", 9.0)):  # the folder of my-task-1 counts
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}/metadata.yaml", META)
            z.writestr(f"{name}/results.json", f'{{"energy": {energy}}}')
    found = runs.read_runs(spark, f"file://{tmp_path}", SCHEMA)
    got = {r.run: r for r in found.collect()}
    assert {k: r.failure for k, r in got.items()} == {"my-task-1": None, "x-task-2": "no run_id", "task-3": "no results", "task-4": "broken results", "task-5": "broken results", "task-6": "no metadata", "task-9": None, "task-10": None}
    one = got["my-task-1"]
    assert (one.workflow, one.run_id, one.source, one.energy, one.sites, one.archived) == ("relax", "r-1", "a: b", -1.5, ["x", "y"], False)
    assert got["task-10"].energy == 2.0 and got["task-10"].archived and got["task-9"].energy is None and got["task-9"].source == "a: b"
    assert {r.run for r in runs.loaded(found).collect()} == {"my-task-1", "task-9", "task-10"}


def test_runs_are_written_and_read(spark, tmp_path):
    rows = [(f"task-{i}", i % 2 == 0, META, f'{{"energy": {i}.5}}') for i in range(20)]
    df = spark.createDataFrame(rows, "run string, z boolean, m string, r string")
    assert runs.write_runs(df, f"file://{tmp_path}/out", "run", "m", "r", "z") == 20
    found = runs.loaded(runs.read_runs(spark, f"file://{tmp_path}/out", SCHEMA))
    assert sorted((r.run, r.archived, r.energy) for r in found.collect()) == sorted((n, z, int(n[5:]) + 0.5) for n, z, _, _ in rows)
    assert runs.write_runs(df.where("false"), f"file://{tmp_path}/none", "run", "m", "r", "z") == 0
    assert runs.read_runs(spark, f"file://{tmp_path}/none", SCHEMA).count() == 0
