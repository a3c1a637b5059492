"""Versions of artifacts: what is committed is read, what isn't is not."""

import pytest

from riskspark.sources import artifacts


def write(spark, folder, value):
    spark.createDataFrame([(1, value), (2, None)], "id int, x double").write.parquet(f"{folder}/table")
    spark.createDataFrame([('{"best_threshold": 0.4}',)], "value string").write.text(f"{folder}/settings")


def test_a_half_written_run_is_never_read(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        artifacts.newest(spark, out, "train")
    first = artifacts.new_folder(out, "train")
    write(spark, first, 1.5)
    with pytest.raises(FileNotFoundError):
        artifacts.newest(spark, out, "train")
    artifacts.commit(spark, out, "train", first, ["table"], ["settings"], uses="there")
    second = artifacts.new_folder(out, "train")
    spark.range(3).write.parquet(f"{second}/table")  # ends before its settings and its manifest entry
    found = artifacts.newest(spark, out, "train")
    assert (found.number, found.folder, found.uses) == (1, first, "there")
    assert artifacts.read_table(spark, found, "table", verify=True).count() == 2
    with pytest.raises(Exception):
        artifacts.commit(spark, out, "train", second, ["table"], ["settings"])
    assert artifacts.newest(spark, out, "train") == found


def test_a_rerun_is_a_new_version_and_pins_hold(spark, tmp_path):
    out = str(tmp_path)
    for value in (1.0, 2.0):
        folder = artifacts.new_folder(out, "prepare")
        write(spark, folder, value)
        artifacts.commit(spark, out, "prepare", folder, ["table"], ["settings"])
    old, new = artifacts.versions(spark, out, "prepare")
    assert (old.number, new.number) == (1, 2) and artifacts.newest(spark, out, "prepare") == new
    assert {r["x"] for r in artifacts.read_table(spark, old, "table", verify=True).collect()} == {1.0, None}
    assert artifacts.by_folder(spark, out, "prepare", old.folder) == old
    with pytest.raises(KeyError):
        new.path("model")


def test_changed_files_are_noticed(spark, tmp_path):
    out = str(tmp_path)
    folder = artifacts.new_folder(out, "prepare")
    write(spark, folder, 1.0)
    version = artifacts.commit(spark, out, "prepare", folder, ["table"], ["settings"])
    spark.createDataFrame([(1, 9.0), (2, None)], "id int, x double").write.mode("overwrite").parquet(f"{folder}/table")
    spark.createDataFrame([('{"best_threshold": 0.5}',)], "value string").write.mode("overwrite").text(f"{folder}/settings")
    assert artifacts.read_table(spark, version, "table").count() == 2
    for read in (lambda: artifacts.read_table(spark, version, "table", verify=True), lambda: artifacts.verify_files(spark, version, "settings")):
        with pytest.raises(ValueError):
            read()
