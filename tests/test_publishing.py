"""Builds on a shared file system: races, restarts and what a reader sees."""

from __future__ import annotations

import threading

import pytest

from passagekit.sources import store, writers

RULES = "rule string, key string"


def rows(spark, n=50, version=0):
    return spark.range(n).selectExpr("id", f"id * 3 + {version} AS v", "CAST(NULL AS STRING) AS t", "IF(id % 3 = 0, 'val', 'train') AS split")


def test_names_follow_content_only(spark):
    df = rows(spark)
    name = writers.build_id(df, {"a": 1})
    assert writers.build_id(df.repartition(7), {"a": 1}) == name
    others = [writers.build_id(d, c) for d, c in [(df, {"a": 2}), (rows(spark, 51), {"a": 1}), (df.union(df.limit(1)), {"a": 1}), (rows(spark, 50, 1), {"a": 1}), (df.limit(0), {"a": 1})]]
    assert len({name, *others}) == 6


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_writers_race_and_readers_see_whole_builds(spark, tmp_path, scheme):
    root, none, failed, seen = f"{scheme}{tmp_path}/b", spark.createDataFrame([], RULES), [], []

    def write(version):
        try:
            writers.publish(rows(spark, 50, version), none, root, {"a": 1})
        except Exception as e:  # noqa: BLE001  (shown below)
            failed.append(e)

    threads = [threading.Thread(target=write, args=(v,)) for v in (0, 0, 1, 0)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        df = writers.current(spark, root)
        if df is not None:
            seen.append(df.count())
    assert not failed and set(seen) <= {50} and writers.current(spark, root).count() == 50
    folders = [p.name for p in (tmp_path / "b").iterdir() if p.is_dir()]
    assert len(folders) == 2 and not any(f.startswith(".") for f in folders)


def test_a_lost_writer_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    root, none = str(tmp_path), spark.createDataFrame([], RULES)
    first = writers.publish(rows(spark), none, root, {})
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            writers.publish(rows(spark, 60), none, root, {})
    assert writers.current(spark, root).count() == 50 and store.read_json(spark, f"{root}/current.json")["build"] in first
    writers.publish(rows(spark, 60), none, root, {})
    assert writers.current(spark, root).count() == 60
    with pytest.raises(ValueError, match="violated"):
        writers.publish(rows(spark, 70), spark.createDataFrame([("r", "k")], RULES), root, {})
    assert writers.current(spark, root).count() == 60


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/d/x.json"
    assert store.read_json(spark, path) is None
    store.write_json(spark, path, {"a": "é"})
    store.write_json(spark, path, [1, None])
    assert store.read_json(spark, path) == [1, None]
    with pytest.raises(ValueError):
        store.write_json(spark, path, float("nan"))
