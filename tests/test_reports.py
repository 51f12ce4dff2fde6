"""Reports of several shapes: counters, typed paths, lines that are none."""

from __future__ import annotations

import pytest

from passagekit.sources import reports


def saved(spark, tmp_path, *lines):
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    return reports.read(spark, str(tmp_path / "r.jsonl"))


def test_two_shapes(spark, tmp_path):
    df = saved(
        spark, tmp_path, '{"counts": {"a": 1, "b": 2, "c": null}, "id": "x"}', '{"result": {"counts": {"a": 4, "d": 12345678901}}, "id": 7}', "",
        '{"counts": {}, "id": "x"}', '{"id": null}', "[1, 2]", "{broken", '{"counts": {"a": 9}, "counts": {"a": 9}}',
    )
    totals = reports.counters(df, ["$.counts", "$.result.counts"])
    assert sorted(map(tuple, totals.collect())) == [("a", 5), ("b", 2), ("c", 0), ("d", 12345678901)]
    assert reports.malformed(df).count() == 2
    named = df.select(reports.part(["$.id"], "string").alias("text"), reports.part(["$.id"], "int").alias("number"))
    assert {tuple(r) for r in named.collect()} == {("x", None), ("7", 7), (None, None)}
    assert reports.of_other_input(df, {"$.id": "x"}).count() == 3  # 7, null and the list


@pytest.mark.parametrize("value", ['"many"', "1.5", "{}"])
def test_counters_are_whole_numbers(spark, tmp_path, value):
    with pytest.raises(Exception, match="(?i)variant|whole number"):
        reports.counters(saved(spark, tmp_path, f'{{"counts": {{"a": {value}}}}}'), ["$.counts"]).collect()


def test_no_reports(spark, tmp_path):
    assert reports.counters(saved(spark, tmp_path, ""), ["$.counts"]).count() == 0
