"""Transcripts kept as a table of files: not a folder and a file for each."""

from __future__ import annotations

from pathlib import Path

import pytest

from speechmart.queries import source_queries as queries
from speechmart.sources import io

ODD = ['[{"text": "a", "start": 1, "end": null, "source": "s"}, {"text": "b\\n", "start": 2.5}]', '{"text": "one", "start": 0}', "[]", '[{"text": "cut"', "", " \n"]


@pytest.mark.parametrize("name", ["nested_json_scan", "json_rows_scan"])
def test_files_written_do_not_grow_with_the_transcripts(spark, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    getattr(queries, name)(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    stems = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    written = sum(1 for new in set(shared.iterdir()) - before for _ in new.rglob("*.parquet")) + sum(1 for new in set(shared.iterdir()) - before for _ in new.rglob("*.txt"))
    assert stems >= 100
    assert 0 < written < stems / 2


def test_a_table_of_files_reads_as_the_files_do(spark, tmp_path):
    for n, text in enumerate(ODD):
        (tmp_path / f"f{n}.json").write_text(text)
    from_files = io.read_rows(spark, str(tmp_path), io.CHUNK).select("audio_stem", "text", "start", "end", "source")
    table = spark.createDataFrame([(f"f{n}", text) for n, text in enumerate(ODD)], "audio_stem string, value string")
    key = lambda r: tuple(map(str, r))
    assert sorted(io.rows_in(table, io.CHUNK).collect(), key=key) == sorted(from_files.collect(), key=key)
