"""F8: the steps of a sequence read written anchors and postings."""

from __future__ import annotations

from speechmart.queries import align_queries


def test_candidates_do_not_read_the_texts_again(spark):
    files = align_queries._candidates(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "/testdata/" in f]
