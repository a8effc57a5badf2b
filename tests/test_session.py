"""Written intermediates can be removed again."""

import os

from corpuscle.session import drop_written, written, written_paths


def test_written_results_are_dropped_from_a_mark_on(spark):
    mark = len(written_paths(spark))
    kept = written(spark.range(3).toDF("id"), "kept")
    a = written(spark.range(5).toDF("id"), "plain")
    b = written(spark.range(7).toDF("id"), "placed", bucket_by="id", buckets=2)
    assert (a.count(), b.count()) == (5, 7)
    paths = [p.removeprefix("file:") for p in written_paths(spark)[mark:]]
    assert all(map(os.path.exists, paths)) and drop_written(spark, mark + 1) == 2
    assert os.path.exists(paths[0]) and not any(map(os.path.exists, paths[1:])) and kept.count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("placed_")]
