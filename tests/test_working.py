"""Working tables: kept while they are needed, and deleted when told so."""

import os

from trajectra.plans import queries
from trajectra.sources import working


def test_folders_go_when_told(spark, monkeypatch):
    monkeypatch.setattr(working, "_made", set())  # other tests' folders stay
    monkeypatch.setattr(queries, "_kept", {(spark.sparkContext.applicationId, "d", "f"): 1, ("other", "d", "f"): 2})
    monkeypatch.setattr(queries, "_fitted", {})
    kept = working.working(spark, "gone")(spark.range(3), "rows")
    assert kept.count() == 3
    (root,) = working._made
    path = root.removeprefix("file://")
    assert os.path.isdir(path)
    queries.forget(spark)
    assert not os.path.exists(path) and not working._made and queries._kept == {("other", "d", "f"): 2}
