import os

from lattica import tables


def test_written_tables_and_their_ends(spark):
    a, b = (tables.materialize(spark.range(5), "t") for _ in range(2))
    paths = [df.written_path.split(":")[-1] for df in (a, b)]
    assert a.count() == 5 and all(map(os.path.isdir, paths)) and paths[0] != paths[1]
    assert f"/lattica/{spark.sparkContext.applicationId}/" in paths[0]
    tables.discard(a)
    assert [os.path.isdir(p) for p in paths] == [False, True] and b.count() == 5
