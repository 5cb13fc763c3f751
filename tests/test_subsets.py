"""Subsets below each other, from several tables or from one."""

from traceforge.sources import problems


def test_subsets_from_tables_and_from_one_column_agree(spark):
    rows = [(1, "x"), (2, None), (3, "y"), (4, "x")]
    frame = spark.createDataFrame(rows, "id long, lang string")
    parts = {name: frame.where(frame["lang"].eqNullSafe(name)).drop("lang") for name in ("x", "y", None)}
    joined = problems.concat_subsets(parts).select("id", "subset")
    marked = problems.subsets_of(frame, "lang")
    assert marked.columns == ["id", "subset"]
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, marked.collect())) == rows
