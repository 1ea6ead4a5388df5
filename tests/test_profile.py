"""Profile operators on literal frames."""

from arrears.operators import profile as pr


def _df(spark):
    rows = [(1, "a", 2.0), (2, None, None), (2, "b", 4.0), (3, "a", None)]
    return spark.createDataFrame(rows, "k long, cat string, x double")


def test_shape_and_non_null(spark):
    df = _df(spark)
    assert tuple(pr.table_shape(df).collect()[0]) == (4, 3)
    got = {r.column_name: (r.position, r.data_type, r.non_null) for r in pr.profile_columns(df).collect()}
    assert got == {"k": (0, "bigint", 4), "cat": (1, "string", 3), "x": (2, "double", 2)}


def test_missing_and_unique(spark):
    df = _df(spark)
    miss = {r.column_name: (r.missing, r.missing_share) for r in pr.missing_table(df).collect()}
    assert miss == {"cat": (1, 0.25), "x": (2, 0.5)}
    nu = {r.column_name: r.n_unique for r in pr.nunique_per_column(df).collect()}
    assert nu == {"k": 3, "cat": 2, "x": 2}  # NULL is not a value (pandas nunique)


def test_counts_keep_null_category_and_order(spark):
    got = [(r.cat, r.cnt) for r in pr.category_counts(_df(spark), "cat").collect()]
    assert got == [("a", 2), ("b", 1), (None, 1)]
    assert [r.cat for r in pr.category_counts(_df(spark), "cat", top=1).collect()] == ["a"]


def test_side_by_side_value_counts(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 1)], "f int, g int")
    got = {r.value: (r.f, r.g) for r in pr.flag_value_counts(df, ["f", "g"]).collect()}
    assert got == {"0": (1, None), "1": (2, 3)}


def test_duplicates_distinct_orphans(spark):
    df = _df(spark)
    assert [(r.k, r.cnt) for r in pr.duplicate_keys(df, "k").collect()] == [(2, 2)]
    assert tuple(pr.distinct_vs_rows(df, "k").collect()[0]) == (3, 4)
    parent = spark.createDataFrame([(1,), (3,)], "k long")
    assert pr.orphan_count(df, parent, "k").collect()[0].orphans == 2


def test_preview_head_and_tail(spark):
    df = _df(spark)
    assert [r.k for r in pr.preview_rows(df, ["k", "x"], 2).collect()] == [1, 2]
    assert [r.k for r in pr.preview_rows(df, ["k"], 1, tail=True).collect()] == [3]
