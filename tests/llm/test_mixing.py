import pytest

from larkspur.llm import mixing
from tests.compare import duck_rows, spark_rows

SCHEMA = "doc_id bigint, text string, source string, size string, extra string"


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA))


def test_equals_sql(spark, duck, sf):
    df = mixing.query(spark, sf)
    assert spark_rows(df) == duck_rows(duck, mixing.SQL, df.columns)


def test_targets_and_limits(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3] if i % 7 else None, "x", "y") for i in range(400)]
    got = mixed(spark, rows).collect()
    assert len(got) == 400
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] and r.extra == "y"
        by.setdefault(r.source, []).append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6
    for rs in by.values():
        assert rs[0].target <= 3 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 5


def test_hot_source_is_capped_and_the_rest_shared(spark):
    rows = [(i, "w " * 10, "a" if i else "b", None, None) for i in range(50)]
    got = {r.source: r for r in mixed(spark, rows).collect()}
    # b would get twice a's share, and stops at three times its size
    assert got["b"].target == 30 and got["a"].target == 470


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "", "a", None, None), (None, "", "a", None, None)]])
def test_empty(spark, rows):
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def test_repeated_rows_go_together(spark):
    got = mixed(spark, [(7, "a b c", "s", None, None)] * 4 + [(8, "a b", "t", None, None)]).collect()
    assert len(got) == 5 and len({r.taken for r in got if r.doc_id == 7}) == 1


def test_nested_budgets(spark):
    """What a smaller weight takes, a larger one takes too."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2], None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    small = {r.doc_id: r.taken for r in mixing.mix(df, weights=(2, 3)).where("source = 'a'").collect()}
    large = {r.doc_id: r.taken for r in mixing.mix(df, weights=(3, 3)).where("source = 'a'").collect()}
    assert all(large[k] >= v for k, v in small.items()) and sum(large.values()) > sum(small.values())


def test_own_columns_stay(spark):
    rows = [(i, "a b c", "s", 1, 2, 3, 4) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, whole int, last int, _hash int, _mix int")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken"]
    assert {tuple(r)[3:7] for r in out.collect()} == {(1, 2, 3, 4)}
