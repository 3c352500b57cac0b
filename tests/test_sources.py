"""CSV types with missing-value tokens, one test per token, and mixed columns."""

import pytest

from anomspark.sources.io import MISSING_TOKENS, read_table


def scan(spark, tmp_path, lines):
    f = tmp_path / "t.csv"
    f.write_text("\n".join(lines) + "\n")
    return read_table(spark, str(f), fmt="csv")


def test_every_token_is_null_in_a_double_column(spark, tmp_path):
    lines = ["k,x,q"] + [f"{i},{t},\"{t}\"" for i, t in enumerate(MISSING_TOKENS)] + ["99,1.5,7"]
    df = scan(spark, tmp_path, lines)
    assert dict(df.dtypes) == {"k": "bigint", "x": "double", "q": "double"}
    rows = {r["k"]: (r["x"], r["q"]) for r in df.collect()}
    assert len(rows) == len(MISSING_TOKENS) + 1 and rows.pop(99) == (1.5, 7.0)
    assert set(rows.values()) == {(None, None)}


@pytest.mark.parametrize("cells, kind, values", [
    (["1", "-2", "+3"], "bigint", [1, -2, 3]), (["1", "NA", "3"], "double", [1.0, None, 3.0]),
    (["1", "2.5", "1e3"], "double", [1.0, 2.5, 1000.0]), (["99999999999999999999", "1", "2"], "double", [1e20, 1.0, 2.0]),
    (["True", "false", "TRUE"], "boolean", [True, False, True]), (["True", "NA", "False"], "string", ["True", None, "False"]),
    (["NA", "null", "N/A"], "double", [None, None, None]), (["2024-01-01", "NA", "2024-01-02"], "string", ["2024-01-01", None, "2024-01-02"]),
    (["1", "na", "3"], "string", ["1", "na", "3"]), (["1.5d", "2", "3"], "string", ["1.5d", "2", "3"]),
    (["inf", "1", "NA"], "double", [float("inf"), 1.0, None])])
def test_types(spark, tmp_path, cells, kind, values):
    df = scan(spark, tmp_path, ["k,my.col"] + [f"{i},{v}" for i, v in enumerate(cells)])
    assert df.schema["my.col"].dataType.simpleString() == kind
    assert [r["my.col"] for r in df.orderBy("k").collect()] == values


def test_header_only(spark, tmp_path):
    df = scan(spark, tmp_path, ["a,b"])
    assert df.columns == ["a", "b"] and df.count() == 0
