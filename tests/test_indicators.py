import pytest
from pyspark.sql import functions as F

from ebbtide.operators import indicators
from ebbtide.operators.clean import Dummies


def rows(spark):
    data = [(i, "hot" if i % 3 else f"v{i}", [None, "", "x", "a`b"][i % 4], i * 2) for i in range(600)]
    data += [(None, "hot", None, 0), (None, "hot", None, 0), (7, None, "x", 1)]
    return spark.createDataFrame(data, "key int, wide string, `small one` string, other int")


@pytest.mark.parametrize("frequent", [2_000, 20])
def test_sparse_rows_equal_the_dense_ones(spark, monkeypatch, frequent):
    monkeypatch.setattr(indicators, "FREQUENT", frequent)
    df, columns = rows(spark).repartition(5), ["wide", "small one"]
    words = indicators.learn(df, columns)
    listed = {r.number: (r.column, r.value) for r in words.collect()}
    assert sorted(listed) == list(range(len(listed)))
    encoded = indicators.encode(df, words, columns, "key")
    assert encoded.columns == ["key", "other", "indices"]
    got = sorted(((r.key, r.other, frozenset(listed[i] for i in r.indices)) for r in encoded.collect()), key=repr)
    dense = Dummies.fit(df)
    names = {f"{c}_{'null' if v is None else v}": (c, v) for c, vs in dense.values.items() for v in vs}
    want = [(r["key"], r["other"], frozenset(pair for n, pair in names.items() if r[n]))
            for r in dense.transform(df).collect()]
    assert got == sorted(want, key=repr)


def test_unknown_values_vectors_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "key int, c string")
    words = indicators.learn(df.where("key < 3"), ["c"])
    number = {r.value: r.number for r in words.collect()}
    out = indicators.encode(df, words, ["c"], "key").withColumn(
        "v", indicators.as_vector(F.col("indices"), 2))
    got = {r.key: (r.indices, r.v) for r in out.collect()}
    assert got[1][0] == [number["a"]] and got[3][0] == []
    assert got[2][1].size == 2 and got[2][1].toArray().tolist() == [float(i == number["b"]) for i in (0, 1)]
    none = indicators.learn(df.where("false"), ["c"])
    assert none.count() == 0 and indicators.encode(df, none, ["c"], "key").where("size(indices) = 0").count() == 3
    with pytest.raises(indicators.VectorTooWide):
        indicators.as_vector(F.col("indices"), 1 << 31)
