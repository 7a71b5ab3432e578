"""The balanced forms give the same rows as the plain ones when one key owns most rows."""

import random

from pyspark.sql import functions as F

from gleanery.operators.gather import gather_text
from gleanery.operators.lookup import hot_slices, lookup
from gleanery.operators.ordered import order_rows, running


def skewed(spark, n=400):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 9}", i, rng.randint(-5, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "k STRING, i LONG, x LONG").repartition(5)


def scan(df, hot_rows):
    rows = order_rows(df, ["k"], ["i"], hot_rows)
    first = running(
        rows, sums={"s": F.col("x")}, maxs={"m": F.col("x")}, maxs_before={"b": F.col("x")}, previous={"p": F.col("x")}
    )
    second = running(first, sums={"ss": F.col("s")}, maxs={"ms": F.when(F.col("x") > 3, F.col("s"))})
    return rows.split, sorted(tuple(r) for r in second.rows().collect())


def test_chunked_scan_equals_window(spark):
    df = skewed(spark)
    plain_split, plain = scan(df, 10_000)
    hot_split, hot = scan(df, 20)
    assert not plain_split and hot_split
    assert plain == hot


def test_carry_rows_are_fewer_than_chunks(spark):
    rows = order_rows(skewed(spark), ["k"], ["i"], 20)
    per_chunk = rows.df.groupBy("_chunk").count().collect()
    assert max(r["count"] for r in per_chunk) < 200  # no chunk holds the hot key whole
    pairs = rows.df.select("k", "_chunk").distinct().count()
    keys = rows.df.select("k").distinct().count()
    assert pairs - keys < len(per_chunk)


def test_sliced_lookup_equals_join(spark):
    facts = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("nobody", 3)], "k STRING, v LONG")
    assert hot_slices(facts, ["k"], 20).count() >= 1
    for how in ("left", "inner"):
        plain = facts.join(dim, ["k"], how).select("k", "i", "x", "v")
        cut = lookup(facts, dim, ["k"], ["i"], how, hot_rows=20).select("k", "i", "x", "v")
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_long_text_comes_whole_in_parts(spark):
    lines = skewed(spark).withColumn("t", F.concat(F.lit("line "), F.col("i")))
    whole = {r.k: r.text for r in gather_text(lines, ["k"], ["i"], "t", "\n").collect()}
    parts = gather_text(lines, ["k"], ["i"], "t", "\n", part_chars=100, hot_rows=20).collect()
    assert max(r.part_no for r in parts) > 5
    assert max(len(r.text) for r in parts) <= 120
    joined = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part_no)):
        joined.setdefault(r.k, []).append(r.text)
    assert {k: "\n".join(v) for k, v in joined.items()} == whole
