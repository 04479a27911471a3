"""Handoff scores at size: what crosses a shuffle, and pieces of curves against whole ones."""

import random

from pyspark.sql import functions as F

from segue import plans
from segue.operators import transitions as ops

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_part_without_voices_reads_no_regions(spark):
    for name in ("landing_score", "energy_continuity", "bass_handoff", "transition_floor", "playtime_score"):
        assert "IN (view,click)" not in plan(spark, name), name
    assert "IN (view,click)" in plan(spark, "style_fit")


def test_no_event_is_spread_over_the_points_of_its_curve(spark):
    for name in ("continuity_audit", "worst_transitions"):
        assert "Generate" not in plan(spark, name), name


def test_windows_over_a_piece_equal_windows_over_the_whole(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        n = rnd.choice([1, 2, 7, 64])
        run = [0.0]
        for _ in range(n):
            run.append(run[-1] + rnd.random())
        low = rnd.choice([-9.0, 0.0, 50.0, 119.0, 130.0])
        start = low + rnd.random() * 20
        rows.append((i, None, None, 120.0, low, low + 50, start, start + rnd.random() * 29) if i % 20 == 0 else (i, n, run, 120.0, low, low + 50, start, start + rnd.random() * 29))
    d = spark.createDataFrame(rows, "id int, b_n int, b_p_x array<double>, b_duration_sec double, low double, high double, s double, e double")
    mean = lambda at: ops.window_mean(F.col("b_p_x"), F.col("b_n"), F.col("s"), F.col("e"), F.col("b_duration_sec"), F.lit(-1.0), at).alias("m")
    cut = ops.piece(d, "b", F.col("low"), F.col("high"))
    assert d.select("id", mean(0)).orderBy("id").collect() == cut.select("id", mean(F.col("b_at"))).orderBy("id").collect()


def test_share_of_a_window_with_regions(spark):
    d = spark.sql("""select * from values (array(struct(0D as s, 4D as e), struct(3D as s, 5D as e), struct(20D as s, 30D as e)), 2D, 10D), (null, 0D, 5D), (array(struct(0D as s, 9D as e), struct(0D as s, 9D as e)), 0D, 8D),
 (array(struct(0D as s, 4D as e)), 1D, 0D) as v(r, s, l)""")
    assert [x[0] for x in d.select(ops.share_of(F.col("r"), F.col("s"), F.col("l"))).collect()] == [0.4, 0.0, 1.0, 0.0]


def test_local_windows_are_rounded_from_whole_numbers(spark):
    from fractions import Fraction as Fr
    from math import floor

    from segue.plans.transitions import _exact

    rows = [(2, s1, n, 1, 2.0 * r) for s1, n, r in [(99999000, 24999000, 24999500), (49999000, -25001000, 49999000), (100000, 0, 0), (149998999, 2499499, 74999500)]] + [(1, 77, 0, 0, 0.0)]
    d = spark.createDataFrame(rows, "a_k long, a_s1 long, a_num long, a_den long, a_root double").selectExpr("*", *_exact("a", "x", "div"))
    half = lambda x, n: (1 if x >= 0 else -1) * floor(abs(x) * 10**n + Fr(1, 2)) / 10**n
    nudge, unit = Fr(1, 10**9), 5 * 10**8
    for r in d.collect():
        assert r.x_energy == half(Fr(r.a_s1, r.a_k * unit) + nudge, 4)
        assert r.x_rhythm == half(Fr(int(r.a_root), r.a_k * unit) + nudge, 4)
        assert r.x_slope == (half(Fr(r.a_num, r.a_den * unit) + nudge, 5) if r.a_den else 0.0)


def test_local_windows_join_no_points(spark):
    for name in ("local_context", "local_context_score"):
        assert "Generate" not in plan(spark, name), name


def test_openers_rank_what_the_sets_of_a_request_hold(spark):
    held = spark.sql(f"select distinct o_custkey, l_partkey from parquet.`{SF}/orders.parquet` join parquet.`{SF}/lineitem.parquet` on l_orderkey = o_orderkey")
    best = plans.QUERIES["openers"](spark, SF).select(F.col("request_id").alias("o_custkey"), F.col("track_id").alias("l_partkey"))
    assert best.count() == held.groupBy("o_custkey").count().selectExpr("sum(least(count, 15))").first()[0]
    assert best.join(held, ["o_custkey", "l_partkey"], "left_anti").isEmpty()


def test_search_agrees_with_its_sql_where_a_stretched_blend_ends_on_a_point(spark, tmp_path):
    import os

    import duckdb

    big = "/root/testdata/sf0.1"
    for name in os.listdir(big):
        if name != "lineitem.parquet":
            os.symlink(f"{big}/{name}", tmp_path / name)
    spark.read.parquet(f"{big}/lineitem.parquet").where("l_orderkey in (2928, 19018, 42364, 60456)").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("part", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("transition_search", "segment_pair_score", "edge_quality_best"):
        d = plans.QUERIES[name](spark, str(tmp_path))
        got = sorted(tuple(r) for r in d.collect())
        assert got == sorted(con.execute(f"select {', '.join(d.columns)} from ({plans.ORACLES[name]})").fetchall()), name
