"""The candidate pool holds every track of the library for every request, without a shuffle of the pairs."""

from pyspark.sql import functions as F

from segue.plans import intent as plan
from segue.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_every_track_meets_every_request(spark, capsys):
    t = Tables(spark, SF)
    df = plan.candidate_pool(t)
    df.explain()
    assert "hashpartitioning(request_id" not in capsys.readouterr().out
    got = df.groupBy("request_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("track_id").alias("ids")).collect()
    n = t.tracks().count()
    assert n > plan.TOP and len(got) == t.raw("customer").count() and {(r.n, r.last, r.ids) for r in got} == {(n, n, n)}


def test_sizes_agree_with_the_totals(spark):
    t = Tables(spark, SF)
    inside = F.count_if(F.col("step").isin("all", "match", "two_tracks", "duration", "variety", "last_resort"))
    got = plan.candidate_pool(t).groupBy("request_id").agg(inside.alias("n_pool"), F.count_if(F.col("step") == "excluded").alias("n_excluded"))
    want = plan.excluded_minus_pool(t).select("request_id", "n_pool", "n_excluded")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
