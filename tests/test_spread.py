"""What is shuffled, and how often a thing is worked out, where rows fan out."""

import math

import pytest

from segue.operators.tagging import tag
from segue.plans import structure
from segue.sources.tables import Tables


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["musical_points", "boundary_grid"])
def test_points_are_spread_after_the_shuffle(spark, tmp_path, capsys, name):
    rows = [(1, 30), (2, 5), (2, 6), (3, -30), (700, 1), (180, 0)]  # a repeated id, a track without tempo
    spark.createDataFrame(rows, "p_partkey long, p_size long").selectExpr("*", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "950.0 as p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = getattr(structure, name)(Tables(spark, str(tmp_path)))
    text = plan(df, capsys)
    assert -1 < text.index("Generate") < text.index("Exchange")  # the last step comes first in a plan
    want = set()
    for i, size in rows:
        bpm, dur = 60.0 + 2 * size, 120.0 + i % 181
        bars = [k for k in range(2000) if bpm > 0 and k * (240 / bpm) < dur]
        points = [dur * f for f in (0.25, 0.5, 0.75, 0.85)]
        if name == "boundary_grid":
            points += [0.0, dur] + [k * (240 / bpm) for k in bars]
        else:
            points += [k * (240 / bpm) for k in bars if k % 4 == 0 or k % 16 == 3]
            points += [k * (960 / max(bpm, 60)) for k in range(math.ceil(dur / (960 / max(bpm, 60))))] if 0 < len(bars) < 8 else []
        want |= {(i, round(x, 4)) for x in points}
    got = [(r.track_id, round(r.point_t, 4)) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_texts_are_tagged_once(spark, capsys):
    rows = [(1, "Chill mix, no sad songs"), (2, "chill mix, no sad songs "), (3, None), (4, "")]
    df = tag(spark.createDataFrame(rows, "request_id long, raw_text string"))
    assert "Join" in plan(df, capsys)
    got = {r.request_id: {k: v for k, v in r.asDict().items() if k != "request_id"} for r in df.collect()}
    assert len(got) == 4 and got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def test_many_mixes_share_a_state_row(spark, tmp_path, capsys):
    from segue.streaming import feedback as live
    from segue.streaming.violations import gap_stream

    schema = "mix_id long, out_start long, out_end long, tie long, track_id long, src_start long, src_end long"
    mixes = [(m, s, s + 10 + m % 3, 0, 1, 0, 1) for m in [*range(-400, 400), 2**60 + 1, 2**60] for s in (0, 10, 30)]
    mixes += [(None, s, s + 10, 0, 1, 0, 1) for s in (0, 12)]
    for k, starts in enumerate(((0, 10), (30, 12))):
        spark.createDataFrame([r for r in mixes if r[1] in starts], schema).coalesce(2).write.parquet(str(tmp_path / "v" / f"{k}.parquet"))
    stream = gap_stream(spark, live.read_stream(spark, str(tmp_path / "v" / "*.parquet"), "*.parquet", 2))
    assert "bucket" in plan(stream, capsys)
    want, ends = [], {}
    for m, s, e, *_ in mixes:
        end = ends.get(m, 0)
        if s != end:
            want.append((m, s, end, "output_gap" if s > end else "output_overlap"))
        ends[m] = max(end, e)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in live.drain(stream, "t-many").collect()), key=key) == sorted(want, key=key)


def test_shuffles_start_with_more_partitions_over_more_input(spark, tmp_path, monkeypatch):
    from segue import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(5000).repartition(4).write.parquet(str(tmp_path / "part.parquet"))
    session.spread(spark, str(tmp_path))
    small = int(spark.conf.get(key))
    monkeypatch.setattr(session, "PART_BYTES", 256)
    session.spread(spark, str(tmp_path))
    assert small == int(spark.conf.get("spark.sql.shuffle.partitions")) < int(spark.conf.get(key))
    spark.conf.unset(key)
