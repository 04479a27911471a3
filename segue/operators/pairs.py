"""Pair operators: whole-matrix summaries and exact best partners without the matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions.basic import snap
from segue.session import cut_lineage

FEATURES = ["bpm", "camelot", "mean_energy", "spectral_centroid"]


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add the four component scores and the rounded overall score to ``a_*``/``b_*`` pairs.

    Components are projected before they are combined, so each is evaluated once per pair.
    """
    a_bpm, b_bpm = F.col("a_bpm"), F.col("b_bpm")
    known = (a_bpm > 0) & (b_bpm > 0)
    return (
        pairs.withColumn("_gap", P.tempo_gap(a_bpm, b_bpm))
        .select(
            *pairs.columns,
            F.when(known, P.tempo_from_gap(F.col("_gap"))).otherwise(0.5).alias("tempo"),
            P.key_score(F.col("a_camelot"), F.col("b_camelot")).alias("key"),
            P.energy_score(F.col("a_mean_energy"), F.col("b_mean_energy")).alias("energy"),
            P.spectral_score(F.col("a_spectral_centroid"), F.col("b_spectral_centroid")).alias("spectral"),
        )
        .withColumn("overall", snap(P.acoustic_score(F.col("tempo"), F.col("key"), F.col("energy"), F.col("spectral"))))
    )


def _attribute_mean(tracks: DataFrame, attr: str, score, n_name: str) -> DataFrame:
    """Sum of one component over every other track, per distinct attribute value.

    Each component depends on one attribute, so the n x n matrix folds into a
    value x value table weighted by counts: its size follows the resolution of
    the attribute (tempo, wheel code, energy, brightness), not the catalog.
    """
    hist = tracks.groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    other = hist.select(F.col(attr).alias("o"), F.col("n").alias("o_n"))
    return (
        hist.join(other, F.col("o_n") > 0)
        .groupBy(attr)
        .agg((F.sum(score(F.col(attr), F.col("o")) * F.col("o_n")) - F.first(score(F.col(attr), F.col(attr)))).alias(n_name))
    )


def pair_matrix_summary(tracks: DataFrame) -> DataFrame:
    """Per track: partners and mean component and overall score over the whole ordered pair matrix."""
    n = tracks.agg(F.count(F.lit(1)).alias("n_all"))
    parts = [
        ("bpm", P.tempo_score, "tempo"), ("camelot", P.key_score, "key"),
        ("mean_energy", P.energy_score, "energy"), ("spectral_centroid", P.spectral_score, "spectral"),
    ]
    out = tracks.select("track_id", *FEATURES).crossJoin(F.broadcast(n))
    for attr, fn, name in parts:
        out = out.join(_attribute_mean(tracks, attr, fn, name), attr)
    others = F.col("n_all") - 1
    means = {name: F.col(name) / others for _, _, name in parts}
    return out.where(others > 0).select(
        F.col("track_id").alias("src"),
        others.cast("bigint").alias("n_partners"),
        *[F.round(m, 6).alias(f"mean_{k}") for k, m in means.items()],
        F.round(P.acoustic_score(*[means[k] for k in ("tempo", "key", "energy", "spectral")]), 6).alias("mean_overall"),
    )


# --- exact best partners -----------------------------------------------------

def _octave(bpm: Column) -> Column:
    """Tempo on a log scale with octaves folded, in [0, 1); null for unknown tempo."""
    x = F.when(bpm > 0, F.log2(bpm))
    return x - F.floor(x)


def _fold(x: Column, n: int) -> Column:
    return F.floor(x * n).cast("int") % n


def _near_fold(x: Column, n: int, reach: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(-reach), F.lit(reach)),
                                        lambda i: ((_fold(x, n) + i) % n + n) % n))


def _near_codes(code: Column) -> Column:
    """Wheel codes at distance at most 1."""
    h, m = P.wheel_hour(code), P.wheel_mode(code)
    name = lambda hour, mode: F.concat(((hour + 11) % 12 + 1).cast("string"), mode)
    other = F.when(m == "A", "B").otherwise("A")
    return F.array(code, name(h, other), name(h + 1, m), name(h - 1, m))


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("overall"), F.asc("dst"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


#: Bits of what is known of a track; unknown parts score one constant with every partner.
TEMPO, KEY, BRIGHT = 1, 2, 4


def _known() -> Column:
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    return flag(F.col("bpm") > 0, TEMPO) + flag(F.col("w") < 24, KEY) + flag(F.col("spectral_centroid") > 0, BRIGHT)


def _has(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(bit) > 0


def _best_possible(bits: Column) -> Column:
    """Score that no partner of a track with these known parts can exceed."""
    part = lambda bit: F.when(_has(bits, bit), 1.0).otherwise(0.5)
    return P.acoustic_score(part(TEMPO), part(KEY), F.lit(1.0), part(BRIGHT))


def _score(pairs: DataFrame) -> DataFrame:
    a_bpm, b_bpm = F.col("a_bpm"), F.col("b_bpm")
    p = pairs.select(
        "src", "dst", "a_top", a_bpm, b_bpm, P.tempo_gap(a_bpm, b_bpm).alias("gap"),
        P.key_score_at(F.col("a_w"), F.col("b_w")).alias("key"),
        P.energy_score(F.col("a_mean_energy"), F.col("b_mean_energy")).alias("energy"),
        P.spectral_score(F.col("a_spectral_centroid"), F.col("b_spectral_centroid")).alias("spectral"))
    tempo = F.when((a_bpm <= 0) | (b_bpm <= 0), 0.5).otherwise(P.tempo_from_gap(F.col("gap")))
    return p.select("src", "dst", "a_top", snap(P.acoustic_score(tempo, F.col("key"), F.col("energy"), F.col("spectral"))).alias("overall"))


def _tempo_bin(bpm: Column, folds: int) -> Column:
    return F.when(bpm > 0, _fold(_octave(bpm), folds)).otherwise(-1)


def _block(a: DataFrame, b: DataFrame, folds: int, width: float) -> DataFrame:
    """Adjacent key, tempo within one of ``folds`` octave bins, energy within one bin of ``width``.

    A source of unknown key or tempo takes every key or tempo bin instead.
    """
    energy = lambda p: F.floor(F.greatest(F.col(f"{p}_mean_energy"), F.lit(0.0)) / width).cast("int")
    any_key = F.array(*map(F.lit, range(26)))
    any_tempo = F.array(*map(F.lit, range(-1, folds)))
    left = (
        a.withColumn("b_w", F.explode(F.when(_has(F.col("a_known"), KEY), F.transform(_near_codes(F.col("a_camelot")), P.key_position)).otherwise(any_key)))
        .withColumn("t", F.explode(F.when(_has(F.col("a_known"), TEMPO), _near_fold(_octave(F.col("a_bpm")), folds, 1)).otherwise(any_tempo)))
        .withColumn("e", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: energy("a") + i)))
    )
    right = b.select("*", _tempo_bin(F.col("b_bpm"), folds).alias("t"), energy("b").alias("e"))
    return left.join(right, ["b_w", "t", "e"])


def _tight(a: DataFrame, b: DataFrame, reach: int, width: float, bright: bool) -> DataFrame:
    """Pairs of sources with all parts known: tempo within 2 %, energy within one bin of ``width``, the same key or (``reach`` 1) an adjacent one.

    With ``bright`` also brightness within a ratio of 0.85.
    """
    folds, step = 34, math.log(1 / 0.85) * (1 + 1e-9)
    energy = lambda p: F.floor(F.greatest(F.col(f"{p}_mean_energy"), F.lit(0.0)) / width).cast("int")
    light = lambda p: F.floor(F.log(F.col(f"{p}_spectral_centroid")) / step).cast("int") if bright else F.lit(0)
    ring = lambda c, r=1: F.transform(F.sequence(F.lit(-r), F.lit(r)), lambda i: c + i)
    codes = F.transform(_near_codes(F.col("a_camelot")), P.key_position) if reach else F.array("a_w")
    left = (
        a.where(F.col("a_known") == (TEMPO | KEY | BRIGHT))
        .withColumn("b_w", F.explode(codes)).withColumn("t", F.explode(_near_fold(_octave(F.col("a_bpm")), folds, 1)))
        .withColumn("e", F.explode(ring(energy("a")))).withColumn("s", F.explode(ring(light("a"), int(bright))))
    )
    right = b.where((F.col("b_bpm") > 0) & (F.col("b_spectral_centroid") > 0 if bright else F.lit(True)))
    return left.join(right.select("*", _fold(_octave(F.col("b_bpm")), folds).alias("t"), energy("b").alias("e"), light("b").alias("s")), ["b_w", "t", "e", "s"])


def _plateau(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Pairs for sources in dense cells, where the k best partners all score what is possible at best.

    A source ignores the parts it doesn't know, so a cell is taken by its known parts alone. Tracks of
    one fine cell and the cells next to it all but surely reach the best possible score with each other; where these hold more
    than k tracks, the best k ids are hardly greater than their k-th smallest id. Only ids up to a little beyond that, in cells
    close enough to reach that score, are read: a few dozen per cell, however many tracks it holds. A source that finds
    less than k partners among them goes on to the next level, so the guess decides only the work.
    """
    n_t, w_e, w_s, many = 68, 0.05, math.log(1 / 0.85) / 2 * (1 + 1e-9), 4
    cell = ["m", "cw", "ct", "ce", "cs"]
    area = ["m", "cw", "gt", "ge", "gs"]

    def cells(df: DataFrame, p: str, m: Column) -> DataFrame:
        c = lambda n: F.col(f"{p}_{n}")
        return df.withColumns({
            "m": m, "cw": F.when(_has(F.col("m") if p == "b" else m, KEY), c("w")).otherwise(-1),
            "ct": F.when(_has(F.col("m") if p == "b" else m, TEMPO), _fold(_octave(c("bpm")), n_t)).otherwise(-1),
            "ce": F.floor(c("mean_energy") / w_e).cast("int"),
            "cs": F.when(_has(F.col("m") if p == "b" else m, BRIGHT), F.floor(F.log(c("spectral_centroid")) / w_s).cast("int")).otherwise(-99)})

    def around(r: int, coarse: int = 1) -> tuple[Column, Column, Column]:
        """Cells (or areas of ``coarse`` cells a side) at most ``r`` cells away by tempo, energy and brightness."""
        near = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(-r), F.lit(r)), c))
        whole = lambda x: F.floor(x / coarse).cast("int")
        return (F.when(F.col("ct") < 0, F.array(F.lit(-1))).otherwise(near(lambda i: whole((F.col("ct") + i + n_t) % n_t))), near(lambda i: whole(F.col("ce") + i)),
                F.when(F.col("cs") == -99, F.array(F.lit(-99))).otherwise(near(lambda i: whole(F.col("cs") + i))))

    def expand(df: DataFrame, names: list[str], lists: tuple[Column, ...]) -> DataFrame:
        df = df.withColumns({f"_{n}": x for n, x in zip(names, lists)})
        for n in names:
            df = df.withColumn(n, F.explode(f"_{n}")).drop(f"_{n}")
        return df

    home = cells(a, "a", F.col("a_known"))
    modes = home.select("m").distinct()
    offered = b.withColumn("m", F.explode(F.array(*map(F.lit, range(8))))).where(F.col("b_known").bitwiseAND(F.col("m")) == F.col("m"))
    offered = cells(offered.join(modes, "m", "left_semi"), "b", F.col("m"))
    first = offered.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy("dst"))).where(F.col("rn") <= k + 2).select(*cell, "dst")
    lists = expand(first, ["ct", "ce", "cs"], around(1)).groupBy(*cell).agg(F.array_sort(F.collect_list("dst")).alias("ids")).where(F.size("ids") >= k)
    bounds = home.select(*cell).distinct().join(lists.select(*cell, F.element_at("ids", F.least(F.lit(k + 2), F.size("ids"))).alias("bound")), cell)
    wide = expand(bounds, ["gt", "ge", "gs"], around(2, many)).select(*area, "bound", *[F.col(c).alias(f"home_{c}") for c in cell[2:]])
    part = lambda c, none: F.when(F.col(c) == none, F.lit(none)).otherwise(F.floor(F.col(c) / many).cast("int"))
    offered = offered.withColumns({"gt": part("ct", -1), "ge": F.floor(F.col("ce") / many).cast("int"), "gs": part("cs", -99)})
    turn = F.abs(F.col("home_ct") - F.col("ct"))
    close = (F.least(turn, n_t - turn) <= 2) & (F.abs(F.col("home_ce") - F.col("ce")) <= 2) & (F.abs(F.col("home_cs") - F.col("cs")) <= 2)
    candidates = wide.join(offered, area).where((F.col("dst") <= F.col("bound")) & close)
    candidates = candidates.select("m", "cw", *[F.col(f"home_{c}").alias(c) for c in cell[2:]], *b.columns)
    return home.join(candidates, cell).select(*a.columns, *b.columns)


def _coarse(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Pairs for what no block settles: sources of sparse regions, a number bounded by the number of cells.

    Tracks are counted in coarse cells of tempo, key and energy, whose number doesn't grow with the
    catalog. For each cell of a source, the least scores of the other cells tell how good k partners
    are at least; cells whose greatest score stays below that are left out.
    """
    folds, width = 8, 0.3
    slot = lambda p: [F.col(f"{p}_w").alias(f"{p}w"), _tempo_bin(F.col(f"{p}_bpm"), folds).alias(f"{p}t"), F.floor(F.greatest(F.col(f"{p}_mean_energy"), F.lit(0.0)) / width).cast("int").alias(f"{p}e")]
    theirs = b.select("*", *slot("b"))
    size = theirs.groupBy("bw", "bt", "be").agg(F.count(F.lit(1)).alias("n"))
    own = a.select("*", *slot("a"))
    pairs = own.select("aw", "at", "ae").distinct().withColumn("bw", F.explode(F.array(*map(F.lit, range(26))))).join(size, "bw")
    turn = F.abs(F.col("at") - F.col("bt"))
    turn = F.least(turn, folds - turn)
    unknown = (F.col("at") < 0) | (F.col("bt") < 0)
    hill = F.abs(F.col("ae") - F.col("be"))
    key = P.key_score_at(F.col("aw"), F.col("bw"))
    most = P.acoustic_score(F.when(unknown, 0.5).when(turn <= 1, 1.0).otherwise(0.5), key, F.when(hill <= 1, 1.0).when(hill == 2, 0.8).otherwise(0.8), F.lit(1.0))
    least = P.acoustic_score(F.when(unknown, 0.5).when(turn == 0, 0.4).otherwise(0.0), key, F.when(hill == 0, 0.7).otherwise(0.0), F.lit(0.2))
    enough = Window.partitionBy("aw", "at", "ae").orderBy(F.desc("least"), "bw", "bt", "be").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("aw", "at", "ae")
    pairs = pairs.select("aw", "at", "ae", "bw", "bt", "be", "n", most.alias("most"), least.alias("least")).withColumn("so_far", F.sum("n").over(enough))
    pairs = pairs.withColumn("floor", F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("least"))).over(whole), F.lit(0.0)))
    chosen = pairs.where(F.col("most") >= F.col("floor") - 0.001).select("aw", "at", "ae", "bw", "bt", "be")
    return own.join(chosen, ["aw", "at", "ae"]).join(theirs, ["bw", "bt", "be"]).select(*a.columns, *b.columns)


def pair_topk(tracks: DataFrame, k: int = 5) -> DataFrame:
    """The k best partners of every track, ties by id; equal to ranking the full matrix.

    Tracks with equal features are ranked once, against the k + 1 smallest ids of each set of equal
    features: more of them can't be among the best. Then blocks are searched from tight to wide. A
    source is settled as soon as its last partner scores above everything its block leaves out, and
    only unsettled sources go on. The same levels run for catalogs of any size.
    """
    tracks = tracks.select("track_id", *FEATURES)
    need = k + 1
    same = Window.partitionBy(*FEATURES).orderBy("track_id")
    first = tracks.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= need).drop("rn")
    first = cut_lineage(first.withColumn("w", P.key_position(F.col("camelot"))).withColumn("known", _known()))
    kinds = first.groupBy(*FEATURES, "w", "known").agg(F.min("track_id").alias("src"))
    cols = [*FEATURES, "w", "known"]
    a = kinds.select("src", *[F.col(c).alias(f"a_{c}") for c in cols]).withColumn("a_top", _best_possible(F.col("a_known")))
    b = first.select(F.col("track_id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in cols])
    partial = F.col("a_known") < (TEMPO | KEY | BRIGHT)
    pick = [*a.columns, *b.columns]
    # Outside the first block brightness loses 0.02, outside the second tempo 0.04, outside the last one key 0.09 (tempo 0.098).
    levels = [
        (lambda s: _plateau(s, b, need), 0.001), (lambda s: _tight(s, b, 0, 0.1, True), 0.02),
        (lambda s: _tight(s, b, 1, 0.2, False).select(pick).unionByName(_block(s.where(partial), b, 11, 0.2).select(pick)), 0.04),
        (lambda s: _block(s, b, 11, 0.3), 0.09),
    ]
    done: list[DataFrame] = []
    rest = a
    for block, lost in levels:
        # Only scores above the bound can settle a source, so the rest is dropped before ranking.
        ranked = cut_lineage(_rank(_score(block(rest)).where(F.col("overall") > snap(F.col("a_top")) - lost + 0.0005), need))
        settled = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == need).select("src")
        done.append(ranked.join(settled, "src", "left_semi"))
        rest = cut_lineage(rest.join(settled, "src", "left_anti"))
    best = _rank(_score(_coarse(rest, b, need)), need)
    for d in done:
        best = best.unionByName(d)
    best = best.select("src", "dst", "overall")
    on = [tracks[c].eqNullSafe(kinds[c]) for c in FEATURES]
    each = tracks.join(kinds, on).select("track_id", "src").join(best, "src").where(F.col("track_id") != F.col("dst"))
    return _rank(each.select(F.col("track_id").alias("src"), "dst", "overall"), k).select("src", "dst", "rank", "overall")


def avoid_penalty(items: DataFrame, avoid_tracks: DataFrame, avoid_edges: DataFrame) -> DataFrame:
    """Soft penalties of listed tracks (0.14 as opener, 0.10 later) and listed edges (0.18)."""
    t = avoid_tracks.select(F.col("track_id").alias("dst"), F.lit(True).alias("bad_track")).distinct()
    s = avoid_tracks.select(F.col("track_id").alias("src"), F.lit(True).alias("bad_opener")).distinct()
    e = avoid_edges.select("src", "dst", F.lit(True).alias("bad_edge")).distinct()
    start = F.when((F.col("pos") == 1) & F.col("bad_opener"), 0.14).otherwise(0.0)
    step = F.when(F.col("bad_track"), 0.10).otherwise(0.0)
    edge = F.when(F.col("bad_edge"), 0.18).otherwise(0.0)
    return (
        items.join(t, "dst", "left").join(s, "src", "left").join(e, ["src", "dst"], "left")
        .select(*items.columns, start.alias("start_penalty"), step.alias("step_penalty"), edge.alias("edge_penalty"))
    )
