"""Exact neighbours, hulls, wake kernel, components, manifests, models against closed forms."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import analogs as N
from windrow.operators import association as A
from windrow.operators import lineage as L
from windrow.operators import models as M
from windrow.operators import spatial as X
from windrow.operators.lookups import attach, bounded
from windrow.sources import dimensions as DM
from windrow.sources import manifests as MF
from windrow.sources import payloads as PL
from windrow.sources import readers as RD
from windrow.sources import sinks as SK


def haversine(a, b):
    la, lo, lb, lp = map(np.radians, (a[0], a[1], b[0], b[1]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 6371.0088 * 2 * np.arcsin(np.sqrt(h))


def test_nearest_cells_are_exact_even_when_far_away(spark):
    rng = np.random.default_rng(7)
    cells = [(i, float(37 + rng.uniform(0, 1)), float(128 + rng.uniform(0, 1))) for i in range(120)]
    sites = [(100 + i, float(37 + rng.uniform(-0.5, 1.5)), float(128 + rng.uniform(-0.5, 1.5))) for i in range(15)] + [(999, 39.5, 131.0)]
    out = X.nearest_cells(spark.createDataFrame(sites, "turbine_id int, lat double, lon double"), spark.createDataFrame(cells, "grid_id int, lat double, lon double"), 5)
    got = {}
    for r in out.collect():
        got.setdefault(r["turbine_id"], {})[r["rank"]] = r["grid_id"]
    for s, la, lo in sites:
        order = sorted(cells, key=lambda c: (round(haversine((la, lo), c[1:]), 9), c[0]))[:5]
        assert [got[s][k + 1] for k in range(5)] == [c[0] for c in order]


def test_idw_weights_sum_to_one(spark):
    near = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 1, 3.0, 1)], "turbine_id int, grid_id int, distance_km double, rank int")
    for mode in (True, False):
        sums = [r[0] for r in X.idw_weights(near, bounded=mode).groupBy("turbine_id").agg(F.sum("weight")).collect()]
        assert [r[1] for r in X.idw_weights(near, bounded=mode).groupBy("turbine_id").agg(F.sum("weight").alias("w")).collect()] == pytest.approx([1.0, 1.0]), sums


def test_layout_extent_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [("f1", i, float(37 + rng.uniform(0, 0.1)), float(128 + rng.uniform(0, 0.1)), 3.6) for i in range(40)] + [("f2", 1, 37.0, 128.0, 3.6), ("f3", 1, 37.0, 128.0, 3.6), ("f3", 2, 37.01, 128.0, 3.6)]
    got = {r["farm"]: r["layout_extent_km"] for r in X.layout_extent(spark.createDataFrame(rows, "farm string, turbine_id int, lat double, lon double, capacity_mw double"), salt=4).collect()}
    pts = np.array([(r[2], r[3]) for r in rows if r[0] == "f1"])
    lat0 = pts[:, 0].mean()
    xy = np.column_stack([(pts[:, 1] - pts[:, 1].mean()) * 111.32 * np.cos(np.radians(lat0)), (pts[:, 0] - lat0) * 110.574])
    assert got["f1"] == pytest.approx(max(np.hypot(*(a - b)) for a in xy for b in xy))
    assert got["f2"] == 0.0 and got["f3"] == pytest.approx(1.10574)


def test_wake_only_reaches_downwind():
    u, v = np.array([[10.0, 10.0]]), np.zeros((1, 2))
    x, y, w = np.array([[0.0, 0.5]]), np.zeros((1, 2)), np.array([[0.5, 0.5]])
    out = X._wake_block(u, v, x, y, w, np.array([0.126]))
    want = 1.0 / (1 + 0.05 * 0.5 / 0.126) ** 2
    assert out["wake_receiver_max"][0] == pytest.approx(want) and out["wake_pair_mean"][0] == pytest.approx(want / 2)
    assert out["downwind_span_km"][0] == pytest.approx(0.5) and out["crosswind_span_km"][0] == 0.0


def test_components_follow_long_chains(spark):
    names = [f"n{i:03d}" for i in range(40)]
    edges = [(names[i], names[i + 1]) for i in range(24)] + [(names[30], names[39])]
    out = A.connected_components(spark.createDataFrame([(n,) for n in names], "feature string"), spark.createDataFrame(edges, "a string, b string"))
    got = {r["feature"]: r["component"] for r in out.collect()}
    assert all(got[n] == "n000" for n in names[:25]) and got["n039"] == "n030" and got["n028"] == "n028"


def test_even_sample_equals_linspace(spark):
    df = spark.range(1000).withColumn("k", F.lit(0))
    got = [r["id"] for r in A.even_sample(df, ["k"], ["id"], 37).orderBy("id").collect()]
    assert got == np.linspace(0, 999, num=37, dtype=np.int64).tolist()
    assert A.even_sample(df.limit(10), ["k"], ["id"], 37).count() == 10


def test_gram_and_effective_rank(spark):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(200, 4))
    m[:, 3] = m[:, 0] * 2
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double").repartition(3)
    r = L.effective_rank(L.increment_gram(df, None, ["a", "b", "c", "d"]), 4).first()
    eig = np.maximum(np.linalg.eigvalsh(m.T @ m), 0)[::-1]
    share = eig / eig.sum()
    assert r["numerical_rank"] == 3
    assert r["entropy_rank"] == pytest.approx(float(np.exp(-(share[share > 1e-15] * np.log(share[share > 1e-15])).sum())))


def test_neighbours_are_strictly_earlier_and_exact(spark):
    rng = np.random.default_rng(17)
    vec = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(i, vec[i].tolist()) for i in range(80)], "run long, embedding array<double>")
    got = {}
    for r in N.past_neighbours(df, df, 3, block=9).collect():
        got.setdefault(r["run"], {})[r["rank"]] = r["neighbour"]
    for q in range(1, 80):
        d = np.sqrt(((vec[:q] - vec[q]) ** 2).sum(axis=1))
        assert [got[q][k + 1] for k in range(min(3, q))] == np.argsort(d, kind="stable")[:3].tolist()
    assert 0 not in got


def test_zero_distance_neighbours_take_all_weight(spark):
    near = spark.createDataFrame([(9, 1, 0.0, 1), (9, 2, 0.0, 2), (9, 3, 1.0, 3), (8, 1, 1.0, 1), (8, 2, 3.0, 2)], "run long, neighbour long, distance double, rank int")
    got = {(r["run"], r["neighbour"]): r["weight"] for r in N.neighbour_weights(near).collect()}
    assert got[(9, 1)] == got[(9, 2)] == 0.5 and got[(9, 3)] == 0.0
    assert got[(8, 1)] == pytest.approx(0.75)


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    model = M.ridge(df, ["a", "b", "c"], "y", 25.0)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 25.0 * np.eye(3), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_class_pmf_has_the_fixed_width(spark):
    rng = np.random.default_rng(23)
    rows = [(float(a), int(a > 0.5) * 3) for a in rng.uniform(size=200)]
    df = spark.createDataFrame(rows, "x double, c int")
    out = M.class_pmf(df, df, ["x"], F.col("c"), 5, numTrees=3, maxDepth=2, minInstancesPerNode=5).first()
    assert len(out["pmf"]) == 5 and sum(out["pmf"]) == pytest.approx(1.0) and out["pmf"][1] == 0.0


def test_density_weights_have_mean_one(spark):
    rng = np.random.default_rng(29)
    rows = lambda shift, n, first: [(f"2024-{first + i // 28:02d}-{i % 28 + 1:02d}", float(rng.normal() + shift), float(rng.normal())) for i in range(n)]
    make = lambda r: spark.createDataFrame(r, "d string, a double, b double").withColumn("run", F.col("d").cast("timestamp_ntz"))
    weighted, audit = M.density_ratio(make(rows(0.0, 84, 1)), make(rows(0.8, 84, 5)), ["a", "b"], "run", F.lit(True), max_iter=8)
    row = audit.first()
    assert row["weight_mean"] == pytest.approx(1.0) and 0 < row["ess"] <= 84 and row["domain_auc"] > 0.5
    assert weighted.count() == 84


def test_checked_lookup_broadcasts_only_what_is_small(spark):
    dim = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert bounded(dim, 49) is None and bounded(dim, 50).count() == 50
    rows = spark.range(200).withColumn("k", F.col("id") % 60)
    for limit in (10, 1000):
        assert attach(rows, dim, ["k"], limit=limit).where(F.col("v").isNull()).count() == 30


def test_forward_fill_crosses_buckets(spark):
    df = spark.createDataFrame([(i, "a" if i == 0 else "b" if i == 7 else None) for i in range(20)], "pos int, grp string").repartition(3)
    got = [r["grp"] for r in DM.forward_fill(df, "pos", "grp", bucket=3).orderBy("pos").collect()]
    assert got == ["a"] * 7 + ["b"] * 13


def test_csv_with_byte_order_mark_and_extra_columns(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("﻿forecast_ts,extra,grid_id,issued_ts,latitude,longitude,u\n2024-01-01 01:00:00,x,3,2023-12-31 13:00:00,37.5,128.5,1.5\n", encoding="utf-8")
    row = RD.read_csv(spark, str(path), RD.weather_schema(["u"])).first()
    assert row["grid_id"] == 3 and row["u"] == 1.5 and str(row["forecast_ts"]) == "2024-01-01 01:00:00"
    with pytest.raises(ValueError, match="lacks columns"):
        RD.read_csv(spark, str(path), RD.weather_schema(["missing"]))


def test_bounded_read_prunes_partitions(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_add("DAY", (F.col("id") * 20).cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"), F.lit("g").alias("grp"), F.col("id").alias("x"))
    SK.write_feature_cache(df.withColumn("split", F.year("ts")), str(tmp_path / "c"))
    back = RD.read_until(spark, str(tmp_path / "c"), "ts", "2021-06-30", "split")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert back.count() == df.where(F.col("ts") <= F.lit("2021-06-30").cast("timestamp_ntz")).count()


def test_manifest_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"world")
    files = MF.describe_files(spark, [str(tmp_path)]).withColumn("path", MF.file_name("path"))
    declared = spark.createDataFrame([("a.bin", 5, hashlib.sha256(b"hello").hexdigest()), ("b.bin", 5, "0" * 64), ("c.bin", 1, "0" * 64)], "path string, size_bytes long, sha256 string")
    got = {r["path"]: r["status"] for r in MF.verify_manifest(declared, files).collect()}
    assert got == {"a.bin": "FOUND_HASH_MATCH", "b.bin": "FOUND_HASH_MISMATCH", "c.bin": "MISSING"}


def test_a_file_above_two_gigabytes_has_a_digest(spark, tmp_path):
    name, size = "gross%20 é.bin", 2_150_000_000
    with open(tmp_path / name, "wb") as f:
        f.write(b"head")
        f.truncate(size)  # sparse: takes no disk
    digest = hashlib.sha256(b"head")
    left = size - 4
    while left:
        digest.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    [row] = MF.describe_files(spark, [str(tmp_path)]).collect()
    assert row.size_bytes == size and row.sha256 == digest.hexdigest() and MF.stream_digest(row.path) == row.sha256


def test_nested_records_at_any_depth(spark):
    doc = {"path": "x", "sha256": "AA", "inner": [{"deep": {"path": "y", "sha256": "bb", "bytes": 3}}, 5, "s"], "path_only": {"path": "z"}}
    df = spark.createDataFrame([("m", json.dumps(doc)), ("bad", "{not json")], "source string, text string")
    got = {(r["path"], r["sha256"], r["size_bytes"]) for r in MF.declared_records(df, "text", "source").collect()}
    assert got == {("x", "aa", None), ("y", "bb", 3)}


def test_malformed_index_and_grid_fail(spark):
    good = "1:0:d=2024010112:UGRD:10 m above ground:3 hour fcst:\n2:50:d=2024010112:VGRD:10 m above ground:3 hour fcst:\n"
    df = spark.createDataFrame([("o", good, 80)], "obj string, text string, size int")
    out = PL.byte_ranges(PL.index_records(df, "text", ["obj", "size"]), "size").orderBy("record").collect()
    assert [(r["byte_start"], r["byte_end"]) for r in out] == [(0, 49), (50, 79)]
    bad = spark.createDataFrame([("o", good.replace("2:50", "2:0"), 80)], "obj string, text string, size int")
    with pytest.raises(Exception, match="malformed"):
        PL.index_records(bad, "text", ["obj"]).collect()
    grid = spark.createDataFrame([("1,2,3,\n",), ("1,2",)], "t string")
    with pytest.raises(Exception, match="contract"):
        PL.grid_cells(grid, "t", {"c": (1, 1)}, ["t"], columns=3, rows=1).collect()
    ok = PL.grid_cells(grid.where(F.col("t").contains("3")), "t", {"c": (3, 1)}, ["t"], columns=3, rows=1).first()
    assert ok["c"] == 3.0 and ok["trailing_comma"]


def test_tile_pyramid_opens_few_cells(spark):
    """A site far from all cells, crowded places and several cells at one point: exact, and most cells are ruled out by tiles."""
    r = np.random.default_rng(9)
    cells = [(i, float(37 + 0.02 * (i % 50)), float(128 + 0.02 * (i // 50))) for i in range(2500)]
    cells += [(3000 + i, float(37.3 + 1e-4 * r.random()), float(128.4 + 1e-4 * r.random())) for i in range(400)] + [(4000 + i, 37.9, 128.9) for i in range(5)]
    sites = [(0, 37.301, 128.401), (1, 60.0, -170.0), (2, -45.0, 128.5), (3, 37.9, 128.9), (4, 37.011, 128.013), (5, 37.3, 179.0)]
    a = spark.createDataFrame(sites, "turbine_id int, lat double, lon double")
    b = spark.createDataFrame(cells, "grid_id int, lat double, lon double").repartition(3)
    got = {(x.turbine_id, x.rank): x.grid_id for x in X.nearest_cells(a, b, 7).collect()}
    for site, lat, lon in sites:
        p, q = np.radians(np.array([c[1] for c in cells])), np.radians(np.array([c[2] for c in cells]))
        h = np.sin((p - np.radians(lat)) / 2) ** 2 + np.cos(p) * np.cos(np.radians(lat)) * np.sin((q - np.radians(lon)) / 2) ** 2
        d = np.round(6371.0088 * 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))), 9)
        want = sorted((x, c[0]) for x, c in zip(d, cells))[:7]
        assert [got[site, k + 1] for k in range(7)] == [c for _, c in want], site
    met = {x.turbine_id: x["count"] for x in X.opened_cells(a, b, 7, "turbine_id", "grid_id").groupBy("turbine_id").count().collect()}
    assert max(met.values()) < 500 and sum(met.values()) < 0.1 * len(sites) * len(cells), met


def _map_frame(spark):
    rng = np.random.default_rng(11)
    rows = [(float(rng.integers(0, 9)), float(rng.normal()), float(rng.integers(0, 5)) / 4, float(rng.normal()), float(rng.integers(0, 2)), float(rng.uniform(0.1, 2)),
             None if i % 17 == 0 else f"k{i % 3}", str(i % 2), i) for i in range(400)]
    return spark.createDataFrame(rows, "a double, b double, y double, z double, hit double, w double, kind string, half string, id int")


def test_ranks_go_to_the_rows_and_agree_with_the_shuffled_join(spark, monkeypatch):
    """Rows were unfolded into slices x columns and shuffled by their number before."""
    df = _map_frame(spark)
    read = lambda out: {tuple(r[:3]): r[3:] for r in out.collect()}
    slices = lambda: A.slice_associations(df, ["kind", "half"], ["a", "b"], ["y", "z"], "w")
    matrix = lambda: A.spearman_matrix(df, ["a", "b", "y"], ["id"], ["kind"])
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    assert "_id" not in plan(slices()) and " Join" not in plan(slices()) and " Join" not in plan(matrix())
    near = read(slices()), read(matrix()), read(A.association_map(df, ["a", "b"], ["y", "z"], ["hit"], "w", ["kind", "half"]))
    monkeypatch.setattr(A, "RANK_TABLE", 0)
    assert "_id" in plan(slices()) and " Join" in plan(matrix())
    far = read(slices()), read(matrix()), read(A.association_map(df, ["a", "b"], ["y", "z"], ["hit"], "w", ["kind", "half"]))
    for one, other in zip(near, far):
        assert one.keys() == other.keys() and len(one) > 5
        for key in one:
            assert [v if isinstance(v, (str, int)) or v is None else pytest.approx(v, abs=1e-9) for v in one[key]] == list(other[key])
    pair = read(A.pair_associations(df.where("kind = 'k1'"), ["kind"], "a", "z", "w").withColumns({"f": F.lit("a"), "t": F.lit("z")}).select("kind", "f", "t", "n_valid", "spearman", "weighted_spearman", "rank_normal_pearson"))
    assert near[0]["kind=k1", "a", "z"] == pytest.approx(pair["k1", "a", "z"])
