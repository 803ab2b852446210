"""Hand-made tables: golden confusion matrices, edges of bins and rules, guards, determinism, plans."""

import pytest
from pyspark.sql import functions as F

from cohortry import run
from cohortry.functions import clinical, normalize
from cohortry.operators import cohorts, fairness, inference, metrics, profile, ranks, tiles
from cohortry.sources import readers, sheets, sinks, work
from cohortry.streaming import predictions as streams


def cells(spark, matrix):
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n], "y_true int, y_pred int, n long")


@pytest.mark.parametrize(
    "matrix, accuracy, balanced, f1",
    [
        ([[0, 33, 3], [0, 0, 0], [0, 7, 1]], 1 / 44, 0.0625, 0.0555555556),
        ([[0, 26, 10], [0, 0, 0], [0, 5, 3]], 0.0681818182, 0.1875, 0.0952380952),
        ([[2, 0, 0, 1], [6, 0, 0, 3], [18, 5, 0, 5], [3, 0, 0, 1]], 0.0681818182, 0.2291666667, 0.0669642857),
        ([[62, 52, 15], [233, 253, 64], [68, 85, 38]], 0.4057471264, 0.3798576782, 0.3456945465),
        ([[871, 7], [15, 42]], 0.9764705882, 0.8644347201, 0.8899905874),
    ],
)
def test_golden_matrices(spark, matrix, accuracy, balanced, f1):
    r = metrics.summary(metrics.per_class(cells(spark, matrix))).first()
    assert r["accuracy"] == pytest.approx(accuracy, abs=1e-9)
    assert r["balanced_accuracy"] == pytest.approx(balanced, abs=1e-9)
    assert r["f1_macro"] == pytest.approx(f1, abs=1e-9)


def test_most_confused(spark):
    r = metrics.errors(cells(spark, [[62, 52, 15], [233, 253, 64], [68, 85, 38]])).first()
    assert (r["n_errors"], r["n"], r["most_true"], r["most_pred"], r["most_n"]) == (517, 870, 1, 0, 233)
    r = metrics.errors(cells(spark, [[5, 0], [0, 3]])).first()
    assert r["n_errors"] == 0 and r["most_true"] is None


def test_auc_ties_single_class_and_missing_support(spark):
    tied = spark.createDataFrame([(0, True, 0.5), (0, False, 0.5), (0, True, 0.5)], "k int, positive boolean, score double")
    assert metrics.auc(tied, ["k"]).first()["auc"] == 0.5
    one = spark.createDataFrame([(0, True, 0.1), (0, True, 1.0)], "k int, positive boolean, score double")
    assert metrics.auc(one, ["k"]).first()["auc"] is None
    p = spark.createDataFrame([(0, [0.6, 0.3, 0.1]), (1, [0.2, 0.7, 0.1])], "y_true int, proba array<double>")
    assert metrics.macro_auc(metrics.one_vs_rest(p), 3).first()["auc"] is None


def test_bins_differ_on_purpose(spark):
    ages = [None, -1.0, 0.0, 49.0, 50.0, 50.5, 70.0, 71.0, 199.0, 200.0, 201.0]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = [tuple(r) for r in df.select(normalize.age_bin(F.col("a")), normalize.age_group(F.col("a"))).collect()]
    assert [g[0] for g in got] == [None, None, None, "<50", "<50", "50-70", "50-70", ">=70", ">=70", ">=70", None]
    assert [g[1] for g in got] == ["MISSING", ">=70", "<50", "<50", "50-70", "50-70", ">=70", ">=70", ">=70", ">=70", ">=70"]


def test_ids_and_stems(spark):
    df = spark.createDataFrame([("42",), (" 42 ",), ("a/b/case_7",), ("a/b/case_7/",), (None,)], "i string")
    assert [r[0] for r in df.select(normalize.normalize_id(F.col("i"))).collect()] == ["42", "42", "case_7", "case_7", None]
    stem = spark.createDataFrame([("bad",)], "s string")
    with pytest.raises(Exception, match="no patient in stem"):
        stem.select(normalize.patient_of_stem(F.col("s"), "case_folders")).collect()


def test_clinical_edges(spark):
    one = lambda text, fn: spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]
    assert [one(t, clinical.parse_ki67) for t in ("15-20%", "<5", "30", "", None, "5-", "-")] == [17.5, None, 30.0, None, None, 5.0, None]
    assert one("ER positive, later negative", lambda c: clinical.ER_IN_TEXT.column(clinical.lowered(c))) == 0
    assert one("hepatic flexure", lambda c: clinical.SITE_GROUP.column(clinical.lowered(c))) == "right_colon"
    assert one("a1", lambda c: clinical.STAGE.column(clinical.lowered(c))) is None
    assert one("N1a (2/14)", clinical.nodes_examined) == 14 and one("N1a (2/14)", clinical.nodes_positive) == 2
    assert one("pn1", lambda c: clinical.PERINEURAL.column(clinical.lowered(c))) == 1


def test_mean_of_means(spark):
    rows = [("p", "s1", [1.0]), ("p", "s2", [3.0]), ("p", "s2", [5.0]), ("p", "s2", [7.0])]
    r = cohorts.patient_vectors(spark.createDataFrame(rows, "patient string, slide string, embedding array<double>"), ["patient"], "slide").first()
    assert r["embedding"] == [3.0] and r["n_slides"] == 2


def test_splits_keep_their_contract(spark):
    df = spark.createDataFrame([(k, "abc"[0 if k < 60 else 1 if k < 67 else 2]) for k in range(68)], "uid long, label string")
    counts = cohorts.folds(df, 5).groupBy("label", "fold").count().collect()
    for label in "abc":
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1
    split = cohorts.fixed_split(df)
    assert split.count() == 68 and cohorts.leaks(split).count() == 0
    assert {r["label"]: r["count"] for r in cohorts.oversample(df).groupBy("label").count().collect()} == {"a": 60, "b": 60, "c": 60}
    with pytest.raises(ValueError):
        cohorts.fixed_split(df, 0.5, 0.1, 0.1)


def test_guards(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "uid long")
    with pytest.raises(ValueError, match="duplicate"):
        cohorts.require_unique(df, ["uid"])
    with pytest.raises(ValueError, match="missing columns"):
        cohorts.require_columns(df, ["age"])
    with pytest.raises(ValueError):
        readers.DatasetSpec("", "m.csv", "id", "flat")
    with pytest.raises(ValueError):
        readers.DatasetSpec("a", "m.csv", "id", "round")
    assert cohorts.merge_shards([df], "uid").count() == 3 and cohorts.merge_shards([df, df], "uid").count() == 2


def test_results_do_not_depend_on_partitioning(spark):
    p = spark.range(500).selectExpr("id as uid", "cast(id % 3 as int) y_true", "cast((id * 7) % 3 as int) y_pred")
    want = None
    for n in (1, 8, 50):
        got = sorted(map(str, inference.bootstrap_summary(p.repartition(n), 20).collect()))
        assert want is None or got == want
        want = got


def test_poisson_bootstrap_has_the_mean_of_its_rows(spark):
    p = spark.range(2000).selectExpr("id as uid", "cast(id % 2 as int) y_true", "1 y_pred")
    n = inference.poisson_cells(p, 50).groupBy("b").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(n - 2000) < 60


def test_subgroups_of_one_class_have_their_size_only(spark):
    rows = [(k, 0, 0, [0.9, 0.1], "a") for k in range(9)] + [(k + 20, k % 2, k % 2, [0.5, 0.5], "b") for k in range(12)] + [(99, 1, 1, [0.1, 0.9], None)]
    got = {r["group"]: r for r in fairness.by_subgroup(spark.createDataFrame(rows, "uid long, y_true int, y_pred int, proba array<double>, g string"), "g", 2).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n"] == 9 and got["a"]["low_n"] and got["a"]["accuracy"] is None and got["b"]["accuracy"] == 1.0


def test_type_detection_thresholds(spark):
    df = spark.range(100).selectExpr("if(id < 79, '1', 'x') a", "if(id < 80, '1', 'x') b", "cast(id % 30 as string) || 'q' c", "cast(id % 31 as string) || 'q' d")
    got = {r["column"]: r["type"] for r in profile.detected_types(df, list("abcd")).collect()}
    assert got == {"a": "categorical", "b": "numeric", "c": "categorical", "d": "string"}


def test_tile_grid_edges(spark):
    slides = spark.createDataFrame([(0, 10, 7)], "slide int, width int, height int")
    places = lambda **o: sorted((r["y"], r["x"]) for r in tiles.grid(slides, F.lit(3), **o).collect())
    assert len(places()) == 4 * 3 and len(places(padding=False)) == 3 * 2
    assert len(places(overlap=0.5)) == 10 * 7
    assert tiles.grid(slides, F.lit(20), padding=False).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿id,name\n1,ñandú\n2,NA\n".encode())
    (tmp_path / "l.csv").write_bytes("id,name\n1,ñandú\n".encode("latin-1"))
    for name, n in (("u", 2), ("l", 1)):
        df = readers.read_with_fallback(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["id", "name"] and df.count() == n and df.first()["name"] == "ñandú"
    (tmp_path / "a.json").write_text('[{"age": "7", "gender": "f"}, {"age": null}]')
    assert readers.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "odd").write_bytes(b"PK\x03\x04")
    assert readers.sniff(spark, str(tmp_path / "odd")) == "excel"
    sinks.write_table(spark.range(5), str(tmp_path / "out"))
    sinks.written_as_expected(spark.range(5), str(tmp_path / "out"), 5)
    with pytest.raises(ValueError):
        sinks.written_as_expected(spark.range(5), str(tmp_path / "out"), 6)
    assert sinks.markdown_header(spark.range(1)) == "| id |\n|---|"


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id % 3 as int) y_true", "cast(id % 2 as int) y_pred")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = streams.run_to_memory(streams.running_cells(stream), "running_cells")
    assert sorted(map(str, got.collect())) == sorted(map(str, streams.running_cells(rows).collect()))


def test_plans_stay_in_the_jvm(spark):
    from cohortry import plans

    for name in ("FAIR_01_subgroups", "BST_01_intervals", "PRJ_46_taxonomy_breast", "AGG_06_crosstab"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_full_inference_queries(spark):
    from cohortry import plans

    run = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    got = {r["metric"]: r for r in run("BST_01_intervals_full")}
    assert set(got) == {"accuracy", "balanced_accuracy", "f1_macro", "sensitivity_0", "sensitivity_1", "sensitivity_2"}
    assert got["accuracy"]["n_valid"] == 1000 and all(r["ci_low"] <= r["ci_high"] for r in got.values())
    gaps = {r["metric"]: r for r in run("BST_02_gap_intervals_full")}
    assert set(gaps) == {"delta_ba", "delta_f1", "delta_auc", "avg_gap", "tpr_gap", "fpr_gap", "auc_es"} and all(r["n_valid"] > 900 for r in gaps.values())
    (p,) = run("MET_13_permutation_test_full")
    assert abs(p["p_value"] * 1001 - round(p["p_value"] * 1001)) < 0.001


def _scored(spark, n=700):
    """Ties, and rows without class or score."""
    return spark.range(n).selectExpr("id * 3 as uid", "if(id % 50 = 7, null, id % 3 = 0) positive", "if(id % 41 = 3, null, (id * 37 % 11) / 11.0D) score")


def test_resampled_auc_draws_in_the_workers(spark):
    df = _scored(spark)
    out = inference.resampled_auc(df, 45)
    # No plan makes a row of every draw, which was put into a broadcast by its size before it was made.
    assert "Generate explode(sequence((" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "104729" not in plan
    want = inference.joined_auc(ranks.numbered(df, ["uid"], name="i"), 700, 45)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "BroadcastHashJoin [i#" not in want._jdf.queryExecution().executedPlan().toString()
    assert inference.resampled_auc(df.limit(0), 3).count() == 0


def test_full_auc_query_broadcasts_no_draws(spark):
    from cohortry import plans

    out = plans.QUERIES["BST_01_auc_full"](spark, "/root/testdata/sf0.001")
    assert "104729" not in out._jdf.queryExecution().optimizedPlan().toString()  # the step of the counters of rows that are draws
    (row,) = out.collect()
    assert row["n_valid"] == 1000 and 0 <= row["ci_low"] <= row["ci_high"] <= 1


def test_gap_intervals_draw_in_the_workers(spark, monkeypatch):
    rows = "id * 3 as uid", "if(id % 31 = 5, null, 'g' || id % 4) g", "cast(id * 7 % 5 % 3 as int) y_true", "cast(id % 3 as int) y_pred"
    df = spark.range(400).selectExpr(*rows, "array(id % 7 / 9.0D, if(id % 29 = 1, null, id % 5 / 9.0D), id % 11 / 12.0D) proba")
    monkeypatch.setattr(fairness, "joined_groups", None)
    got = sorted(map(tuple, fairness.all_gap_intervals(df, "g", 3, 30).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(inference.vectors, "HELD", 0)
    want = sorted(map(tuple, fairness.all_gap_intervals(df, "g", 3, 30).collect()))
    assert [r[0] for r in got] == [r[0] for r in want] and [r[3] for r in got] == [r[3] for r in want] == [30] * 7
    assert all(abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x[1:3], y[1:3]))


def test_permutations_are_sorted_in_the_workers(spark):
    df = _scored(spark, 300).withColumn("uid", F.concat(F.repeat(F.lit("ü"), (F.col("uid") % 40).cast("int")), F.col("uid").cast("string")))
    out = inference.permuted_auc(df, 23)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row of a table for each lot
    want = inference.joined_permutations(ranks.numbered(df, ["uid"], name="i"), 23)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_lots_are_those_of_md5():
    import hashlib

    import pyarrow as pa

    ends = [f"|{k * 977}" for k in range(3000)] + ["|" + "x" * k for k in range(49, 70)] + ["", "|7", "|7"]
    for b in (0, 12, 999):
        key = lambda i: (hashlib.md5(f"{b}{ends[i]}".encode()).hexdigest(), i)  # noqa: E731, B023
        assert inference.vectors.Lots(pa.array(ends)).order(b).tolist() == sorted(range(len(ends)), key=key)


@pytest.mark.parametrize("n, k", [(5, 2), (3000, 3), (70_000, 12)])
def test_drawn_cells_are_the_resampled_ones(spark, n, k):
    p = spark.range(n).selectExpr("id as uid", f"if(id = 3, null, cast(id % {k} as int)) y_true", f"cast((id * 7) div 3 % {k} as int) y_pred")
    got, want = (f(metrics.cells(p), 23) for f in (inference.vectors.drawn_cells, inference.resampled_cells))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    # Chunks of draws are few bytes each before they are made: they must not end in one task.
    assert got.rdd.getNumPartitions() and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in want._jdf.queryExecution().executedPlan().toString()


def test_full_display_counts_draws_by_vectors(spark):
    from cohortry import plans

    out = plans.QUERIES["OOD_04_display_full"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "104729" not in plan  # the step of the counters of rows that are draws
    from cohortry.plans import base, evaluation

    joined = evaluation._display(inference.resampled_cells(metrics.cells(base.predictions3(spark, "/root/testdata/sf0.001")), 1000))
    assert out.collect() == joined.collect()


def test_full_diagnostics_make_no_row_of_a_lot(spark):
    from cohortry import plans

    out = plans.QUERIES["MET_15_diagnostics_full"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    (row,) = out.collect()
    assert 0 <= row["auc"] <= 1 and 0.4 < row["null_mean"] < 0.6


def test_groups_of_replicates_read_one_copy(spark, monkeypatch):
    df = _scored(spark, 300)
    placed = ranks.numbered(df, ["uid"], name="i")
    monkeypatch.setattr(inference.vectors, "COPIED", 299)
    monkeypatch.setattr(inference.vectors, "BLOCK", 64)
    for taken, joined in ((inference.permuted_auc, inference.joined_permutations), (inference.resampled_auc, lambda p, b: inference.joined_auc(p, 300, b))):
        out = taken(df, 45)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # A copy of all blocks for each group went through a shuffle: fifty times the table for 1,000 replicates.
        assert "CartesianProduct" in plan and "Exchange" not in plan and "explode" not in plan
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joined(placed, 45).collect()))
    rows = "id * 3 as uid", "if(id % 31 = 5, null, 'g' || id % 4) g", "cast(id * 7 % 5 % 3 as int) y_true", "cast(id % 3 as int) y_pred"
    df = spark.range(400).selectExpr(*rows, "array(id % 7 / 9.0D, if(id % 29 = 1, null, id % 5 / 9.0D), id % 11 / 12.0D) proba")
    got = fairness.all_gap_intervals(df, "g", 3, 30).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == sorted(map(tuple, fairness.all_gap_intervals(df, "g", 3, 30).collect()))


def test_lots_with_equal_first_bits():
    import hashlib

    import pyarrow as pa

    ends = ["|7", "", "|7", "|8", "", "|7"] + [f"|{k}" for k in range(40)]
    for some in (ends, ends[:3], ends[:1]):
        key = lambda i: (hashlib.md5(f"5{some[i]}".encode()).hexdigest(), i)  # noqa: E731, B023
        assert inference.vectors.Lots(pa.array(some)).order(5).tolist() == sorted(range(len(some)), key=key)

    class Halves(inference.vectors.Lots):
        def _digests(self, prefix, content):
            high, low = super()._digests(prefix, content)
            return high >> np.uint64(60) << np.uint64(4), low

    import numpy as np

    halves = Halves(pa.array(ends))
    digests = [hashlib.md5(f"5{e}".encode()).hexdigest() for e in ends]
    assert halves.order(5).tolist() == sorted(range(len(ends)), key=lambda i: (digests[i][0], digests[i][16:], i))


def test_first_failures_are_tried_again():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert work.retried(flaky, 3, 0.0) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        work.retried(lambda: open("/nonexistent/file"), 2, 0.0)


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", 1.5, True), (2, None, None, False), (3, " kept ", -0.25, None)], "id long, name string, v double, ok boolean")
    sheets.write_sheet(df, str(tmp_path / "b.xlsx"), 'A & "B"')
    for sheet in (0, 'A & "B"'):
        got = sheets.read_sheet(spark, str(tmp_path / "b.xlsx"), sheet)
        assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", "a<b", "1.5", "1"), ("2", None, None, "0"), ("3", " kept ", "-0.25", None)]
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_sheet(spark, str(tmp_path / "b.xlsx"), "other").count()
    assert [sheets.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(sheets.column_index(sheets.column_name(i) + "7") == i for i in range(1000))


def test_row_numbers_over_ranges(spark):
    rows = [(None if i % 10 == 9 else "hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1009, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = {r["i"]: r["place"] for r in ranks.numbered(df, ["v", "i"], ["k"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            want[row[2]] = place
    assert got == want
    assert sorted(r["place"] for r in ranks.numbered(df, ["v", "i"]).collect()) == list(range(3000))
    assert ranks.numbered(df.limit(0), ["v"]).count() == 0


def test_quantiles_are_exact(spark):
    df = spark.createDataFrame([(float(i * i % 97), None, 1.0 if i < 400 else float(i)) for i in range(501)], "a double, none double, hot double")
    got = {r["column"]: r["q"] for r in ranks.quantiles(df, ["a", "none", "hot"], [0.0, 0.13, 0.5, 0.999, 1.0]).collect()}
    assert got["none"] is None
    for name in ("a", "hot"):
        want = df.agg(F.percentile(name, [0.0, 0.13, 0.5, 0.999, 1.0])).first()[0]
        assert got[name] == pytest.approx(want, abs=1e-9)
    assert ranks.quantiles(df.limit(0), ["a"], [0.5]).first()["q"] is None


def test_runner(spark, tmp_path, capsys):
    given, out = str(tmp_path / "given"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0)], "uid long, y_true int, y_pred int")
    for combo in ("site/uni2", "site/virchow2", "side/uni2"):
        sinks.write_table(rows, f"{given}/{combo}")
    sinks.write_table(rows.drop("y_pred"), f"{given}/side/broken")
    place = ["--predictions", given, "--out", out]
    assert run.main([*place, "--list"], spark) == 0
    assert capsys.readouterr().out.split() == ["side:broken", "side:uni2", "site:uni2", "site:virchow2"]
    assert run.main([*place, "--task", "site", "--dry-run"], spark) == 0 and not (tmp_path / "out").exists()
    assert run.main([*place, "--combo", "site:uni2"], spark) == 0
    assert spark.read.parquet(f"{out}/site/uni2").first()["n"] == 3
    capsys.readouterr()
    assert run.main([*place, "--all"], spark) == 1  # the broken one fails, the others are there
    lines = capsys.readouterr().out
    assert "skip site uni2" in lines and "done side uni2" in lines and "failed side broken" in lines
    assert not (tmp_path / "out/side/broken").exists()
    for wrong in (["--combo", "site"], ["--combo", "a:b"], []):
        with pytest.raises(SystemExit):
            run.main([*place, *wrong], spark)
