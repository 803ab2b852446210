import pytest

from cohortry.sources import metadata
from cohortry.sources.readers import DatasetSpec


def test_cohorts_of_a_task(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,age,sex,site\nx/case_1/,50,F,colon\ncase_2,n/a,M,\n3,61,f,appendix\n")
    (tmp_path / "b.csv").write_text("id,side\ncase_1,left\n")
    specs = (
        DatasetSpec("A", str(tmp_path / "a.csv"), "id", "flat", label_column="site", label_map={"appendix": "other"}),
        DatasetSpec("B", str(tmp_path / "b.csv"), "id", "flat", force_label="colon"),
    )
    got = sorted(tuple(r) for r in metadata.load_task(spark, metadata.Task("site", specs)).collect())
    assert got == [("A::3", "3", "A", 61.0, "f", "other"), ("A::case_1", "case_1", "A", 50.0, "F", "colon"), ("B::case_1", "case_1", "B", None, None, "colon")]
    raw = spark.read.option("header", True).csv(str(tmp_path / "a.csv"))
    assert [tuple(r) for r in metadata.unmapped_labels(raw, specs[0]).collect()] == [("colon", 1)]
    with pytest.raises(ValueError, match="duplicate"):
        metadata.load_task(spark, metadata.Task("site", (specs[0], specs[0])))
    with pytest.raises(ValueError, match="missing columns"):
        metadata.cohort_rows(raw, DatasetSpec("A", "", "id", "flat", label_column="nope"))
