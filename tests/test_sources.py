"""Readers, writers, profiles and incremental loads."""

import json
import os

import pytest
from pyspark.sql import functions as F

from grantloom.functions.dimension import with_agency
from grantloom.plans import assignment, texts, validation
from grantloom.sources import files, portfolio, profile
from grantloom.sources.schemas import SOURCE_TABLES
from grantloom.streaming import incremental


def yearly(spark, year, kind="double"):
    return spark.range(5).select(
        F.col("id").cast(kind).alias("APPLICATION_ID"), F.concat(F.lit("t"), F.col("id")).alias("TITLE")
    )


def test_year_folders_are_pruned(spark, tmp_path):
    base = str(tmp_path / "t")
    files.append_years({year: yearly(spark, year) for year in (1999, 2000, 2001)}, base)
    rows = files.year_folders(spark, base, [2000])
    assert rows.count() == 5 and rows.select("YEAR").distinct().first().YEAR == 2000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "YEAR=1999" not in plan and "YEAR=2001" not in plan
    again = files.year_folders(spark, base, schema="APPLICATION_ID double, TITLE string, YEAR int")
    assert again.count() == 15


def test_append_adds_columns(spark, tmp_path):
    base = str(tmp_path / "t")
    files.append_years({2000: yearly(spark, 2000), 2001: yearly(spark, 2001).withColumn("EXTRA", F.lit(1))}, base)
    rows = files.year_folders(spark, base)
    assert rows.count() == 10 and rows.where("EXTRA = 1").count() == 5


def test_drifting_types_become_text_and_failures_are_reported(spark, tmp_path):
    paths = {}
    for year, kind in ((1990, "double"), (1991, "string")):
        paths[year] = str(tmp_path / f"{year}")
        yearly(spark, year, kind).write.parquet(paths[year])
    paths[1992] = str(tmp_path / "absent")
    rows, report = files.repaired_years(spark, paths)
    assert rows.count() == 10 and dict(rows.dtypes)["APPLICATION_ID"] == "string"
    assert {r.year: r.status for r in report.collect()} == {1990: "fixed", 1991: "fixed", 1992: "failed"}


def test_wildcard_union(spark, tmp_path):
    for year in (2000, 2001):
        yearly(spark, year).write.parquet(str(tmp_path / f"projects_fy{year}"))
    assert files.matching_files(spark, str(tmp_path / "projects_fy*")).count() == 10


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", text\nline')], "id int, t string")
    files.write_csv(rows, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "id int, t string", multi_line=True).collect() == rows.collect()


def test_points_documents(spark, tmp_path):
    document = {
        "points": [{"x": 1.0, "y": 2.0, "cluster": 3, "application_id": "9", "title": "t", "ic": "CA", "year": 2001, "cost": 5.0}],
        "clusters": [{"id": 3, "label": "a / b", "size": 1, "top_terms": ["a"]}],
    }
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document, indent=1))
    points, clusters = files.read_points_document(spark, str(path))
    assert points.first().application_id == "9" and clusters.first().top_terms == ["a"]
    files.write_points_document(points, clusters, str(tmp_path / "out"))
    again, _ = files.read_points_folders(spark, str(tmp_path / "out"))
    assert again.collect() == points.collect()


def test_snapshot_and_export(spark, tmp_path):
    files.export(yearly(spark, 1), str(tmp_path / "a"))
    assert any(".snappy." in name for name in os.listdir(tmp_path / "a"))
    copy = files.snapshot(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert copy.count() == 5


def test_payload_flattening_and_dedup(spark):
    rows = spark.createDataFrame(
        [(1, '{"p": {"id": 7, "org": {"name": "x"}}}'), (2, '{"p": {"id": 7, "org": {"name": "y"}}}')], "n int, j string"
    )
    got = files.payload_table(rows, "j", "p struct<id: int, org: struct<name: string>>", ["`p.id`"], ["n"]).collect()
    assert len(got) == 1 and got[0]["p.org.name"] == "x"


def test_catalog_helpers(spark):
    assert profile.dataset_kind(["A", "CORE_PROJECT_NUM"]) == "projects"
    assert profile.dataset_kind(["PMID", "x"]) == "publications"
    assert profile.column_roles(["FY", "TOTAL_COST"])["fiscal_year"] == ["FY"]
    empty = spark.createDataFrame([], SOURCE_TABLES["projects"])
    assert len(empty.columns) == 47
    assert profile.category_columns({"projects": empty}, "spending_cats") == [("projects", "NIH_SPENDING_CATS", "string")]
    assert json.loads(profile.schema_json(empty))[0] == {"name": "APPLICATION_ID", "type": "DOUBLE", "mode": "NULLABLE"}
    empty.createOrReplaceTempView("projects_fy2000")
    assert profile.tables_like(spark, "projects_fy*") == ["projects_fy2000"]


def test_views_are_registered(spark, root):
    made = texts.register_views(
        portfolio.projects(spark, root), portfolio.abstracts(spark, root),
        portfolio.link_table(spark, root), portfolio.clinical_studies(spark, root),
    )
    for name in made:
        assert spark.sql(f"select count(*) from {name}").first()[0] == portfolio.projects(spark, root).count()


def test_award_key_is_unique(spark, root):
    check = profile.key_check(portfolio.awards(spark, root), "core_project_num").first()
    assert check.duplicates == 0


def test_phases_do_not_overlap_and_shares_add_up(spark, root):
    awards = with_agency(portfolio.awards(spark, root, "unit", "topic", "people"))
    given = assignment.by_unit_heuristic(awards)
    overlap = {r.metric: r["count"] for r in validation.phase_overlap(awards, given).collect()}
    assert overlap["Overlap (Should be 0)"] == 0
    cards = assignment.merged_cards(awards, given, "existing", "IC-heuristic")
    shares = assignment.phase_coverage(cards).toPandas()
    assert shares["pct_total"].sum() == pytest.approx(100, abs=0.2)
    assert cards.count() == awards.count()


def test_new_files_are_appended_once(spark, tmp_path):
    folder, table, state = (str(tmp_path / name) for name in ("in", "table", "state"))
    schema = "APPLICATION_ID double, TITLE string, YEAR int"
    for year in (2000, 2001):
        yearly(spark, year).withColumn("YEAR", F.lit(year)).write.mode("append").parquet(folder)
        incremental.append_new_files(spark, folder, schema, table, state).awaitTermination()
    rows = spark.read.parquet(table)
    assert rows.groupBy("YEAR").count().orderBy("YEAR").collect() == [(2000, 5), (2001, 5)]


def test_new_points_get_the_nearest_cluster(spark, tmp_path):
    folder, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    spark.createDataFrame([(1, 0.1, 0.0), (2, 9.0, 9.5)], "id int, x double, y double").write.parquet(folder)
    centroids = spark.createDataFrame([(5, 0.0, 0.0), (6, 10.0, 10.0)], "cluster_id int, centroid_x double, centroid_y double")
    incremental.assign_new_points(spark, folder, "id int, x double, y double", centroids, target, state).awaitTermination()
    assert {r.id: r.cluster_id for r in spark.read.parquet(target).collect()} == {1: 5, 2: 6}
