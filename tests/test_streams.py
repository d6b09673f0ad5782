from archivolt.plans.catalogue import QUERIES


def test_daily_counts_of_files_that_overlap_in_time(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(8, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((str(r.day), r.event_type, r.n) for r in QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect())
    days = events.selectExpr("cast(ts as date) AS day", "event_type")
    last = days.selectExpr("max(day)").first()[0]
    want = days.where(days.day < last).groupBy("day", "event_type").count()
    assert got == sorted((str(r[0]), r[1], r[2]) for r in want.collect())
