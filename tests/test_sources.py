"""Sources: database tables and file size bounds."""

from talentlake.sources import domain, readers


def test_jdbc_reads_all_rows_in_parts(spark):
    url, driver = "jdbc:derby:memory:people;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    people = spark.createDataFrame([(i, f"p{i}") for i in range(100)], "ID int, NAME string")
    people.write.format("jdbc").options(url=url, dbtable="people", driver=driver).save()
    spark.createDataFrame([], "ID int, NAME string").write.format("jdbc").options(url=url, dbtable="nobody", driver=driver).save()
    got = readers.read_jdbc(spark, url, "people", "ID", 4, ["NAME"], driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(r.NAME for r in got.collect()) == sorted(f"p{i}" for i in range(100))
    assert readers.read_jdbc(spark, url, "people", driver=driver).count() == 100
    assert readers.read_jdbc(spark, url, "nobody", "ID", driver=driver).count() == 0


def test_refused_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("long " * 100)
    folder = str(tmp_path)
    assert readers.read_cv_text(spark, folder).count() == 2
    assert [r.n_bytes for r in readers.read_cv_text(spark, folder, 100).collect()] == [5]
    assert [r.n_bytes for r in readers.refused_files(spark, folder, 100).collect()] == [500]


def test_dictionaries_as_documents_and_lines(spark, tmp_path):
    from talentlake.sources import writers

    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "skills.json").write_text('{\n  "tech": ["SQL", "C++"],\n  "soft": ["Team \\"work\\"", " "]\n}')
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = readers.read_skill_dictionary(spark, str(tmp_path / "one"))
    assert rows(whole) == [("soft", 'Team "work"'), ("tech", "C++"), ("tech", "SQL")]
    writers.write_skill_dictionary(whole.withColumnRenamed("skill", "name").repartition(3), str(tmp_path / "lines"))
    again = readers.read_skill_dictionary(spark, str(tmp_path / "lines"), lines=True)
    assert rows(again) == rows(whole)
    writers.write_alias_map(spark.createDataFrame([("JS", "JavaScript"), ("k8s", "Kubernetes")], "alias string, canonical string"), str(tmp_path / "aliases"))
    assert rows(readers.read_alias_map(spark, str(tmp_path / "aliases"), lines=True)) == [("js", "JavaScript"), ("k8s", "Kubernetes")]


def test_summary_counts_all_screened(spark):
    from talentlake.operators import reports

    results = spark.createDataFrame([(1, 0.9), (1, 0.7)], "criteria_id int, score_01 double")
    criteria, people = spark.createDataFrame([(1,), (2,)], "criteria_id int"), spark.range(5)
    got = {r.criteria_id: (r.total_screened, r.strong, r.moderate) for r in reports.shortlist_summary(results, criteria, people).collect()}
    assert got == {1: (5, 1, 1), 2: (5, 0, 0)}


def test_a_hot_criteria_is_written_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from talentlake.sources import writers

    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7 + 2).alias("criteria_id"), F.col("id").alias("candidate_id"), F.rand(1).alias("score_pct")).repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        writers.write_match_results(rows, str(tmp_path / "r"))
    finally:
        spark.conf.unset(size)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "r").glob("criteria_id=*")}
    assert files["criteria_id=1"] > 3 and len(files) == 8
    writers.write_match_results(spark.createDataFrame([(1, 5, 0.5)], "criteria_id int, candidate_id long, score_pct double"), str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert stored.filter("criteria_id = 1").count() == 1 and stored.count() == 4001


def test_split_size_with_a_unit(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = spark.range(10).repartition(3)
        assert domain.spread(rows, 1 << 30).rdd.getNumPartitions() == 3
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
        assert domain.spread(rows, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
