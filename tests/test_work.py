"""Work is done once and by all cores: what made queries fail by time on larger tables."""

from pyspark.sql import functions as F

from gleaner.catalog import QUERIES
from gleaner.functions import addresses
from gleaner.plans import board, inputs

FOLDER = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cases_are_dealt_to_all_cores(spark):
    assert QUERIES["verified_posting_keys"](spark, FOLDER).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_an_address_is_parsed_once_for_a_question(spark):
    df = spark.createDataFrame([("https://a.com/job-1?b=2&jobId=&JobId=3&jobid=4&reqId=5&gh_jid=",)], "u string")
    for ask in (addresses.is_specific, addresses.verified_key):  # the address and its canonical form, four parts each
        assert optimized(df.select(ask(F.col("u")).alias("x"))).count("(?://([^/?#]*))?") <= 8
    assert df.select(addresses.verified_key(F.col("u"))).head()[0] == "a.com:jobid:4"
    both = df.select(addresses.key_and_specific(F.col("u")).alias("x")).select("x.*").head()
    assert (both.key, both.specific) == ("a.com:jobid:4", True)


def test_postings_are_dealt_to_all_cores(spark):
    assert inputs.operational(spark, FOLDER, "raw_jobs").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_titles_are_classified_after_the_grouping(spark):
    jobs = spark.createDataFrame([("1", "Data Engineer"), ("2", "Data Engineer"), ("3", "Cook - sales analyst"), ("4", None)], "record_key string, title string")
    plan = optimized(board.fitting(jobs))
    assert "data" in plan and "RLIKE" in plan and "RLIKE" not in plan[plan.index("Aggregate"):].partition("\n")[2]
    assert sorted(r.record_key for r in board.fitting(jobs).collect()) == ["1", "2", "4"]


def test_operation_metrics_prepares_its_tables_once(spark, monkeypatch):
    made, prepared = [], board.prepared
    monkeypatch.setattr(board, "prepared", lambda t: made.append(1) or prepared(t))
    assert QUERIES["operation_metrics"](spark, FOLDER).count() > 3 and len(made) == 1
