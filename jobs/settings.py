"""What the jobs share: settings files and tables that may not be there yet, both read through Spark."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def load_settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """Settings of a JSON file at any path Spark reads, over the defaults; unknown ones are refused."""
    if not path:
        return dict(defaults)
    row = spark.read.option("multiLine", True).json(path).first()
    given = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    return checked_settings(given, defaults)


def checked_settings(given: dict, defaults: dict) -> dict:
    if odd := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return {**defaults, **given}


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of a known schema; without rows where its path is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket_of(key, buckets: int):
    """A bucket from 0 of a text key, by 16 bits of its digest."""
    from pyspark.sql import functions as F

    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int") % buckets).cast("int")


def command_line(description: str, paths: dict[str, str], run) -> None:
    """Parse paths and ``--config``, make a session, ``run(spark, config, **paths)`` and stop it."""
    import argparse

    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a JSON file of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description.split(":")[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = given.pop("config")
        run(spark, config, **given)
    finally:
        spark.stop()
