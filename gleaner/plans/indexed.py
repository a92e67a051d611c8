"""Searches by an index as queries: the index of all points is built in a folder of its own, then asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import index
from .catalogue import ORACLE_SQL as CATALOGUE_SQL
from .catalogue import SEARCH_TEXT, a_vector, points
from .streams import new_folder


def _dense(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    path = new_folder(spark, "dense-index")
    index.build_dense(points(spark, sf_dir).select("id", "dense"), path, metric)
    return index.search_dense(spark, path, a_vector(), 5).hits.select("id", "score")


def search_dense_cosine_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine")


def search_dense_euclid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "euclid")


def search_sparse_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "postings")
    index.build_postings(points(spark, sf_dir).select("id", "text"), path)
    return index.search_sparse(spark, path, SEARCH_TEXT, 5)


QUERIES = {f.__name__: f for f in (search_dense_cosine_indexed, search_dense_euclid_indexed, search_sparse_indexed)}

ORACLE_SQL = {name: CATALOGUE_SQL[name.removesuffix("_indexed").replace("euclid", "l2")] for name in QUERIES}
