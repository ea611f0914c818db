"""Functions of one's own: SQL functions that any expression can call, and table functions for DataFrame.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def define(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A temporary SQL function; it is expanded into the plan, so calls cost what their body costs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after another."""
    for step in steps:
        df = df.transform(step)
    return df
