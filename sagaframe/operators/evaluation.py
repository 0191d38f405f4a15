"""Grades, traces and the agent's loop rules, as operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS_MARK = 0.7
MAX_CALLS, MAX_ITERATIONS, CALLS_PER_ITERATION = 20, 6, 5


def total_grade(faithfulness: Column, completeness: Column, golden: Column | None = None) -> Column:
    """Mean of the two grades; without a golden answer both are 1."""
    mean = F.round((faithfulness + completeness) / 2, 4)
    return mean if golden is None else F.when(F.coalesce(golden, F.lit("")) == "", F.lit(1.0)).otherwise(mean)


def routing(iterations: DataFrame, run_col: str = "run", no_col: str = "iteration", calls_col: str = "calls") -> DataFrame:
    """Per iteration: calls run and skipped, their running sum, and where the loop goes.

    At most CALLS_PER_ITERATION calls run; without calls the loop ends in the answer; at MAX_CALLS
    calls or MAX_ITERATIONS iterations it is forced to.
    """
    so_far = Window.partitionBy(run_col).orderBy(no_col).rowsBetween(Window.unboundedPreceding, 0)
    ran = F.least(F.col(calls_col), F.lit(CALLS_PER_ITERATION))
    step = iterations.withColumn("ran", ran).withColumn("skipped", F.col(calls_col) - F.col("ran")).withColumn("total_calls", F.sum("ran").over(so_far))
    forced = (F.col("total_calls") >= MAX_CALLS) | (F.col(no_col) >= MAX_ITERATIONS)
    return step.withColumn("route", F.when(F.col(calls_col) == 0, "answer").when(forced, "force_answer").otherwise("continue"))


def write_results(results: DataFrame, label: str, path: str, at: str) -> str:
    """Write evaluation rows as JSON lines below ``path``, in a folder named by label and time, with a
    summary ``(label, timestamp, count)`` that is written last; gives the folder. A folder that is there is an error."""
    folder = f"{path}/{label}_{at}"
    results.write.mode("errorifexists").json(f"{folder}/results")
    count = results.sparkSession.read.schema(results.schema).json(f"{folder}/results").agg(F.count(F.lit(1)).alias("count"))
    count.select(F.lit(label).alias("label"), F.lit(at).alias("timestamp"), "count").coalesce(1).write.json(f"{folder}/summary")
    return folder


def read_results(like: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows that were written, with the columns of ``like``, and their summary."""
    spark = like.sparkSession
    return spark.read.schema(like.schema).json(f"{folder}/results"), spark.read.schema("label string, timestamp string, count bigint").json(f"{folder}/summary")
