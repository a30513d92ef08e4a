"""Set operations over runs and libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def merge_libraries(libraries: list[DataFrame], key: list[str], score: str, tie: list, dedupe: bool = True) -> DataFrame:
    from peakfold.operators.aggregates import best_per_key

    both = union_runs(libraries)
    return best_per_key(both, key, score, tie) if dedupe else both


def merge_scans(files: DataFrame, file: str, window: list[str], rt: str, most: float = 1.5) -> DataFrame:
    """Scans of many files: windows with a duty cycle over `most` times the median go, each scan gets its file's ordinal."""
    from peakfold.operators.aggregates import duty_cycle

    cycles = duty_cycle(files, [file, *window], rt)
    median = cycles.agg(F.percentile("duty_cycle", F.lit(0.5)).alias("__m"))
    kept = cycles.join(F.broadcast(median)).where(F.col("duty_cycle") <= most * F.col("__m")).select(file, *window)  # median is one row
    names = files.select(file).distinct().withColumn("fraction", F.row_number().over(Window.orderBy(file)) - 1)
    return files.join(kept, [file, *window], "left_semi").join(names, file)


def new_items(df: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return df.join(known.select(*key).distinct(), key, "left_anti")


def common_items(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def upsert_sets(df: DataFrame, key: str, values: str) -> DataFrame:
    """One row a key with the union of its arrays, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(values))


def targets_and_decoys(df: DataFrame, sequence: str) -> DataFrame:
    """Each row with its decoy, whose inside is reversed; palindromes and collisions with targets have none."""
    from peakfold.functions.sequences import reverse_inside

    decoys = df.withColumn(sequence, reverse_inside(F.col(sequence))).join(df.select(sequence).distinct(), sequence, "left_anti").select(*df.columns)
    return df.withColumn("decoy", F.lit(False)).unionByName(decoys.withColumn("decoy", F.lit(True)))
