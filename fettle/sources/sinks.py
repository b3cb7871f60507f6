"""Result datasets out and back in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the seven result datasets
RESULTS = ("cases", "history", "units", "near_misses", "explanations", "meta", "alerts")


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Full refresh: each dataset is rewritten, one directory each."""
    missing = set(RESULTS) - set(results)
    if missing:
        raise KeyError(f"results missing: {sorted(missing)}")
    paths = []
    for name in RESULTS:
        path = f"{folder}/{name}"
        results[name].write.mode("overwrite").format(fmt).save(path)
        paths.append(path)
    return paths


def load_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All seven datasets; a missing one is an error at load, not at query time."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in RESULTS}


def by_id(results: dict[str, DataFrame], name: str, pseudonym_id: str) -> DataFrame:
    """One person's rows; the key filter reaches the parquet scan."""
    return results[name].filter(F.col("pseudonym_id") == pseudonym_id)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    return path
