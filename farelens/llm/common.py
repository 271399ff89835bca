"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelens.session import scratch_path

# ASCII white space; everything between is a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def fold(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def steps(count: Column) -> Column:
    """0 .. count - 1; empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Lineage ends there: a lost executor costs the tasks that ran on it, not what came before.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
