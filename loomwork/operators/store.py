"""Changes to stored tables, each as the table it leaves behind."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The incoming rows whose key is not stored yet, one a key (the smallest tie column)."""
    once = dedupe(incoming, keys, tie)
    return once.join(existing.select(*keys), keys, "left_anti")


def dedupe(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; rows whose key has a null stand for themselves like any other key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of untouched keys and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_cascade(parent: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parent and children, {name: (table, foreign key)}, without the rows of the keys in gone."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    drop = lambda df, fk: df.join(ids, df[fk] == ids["_gone"], "left_anti")
    return {"parent": drop(parent, key)} | {name: drop(df, fk) for name, (df, fk) in children.items()}


def nullify(df: DataFrame, fk: str, gone: DataFrame, key: str) -> DataFrame:
    """The foreign key set to null where its target is gone."""
    ids = gone.select(F.col(key).alias(fk), F.lit(True).alias("_gone")).distinct()
    return df.join(ids, fk, "left").withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")


def resolve_fk(rows: DataFrame, names: DataFrame, column: str, id_column: str) -> DataFrame:
    """rows with names(id, name) looked up; rows that name nothing are skipped."""
    return rows.join(names.select(F.col("id").alias(id_column), F.col("name").alias(column)), column)


def flatten_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) in long form without nulls."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))
    return df.select(*keys, F.explode(pairs).alias("metric", "value")).where("value is not null")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str, order: str, decimals: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): existing with one row a key of incoming (the last by `order`), which replaces the stored one or is added,
    its value rounded, halves up, to `decimals`; outcome(keys, inserted) holds 1 for new keys and 0 for known ones. A null in a
    key makes no match, as in a unique index. Both tables have the same columns."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in keys]), order).alias("_row"))
    last = last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in incoming.columns if c not in keys])
    if decimals is not None:
        last = last.withColumn(value, F.round(value, decimals))
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    outcome = last.select(*keys).join(known, keys, "left").select(*keys, F.when(F.col("_known"), 0).otherwise(1).alias("inserted"))
    table = existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))
    return table, outcome


def source_metrics(df: DataFrame, source: str, metrics: list[str]) -> DataFrame:
    """(metric, value) named source__metric, without the ones that could not be worked out (null)."""
    return flatten_metrics(df, [source], metrics).select(F.concat_ws("__", source, "metric").alias("metric"), "value")


def log_run(runs: str, name: str, model_type: str, dataset_version: str, features: list[str], hyperparameters: dict, metrics: DataFrame, commit: str | None = None) -> DataFrame:
    """Appends one run to the Parquet table at `runs` and returns its row: who, on what, with which features and parameters, and
    the metrics of source_metrics as a map. Earlier runs are never touched."""
    spark = metrics.sparkSession
    kept = metrics.where("value is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    run_id = uuid.uuid4().hex
    about = [F.lit(x).cast("string") for x in (run_id, name, model_type, dataset_version)]
    row = kept.select(
        *[c.alias(n) for c, n in zip(about, ("run_id", "name", "model_type", "dataset_version"), strict=True)],
        F.array(*map(F.lit, features)).cast("array<string>").alias("features"),
        F.lit(json.dumps(hyperparameters, sort_keys=True)).alias("hyperparameters"),
        "metrics",
        F.lit(commit).cast("string").alias("git_commit"),
        F.current_timestamp().alias("logged_at"),
    )
    row.write.mode("append").parquet(runs)
    return spark.read.schema(row.schema).parquet(runs).where(F.col("run_id") == run_id)


def update_values(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """df with `column` replaced where new(key, column) has a row for the key, null included; new holds a key once."""
    other = new.select(F.col(key).alias("_k"), F.col(column).alias("_v"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))
    return df.join(other, df[key] == other["_k"], "left").select(*[value.alias(c) if c == column else df[c] for c in df.columns])
