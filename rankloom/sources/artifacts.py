"""Stored results of preparation: split tables, features, manifest, and exports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.columns import EVALUATION_PROTOCOL, ROW, SPLIT, SPLITS, UNDEFINED, ordered_columns
from rankloom.functions.names import field_names, field_type
from rankloom.functions.text import strip
from rankloom.operators.cleaning import number, positives
from rankloom.operators.sequences import sequence_rows

CACHE_VERSION = 2
TABLES = ("interactions", "user_features", "item_features")


# --- prepared data ------------------------------------------------------------------


def save_prepared(folder: str, tables: Mapping[str, DataFrame], parameters: Mapping[str, object]) -> None:
    """Write the tables, then the manifest: a folder without one is incomplete.

    ``interactions`` is partitioned by split, so reading one split skips the rest.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if SPLIT in df.columns:
            writer = writer.partitionBy(SPLIT)
        writer.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    content = {"version": CACHE_VERSION, "tables": sorted(tables), **parameters}
    text = json.dumps(content, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    try:
        rows = spark.read.text(f"{folder}/manifest").collect()
        return json.loads(rows[0]["value"]) if rows else None
    except Exception:  # noqa: BLE001 - a missing or broken manifest means "not prepared"
        return None


def prepared_exists(spark: SparkSession, folder: str, parameters: Mapping[str, object] | None = None) -> bool:
    """Whether a complete folder of the current version exists.

    With ``parameters`` they must also be the ones the folder was written with.
    """
    manifest = read_manifest(spark, folder)
    if not manifest or manifest.get("version") != CACHE_VERSION:
        return False
    if not set(TABLES) <= set(manifest.get("tables", [])):
        return False
    given = json.loads(json.dumps(dict(parameters or {}), default=str))
    return all(manifest.get(k) == v for k, v in given.items())


def load_prepared(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    manifest = read_manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"no prepared data in {folder}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def feature_columns(features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Wide form of a ``(key, features)`` table; a wrong width fails the job."""
    wrong = F.raise_error(F.lit(f"expected {len(names)} features per row")).cast("array<float>")
    checked = features.withColumn("_f", F.when(F.size("features") == len(names), F.col("features")).otherwise(wrong))
    return checked.select(key, *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


# --- typed text exports ---------------------------------------------------------------


def atomic_frame(df: DataFrame, categorical: set[str] = frozenset(), namespace: str | None = None) -> DataFrame:
    """Columns named ``field:type`` for text export.

    A token column that is numeric in every row is written as rounded integers,
    otherwise as text with ``Undefined`` for blanks; other columns are numbers with
    0 for blanks. Whether a column is numeric takes one aggregation for all of them.
    """
    names = field_names(df.columns, namespace)
    tokens = [c for c in df.columns if field_type(c, categorical) == "token"]
    numeric = {}
    if tokens:
        checks = [F.coalesce(F.bool_and(number(F.col(c)).isNotNull()), F.lit(True)).alias(c) for c in tokens]
        numeric = df.agg(*checks).first().asDict()
    out = []
    for c in df.columns:
        kind = field_type(c, categorical)
        if kind == "float":
            value = F.coalesce(number(F.col(c)), F.lit(0.0)).cast("float")
        elif numeric[c]:
            value = F.rint(number(F.col(c))).cast("bigint").cast("string")
        else:
            value = F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), F.lit(UNDEFINED))
        out.append(value.alias(f"{names[c]}:{kind}"))
    return df.select(*out)


def _tsv(io):
    """Quotes are doubled and blanks kept, on both ways."""
    options = {"sep": "\t", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return io.options(**options)


def write_tsv(df: DataFrame, path: str) -> None:
    _tsv(df.write.mode("overwrite")).option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark.read).csv(path)


def tsv_fields(spark: SparkSession, path: str) -> list[str]:
    """Field names of a typed export, from its header."""
    return [c.split(":", 1)[0] for c in read_tsv(spark, path).columns]


def save_atomic(
    folder: str, name: str, labelled: DataFrame, users: DataFrame, items: DataFrame, categorical: Mapping[str, set[str]]
) -> dict[str, str]:
    """Write positive interactions (all and per split), users and items as typed TSV."""
    written = {}

    def put(kind: str, df: DataFrame, group: str) -> None:
        written[kind] = f"{folder}/{name}.{kind}"
        write_tsv(atomic_frame(df, categorical.get(group, set()), group), written[kind])

    rows = positives(labelled)
    columns = ordered_columns([c for c in rows.columns if c not in (SPLIT, ROW)])
    put("inter", rows.select(*columns), "inter")
    for split, kind in zip(SPLITS, ("train", "valid", "test")):
        put(f"{kind}.inter", rows.where(F.col(SPLIT) == split).select(*columns), "inter")
    put("user", users, "user")
    put("item", items, "item")
    return written


def save_sequences(folder: str, name: str, histories: DataFrame) -> dict[str, str]:
    """Write the three sequence splits; an empty split is an error."""
    written = {}
    for split, kind in zip(SPLITS, ("train_seq", "valid_seq", "test_seq")):
        rows = sequence_rows(histories, split)
        if rows.isEmpty():
            raise RuntimeError(f"sequence split {kind!r} has no usable queries")
        written[kind] = f"{folder}/{name}.{kind}.inter"
        write_tsv(rows, written[kind])
    return written


# --- result tables ------------------------------------------------------------------


def save_results(df: DataFrame, folder: str) -> None:
    """Store metric rows per (dataset, model, seed), replacing only the given ones."""
    stamped = df.withColumn("evaluation_protocol", F.lit(EVALUATION_PROTOCOL))
    writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset", "model", "seed").parquet(folder)


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """Stored metric rows of the current evaluation protocol."""
    return spark.read.parquet(folder).where(F.col("evaluation_protocol") == EVALUATION_PROTOCOL)


def load_metric_files(spark: SparkSession, glob: str) -> DataFrame:
    """CSV results of several folders; the folder name becomes ``dataset``.

    Files may differ in columns and their order: those with one header are read together, and absent columns are null. Files
    without a header line are skipped. There is one result file per run, so their names fit the driver.
    """
    first = F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r"))
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), first.alias("header"))
    by_header: dict[str, list[str]] = {}
    for path, header in files.where("trim(header) <> ''").orderBy("path").collect():
        by_header.setdefault(header, []).append(path)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    parts = [spark.read.option("header", True).csv(paths).withColumn("dataset", folder) for paths in by_header.values()]
    if not parts:
        raise FileNotFoundError(f"no result file with a header in {glob}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def latest_artifact(artifacts: DataFrame, by: str = "dataset") -> DataFrame:
    """Newest stored artifact per dataset: by folder name, then by change time."""
    complete = artifacts.where("has_model and has_metadata")
    newest = F.max_by(F.col("path"), F.struct("name", "modified"))
    return complete.groupBy(by).agg(newest.alias("path"))


def save_table(df: DataFrame, path: str) -> None:
    """Write one report table as a single CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

