"""Readers and writers: corpora, manifests, labelled sets, indexes, exports, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_ROWS = 5000


def read_corpus(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Every text file below ``path`` as (doc_id, source, text), one row per file."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return files.select(F.regexp_replace(name, rf"\Q{suffix}\E$", "").alias("doc_id"), name.alias("source"), F.col("value").alias("text"))


MANIFEST = T.StructType([T.StructField("documents", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
    "file", "provenance", "source_url", "retrieved_on", "confidence", "notes", "version", "effective_from")])))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per declared document; a missing provenance reads ``undeclared``."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    return rows.filter(F.col("file").isNotNull()).withColumn("provenance", F.coalesce("provenance", F.lit("undeclared")))


def edition_label(version: Column, provenance: Column, effective_from: Column, retrieved_on: Column) -> Column:
    """"version V, effective D" / "as published D" / prototype note; bad dates are ignored."""
    def day(c: Column) -> Column:
        return F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "d MMM yyyy")

    when = (F.when(provenance == "synthetic", "prototype document, not published policy")
            .when(day(effective_from).isNotNull(), F.concat(F.lit("effective "), day(effective_from)))
            .when(day(retrieved_on).isNotNull(), F.concat(F.lit("as published "), day(retrieved_on))))
    return F.concat_ws(", ", F.when(F.length(F.coalesce(version, F.lit(""))) > 0, F.concat(F.lit("version "), version)), when)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, language, source) from quoted CSV with a header; empty texts dropped.
    Files without the last two columns read as authored English."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    for name, value in (("language", "en"), ("source", "authored")):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value))
    return rows.filter(F.length(F.coalesce("text", F.lit(""))) > 0).select("text", "label", "language", "source")


EVAL_SET = "id string, query string, expected_topics array<string>, expected_keywords array<string>"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SET).json(path, multiLine=True)


def write_index(index: DataFrame, path: str, mode: str = "overwrite", partition: str = "source") -> None:
    """The chunk index as parquet, one folder per provenance; ``append`` adds documents."""
    index.write.mode(mode).partitionBy(partition).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_events(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def safe_cell(value: Column) -> Column:
    """A cell no spreadsheet runs as a formula; NULL becomes empty."""
    cell = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def export_rows(df: DataFrame, columns: Sequence[str], order: Sequence[Column], cap: int = CSV_ROWS) -> DataFrame:
    """The newest ``cap`` rows, fixed columns, every cell safe."""
    return df.orderBy(*order).limit(cap).select(*[safe_cell(F.col(c)).alias(c) for c in columns])


def export_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column], cap: int = CSV_ROWS) -> None:
    export_rows(df, columns, order, cap).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
