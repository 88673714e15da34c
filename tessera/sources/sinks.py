"""Sinks (K1-K4): parquet, CSV, SQL insert script, fitted models.

The SQL script is built as DataFrame rows: every fact row becomes one
literal tuple by a column expression, tuples are grouped in batches of 500
by surrogate id (bounded groups) and each batch is one INSERT statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import domain
from tessera.operators.export import surrogate_ids
from tessera.operators.trees import TreeModel


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """K1."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """K2."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def sql_literal(c: str, dtype: T.DataType) -> Column:
    """One value as a SQL literal: strings quoted with '' doubling, integers as
    digits, doubles with 6 decimals, NULL / NaN / +-Inf -> NULL."""
    col = F.col(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = col.cast("double")
        ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
        return F.when(ok, F.format_string("%.6f", d)).otherwise(F.lit("NULL"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(col.cast("string"), F.lit("NULL"))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.when(col, F.lit("TRUE")).otherwise(F.lit("FALSE")), F.lit("NULL"))
    s = col.cast("string")
    return F.when(s.isNull(), F.lit("NULL")).otherwise(
        F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def insert_statements(df: DataFrame, table_name: str, order_cols, batch_rows: int = domain.SQL_BATCH_ROWS) -> DataFrame:
    """K3: (table_name, batch, statement) with one INSERT ... VALUES per batch
    of ``batch_rows`` rows in ``order_cols`` order."""
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    tup = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(c, types[c]) for c in cols]), F.lit(")"))
    rows = surrogate_ids(df.select(*cols, tup.alias("_tuple")), order_cols, "_id")
    batches = (rows.withColumn("batch", F.floor((F.col("_id") - 1) / batch_rows).cast("long"))
                   .groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("_id", "_tuple"))).alias("_t")))
    head = f"INSERT INTO {table_name} ({', '.join(cols)}) VALUES\n    "
    body = F.array_join(F.transform("_t", lambda s: s["_tuple"]), ",\n    ")
    return batches.select(F.lit(table_name).alias("table_name"), "batch",
                          F.concat(F.lit(head), body, F.lit(";")).alias("statement"))


def write_sql_script(statements: DataFrame, path: str, ddl: str = "") -> None:
    """K3 script: DDL, BEGIN, statements in (table order, batch) order, COMMIT.
    Written as text by Spark: a range sort gives part files whose names are in
    statement order, so no task writes a whole fact table.  ``table_order`` is
    a column of the statements (parents first); without it, one table."""
    spark = statements.sparkSession
    order = (F.col("table_order") if "table_order" in statements.columns else F.lit(0)).cast("int")
    parts = [spark.createDataFrame([(0, 0, ddl + "BEGIN;\n")], "t int, b long, statement string")]
    parts.append(statements.select((order + 1).alias("t"), F.col("batch").alias("b"), "statement"))
    parts.append(spark.createDataFrame([(2**31 - 1, 0, "COMMIT;")], "t int, b long, statement string"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("t", "b")
    out.select("statement").write.mode("overwrite").text(path)


def save_models(models, path: str) -> None:
    """K4: one saved PipelineModel per target, or a tree model as Parquet: its nodes, and one row of the rest."""
    root = path.rstrip("/")
    if isinstance(models, TreeModel):
        models.nodes.write.mode("overwrite").parquet(f"{root}/nodes")
        models.nodes.sparkSession.createDataFrame([(models.features, models.targets, models.scale, models.base)], _TREE_MODEL) \
            .write.mode("overwrite").parquet(f"{root}/model")
        return
    for name, m in models.items():
        m.write().overwrite().save(f"{root}/{name}")


def load_tree_model(spark: SparkSession, path: str) -> TreeModel:
    root = path.rstrip("/")
    r = spark.read.parquet(f"{root}/model").first()
    return TreeModel(list(r["features"]), list(r["targets"]), spark.read.parquet(f"{root}/nodes"), list(r["scale"]), list(r["base"]))


_TREE_MODEL = "features array<string>, targets array<string>, scale array<double>, base array<double>"
