"""Audits and profiles of the clean tables (counts, bounds, options)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- A6 ---------------------------------------------------------------------
def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One (table_name, n) row per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- A7 ---------------------------------------------------------------------
def clean_audit(tables: Mapping[str, DataFrame], price_col: str = "price") -> DataFrame:
    """table_name, column count, rows, min/max price (NULL without a price column)."""
    parts = []
    for name, df in tables.items():
        has_price = price_col in df.columns
        parts.append(df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.min(price_col) if has_price else F.lit(None).cast("double")).alias("min_price"),
            (F.max(price_col) if has_price else F.lit(None).cast("double")).alias("max_price"),
        ).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
                 "n_rows", "min_price", "max_price"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- A8 ---------------------------------------------------------------------
def catalog_listing(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views in the catalog with their column counts (metadata only);
    of a named ``database`` its own only, without the session's temporary views."""
    rows = []
    for t in spark.catalog.listTables(database):
        if database and t.database != database:
            continue
        cols = spark.catalog.listColumns(f"{t.database}.{t.name}" if t.database else t.name)
        rows.append((t.name, t.database, t.tableType, len(cols)))
    return spark.createDataFrame(rows, "table_name string, database string, table_type string, n_cols int")


# --- A9 ---------------------------------------------------------------------
def category_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values as text, sorted; none for an absent column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "option string")
    return (df.select(F.col(column).cast("string").alias("option")).where(F.col("option").isNotNull())
            .distinct().orderBy("option"))


# --- A10 --------------------------------------------------------------------
def numeric_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, median) per column: min/max from one aggregate,
    exact medians from the bounded-memory selection (all columns share its
    passes).  An absent column has no row."""
    from .quantiles import exact_quantiles_many

    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, min_value double, max_value double, median_value double")
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    medians = exact_quantiles_many(df, {c: [0.5] for c in columns})
    wide = df.agg(*aggs).select("*", *[F.lit(medians[c][0]).cast("double").alias(f"{c}__median")
                                       for c in columns])
    stack = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__median`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, min_value, max_value, median_value)")


# --- A11 --------------------------------------------------------------------
def kept_categories(mapping: DataFrame, slim: str = "property_type_slim", other: str = "Other") -> DataFrame:
    """Sorted kept categories with 'Other' last.  There are at most 1 / threshold
    kept ones, so the ranking task stays small however many rare types map to 'Other'."""
    kept = mapping.select(F.col(slim).alias("category")).where(F.col("category") != other).distinct()
    with_other = kept.unionByName(mapping.sparkSession.range(1).select(F.lit(other).alias("category")))
    return with_other.select("category", F.when(F.col("category") == other, 1).otherwise(0).alias("__last"))\
        .distinct().selectExpr("category", "row_number() OVER (ORDER BY __last, category) AS position")
