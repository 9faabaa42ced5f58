"""Catalog records as tasks and as search documents, and what their schema looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.text import col, strip


def tasks(records: DataFrame, scenario: str, split: Column | str) -> DataFrame:
    """(task_id, scenario, official_split, source_index, domain, category, instruction): from records with position."""
    first = F.try_element_at("instructions", F.lit(1)) if "instructions" in records.columns else F.lit(None)
    return records.select(
        F.coalesce(F.col("asin"), F.lit("")).alias("task_id"),
        F.lit(scenario).alias("scenario"),
        col(split).alias("official_split"),
        F.col("position").alias("source_index"),
        F.col("domain_zh").alias("domain"),
        "category",
        first.alias("instruction"),
    )


def option_text(options: Column | str) -> Column:
    """map<name, array<struct<value>>> as ``name: a, b, and other: c``: lower-case, slashes as bars, null lists left out."""
    entries = F.filter(F.map_entries(col(options)), lambda e: e["value"].isNotNull())

    def shown(e: Column) -> Column:
        values = F.transform(e["value"], lambda v: F.lower(F.replace(strip(F.coalesce(v["value"], F.lit(""))), F.lit("/"), F.lit(" | "))))
        return F.concat(F.lower(e["key"]), F.lit(": "), F.array_join(values, ", "))

    return F.coalesce(F.array_join(F.transform(entries, shown), ", and "), F.lit(""))


def documents(records: DataFrame) -> DataFrame:
    """(id, contents) for a search index; an id that is empty, nan or over 20 characters is an error."""
    bad = (F.coalesce("asin", F.lit("")) == "") | (F.col("asin") == "nan") | (F.char_length("asin") > 20)
    contents = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("full_description", F.lit("")), F.lit(""), option_text("customization_options"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad id: "), F.coalesce("asin", F.lit("null")))).cast("string")).otherwise(F.col("asin"))
    return records.select(checked.alias("id"), F.lower(contents).alias("contents"))


def observed_schema(records: DataFrame, text: str, position: str, all_records: bool = False) -> DataFrame:
    """(schema): of the first record's JSON text, or merged over all records."""
    if all_records:
        return records.agg(F.schema_of_variant_agg(F.parse_json(text)).alias("schema"))
    first = records.orderBy(position).limit(1)
    return first.select(F.schema_of_variant(F.parse_json(text)).alias("schema"))


def checked_join(tasks_: DataFrame, records: DataFrame) -> DataFrame:
    """Tasks with their record by position; another id there, or no record, is an error."""
    (own,) = free(tasks_, records, wanted=["asin"])
    r = records.select(F.col("position").alias("source_index"), F.col("asin").alias(own), *[c for c in records.columns if c not in ("position", "asin") and c not in tasks_.columns])
    joined = tasks_.join(r, "source_index", "left")
    same = F.when(F.col(own).eqNullSafe(F.col("task_id")), F.col("task_id")).otherwise(F.raise_error(F.lit("id at position differs")).cast("string"))
    return joined.withColumn("task_id", same).drop(own)
