"""The profile of a dataset: tasks against the raw records that they came from, read once as semi-structured values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.operators.profiling import MISSING, ranked_summaries

#: Fixed value: the scenario whose records have a persona.
PERSONA_SCENARIO = "single_persona"
_LIST = "array<variant>"
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"
MEASURES = ("instruction_chars", "persona_chars", "attribute_count", "option_count", "target_price_values")


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def spaced_length(json: Column) -> Column:
    """Characters of compact JSON written with a space after each comma and colon, as reports print it."""
    marks = F.regexp_replace(F.regexp_replace(json, r'"(?:\\.|[^"\\])*"', ""), "[^,:]", "")
    return F.char_length(json) + F.char_length(marks)


def measured(tasks: DataFrame, records: DataFrame, tokenizer: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """A row for each task: task_id, domain, category, what is missing, whether its record is another product's, and the measures.

    tasks: source_index, task_id, scenario, domain, category; records: source_index, json (text). A task without a
    record, or with one that isn't JSON, misses all fields and refers badly. Lists that aren't lists are missing, an empty
    list of prices too; of prices only numbers count. ``tokenizer`` makes a function that counts a text's tokens, once
    for each worker; it adds instruction_tokens and persona_tokens.
    """
    raw, v = free(tasks, records, wanted=["json", "record"])
    told = tasks.join(records.select("source_index", F.col("json").alias(raw)), "source_index", "left").withColumn(v, F.try_parse_json(raw))
    r = F.col(v)
    text = F.nullif(_get(r, "$.instructions[0].instruction", "string"), F.lit(""))
    attributes, options, prices = (_get(r, p, _LIST) for p in ("$.instructions[0].attributes", "$.instructions[0].options", "$.pricing"))
    persona = F.when((F.col("scenario") == PERSONA_SCENARIO) & _get(r, "$.user_persona", "map<string, variant>").isNotNull(), F.get_json_object(raw, "$.user_persona"))
    numbers = F.transform(F.filter(prices, lambda x: F.coalesce(F.schema_of_variant(x).rlike(_NUMBER), F.lit(False))), lambda x: _get(x, "$", "double"))
    out = told.select(
        "task_id", "domain", "category", text.alias("instruction"), persona.alias("persona"),
        text.isNull().alias("missing_instruction"), ((F.col("scenario") == PERSONA_SCENARIO) & persona.isNull()).alias("missing_user_persona"),
        attributes.isNull().alias("missing_attributes"), options.isNull().alias("missing_options"), F.coalesce(F.size(prices) <= 0, F.lit(True)).alias("missing_pricing"),
        (~F.coalesce(_get(r, "$.asin", "string"), F.lit("")).eqNullSafe(F.col("task_id").cast("string"))).alias("bad_reference"),
        F.char_length(text).alias("instruction_chars"), spaced_length(persona).alias("persona_chars"), F.size(attributes).alias("attribute_count"), F.size(options).alias("option_count"),
        numbers.alias("target_price_values"),
    )
    if tokenizer is None:
        return out.drop("instruction", "persona")

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer()
        for batch in batches:
            yield batch.map(lambda x: None if x is None else count(x)).astype("Int64")

    out = out.withColumn("instruction_tokens", tokens(F.coalesce("instruction", F.lit("")))).withColumn("persona_tokens", tokens("persona"))
    return out.drop("instruction", "persona")


def profile(told: DataFrame) -> DataFrame:
    """(measure, count, min, p50, p90, p95, p99, max, mean) of the rows of ``measured``: lengths, counts and each price, and
    tokens if they were counted. A measure without values has no row."""
    names = [m for m in (*MEASURES, "instruction_tokens", "persona_tokens") if m in told.columns]

    def values(name: str) -> Column:
        one = F.transform(name, lambda x: x.cast("double")) if name == "target_price_values" else F.array(F.when(F.col(name) >= 0, F.col(name).cast("double")))
        none = F.array().cast("array<struct<measure: string, value: double>>")
        return F.coalesce(F.transform(one, lambda x: F.struct(F.lit(name).alias("measure"), x.alias("value"))), none)

    return ranked_summaries(told.select(F.explode(F.concat(*map(values, names))).alias("m")).select("m.*"), "measure", "value")


def counts(told: DataFrame) -> DataFrame:
    """One row: tasks, distinct categories and domains, tasks that miss each field, and bad references."""
    fields = [c for c in told.columns if c.startswith("missing_")]
    named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING)) for c in ("category", "domain")]
    return told.agg(
        F.count("*").alias("task_count"), F.count_distinct(named[0]).alias("category_count"), F.count_distinct(named[1]).alias("domain_count"),
        *(F.count_if(c).alias(c) for c in fields), F.count_if("bad_reference").alias("invalid_product_references"),
    )


def bad_references(tasks: DataFrame, products: DataFrame, task: str = "task_id", product: str = "asin") -> DataFrame:
    """Tasks whose product isn't among the products at all: an anti-join on the ids alone."""
    (key,) = free(tasks, wanted=["key"])
    ids = products.select(F.col(product).cast("string").alias(key)).distinct()
    return tasks.join(ids, F.col(task).cast("string") == F.col(key), "left_anti")
