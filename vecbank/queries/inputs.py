"""Inputs derived from the given tables, for Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import as_double, l2_normalize
from vecbank.session import table

DIM = 64


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, species, vec``: the raw vectors as a bank."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("species"),
        F.col("embedding").alias("vec"),
    )


def blended(spark: SparkSession, sf: str, weight: float, rest: float) -> DataFrame:
    """``row_id, species, vec``: every vector mixed with its successor (the last one with itself), unit length."""
    rows = embeddings(spark, sf)
    successors = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("vec").alias("next"))
    mixed = F.zip_with(
        as_double(F.col("vec")), as_double(F.coalesce("next", "vec")), lambda a, b: a * weight + b * rest
    )
    joined = rows.join(successors, "row_id", "left")
    return joined.select("row_id", "species", mixed.alias("raw")).select(
        "row_id", "species", l2_normalize(F.col("raw")).alias("vec")
    )


def as_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("query_id"), "species", "vec")


E = "e as (select vec_id as row_id, 'label_' || label as species, embedding::DOUBLE[] as vec from embeddings)"


def blend_sql(name: str, weight: float, rest: float) -> str:
    return f"""{name} as (
      select row_id, species, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) as vec
      from (select a.row_id, a.species, list_transform(a.vec, lambda x, i: x * {weight}::DOUBLE
                     + coalesce(b.vec, a.vec)[i] * {rest}::DOUBLE) as raw
            from e a left join e b on b.row_id = a.row_id + 1))"""


def hits_sql(queries: str, bank: str, k: int) -> str:
    """CTE ``hits``: the k best bank rows per query."""
    return f"""hits as (
      select * from (
        select query_id, row_id, species, sim,
               row_number() over (partition by query_id order by sim desc, row_id) as rank
        from (select q.row_id as query_id, b.row_id, b.species, list_dot_product(q.vec, b.vec) as sim
              from {queries} q cross join {bank} b))
      where rank <= {k})"""


VOTE_SQL = """votes as (
      select query_id, species, count(*) as votes, max(sim) as best, min(rank) as first
      from hits group by 1, 2),
    winners as (
      select * from (select *, row_number() over (partition by query_id order by votes desc, best desc, first) as place
                     from votes) where place = 1),
    tops as (select query_id, species as top_species, sim as top_sim from hits where rank = 1)"""


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of different lengths: every value times (label + 1) / 2."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform(as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1) / 2.0).alias("vec")
    )


SCALED = "scaled as (select vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1) / 2.0::DOUBLE) as vec from embeddings)"


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, species, vec``: vectors turned to zero, given a NaN or cut short, depending on their values."""
    rows = embeddings(spark, sf)
    vec = as_double(F.col("vec"))
    broken = (
        F.when(F.get(vec, 0) > 0.12, F.transform(vec, lambda x: F.lit(0.0)))
        .when(F.get(vec, 1) > 0.12, F.transform(vec, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
        .when(F.get(vec, 2) > 0.12, F.slice(vec, 1, DIM - 1))
        .otherwise(vec)
    )
    return rows.select("row_id", "species", broken.alias("vec"))


DAMAGED = f"""damaged as (
      select row_id, species, case
        when vec[1] > 0.12 then list_transform(vec, lambda x: 0.0::DOUBLE)
        when vec[2] > 0.12 then list_transform(vec, lambda x, i: case when i = 6 then 'nan'::DOUBLE else x end)
        when vec[3] > 0.12 then vec[1:{DIM - 1}] else vec end as vec from e)"""


def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """``p_partkey, p_name, name``: part names in four spellings."""
    name = F.col("p_name")
    variant = (
        F.when(F.col("p_partkey") % 4 == 0, F.upper(name))
        .when(F.col("p_partkey") % 4 == 1, F.translate(name, " ", "_"))
        .when(F.col("p_partkey") % 4 == 2, F.translate(name, " ", "-"))
        .otherwise(F.regexp_replace(name, " ", ". "))
    )
    return table(spark, sf, "part").select("p_partkey", "p_name", variant.alias("name"))


VARIANTS = """variants as (
      select p_partkey, p_name, case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '_')
             when 2 then replace(p_name, ' ', '-') else replace(p_name, ' ', '. ') end as name from part)"""


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, op, species``: events as changes of a bank."""
    kind = F.col("event_type")
    op = F.when(kind == "error", "forget").when(kind == "click", "reload").otherwise("learn")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"),
        F.when(op != "reload", F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("species"),
    )


LOG = """log as (
      select event_id as seq, case event_type when 'error' then 'forget' when 'click' then 'reload' else 'learn' end as op,
             case when event_type <> 'click' then 'user_' || user_id end as species from events)"""


def micros(value: Column) -> Column:
    """A number as whole millionths, for comparing text."""
    return F.round(value * 1000000).cast("long")


def micros_text(vec: Column) -> Column:
    return F.array_join(F.transform(as_double(vec), lambda x: micros(x).cast("string")), ",")


MICROS_TEXT = "array_to_string(list_transform({vec}, lambda x: cast(round(x * 1000000) as bigint)::varchar), ',')"
