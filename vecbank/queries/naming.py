"""Label-name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.names import (
    folder_label, is_valid_name, name_key, new_name, pick_label_and_image, stored_label,
)
from vecbank.operators.naming import (
    cap_labels, decode_labels, encode_labels, known_only, label_universe, name_index, remote_only, resolve_names,
    suggest_names, suggestion_candidates,
)
from vecbank.queries import query
from vecbank.queries.inputs import VARIANTS, name_variants
from vecbank.session import table
from vecbank.settings import IMAGE_COLUMNS, LABEL_COLUMNS

KEY = "regexp_replace(lower({0}), '[^a-z0-9♀♂]+', '', 'g')"
NEW = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '\\s+', '_', 'g')"
FOLDER = "lower(trim(replace({0}, '_', ' ')))"


@query("name_key", f"with {VARIANTS} select p_partkey, {KEY.format('name')} as name_key from variants")
def key_of_name(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants(spark, sf).select("p_partkey", name_key(F.col("name")).alias("name_key"))


@query(
    "new_name",
    f"with {VARIANTS} select p_partkey, {NEW.format("chr(9) || ' ' || name || chr(10)")} as new_name from variants",
)
def spelling_of_new_name(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("name"), F.lit("\n"))
    return name_variants(spark, sf).select("p_partkey", new_name(padded).alias("new_name"))


@query("folder_label", f"with {VARIANTS} select p_partkey, {FOLDER.format('name')} as label from variants")
def label_of_folder(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants(spark, sf).select("p_partkey", folder_label(F.col("name")).alias("label"))


@query("stored_label", f"with {VARIANTS} select p_partkey, substr(repeat(name, 10), 1, 64) as label from variants")
def published_label(spark: SparkSession, sf: str) -> DataFrame:
    """Published labels are at most 64 characters long."""
    return name_variants(spark, sf).select("p_partkey", stored_label(F.repeat("name", F.lit(10))).alias("label"))


BANK_NAMES = """bank as (select p_partkey as row_id,
      case when p_partkey % 2 = 0 then replace(p_name, ' ', '_') else p_name end as species from part)"""


def _bank_names(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", " ", "_")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), spelled.alias("species"))


@query(
    "name_index",
    f"""with {BANK_NAMES} select {KEY.format('species')} as key, arg_min(species, row_id) as species
    from bank group by 1""",
)
def index_of_names(spark: SparkSession, sf: str) -> DataFrame:
    return name_index(_bank_names(spark, sf)).select("key", "species")


@query(
    "resolve_names",
    f"""with {VARIANTS}, {BANK_NAMES}, idx as (
      select {KEY.format('species')} as key, arg_min(species, row_id) as species from bank group by 1),
    asked as (select 'part' as origin, p_partkey as id, name from variants
              union all select 'customer', c_custkey, c_name from customer)
    select origin, id, name, idx.species from asked left join idx on idx.key = {KEY.format('name')}""",
)
def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = name_variants(spark, sf).select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), "name")
    others = table(spark, sf, "customer").select(F.lit("customer"), "c_custkey", "c_name")
    found = resolve_names(parts.union(others), name_index(_bank_names(spark, sf)))
    return found.select("origin", "id", "name", "species")


@query(
    "valid_names",
    f"""with {VARIANTS}, asked as (
      select 'part' as origin, p_partkey as id, name from variants
      union all select 'document', doc_id, text from documents
      union all select 'event', event_id, regexp_replace(props, '[0-9a-z]', '', 'g') from events)
    select origin, id, length(t) > 0 and length(t) <= 64 and length({KEY.format('t')}) > 0 as valid
    from (select origin, id, regexp_replace(name, '^\\s+|\\s+$', '', 'g') as t from asked)""",
)
def valid_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = name_variants(spark, sf).select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), "name")
    texts = table(spark, sf, "documents").select(F.lit("document"), "doc_id", "text")
    signs = table(spark, sf, "events").select(
        F.lit("event"), "event_id", F.regexp_replace("props", "[0-9a-z]", "")
    )
    asked = parts.union(texts).union(signs)
    return asked.select("origin", "id", is_valid_name(F.col("name")).alias("valid"))


@query(
    "label_decode",
    """select s_suppkey, coalesce(r_name, 'unknown') as species
    from supplier left join region on r_regionkey = s_nationkey""",
)
def decoded_labels(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = table(spark, sf, "region").select(F.col("r_regionkey").alias("idx"), F.col("r_name").alias("species"))
    return decode_labels(table(spark, sf, "supplier"), dictionary, "s_nationkey").select("s_suppkey", "species")


@query(
    "candidate_columns",
    """select 'embeddings' as dataset, label::varchar as label, count(*) as n, sum(len(embedding))::bigint as volume
       from embeddings group by label
    union all
    select 'benchmark', item_id::varchar, count(*), sum(length(text))::bigint from benchmark group by item_id""",
)
def candidate_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Label and image column by name (first dataset) or by position (second)."""
    first = table(spark, sf, "embeddings").withColumnRenamed("embedding", "img")
    second = table(spark, sf, "benchmark").withColumnRenamed("text", "body")
    outs = []
    for name, dataset in (("embeddings", first), ("benchmark", second)):
        label, image = pick_label_and_image(dataset.columns, LABEL_COLUMNS, IMAGE_COLUMNS)
        measure = F.size(image) if name == "embeddings" else F.length(image)
        outs.append(
            dataset.groupBy(F.col(label).cast("string").alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("volume"))
            .select(F.lit(name).alias("dataset"), "label", "n", "volume")
        )
    return outs[0].union(outs[1])


def _misspelt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    name = F.col("p_name")
    at = (F.col("p_partkey") % 5).cast("int")
    misspelt = F.concat(F.substring(name, F.lit(1), at + 1), F.substring(name, at + 3, F.length(name)))
    asked = table(spark, sf, "part").select(misspelt.alias("name"))
    return asked, table(spark, sf, "part").select(F.translate("p_name", " ", "_").alias("species"))


@query(
    "suggestion_candidates",
    """with words as (
      select distinct replace(substr(p_name, 1, p_partkey % 5 + 1) || substr(p_name, p_partkey % 5 + 3), ' ', '_') as word from part),
    labels as (select distinct replace(p_name, ' ', '_') as label from part),
    w as (select word, c, count(*) as n from (select word, unnest(string_split(word, '')) as c from words) group by 1, 2),
    l as (select label, c, count(*) as n from (select label, unnest(string_split(label, '')) as c from labels) group by 1, 2),
    shared as (select word, label, sum(least(w.n, l.n)) as m from w join l using (c) group by 1, 2)
    select word, count(label) as candidates from words left join (
      select * from shared where 2.0 * m / (length(word) + length(label)) >= 0.6) using (word) group by 1""",
)
def candidates_for_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that the index of characters lets through, against counting the characters of all pairs."""
    return suggestion_candidates(*_misspelt(spark, sf))


@query("suggest_names")
def suggested_names(spark: SparkSession, sf: str) -> DataFrame:
    """Misspelt part names against the real ones (the ratio has no SQL form; tested against difflib)."""
    found = suggest_names(*_misspelt(spark, sf))
    return found.select("word", F.array_join("suggestions", ",").alias("suggestions"))


def _local(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("species"))


def _remote(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants(spark, sf).select(folder_label(F.col("name")).alias("species"))


UNIVERSE = f"""{VARIANTS}, local as (select distinct p_name as species from part),
    remote as (select distinct {FOLDER.format('name')} as species from variants),
    universe as (select species, bool_or(is_local) as is_local, row_number() over (order by species) - 1 as idx
      from (select species, true as is_local from local union all select species, false from remote)
      where length(species) > 0 group by species)"""


@query("label_universe", f"with {UNIVERSE} select species, is_local, idx from universe")
def universe(spark: SparkSession, sf: str) -> DataFrame:
    return label_universe(_local(spark, sf), _remote(spark, sf)).select("species", "is_local", "idx")


@query("remote_only_labels", f"with {UNIVERSE} select species from remote except select species from local")
def remote_names(spark: SparkSession, sf: str) -> DataFrame:
    return remote_only(_local(spark, sf), _remote(spark, sf))


@query(
    "label_cap",
    f"""with {UNIVERSE} select species, is_local, idx from (
      select species, is_local, row_number() over (order by is_local desc, species) - 1 as idx from universe)
    where idx < 100""",
)
def capped_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cap_labels(label_universe(_local(spark, sf), _remote(spark, sf)), 100).select("species", "is_local", "idx")


@query(
    "label_index_join",
    f"""with {UNIVERSE} select p_partkey, idx from variants join universe on universe.species = {FOLDER.format('name')}""",
)
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = name_variants(spark, sf).select("p_partkey", folder_label(F.col("name")).alias("species"))
    return encode_labels(rows, label_universe(_local(spark, sf), _remote(spark, sf))).select("p_partkey", "idx")


@query(
    "known_labels",
    f"""with {VARIANTS} select p_partkey, {FOLDER.format('name')} as species from variants
    where {FOLDER.format('name')} in (select p_name from part)""",
)
def known_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = name_variants(spark, sf).select("p_partkey", folder_label(F.col("name")).alias("species"))
    return known_only(rows, _local(spark, sf)).select("p_partkey", "species")
