"""Bank building, checking, storing and scanning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import (
    as_double, from_base64, from_bytes, from_json_text, half_precision, has_dim, is_finite, norm, to_base64, to_bytes,
    to_json_text,
)
from vecbank.operators.bank import (
    bank_stats, bank_union, combine_blocks, extend_blocks, fingerprint_blocks, join_positions, migrate_json_vectors,
    row_verdict, usable_rows,
)
from vecbank.operators.changes import learned_rows
from vecbank.operators.quotas import hold_out
from vecbank.plans.load import export_folder, load_folder
from vecbank.queries import query
from vecbank.queries.inputs import DAMAGED, DIM, E, MICROS_TEXT, blend_sql, blended, damaged, embeddings, micros_text
from vecbank.session import materialize, scratch_path, table
from vecbank.sources.learned import read_learned, read_meta, scan_learned_lines, write_learned
from vecbank.sources.npy import NpySource, write_npy
from vecbank.sources.store import BankStore, DimensionMismatch, newest_valid, read_split_features, write_split_features

UNION = f"""{E}, {blend_sql('near', 0.95, 0.05)}, bank as (
      select row_id, species, vec, 'base' as origin from e union all
      select row_id + (select count(*) from e), species, vec, 'learned' from near)"""


def _union(spark: SparkSession, sf: str) -> DataFrame:
    learned = blended(spark, sf, 0.95, 0.05).withColumnRenamed("row_id", "seq")
    base = embeddings(spark, sf).withColumn("vec", as_double(F.col("vec")))
    return bank_union(base, learned)


@query("bank_union", f"with {UNION} select row_id, species, origin, round(sqrt(list_dot_product(vec, vec)), 6) as norm from bank")
def union(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).select("row_id", "species", "origin", F.round(norm(F.col("vec")), 6).alias("norm"))


@query(
    "bank_stats",
    f"""with {UNION} select count(*) as vectors, count(distinct species) as species,
      count(*) filter (origin = 'learned') as learned, max(len(vec))::int as dim,
      max(len(vec)) <> min(len(vec)) as mixed_dims from bank""",
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return bank_stats(_union(spark, sf))


FINITE = "not list_contains(list_transform(vec, lambda x: isfinite(x)), false)"


@query(
    "drop_zero_vectors",
    f"with {E}, {DAMAGED} select row_id, species from damaged where {FINITE} and sqrt(list_dot_product(vec, vec)) > 1e-6",
)
def without_zero_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return damaged(spark, sf).filter(is_finite(F.col("vec")) & (norm(F.col("vec")) > 1e-6)).select("row_id", "species")


@query("finite_vectors", f"with {E}, {DAMAGED} select row_id, {FINITE} as finite from damaged")
def finite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return damaged(spark, sf).select("row_id", is_finite(F.col("vec")).alias("finite"))


@query("dim_check", f"with {E}, {DAMAGED} select row_id, len(vec) = {DIM} as fits from damaged")
def dim_check(spark: SparkSession, sf: str) -> DataFrame:
    return damaged(spark, sf).select("row_id", has_dim(F.col("vec"), DIM).alias("fits"))


VERDICT = f"""case when len(vec) <> {DIM} then 'wrong_dim' when not {FINITE} then 'not_finite'
      when list_dot_product(vec, vec) = 0 then 'zero' else 'ok' end"""


@query("row_verdicts", f"with {E}, {DAMAGED} select species, {VERDICT} as verdict, count(*) as n from damaged group by all")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    judged = damaged(spark, sf).select("species", row_verdict(F.col("vec"), DIM).alias("verdict"))
    return judged.groupBy("species", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("usable_bank_rows", f"with {E}, {DAMAGED} select row_id, species from damaged where {VERDICT} = 'ok'")
def usable(spark: SparkSession, sf: str) -> DataFrame:
    return usable_rows(damaged(spark, sf), DIM).select("row_id", "species")


@query("positional_join", f"with {E} select row_id, species, round(sqrt(list_dot_product(vec, vec)), 6) as norm from e")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    joined = join_positions(rows.select("row_id", "species"), rows.select("row_id", "vec"))
    return joined.select("row_id", "species", F.round(norm(F.col("vec")), 6).alias("norm"))


FANOUT = 64


def _hashed(rows: DataFrame) -> DataFrame:
    text = F.concat("species", F.lit("\n"), micros_text(F.col("vec")))
    return rows.select("row_id", F.sha1(text.cast("binary")).alias("row_hash"))


FINGERPRINT_SQL = f"""with {E}, leaves as (
      select row_id // {FANOUT} as block_id,
             sha1(string_agg(sha1(species || chr(10) || {MICROS_TEXT.format(vec='vec')}), '' order by row_id)) as digest
      from e group by 1)
    select substr(sha1('model-1' || chr(10) || string_agg(digest, '' order by block_id)), 1, 16) as fingerprint,
           (select count(*) from e) as vectors from leaves"""


@query("bank_fingerprint", FINGERPRINT_SQL)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    blocks = materialize(fingerprint_blocks(_hashed(embeddings(spark, sf)), FANOUT), "blocks")
    return combine_blocks(blocks, "model-1", FANOUT)


@query("bank_fingerprint_incremental", FINGERPRINT_SQL)
def incremental_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Hash what was there, append the rest, hash only the new rows: the same fingerprint."""
    rows = embeddings(spark, sf)
    median = rows.agg(F.percentile("row_id", F.lit(0.5)).cast("long")).first()[0]
    stored = materialize(fingerprint_blocks(_hashed(rows.filter(F.col("row_id") <= median)), FANOUT), "blocks")
    blocks = materialize(extend_blocks(stored, _hashed(rows), FANOUT), "blocks")
    return combine_blocks(blocks, "model-1", FANOUT)


@query(
    "migrate_json_vectors",
    """select species, accepted, count(*) as n, sum(case when accepted then 256 else 0 end)::bigint as bytes from (
      select 'label_' || label as species, embedding[1] <= 0.15 as accepted from embeddings) group by all""",
)
def migration(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    text = to_json_text(F.col("vec"))
    cut = F.when(F.get("vec", 0) > 0.15, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    moved = migrate_json_vectors(rows.select(F.col("row_id").alias("id"), "species", cut.alias("vec_text")))
    size = F.coalesce(F.octet_length("vec_bytes"), F.lit(0))
    return moved.groupBy("species", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


@query(
    "vector_codec",
    """select vec_id, 256 as n_bytes, true as bytes_ok, true as base64_ok, true as json_ok, true as rejected
    from embeddings""",
)
def codecs(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes, base64 and JSON lead back to the vector; text that is none of them gives null."""
    rows = embeddings(spark, sf)
    vec = F.col("vec")
    broken = from_json_text(F.lit('[1, "a"]')).isNull() & from_base64(F.lit("!")).isNull()
    return rows.select(
        F.col("row_id").alias("vec_id"), F.octet_length(to_bytes(vec)).alias("n_bytes"),
        (from_bytes(to_bytes(vec)) == vec).alias("bytes_ok"),
        (from_base64(to_base64(vec)) == vec).alias("base64_ok"),
        (from_json_text(to_json_text(vec)) == vec).alias("json_ok"), broken.alias("rejected"),
    )


@query(
    "half_precision",
    """with x as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE * 0.001 ** (vec_id % 3) as x from embeddings),
    s as (select *, case when x = 0 then 1.0 else 2.0 ** (greatest(floor(log2(abs(x::FLOAT::DOUBLE))), -14) - 10) end as step,
                 x::FLOAT::DOUBLE as single from x)
    select vec_id, round(sum(abs(round_even(single / step, 0) * step - single)) * 1000000, 6) as micro_error,
           round(max(abs(round_even(single / step, 0) * step)), 9) as largest, count(*) filter (round_even(single / step, 0) * step = single) as exact
    from s group by 1""",
)
def halves(spark: SparkSession, sf: str) -> DataFrame:
    """fp16 keeps 11 significant bits down to 2^-14, and steps of 2^-24 below: the error of every vector, two thirds of them scaled down."""
    scale = F.pow(F.lit(0.001), F.col("vec_id") % 3)
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x.cast("double") * scale).cast("float")).alias("vec")
    )
    both = rows.select("vec_id", as_double(F.col("vec")).alias("vec"), as_double(half_precision(F.col("vec"))).alias("half"))
    gaps = F.zip_with("vec", "half", lambda a, b: F.abs(a - b))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    largest = F.array_max(F.transform("half", F.abs))
    return both.select(
        "vec_id", F.round(total * 1000000, 6).alias("micro_error"), F.round(largest, 9).alias("largest"),
        F.size(F.filter(gaps, lambda x: x == 0.0)).cast("long").alias("exact"),
    )


@query(
    "learned_rows",
    """select event_id, variant_name from (select event_id, case when event_type in ('purchase', 'signup')
      then 'user_' || user_id || '__learned_' || event_id else 'user_' || user_id || '_base' end as variant_name from events)
    where contains(variant_name, '__learned_')""",
)
def learned_variants(spark: SparkSession, sf: str) -> DataFrame:
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    learned = F.concat(user, F.lit("__learned_"), F.col("event_id").cast("string"))
    variant = F.when(F.col("event_type").isin("purchase", "signup"), learned).otherwise(F.concat(user, F.lit("_base")))
    return learned_rows(table(spark, sf, "events").select("event_id", variant.alias("variant_name")))


@query(
    "active_version",
    """select version, model_id from (select event_id as version, 'model-' || user_id as model_id,
      case event_type when 'error' then 128 else 64 end as dim from events) where dim = 64 order by version desc limit 1""",
)
def active_version(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version whose width fits the model."""
    manifest = table(spark, sf, "events").select(
        F.col("event_id").alias("version"), F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("model_id"),
        F.when(F.col("event_type") == "error", 128).otherwise(64).alias("dim"),
    )
    return newest_valid(manifest, 64).select("version", "model_id")


def _published(spark: SparkSession, sf: str) -> BankStore:
    store = BankStore(spark, scratch_path(spark, "bank"))
    store.publish(embeddings(spark, sf), "model-1", DIM, dtype="fp32")
    return store


@query(
    "publish_bank",
    """select 'label_' || label as species, count(*) as rows, 64 as dim, 1::bigint as version, 'model-1' as model_id
    from embeddings group by 1""",
)
def publish(spark: SparkSession, sf: str) -> DataFrame:
    store = _published(spark, sf)
    version = store.active()
    rows = store.bank(version).groupBy("species").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dim"))
    return rows.select(
        "species", "rows", "dim", F.lit(version["version"]).cast("long").alias("version"),
        F.lit(version["model_id"]).alias("model_id"),
    )


@query(
    "publish_damaged",
    f"""with {E}, {DAMAGED}, fit as (select * from damaged where len(vec) = {DIM}),
    sound as (select * from fit where {FINITE} and list_dot_product(vec, vec) > 0)
    select species, count(*) as rows, 'dropped=' || ((select count(*) from fit) - (select count(*) from sound)) as source
    from sound group by 1""",
)
def publish_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Zero vectors and NaN are left out of a published base and counted."""
    store = BankStore(spark, scratch_path(spark, "bank"))
    version = store.publish(damaged(spark, sf).filter(has_dim(F.col("vec"), DIM)), "model-1", DIM, dtype="fp32")
    return store.labels(version).select("species", F.col("count").alias("rows"), F.lit(version["source"]).alias("source"))


@query(
    "publish_refused",
    """select 'label_' || label as species, count(*) as rows, 64 as dim, 1::bigint as version, 1::bigint as versions,
      count(*) filter (vec_id % 3 = 0) > 0 as refused from embeddings group by 1""",
)
def publish_refused(spark: SparkSession, sf: str) -> DataFrame:
    """A base in which some vectors have another width is refused: the version before stays active, and no other one is listed."""
    store = _published(spark, sf)
    narrow = F.when(F.col("row_id") % 3 == 0, F.slice("vec", 1, DIM - 1)).otherwise(F.col("vec"))
    wrong = embeddings(spark, sf).withColumn("vec", narrow)
    try:
        store.publish(wrong, "model-2", DIM, dtype="fp32")
        refused = F.lit(False)
    except DimensionMismatch:
        refused = F.count_if(F.col("row_id") % 3 == 0) > 0
    version = store.active()
    rows = store.bank(version).groupBy("species").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dim"), refused.alias("refused")
    )
    return rows.withColumns({"version": F.lit(version["version"]).cast("long"), "versions": F.lit(store.manifest().count()).cast("long")})


@query(
    "append_and_rewrite_learned",
    f"""with {E} select origin, species, count(*) as rows, (1 + (select count(*) from e) + 1)::bigint as version,
      2::bigint as generation
    from (select 'base' as origin, species from e union all select 'learned', species from e where species <> 'label_3')
    group by 1, 2""",
)
def append_and_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Append learned rows (one batch twice, as a retry would), then forget a label."""
    store = _published(spark, sf)
    learned = blended(spark, sf, 0.6, 0.4).withColumnRenamed("row_id", "seq")
    store.append_learned(learned, batch=0)
    store.append_learned(learned, batch=0)
    version, _ = store.forget("Label 3")
    counted = store.bank(version).groupBy("origin", "species").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumns({
        "version": F.lit(version["version"]).cast("long"), "generation": F.lit(version["generation"]).cast("long")
    })


@query(
    "split_store",
    """select split, label, count(*) as n, sum(dim)::bigint as volume from (select label, len(embedding) as dim,
      case when row_number() over (partition by label order by vec_id) <= 2 then 'val' else 'train' end as split
      from embeddings) group by all""",
)
def split_store(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    curated = hold_out(rows, "label", ["vec_id"])
    path = scratch_path(spark, "features")
    write_split_features(curated.select("split", "label", F.col("embedding").alias("feat")), path)
    both = [read_split_features(spark, path, s).select("split", "label", "feat") for s in ("train", "val")]
    return both[0].union(both[1]).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("feat")).alias("volume")
    )


@query(
    "learned_lines",
    f"""with {E} select species, verdict, count(*) as n from (select species, case when vec[1] > 0.15 then 'malformed'
      when vec[2] > 0.15 then 'wrong_dim' else 'ok' end as verdict from e) group by all""",
)
def learned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with broken base64 and wrong widths among them."""
    rows = embeddings(spark, sf)
    vec = F.when(F.get("vec", 1) > 0.15, F.slice("vec", 1, DIM - 1)).otherwise(F.col("vec"))
    text = F.when(F.get("vec", 0) > 0.15, F.lit("***")).otherwise(to_base64(vec))
    path = scratch_path(spark, "lines")
    rows.select("species", text.alias("vec"), F.col("row_id").alias("t")).write.json(path)
    return scan_learned_lines(spark, path, DIM).groupBy("species", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("learned_round_trip", f"with {E} select row_id as t, species, round(vec[7], 6) + 0.0::DOUBLE as x from e")
def learned_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "learned")
    write_learned(embeddings(spark, sf).withColumn("t", F.col("row_id")), path)
    rows = read_learned(spark, path, DIM)
    return rows.select("t", "species", (F.round(F.get(as_double(F.col("vec")), 6), 6) + F.lit(0.0)).alias("x"))


@query("npy_scan", f"with {E} select row_id, species, round(vec[7], 6) + 0.0::DOUBLE as x, len(vec)::int as dim from e")
def npy_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Write the bank as ``.npy`` shards, scan vectors and labels, join them by position."""
    out = scratch_path(spark, "npy")
    write_npy(embeddings(spark, sf), out, dtype="fp32", rows_per_shard=200)
    spark.dataSource.register(NpySource)
    vectors = spark.read.format("npy").option("rowsPerPartition", 150).load(f"{out}/base_features")
    labels = spark.read.format("npy").load(f"{out}/base_species")
    rows = join_positions(labels, vectors)
    x = F.round(F.get(as_double(F.col("vec")), 6), 6) + F.lit(0.0)
    return rows.select("row_id", "species", x.alias("x"), F.size("vec").alias("dim"))


@query(
    "load_exchange_folder",
    f"""with {E}, {blend_sql('near', 0.95, 0.05)}, bank as (
      select 'base' as origin, species, vec from e union all select 'learned', species, vec from near)
    select origin, species, count(*) as n, (select count(*) from e)::bigint as base_rows, 64 as dim,
           round(sum(vec[7]), 3) + 0.0::DOUBLE as total from bank group by 1, 2""",
)
def load_exchange_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Publish, learn, export to vector, label, metadata and learned files, and load them again."""
    store = _published(spark, sf)
    store.append_learned(blended(spark, sf, 0.95, 0.05).withColumnRenamed("row_id", "seq"), batch=0)
    folder = scratch_path(spark, "folder")
    export_folder(store, store.active(), folder)
    bank, dim = load_folder(spark, folder)
    meta = read_meta(spark, f"{folder}/base_meta.json").first()
    x = F.get(as_double(F.col("vec")), 6)
    sums = bank.groupBy("origin", "species").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.sum(x), 3) + F.lit(0.0)).alias("total")
    )
    return sums.withColumns({"base_rows": F.lit(meta["rows"]).cast("long"), "dim": F.lit(dim)})


@query(
    "label_table",
    f"with {UNION} select species, min(row_id) as row_id, count(*) as count from bank group by 1",
)
def labels_of_bank(spark: SparkSession, sf: str) -> DataFrame:
    """First row and example count per label, as the store keeps them."""
    store = _published(spark, sf)
    store.append_learned(blended(spark, sf, 0.95, 0.05).withColumnRenamed("row_id", "seq"), batch=0)
    return store.labels(store.active())
