"""Teach, forget and change-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.admission import exactly_one
from vecbank.functions.names import variant_name
from vecbank.functions.vectors import as_double, has_dim
from vecbank.operators.changes import (
    forget_label, latest_learned, removal_summary, surviving, upsert_counts, versions, without,
)
from vecbank.operators.learn import learn, max_similarity
from vecbank.operators.ordered import numbered
from vecbank.queries import query
from vecbank.queries.inputs import DAMAGED, DIM, E, LOG, blend_sql, blended, change_log, damaged, embeddings
from vecbank.session import scratch_path, table
from vecbank.sources.store import BankStore
from vecbank.streaming import keyed
from vecbank.streaming.jobs import file_stream, stream_output, teach_stream

STEP = 10**9  # room for one pass over the embeddings in the sequence numbers


@query(
    "near_dup_pairs",
    f"""with {E}, {blend_sql('dup', 0.95, 0.05)}, {blend_sql('far', 0.6, 0.4)},
    items as (select row_id * 2 as item_id, species, vec from dup union all select row_id * 2 + 1, species, vec from far)
    select item_id, round(max(list_dot_product(i.vec, e.vec)), 6) as max_sim,
           max(list_dot_product(i.vec, e.vec)) >= 0.995 as duplicate
    from items i join e on e.species = i.species group by 1""",
)
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    dup = blended(spark, sf, 0.95, 0.05).select((F.col("row_id") * 2).alias("item_id"), "species", "vec")
    far = blended(spark, sf, 0.6, 0.4).select((F.col("row_id") * 2 + 1).alias("item_id"), "species", "vec")
    best = max_similarity(dup.union(far), embeddings(spark, sf))
    return best.select("item_id", F.round("max_sim", 6).alias("max_sim"), (F.col("max_sim") >= 0.995).alias("duplicate"))


@query(
    "learn_damaged_bank",
    f"""with {E}, {DAMAGED}, {blend_sql('dup', 0.95, 0.05)},
    sound as (select * from damaged where len(vec) = {DIM} and not list_contains(list_transform(vec, lambda x: isfinite(x)), false))
    select d.row_id as seq, case when max(case when s.species = d.species then list_dot_product(d.vec, s.vec) end) >= 0.995
                          then 'duplicate' else 'new' end as status
    from dup d cross join sound s group by 1""",
)
def learn_damaged_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with NaN in the bank block nothing from being learned."""
    items = blended(spark, sf, 0.95, 0.05).select(F.col("row_id").alias("item_id"), "species", "vec")
    bank = damaged(spark, sf).filter(has_dim(F.col("vec"), DIM))
    found = items.select("item_id").join(max_similarity(items, bank), "item_id", "left")
    status = F.when(F.col("max_sim") >= 0.995, "duplicate").otherwise("new")
    return found.select(F.col("item_id").alias("seq"), status.alias("status"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Six passes over the embeddings: near duplicates, new examples, the same again, unknown names, new names, zeros."""
    raw = embeddings(spark, sf).withColumn("vec", as_double(F.col("vec")))
    dup, far = blended(spark, sf, 0.95, 0.05), blended(spark, sf, 0.6, 0.4)
    spoken = F.initcap(F.translate("species", "_", " "))
    passes = [
        (dup, F.col("species"), F.lit(False)),
        (far, spoken, F.lit(False)),
        (far, F.concat(F.lit(" "), F.upper("species")), F.lit(True)),
        (raw, F.concat(F.lit("New "), spoken), F.lit(False)),
        (raw, F.concat(F.lit("New "), spoken), F.lit(True)),
        (raw.withColumn("vec", F.transform("vec", lambda x: F.lit(0.0))), F.col("species"), F.lit(True)),
    ]
    out = None
    for i, (rows, name, allow) in enumerate(passes):
        part = rows.select((F.col("row_id") + i * STEP).alias("seq"), name.alias("name"), "vec", allow.alias("allow_new"))
        out = part if out is None else out.unionByName(part)
    return out


LEARN_SQL = f"""with {E}, {blend_sql('dup', 0.95, 0.05)}, {blend_sql('far', 0.6, 0.4)},
    asked as (
      select row_id as seq, species, vec, 'open' as status from dup
      union all select row_id + {STEP}, species, vec, 'open' from far
      union all select row_id + {2 * STEP}, species, vec, 'open' from far
      union all select row_id + {3 * STEP}, null, vec, 'unknown' from e
      union all select row_id + {4 * STEP}, 'new_' || species, vec, 'open' from e
      union all select row_id + {5 * STEP}, null, vec, 'bad_image' from e),
    known as (select -1 as seq, species, vec from e union all select seq, species, vec from asked where status = 'open'),
    near as (select a.seq from asked a join known k on k.species = a.species and k.seq < a.seq
             where a.status = 'open' and list_dot_product(a.vec, k.vec) >= 0.995 group by 1),
    judged as (select seq, species, case when status <> 'open' then status
                      when seq in (select seq from near) then 'duplicate' else 'learned' end as status from asked),
    nth as (select seq, row_number() over (partition by species order by seq) as n from judged where status = 'learned'),
    held as (select species, count(*) as n from e group by 1)
    select j.seq, j.status, j.species, case when j.status = 'learned' then nth.n + coalesce(held.n, 0) end as examples
    from judged j left join nth using (seq) left join held on held.species = j.species"""


@query("learn_sequential", LEARN_SQL)
def learn_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """No item here is close to a rejected one only, so one SQL pass gives the sequential outcome too."""
    results, _ = learn(embeddings(spark, sf), _requests(spark, sf), DIM)
    return results.select("seq", "status", "species", "examples")


@query("learn_stream", LEARN_SQL)
def learn_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests as a stream into a bank store; batches follow the passes."""
    store = BankStore(spark, scratch_path(spark, "bank"))
    store.publish(embeddings(spark, sf), "model-1", DIM, dtype="fp32", normalize=False)
    source = scratch_path(spark, "requests")
    _requests(spark, sf).repartitionByRange(4, "seq").write.parquet(source)
    stream = file_stream(spark, source, "seq long, name string, vec array<double>, allow_new boolean")
    out = scratch_path(spark, "taught")
    teach_stream(store, stream, out, scratch_path(spark, "checkpoint"))
    return stream_output(spark, out).select("seq", "status", "species", "examples")


@query("learn_stream_stateful", LEARN_SQL)
def learn_in_keyed_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests in two runs of a stream whose state holds the bank; the second one starts from the checkpoint alone."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("requests", "taught", "checkpoint"))
    requests = _requests(spark, sf)
    for run in range(2):
        half = requests.filter((F.col("seq") >= 3 * STEP) == F.lit(run == 1))
        half.repartitionByRange(2, "seq").write.mode("append").parquet(source)
        stream = file_stream(spark, source, "seq long, name string, vec array<double>, allow_new boolean")
        bank = embeddings(spark, sf)
        # Only the first batch reads the bank.
        keyed.learn_stream(stream, bank if run == 0 else bank.limit(0), out, checkpoint, DIM)
    return stream_output(spark, out).select("seq", "status", "species", "examples")


@query(
    "forget_by_log",
    f"""with {LOG} select seq, species from log l where op = 'learn' and not exists (
      select 1 from log f where f.op = 'forget' and f.species = l.species and f.seq > l.seq)""",
)
def forget_by_log(spark: SparkSession, sf: str) -> DataFrame:
    return surviving(change_log(spark, sf)).select("seq", "species")


def _learned(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).withColumnRenamed("row_id", "seq")


@query("forget_label", f"with {E} select row_id as seq, species from e where species <> 'label_3'")
def forget_one_label(spark: SparkSession, sf: str) -> DataFrame:
    learned = _learned(spark, sf)
    return without(learned, forget_label(learned, "Label 3")).select("seq", "species")


@query("forget_exact_label", f"with {E} select row_id as seq, species from e where species <> 'label_4'")
def forget_exact_label(spark: SparkSession, sf: str) -> DataFrame:
    """The exact rule does not see 'Label 4' as label_4."""
    learned = _learned(spark, sf)
    left = without(learned, forget_label(learned, "label_4", exact=True))
    return without(left, forget_label(left, "Label 5", exact=True)).select("seq", "species")


@query("undo_last", f"with {E} select row_id as seq, species from e where row_id < (select max(row_id) from e)")
def undo_last(spark: SparkSession, sf: str) -> DataFrame:
    learned = _learned(spark, sf)
    return without(learned, latest_learned(learned)).select("seq", "species")


@query(
    "removal_summary",
    f"""with {LOG} select count(*) as removed, string_agg(distinct species, ',' order by species) as species
    from log l where op = 'learn' and exists (
      select 1 from log f where f.op = 'forget' and f.species = l.species and f.seq > l.seq)""",
)
def removed_by_log(spark: SparkSession, sf: str) -> DataFrame:
    log = change_log(spark, sf)
    removed = log.filter(F.col("op") == "learn").join(surviving(log).select("seq"), "seq", "left_anti")
    return removal_summary(removed).select("removed", F.array_join("species", ",").alias("species"))


@query(
    "label_counts_upsert",
    """select 'user_' || user_id as species, greatest(sum(case event_type when 'view' then 1 when 'purchase' then 1
      when 'signup' then 1 else -1 end), 0)::bigint as count from events group by 1""",
)
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("species", F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    counts = events.filter(F.col("event_type") == "view").groupBy("species").agg(F.count(F.lit(1)).alias("count"))
    changes = events.filter(F.col("event_type") != "view").select(
        "species", F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1).alias("delta")
    )
    return upsert_counts(counts, changes)


@query(
    "bank_versions",
    f"""with {LOG}, marked as (select *, case when op = 'forget' then lag(op) over (partition by species order by seq) = 'learn'
      else false end as removed from log)
    select seq, op, sum(case when op <> 'forget' or removed then 1 else 0 end) over (order by seq)::bigint as version,
           sum(case when op = 'reload' or removed then 1 else 0 end) over (order by seq)::bigint as generation from marked""",
)
def bank_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions(change_log(spark, sf)).select("seq", "op", "version", "generation")


@query(
    "example_counts",
    f"""with {LOG} select seq, species, row_number() over (partition by species order by seq) as examples
    from log where op = 'learn'""",
)
def example_counts(spark: SparkSession, sf: str) -> DataFrame:
    learned = change_log(spark, sf).filter(F.col("op") == "learn")
    return numbered(learned, ["seq"], ["species"], "examples").select("seq", "species", "examples")


@query(
    "variant_names",
    """select event_id, 'user_' || user_id || '__learned_' || (1700000000000 + event_id * 1000) || '_'
      || substr(sha1(event_id::varchar), 1, 8) as variant_name from events""",
)
def variant_names(spark: SparkSession, sf: str) -> DataFrame:
    species = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    millis = F.lit(1700000000000) + F.col("event_id") * 1000
    return table(spark, sf, "events").select(
        "event_id", variant_name(species, millis, F.col("event_id")).alias("variant_name")
    )


@query(
    "exactly_one_input",
    """select d.doc_id, (l.quality is null) <> (nullif(d.lang, 'en') is null) as accepted
    from documents d left join labels l using (doc_id)""",
)
def exactly_one_input(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    second = F.when(F.col("lang") != "en", F.col("lang"))
    return rows.select("doc_id", exactly_one(F.col("quality"), second).alias("accepted"))
