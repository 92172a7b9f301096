"""Serving queries: admission, batches, counters, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.admission import content_hash, payload_admission, pixel_hash, url_admission
from vecbank.functions.vectors import l2_normalize
from vecbank.operators.learn import pair_batch
from vecbank.operators.ordered import chunked
from vecbank.operators.quality import throughput
from vecbank.operators.serving import counters, embed_distinct, latency_percentiles, ordered_results
from vecbank.queries import query
from vecbank.session import materialize, scratch_path, table
from vecbank.settings import REQUEST_ITEMS
from vecbank.streaming.jobs import file_stream, observed_counts, stream_output
from vecbank.streaming.latency import rolling_latency

LATENCY_SQL = """select kind, count(*) as n, round(quantile_cont(ms, 0.5), 2) as p50, round(quantile_cont(ms, 0.95), 2) as p95
    from (select event_type as kind, value as ms, row_number() over (partition by event_type order by event_id desc) as r
          from events) where r <= 500 group by 1"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.col("value").alias("ms")
    )


@query("latency_percentiles", LATENCY_SQL)
def latency(spark: SparkSession, sf: str) -> DataFrame:
    return latency_percentiles(_samples(spark, sf))


@query("rolling_latency_stream", LATENCY_SQL)
def latency_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch_path(spark, "samples")
    _samples(spark, sf).repartition(3).write.parquet(source)
    stream = file_stream(spark, source, "kind string, seq long, ms double", files_per_batch=2)
    return rolling_latency(stream, scratch_path(spark, "latency"), scratch_path(spark, "checkpoint"), salts=2)


@query(
    "throughput",
    """with flushes as (select row_number() over (order by event_id) as flush,
      (epoch_us(ts) - min(epoch_us(ts)) over ()) / 1000000.0::DOUBLE as seconds from events)
    select flush, flush as rows,
           round((flush - coalesce(lag(flush) over (order by flush), 0)) * 3600
                 / greatest(seconds - coalesce(lag(seconds) over (order by flush), 0), 1e-6), 6) as window_rate,
           round(flush * 3600 / greatest(seconds, 1e-6), 6) as lifetime_rate
    from flushes where flush % 25 = 0""",
)
def throughput_report(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").select(F.col("event_id").alias("seq"), micros.alias("at"))
    start = events.agg(F.min("at")).first()[0]
    flushes = events.select("seq", ((F.col("at") - start) / 1000000.0).alias("seconds"), F.lit(1).alias("items"))
    per_hour = [F.round(F.col(c) * 3600, 6).alias(c) for c in ("window_rate", "lifetime_rate")]
    return throughput(flushes).select("flush", "rows", *per_hour)


SUFFIXES = (".example.com",)
HOSTS = ("thther.example.org",)


def _url_forms(url: Column) -> Column:
    """The URL as it is, and altered so that every rule is met."""
    rest = F.regexp_replace(url, "^[a-z]+://", "")
    return F.array(
        url, F.upper(url), F.concat(F.lit("ftp://"), rest), F.concat(F.lit("https://user:secret@"), rest),
        F.concat(F.lit("https://example.com/"), rest), rest, F.lit("https:///nohost"),
    )


@query(
    "url_admission",
    """with rests as (select page_id, url, regexp_replace(url, '^[a-z]+://', '') as rest from pages),
    forms as (select page_id, unnest([0, 1, 2, 3, 4, 5, 6]) as form, unnest([url, upper(url), 'ftp://' || rest,
        'https://user:secret@' || rest, 'https://example.com/' || rest, rest, 'https:///nohost']) as url from rests),
    parts as (select *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme,
        regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as authority from forms),
    hosts as (select *, lower(regexp_replace(authority, '^.*@', '')) as host, contains(authority, '@') as named from parts)
    select page_id, form::bigint as form, case when scheme not in ('http', 'https') or host = '' or named then 'bad_url'
        when host = 'example.com' or ends_with(host, '.example.com') or host = 'thther.example.org' then 'ok'
        else 'host_not_allowed' end as verdict from hosts""",
)
def url_rules(spark: SparkSession, sf: str) -> DataFrame:
    forms = table(spark, sf, "pages").select("page_id", F.posexplode(_url_forms(F.col("url"))).alias("form", "url"))
    verdict = url_admission(F.col("url"), SUFFIXES, HOSTS)
    return forms.select("page_id", F.col("form").cast("long").alias("form"), verdict.alias("verdict"))


@query(
    "payload_admission",
    """select origin, id, case when strlen(body) = 0 then 'empty' when strlen(body) > 4000 then 'too_large' else 'ok' end as verdict
    from (select 'document' as origin, doc_id as id, text as body from documents
          union all select 'page', page_id, html from pages
          union all select 'event', event_id, case when event_type = 'error' then '' else props end from events)""",
)
def payload_rules(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = table(spark, sf, "pages").select(F.lit("page"), "page_id", "html")
    props = F.when(F.col("event_type") == "error", "").otherwise(F.col("props"))
    events = table(spark, sf, "events").select(F.lit("event"), "event_id", props)
    return texts.union(pages).union(events).select("origin", "id", payload_admission(F.col("body"), 4000).alias("verdict"))


@query("content_hash", "select doc_id, sha1(text) as digest from documents")
def hash_of_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("digest"))


@query("pixel_hash", "select doc_id, md5(n_chars || 'x' || length(source) || ':' || text) as digest from documents")
def hash_of_pixels(spark: SparkSession, sf: str) -> DataFrame:
    digest = pixel_hash(F.col("n_chars"), F.length("source"), F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", digest.alias("digest"))


LETTERS = ("a", "e", "i", "o", "u", " ")


def _letter_vector(rows: DataFrame) -> DataFrame:
    """Stand-in model: the unit vector of letter counts."""
    text = F.col("content")
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") + 1 for c in LETTERS]
    return rows.select("hash", l2_normalize(F.array(*counts)).alias("vec"))


_COUNTS = ", ".join(f"(length(text) - length(replace(text, '{c}', '')) + 1)::DOUBLE" for c in LETTERS)


@query(
    "dedup_embed_join",
    f"""with items as (select doc_id, sha1(text) as hash, [{_COUNTS}] as raw from documents)
    select doc_id, hash, count(*) over (partition by hash) as copies,
           (select count(distinct hash) from items) as embedded,
           round(raw[1] / sqrt(list_dot_product(raw, raw)), 6) as x from items""",
)
def dedup_embed_join(spark: SparkSession, sf: str) -> DataFrame:
    """One inference per distinct text; a second run takes all vectors from the cache."""
    items = table(spark, sf, "documents").select("doc_id", "text")
    _, cache = embed_distinct(items, "text", content_hash(F.col("text")), _letter_vector)
    cache = materialize(cache, "vectors")
    joined, cache = embed_distinct(items, "text", content_hash(F.col("text")), _letter_vector, cache)
    embedded = cache.count()
    copies = joined.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    return joined.join(copies, "hash").select(
        "doc_id", "hash", "copies", F.lit(embedded).cast("long").alias("embedded"), F.round(F.get("vec", 0), 6).alias("x")
    )


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf, "conversations")
    answers = turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.length("text").alias("chars"))
    return turns.select("conv_id", "turn"), answers


@query(
    "ordered_results",
    """select conv_id, turn, case when role = 'assistant' then length(text) end::int as chars, role = 'assistant' as ok
    from conversations""",
)
def results_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_results(*_answers(spark, sf), ["conv_id", "turn"])


@query(
    "counters",
    """select count(*) filter (role = 'assistant') as predictions, count(*) filter (role <> 'assistant') as unreadable
    from conversations""",
)
def prediction_counters(spark: SparkSession, sf: str) -> DataFrame:
    return counters(ordered_results(*_answers(spark, sf), ["conv_id", "turn"]))


@query(
    "counters_observed",
    """with c as (select count(*) filter (role = 'assistant') as predictions, count(*) filter (role <> 'assistant') as unreadable
      from conversations)
    select 'observed' as origin, * from c union all select 'stored', * from c""",
)
def counters_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counted by the running stream, three files a batch, and from what it stored."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("results", "served", "checkpoint"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("ok"))
    turns.repartition(7).write.parquet(source)
    seen = observed_counts(file_stream(spark, source, turns.schema, files_per_batch=3), out, checkpoint)
    observed = spark.createDataFrame([("observed", seen["predictions"], seen["unreadable"])], "origin string, predictions long, unreadable long")
    return observed.unionByName(counters(stream_output(spark, out)).withColumn("origin", F.lit("stored")))


@query(
    "batch_pairing",
    f"""select conv_id, (n - 1) // {REQUEST_ITEMS} as chunk, ((n - 1) % {REQUEST_ITEMS})::int as pos, role as name, md5(text) as item from (
      select *, row_number() over (partition by conv_id order by turn) as n from conversations)""",
)
def batch_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of at most 64 names and items, paired by position."""
    turns = chunked(table(spark, sf, "conversations"), ["turn"], REQUEST_ITEMS, ["conv_id"])
    rows = F.array_sort(F.collect_list(F.struct("slot", "role", "text")))
    batches = turns.groupBy("conv_id", "chunk").agg(rows.alias("rows")).select(
        "conv_id", "chunk", F.col("rows.role").alias("names"), F.col("rows.text").alias("items")
    )
    pairs = pair_batch(batches, "names", "items")
    return pairs.select("conv_id", "chunk", "pos", "name", F.md5("item").alias("item"))
