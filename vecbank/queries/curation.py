"""Curation, sampling and archive queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.admission import file_extension, has_extension, is_large_enough
from vecbank.operators.blocks import group_bounds, map_sorted_groups
from vecbank.operators.ordered import chunked, stride_sample
from vecbank.operators.quotas import (
    arrival_rank, by_source, collect_until_full, collection_progress, coverage, curate, missing_labels, shuffled,
)
from vecbank.queries import query
from vecbank.session import scratch_path, table
from vecbank.sources.archives import expand_archives
from vecbank.sources.files import move_files
from vecbank.sources.shards import run_until_read, shard_stream
from vecbank.streaming.jobs import file_stream, finish_curation, is_finished, stream_output
from vecbank.streaming.keyed import curate_stream

CURATED_SQL = """select species, arrival, place::bigint as place, case when place <= 2 then 'val' else 'train' end as split
    from (select source as species, doc_id as arrival, row_number() over (partition by source order by doc_id) as place
          from documents) where place <= 10"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("species"), F.col("doc_id").alias("arrival"))


def _placed(curated: DataFrame) -> DataFrame:
    return curated.select("species", "arrival", F.col("place").cast("long").alias("place"), "split")


@query("train_val_split", CURATED_SQL)
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(curate(_records(spark, sf), "species", ["arrival"]))


@query("curate_stream", CURATED_SQL)
def curate_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch_path(spark, "records")
    _records(spark, sf).repartitionByRange(4, "arrival").write.parquet(source)
    stream = file_stream(spark, source, "species string, arrival long")
    out = scratch_path(spark, "curated")
    curate_stream(stream, out, scratch_path(spark, "checkpoint"))
    return _placed(stream_output(spark, out))


#: Every third document has no label; every fifth arrives late, with the last wave.
WAVES = """select case when doc_id % 3 <> 0 then source end as species, doc_id as arrival,
      case when doc_id % 5 = 4 then 2 else doc_id % 2 end as wave from documents"""
WAVES_SQL = f"""select species, arrival, place::bigint as place, case when place <= 2 then 'val' else 'train' end as split
    from (select *, row_number() over (partition by species order by wave, arrival) as place from ({WAVES})) where place <= 10"""


def _waves(spark: SparkSession, sf: str) -> list[DataFrame]:
    arrival = F.col("arrival")
    species = F.when(arrival % 3 != 0, F.col("species")).alias("species")
    wave = F.when(arrival % 5 == 4, 2).otherwise(arrival % 2)
    rows = _records(spark, sf)
    return [rows.filter(wave == n).select(species, "arrival") for n in range(3)]


@query("curate_stream_waves", WAVES_SQL)
def curate_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Three micro-batches, each of a run of its own, with missing labels and late records."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("records", "curated", "checkpoint"))
    for wave in _waves(spark, sf):
        wave.repartition(4).write.mode("append").parquet(source)
        curate_stream(file_stream(spark, source, wave.schema), out, checkpoint)
    return _placed(stream_output(spark, out))


class Interrupted(Exception):
    pass


def _stop_at(batch: int) -> Callable[[int], None]:
    def check(stored: int) -> None:
        if stored == batch:
            raise Interrupted(f"batch {batch}")

    return check


@query("curate_resumed", f"select *, 1::bigint as interruptions from ({WAVES_SQL})")
def curate_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The same, cut off after the second batch was stored but before the stream took note of it, then started again."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("records", "curated", "checkpoint"))
    cut = 0
    for n, wave in enumerate(_waves(spark, sf)):
        wave.repartition(4).write.mode("append").parquet(source)
        if n == 1:
            try:
                curate_stream(file_stream(spark, source, wave.schema), out, checkpoint, on_batch=_stop_at(1))
            except StreamingQueryException:
                cut += 1
        curate_stream(file_stream(spark, source, wave.schema), out, checkpoint)
    return _placed(stream_output(spark, out)).withColumn("interruptions", F.lit(cut).cast("long"))


FILES = 16


@query(
    "early_finish",
    """select species, arrival, place::bigint as place, true as files_left from (
      select source as species, doc_id as arrival, row_number() over (partition by source order by doc_id) as place from documents)
    where place <= 2""",
)
def early_finish(spark: SparkSession, sf: str) -> DataFrame:
    """The scan ends with files left once every label has its two rows; they are those of the whole scan."""
    source = scratch_path(spark, "records")
    records = _records(spark, sf)
    records.repartitionByRange(FILES, "arrival").sortWithinPartitions("arrival").write.parquet(source)
    files = sorted(spark.read.parquet(source).inputFiles())
    kept, n = collect_until_full(spark, files, "species string, arrival long", records.select("species"), 2)
    return kept.withColumn("files_left", F.lit(n < len(files)))


@query("sharded_stream", "select doc_id, source, md5(text) as digest, 3::bigint as batches from documents")
def sharded_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve files in four reader shards, one file of each shard in a batch; the stream is stopped and started again in between."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("documents", "read", "checkpoint"))
    batches = 0
    for part in range(3):
        half = rows.filter(F.pmod("doc_id", F.lit(3)) == part).repartition(4)
        # Names that sort behind those of the files before.
        half.write.parquet(f"{source}-{part}")
        move_files(f"{source}-{part}", source, prefix=f"{part}-")
        stream = shard_stream(spark, source, rows.schema, f"{checkpoint}-progress.json")
        batches += run_until_read(stream, out, checkpoint)
    return stream_output(spark, out).select("doc_id", "source", F.md5("text").alias("digest"), F.lit(batches).cast("long").alias("batches"))


@query(
    "quota_per_label",
    """select o_custkey, o_orderkey, place::bigint as place from (
      select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders)
    where place <= 10""",
)
def quota_per_label(spark: SparkSession, sf: str) -> DataFrame:
    kept = arrival_rank(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 10)
    return kept.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    "quota_hot_label",
    """select l_returnflag, l_orderkey, l_linenumber, place::bigint as place from (
      select *, row_number() over (partition by l_returnflag
             order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from lineitem)
    where place <= 50""",
)
def quota_hot_label(spark: SparkSession, sf: str) -> DataFrame:
    """Three labels hold all rows: the quota is applied per task before the shuffle."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    kept = arrival_rank(table(spark, sf, "lineitem"), "l_returnflag", order, 50)
    return kept.select("l_returnflag", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query(
    "source_priority",
    """with sources as (select 0 as source_rank, s_nationkey as nation, s_suppkey as id from supplier
      union all select 1, c_nationkey, c_custkey from customer)
    select nation, source_rank, id, place::bigint as place from (
      select *, row_number() over (partition by nation order by source_rank, id) as place from sources) where place <= 10""",
)
def source_priority(spark: SparkSession, sf: str) -> DataFrame:
    local = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    remote = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    kept = arrival_rank(by_source([local, remote]), "nation", ["source_rank", "id"], 10)
    return kept.select("nation", "source_rank", "id", F.col("place").cast("long").alias("place"))


@query(
    "quota_beyond_group_limit",
    """select l_linestatus, l_orderkey, l_linenumber, l_partkey, place from (
      select *, row_number() over (partition by l_linestatus
             order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from lineitem)
    where place <= 2500""",
)
def quota_beyond_group_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A quota larger than Spark's group limit on labels that hold half of all rows each."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select("l_linestatus", *order)
    kept = arrival_rank(rows, "l_linestatus", order, 2500)
    return kept.select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "place")


NULL_LABELS = "select case when l_linestatus = 'F' then l_linestatus end as label, l_orderkey, l_linenumber, l_partkey from lineitem"


@query(
    "quota_null_label",
    f"""select quota, label, l_orderkey, l_linenumber, l_partkey, place from (
      select *, row_number() over (partition by label order by l_orderkey, l_linenumber, l_partkey) as place
      from ({NULL_LABELS})), (values (1000), (1001)) quotas(quota) where place <= quota""",
)
def quota_null_label(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label are a label of their own, below and above Spark's group limit."""
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("label"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    kept = [arrival_rank(rows, "label", order, n).withColumn("quota", F.lit(n)) for n in (1000, 1001)]
    return kept[0].unionByName(kept[1].select(kept[0].columns)).select("quota", "label", *order, F.col("place").cast("long").alias("place"))


LABELLED = """universe as (select distinct source || '/' || lang as species from documents),
    curated as (select species, case when place <= 2 then 'val' else 'train' end as split from (
      select source || '/' || lang as species, row_number() over (partition by source, lang order by doc_id) as place
      from documents join labels using (doc_id)) where place <= 10)"""


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat_ws("/", "source", "lang").alias("species")
    universe = table(spark, sf, "documents").select(name).distinct()
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(name, "doc_id")
    return universe, curate(rows, "species", ["doc_id"])


@query(
    "coverage",
    f"""with {LABELLED} select species, count(split) as train_rows, count(split) = 0 as missing from universe
    left join (select * from curated where split = 'train') using (species) group by 1""",
)
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(*_labelled(spark, sf))


@query("missing_labels", f"with {LABELLED} select species from universe where species not in (select species from curated where split = 'train')")
def labels_without_rows(spark: SparkSession, sf: str) -> DataFrame:
    return missing_labels(*_labelled(spark, sf))


@query(
    "collection_target",
    f"""with {LABELLED} select (select count(*) from curated) as collected, count(*) * 10 as target_total, count(*) as labels,
      (select count(*) from curated) >= count(*) * 10 as complete from universe""",
)
def collection_target(spark: SparkSession, sf: str) -> DataFrame:
    universe, curated = _labelled(spark, sf)
    return collection_progress(curated, universe)


@query(
    "stride_sample",
    """select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as n, count(*) over () as total
      from orders) where (n - 1) % greatest(1, total // 24) = 0 and n <= 24 * greatest(1, total // 24)""",
)
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stride_sample(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 24)


@query(
    "chunks",
    """select doc_id, (row_number() over (order by doc_id) - 1) // 8 as chunk, (row_number() over (order by doc_id) - 1) % 8 as slot
    from documents""",
)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in chunks of eight, as inference takes them."""
    return chunked(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 8)


@query(
    "chunks_per_batch",
    """select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 4 as chunk,
      (row_number() over (partition by conv_id order by turn) - 1) % 4 as slot from conversations""",
)
def chunks_per_batch(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(table(spark, sf, "conversations").select("conv_id", "turn"), ["turn"], 4, ["conv_id"])


@query(
    "mini_batches",
    """select vec_id, (row_number() over (order by vec_id) - 1) // 64 as chunk,
      (row_number() over (order by vec_id) - 1) % 64 as slot from embeddings""",
)
def mini_batches(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"], 64)


@query("mini_batches_shuffled")
def shuffled_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = shuffled(table(spark, sf, "embeddings").select("vec_id"), "vec_id", seed=3)
    return chunked(rows, ["shuffle_key", "vec_id"], 64).drop("shuffle_key")


EXTENSION = "lower(regexp_extract(regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$'), '^.+(\\.[^.]+)$', 1))"


@query(
    "ext_filter",
    f"select page_id, {EXTENSION} as extension, {EXTENSION} in ('.html', '.htm') as accepted from pages",
)
def extension_filter(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return table(spark, sf, "pages").select(
        "page_id", file_extension(path).alias("extension"), has_extension(path, (".html", ".htm")).alias("accepted")
    )


@query(
    "min_image_size",
    """select p_partkey, case when p_type = 'ECONOMY' then least(p_size, length(p_name)) > 10
      else least(p_size, length(p_name)) >= 10 end as accepted from part""",
)
def min_image_size(spark: SparkSession, sf: str) -> DataFrame:
    size = is_large_enough(F.col("p_size"), F.length("p_name"), F.col("p_type") == "ECONOMY")
    return table(spark, sf, "part").select("p_partkey", size.alias("accepted"))


ZIP_ROWS = 64


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content``: zips of 64 documents each, every text a member ``<source>/<slot>.png``."""
    rows = chunked(table(spark, sf, "documents").select("doc_id", "source", "text"), ["doc_id"], ZIP_ROWS)

    def run(members: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = group_bounds(members, ["chunk"])
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = members.slice(int(a), int(b - a)).to_pylist()
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                for row in part:
                    archive.writestr(f"data/{row['source']}/{row['slot']}.PNG", row["text"].encode())
                archive.writestr("readme.txt", "no image")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part[0]['chunk']:09d}.zip"]), pa.array([out.getvalue()], pa.binary())], ["path", "content"]
            )

    return map_sorted_groups(rows, ["chunk"], ["slot"], run, "path string, content binary")


@query(
    "zip_expand",
    f"""with rows as (select source, text, (row_number() over (order by doc_id) - 1) // {ZIP_ROWS} as chunk,
      (row_number() over (order by doc_id) - 1) % {ZIP_ROWS} as slot from documents),
    named as (select *, row_number() over (partition by source, slot order by chunk) as n from rows)
    select source as label, case when n = 1 then slot || '.PNG' else slot || '_' || (n - 1) || '.PNG' end as file_name,
           md5(text) as digest from named""",
)
def zip_expand(spark: SparkSession, sf: str) -> DataFrame:
    members = expand_archives(spark, _archives(spark, sf))
    return members.select("label", "file_name", F.md5("content").alias("digest"))


@query(
    "curation_marker",
    """select sum(least(n, 10))::bigint as collected, count(*) * 10 as target_total, count(*) as labels,
      sum(least(n, 10)) >= count(*) * 10 as complete, true as finished
    from (select source, count(*) as n from documents group by 1)""",
)
def curation_marker(spark: SparkSession, sf: str) -> DataFrame:
    """A finished streaming curation leaves a marker."""
    source, out = scratch_path(spark, "records"), scratch_path(spark, "curated")
    records = _records(spark, sf)
    records.repartitionByRange(4, "arrival").write.parquet(source)
    curate_stream(file_stream(spark, source, records.schema), out, scratch_path(spark, "checkpoint"))
    marker = finish_curation(spark, out, records.select("species").distinct())
    return marker.drop("completed_at").withColumn("finished", F.lit(is_finished(spark, out)))
