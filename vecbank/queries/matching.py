"""kNN, voting and prediction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecbank.functions.vectors import as_double, has_dim, l2_normalize, norm
from vecbank.operators.knn import compared_share, knn
from vecbank.operators.vote import confident_only, publish_prediction, vote
from vecbank.plans.identify import identify
from vecbank.queries import query
from vecbank.queries.inputs import (
    DAMAGED, DIM, E, MICROS_TEXT, SCALED, VOTE_SQL, as_queries, blend_sql, blended, damaged, embeddings, hits_sql,
    micros, micros_text, scaled,
)
from vecbank.session import materialize, scratch_path
from vecbank.streaming.jobs import file_stream, identify_stream, stream_output

NEAR = blend_sql("q", 0.8, 0.2)
MATCH = f"with {E}, {NEAR}, {hits_sql('q', 'e', 5)}, {VOTE_SQL}"
NEAR_EXACT = """final as (
      select w.query_id,
             case when t.top_species <> w.species and t.top_sim >= 0.95 then t.top_species else w.species end as species,
             case when t.top_species <> w.species and t.top_sim >= 0.95 then t.top_sim else w.best end as score,
             t.top_species <> w.species and t.top_sim >= 0.95 as overruled, w.votes
      from winners w join tops t using (query_id))"""
TOPK_SQL = f"""with {E}, {NEAR}, {hits_sql('q', 'e', 5)}
    select query_id, rank::bigint as rank, row_id, species, round(sim, 6) as score from hits"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return as_queries(blended(spark, sf, 0.8, 0.2))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "row_id", "species", F.round("sim", 6).alias("score")
    )


@query("knn_topk", TOPK_SQL)
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(knn(_near(spark, sf), embeddings(spark, sf)))


@query("knn_topk_blocked", TOPK_SQL)
def knn_topk_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The path for query sets too large to travel: cells and bounded blocks."""
    return _ranked(knn(_near(spark, sf), embeddings(spark, sf), broadcast_rows=0, block_rows=128))


@query(
    "knn_clustered",
    f"""with {E}, c as (
      select row_id, species, list_transform(vec, lambda x, i: x * 0.05 + (i = right(species, 1)::int + 1)::int) as vec from e),
    q as (select * from c where row_id % 5 = 0), {hits_sql('q', 'c', 5)}
    select query_id, rank::bigint as rank, row_id, species, round(sim, 6) as score, true as pruned from hits""",
)
def knn_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Pivots in two levels on vectors around a centre per label: exact, with less than half of the pairs compared."""
    place = F.substring("species", -1, 1).cast("int")
    near = F.transform(as_double(F.col("vec")), lambda x, i: x * 0.05 + F.when(i == place, 1).otherwise(0))
    bank = materialize(embeddings(spark, sf).withColumn("vec", near), "clustered")
    asked = bank.filter("row_id % 5 = 0").select(F.col("row_id").alias("query_id"), "vec")
    share = compared_share(asked, bank, 5, block_rows=8, pivots=8)
    hits = knn(asked, bank, 5, broadcast_rows=0, block_rows=8, pivots=8)
    return _ranked(hits).withColumn("pruned", F.lit(share < 0.5))


SOUND = f"len(vec) = {DIM} and not list_contains(list_transform(vec, lambda x: isfinite(x)), false)"


@query(
    "knn_damaged_bank",
    f"""with {E}, {NEAR}, {DAMAGED}, sound as (select * from damaged where {SOUND}), {hits_sql('q', 'sound', 5)}
    select path, query_id, rank::bigint as rank, row_id, round(sim, 6) as score
    from hits, (values ('scan'), ('blocks')) paths(path)""",
)
def knn_damaged_bank(spark: SparkSession, sf: str) -> DataFrame:
    """A bank with zeros and NaN, which must not take hits from sound rows on either path."""
    bank = damaged(spark, sf).filter(has_dim(F.col("vec"), DIM))
    paths = [
        knn(_near(spark, sf), bank, **sizes).withColumn("path", F.lit(path))
        for path, sizes in (("scan", {}), ("blocks", {"broadcast_rows": 0, "block_rows": 128}))
    ]
    return paths[0].unionByName(paths[1]).select(
        "path", "query_id", F.col("rank").cast("long").alias("rank"), "row_id", F.round("sim", 6).alias("score")
    )


@query(
    "knn_vote",
    f"""{MATCH} select query_id, species, round(best, 6) as score, votes, best >= 0.5 as confident from winners""",
)
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The command-line rule: votes only, no override."""
    voted = vote(knn(_near(spark, sf), embeddings(spark, sf)), near_exact=None)
    published = publish_prediction(voted).select("query_id", "species", "score", "confident")
    return published.join(voted.select("query_id", "votes"), "query_id")


@query(
    "knn_vote_near_exact",
    f"""{MATCH}, {NEAR_EXACT}
    select query_id, species, round(score, 6) as score, overruled, score >= 0.5 as confident from final""",
)
def knn_vote_near_exact(spark: SparkSession, sf: str) -> DataFrame:
    voted = vote(knn(_near(spark, sf), embeddings(spark, sf)))
    return voted.select(
        "query_id", "species", F.round("score", 6).alias("score"), "overruled", (F.col("score") >= 0.5).alias("confident")
    )


@query(
    "neighbors_nested",
    f"""{MATCH}, {NEAR_EXACT}
    select f.query_id, f.species, string_agg(h.species, ',' order by h.rank) as neighbor_species,
           string_agg(cast(round(h.sim * 1000000) as bigint)::varchar, ',' order by h.rank) as neighbor_micros
    from final f join hits h using (query_id) group by 1, 2""",
)
def neighbors_nested(spark: SparkSession, sf: str) -> DataFrame:
    voted = vote(knn(_near(spark, sf), embeddings(spark, sf)))
    return voted.select(
        "query_id", "species",
        F.array_join(F.transform("neighbors", lambda n: n["species"]), ",").alias("neighbor_species"),
        F.array_join(F.transform("neighbors", lambda n: micros(n["score"]).cast("string")), ",").alias("neighbor_micros"),
    )


@query(
    "confident_only",
    f"""with {E}, {blend_sql('q', 0.6, 0.4)}, {hits_sql('q', 'e', 5)}, {VOTE_SQL}, {NEAR_EXACT}
    select query_id, species, round(score, 6) as score from final where score >= 0.8""",
)
def confident(spark: SparkSession, sf: str) -> DataFrame:
    voted = vote(knn(as_queries(blended(spark, sf, 0.6, 0.4)), embeddings(spark, sf)))
    return confident_only(voted, 0.8).select("query_id", "species", F.round("score", 6).alias("score"))


@query(
    "prediction_rows",
    f"""{MATCH}, {NEAR_EXACT}
    select f.query_id, f.species, round(f.score, 6) as score, f.score >= 0.75 as confident, 0.75::DOUBLE as threshold,
           7::BIGINT as bank_version, (select count(*) from hits h where h.query_id = f.query_id) as n_neighbors,
           {MICROS_TEXT.format(vec='q.vec')} as embedding
    from final f join q on q.row_id = f.query_id""",
)
def prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    queries = materialize(_near(spark, sf), "queries")
    voted = vote(knn(queries, embeddings(spark, sf))).withColumn("bank_version", F.lit(7).cast("long"))
    published = publish_prediction(voted.join(queries.select("query_id", "vec"), "query_id"), 0.75, True)
    return published.select(
        "query_id", "species", "score", "confident", "threshold", "bank_version",
        F.size("neighbors").cast("long").alias("n_neighbors"), micros_text(F.col("embedding")).alias("embedding"),
    )


IDENTIFY_SQL = f"""with {E}, {DAMAGED},
    q as (select * from damaged where len(vec) = 64 and not list_contains(list_transform(vec, lambda x: isnan(x)), true)
          and list_dot_product(vec, vec) > 0),
    {hits_sql('q', 'e', 5)}, {VOTE_SQL}, {NEAR_EXACT}
    select d.row_id as query_id, f.species, round(f.score, 6) as score, f.query_id is not null as ok
    from damaged d left join final f on f.query_id = d.row_id"""


def _damaged_queries(spark: SparkSession, sf: str) -> DataFrame:
    return damaged(spark, sf).select(F.col("row_id").alias("query_id"), "vec")


@query("identify_batch", IDENTIFY_SQL)
def identify_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Unreadable inputs keep their place with a null result."""
    return identify(_damaged_queries(spark, sf), embeddings(spark, sf), dim=DIM).select("query_id", "species", "score", "ok")


@query("identify_stream", IDENTIFY_SQL)
def identify_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch_path(spark, "queries")
    _damaged_queries(spark, sf).repartition(4).write.parquet(source)
    stream = file_stream(spark, source, "query_id long, vec array<double>", files_per_batch=2)
    out = scratch_path(spark, "identified")
    identify_stream(stream, embeddings(spark, sf), out, scratch_path(spark, "checkpoint"), dim=DIM)
    return stream_output(spark, out).select("query_id", "species", "score", "ok")


@query(
    "l2_normalize",
    f"""with {SCALED} select vec_id, pos::bigint as pos, round(x, 6) + 0.0::DOUBLE as x from (
      select vec_id, unnest(range(0, len(vec))) as pos,
             unnest(list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))) as x from scaled)""",
)
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    unit = scaled(spark, sf).select("vec_id", F.posexplode(l2_normalize(F.col("vec"))).alias("pos", "x"))
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("vector_norm", f"with {SCALED} select vec_id, round(sqrt(list_dot_product(vec, vec)), 6) as norm from scaled")
def vector_norm(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf).select("vec_id", F.round(norm(as_double(F.col("vec"))), 6).alias("norm"))
