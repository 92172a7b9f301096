"""Teach and forget against a bank store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vecbank.functions.names import name_key
from vecbank.operators.changes import removal_summary
from vecbank.operators.learn import learn
from vecbank.operators.naming import name_index
from vecbank.session import materialize
from vecbank.sources.store import BankStore


class UnknownSpecies(LookupError):
    pass


def teach(
    store: BankStore,
    requests: DataFrame,
    batch: int | None = None,
    source: str = "",
    out: str | None = None,
    **options,
) -> DataFrame:
    """Apply a batch of requests and append what was learned.

    Returns ``seq, status, species, examples, suggestions, bank_version``. Sequence numbers have to
    grow from batch to batch. With ``out`` the results are stored there before the bank changes.
    """
    version = store.active()
    results, learned = learn(
        store.packed_bank(version), requests, dim=version["dim"], labels=store.labels(version), **options
    )
    # Stored before the bank changes: the lazy plan must not see its own additions.
    if out:
        results.write.mode("overwrite").parquet(out)
        results = store.spark.read.schema(results.schema).parquet(out)
    else:
        results = materialize(results, "results")
    after = store.append_learned(learned, batch, source)
    return results.withColumn("bank_version", F.lit(after["version"]).cast("long"))


def forget(store: BankStore, species: str | None = None, last: bool = False) -> tuple[Row, DataFrame]:
    """Forget by name (resolved against the bank) or undo; returns (version, removal summary)."""
    target = None
    if species:
        found = name_index(store.labels(store.active())).filter(F.col("key") == name_key(F.lit(species))).first()
        if found is None:
            raise UnknownSpecies(species)
        target = found["species"]
    version, removed = store.forget(target, last and not species)
    return version, removal_summary(removed)
