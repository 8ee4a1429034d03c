"""Knowledge base: typed features of objects, from the results of the analysis services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import json_fields as J
from relspark.functions.gzip_text import decode_results
from relspark.functions.text import clean_rules
from relspark.operators.joins import fits_broadcast, semi_join
from relspark.sources.schemas import OBJECTS
from relspark.sources.stored import measured
from relspark.sources.tables import ISIN_LIMIT, local_rows, only_batch

# Service names as stored in the result tables.
PEINFO, YARA, CUCKOO = "peinfo", "yara", "CUCKOO"

RESULT_KEY = ["object_id", "service_name"]


def service_results(data: DataFrame, services: list[str]) -> DataFrame:
    """Decoded results of some services."""
    return decode_results(data.where(F.col("service_name").isin(services)))


def listed(features: DataFrame, meta: DataFrame, data: DataFrame, spread: list[str]) -> DataFrame:
    """Rows whose (object_id, service_name) is in the result metadata.

    Called on features extracted from `data`, not on the result blobs: the join then shuffles short
    rows, and being a semi join it does not multiply rows where the metadata has repeats. Hot keys
    are counted in the key columns of `data`, so that nothing is extracted twice.
    """
    keys = data.select(*RESULT_KEY)
    return semi_join(features, meta, RESULT_KEY, spread, counted=keys)


def in_batch(
    meta: DataFrame, data: DataFrame, batch: DataFrame | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Cut metadata and data down to a batch of ids.

    A short list becomes an IN filter, a batch that fits a broadcast is joined in place. A larger
    one cuts only the metadata, which `listed` then applies to the extracted features: the result
    is the same and the result blobs are never shuffled.
    """
    if not isinstance(batch, DataFrame) and len(batch) <= ISIN_LIMIT:
        return only_batch(meta, batch, "object_id", []), only_batch(data, batch, "object_id", [])
    if not isinstance(batch, DataFrame):
        batch = local_rows(meta.sparkSession, [(b,) for b in batch], OBJECTS)
    ids = measured(batch.select("object_id").distinct())
    meta = semi_join(meta, ids, ["object_id"], ["service_name"])
    if fits_broadcast(ids):
        data = data.join(F.broadcast(ids.df), "object_id", "left_semi")
    return meta, data


def result_features(results: DataFrame, drop_empty: bool = False) -> DataFrame:
    """(object_id, service_name, feature_type, feature_value), one pass over the results.

    Each result is parsed once and gives the features of its service; there is no union of scans.
    `drop_empty` leaves out empty rule lists, which are otherwise kept as an empty value.
    """

    def of(service: str) -> Column:
        return F.when(F.col("service_name") == service, F.col("results"))

    def feature(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("feature_type"), value.alias("feature_value"))

    rules = clean_rules(of(YARA))
    if drop_empty:
        rules = F.nullif(rules, F.lit(""))
    parsed = results.select(
        *RESULT_KEY,
        J.parse_peinfo(of(PEINFO), "pehash", "imphash").alias("pe"),
        J.first_signature(of(PEINFO), J.parse_peinfo(of(PEINFO), "version_info")["version_info"]).alias("signature"),
        rules.alias("rules"),
        F.array_join(J.called_urls(of(CUCKOO)), ",").alias("urls"),
    )
    found = F.array(
        feature("pehash", J.string_only(F.col("pe.pehash"))),
        feature("imphash", J.string_only(F.col("pe.imphash"))),
        feature("binary_signature", F.col("signature")),
        feature("yara_rules", F.col("rules")),
        feature("called_domains", F.nullif(F.col("urls"), F.lit(""))),
    )
    # the outer form, or Spark would evaluate all of the above a second time in a filter
    return parsed.select(*RESULT_KEY, F.inline_outer(found)).where("feature_value IS NOT NULL")


def build_knowledge_base(
    meta: DataFrame,
    data: DataFrame,
    batch: DataFrame | list[str] | None = None,
    ts: Column | None = None,
    drop_empty: bool = False,
) -> DataFrame:
    """Knowledge-base rows of all listed results, or of the objects in `batch`."""
    if batch is not None:
        meta, data = in_batch(meta, data, batch)
    results = service_results(data, [PEINFO, YARA, CUCKOO])
    spread = ["feature_type", "feature_value"]
    found = listed(result_features(results, drop_empty), meta, data, spread)
    stamp = F.current_timestamp() if ts is None else ts
    return found.select("object_id", "feature_type", "feature_value", stamp.alias("ts"))
