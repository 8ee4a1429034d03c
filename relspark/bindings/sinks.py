"""What is written and read back, models and their checks: results that must survive a round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.bindings.basics import EVENT_KB, event_knowledge, event_results, time_text
from relspark.bindings.derived import table
from relspark.bindings.ml import embedding_arrays, vector_model
from relspark.bindings.relations import (
    ALL_EDGES,
    CELL,
    CLASS_RECORD_DEALT,
    EVERY,
    RECORD_DEALT,
    WHOLE_EDGES,
    all_edges,
    whole_edges,
)
from relspark.functions.gzip_text import gunzip_text
from relspark.operators.latest import latest_rows
from relspark.operators.relationships import records_as_blobs, relationship_records
from relspark.plans import classify
from relspark.sources import tables as TB
from relspark.sources.buckets import BucketTable, bucketed
from relspark.sources.schemas import KNOWLEDGE_BASE
from relspark.sources.stored import folder_of_application, stored

BUCKETS, UPSERTS = 64, 4
EXACT = ("pehash", "imphash", "binary_signature")


def new_path(spark) -> str:
    return f"{folder_of_application(spark)}/{uuid.uuid4().hex}"


def kb_sink(spark, sf_dir):
    """Two appends to a partitioned folder, read back with its schema, one feature type at the scan."""
    path = new_path(spark)
    kb = event_knowledge(spark, sf_dir)
    TB.append_knowledge_base(kb.where("feature_type <> 'view'"), path)
    TB.append_knowledge_base(kb.where("feature_type = 'view'"), path)
    back = TB.read_table(spark, path, KNOWLEDGE_BASE)
    parts = TB.kb_by_feature(back, "view").unionByName(TB.kb_by_feature(back, "purchase"))
    return parts.select("object_id", "feature_type", "feature_value", time_text())


def record_upsert(spark, sf_dir):
    """Records written twice, of objects and of the classes they are linked to: only the newest write of each shows."""
    kb, targets, edges = whole_edges(spark, sf_dir)
    path = new_path(spark)
    for day, some in ((1, edges.limit(0)), (2, edges)):
        stamp = F.lit(f"2024-06-0{day}").cast("timestamp_ntz")
        TB.append_relationships(relationship_records(kb, targets, some, stamp, most=CELL), path)
    current = TB.current_relationships(spark.read.parquet(path))
    sizes = [F.coalesce(F.size(c), F.lit(-1)).alias(f"n_{c}") for c in EXACT]
    return current.select("object_id", "part", F.date_format("ts", "yyyy-MM-dd").alias("day"), *sizes)


def bucket_lookup(spark, sf_dir):
    """The history of every 50th user, from a knowledge base laid out by buckets: other buckets stay unread."""
    kb = event_knowledge(spark, sf_dir)
    laid_out = bucketed(kb, new_path(spark), BUCKETS)
    ids = kb.select("object_id").where(F.col("object_id").cast("long") % EVERY == 0)
    found = laid_out.lookup(ids)
    return found.select("object_id", "feature_type", "feature_value", time_text())


def bucket_upsert(spark, sf_dir):
    """The newest event of each user, after one upsert for each part of the events in order of time."""
    events = event_results(spark, sf_dir).select("object_id", "ts", "event_id", "value")
    latest = BucketTable(new_path(spark), events.schema, BUCKETS)
    latest.create(spark)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return latest.read(spark).select("object_id", "event_id", "value", time_text())
    step = (high - low) / UPSERTS
    for i in range(UPSERTS):
        some = events.where(F.col("ts") >= F.lit(low + i * step))
        if i + 1 < UPSERTS:
            some = some.where(F.col("ts") < F.lit(low + (i + 1) * step))
        latest.upsert(latest_rows(some, ["object_id"], [F.desc("ts"), F.desc("event_id")]))
    return latest.read(spark).select("object_id", "event_id", "value", time_text())


def record_json(spark, sf_dir):
    """The exchange form over real edges: gzip blobs of JSON lists, unpacked again."""
    kb, targets, edges = all_edges(spark, sf_dir)
    stamp = F.lit("2024-06-01").cast("timestamp_ntz")
    blobs = stored(records_as_blobs(relationship_records(kb, targets, edges, stamp, most=CELL)))
    return blobs.select("object_id", "part", *[gunzip_text(c).alias(c) for c in EXACT])


def word_lists(spark, sf_dir):
    """A stop list written as lines and read in lower case."""
    path = new_path(spark)
    TB.write_lines(table(spark, sf_dir, "nation"), F.col("n_name"), path)
    return TB.read_words(spark, path, lower=True)


def typed_scan(spark, sf_dir):
    """Two columns read with other types, cut down to a short IN list."""
    schema = T.StructType(
        [T.StructField("o_orderkey", T.StringType()), T.StructField("o_totalprice", T.DoubleType())]
    )
    orders = TB.read_table(spark, f"{sf_dir}/orders.parquet", schema)
    return TB.only_batch(orders, ["1", "2", "3", "4", "5", "6", "7", "32"], "o_orderkey", [])


def model_reload(spark, sf_dir):
    """A saved and reloaded classifier predicts the same for every vector."""
    rows = stored(embedding_arrays(spark, sf_dir))
    model, path = vector_model(rows), new_path(spark)
    classify.save(model, path)
    mine = classify.predict(model, rows)
    again = classify.predict(classify.load(path), rows).withColumnRenamed("prediction", "again")
    same = F.col("prediction").eqNullSafe(F.col("again")).alias("same")
    return mine.join(again, "object_id").select("object_id", same)


def accuracy(spark, sf_dir):
    """Accuracy on vectors the model was not trained on, as printed; and whether it learned those it was trained on.

    A model that gives one class to all is right for the share of that class at most. The given labels do not
    follow from the vectors, so that only the trained ones can show more.
    """
    rows = stored(embedding_arrays(spark, sf_dir))
    model = vector_model(rows)
    evaluated = classify.evaluate(model, rows.where("held_out"))
    evaluated = stored(evaluated.select("*", classify.evaluation_line().alias("line")))
    line = r"^Label: (\d+), Prediction: (\d+)$"
    printed = F.regexp_extract("line", line, 1) == F.regexp_extract("line", line, 2)
    counted = evaluated.agg(F.count("*").alias("n"), F.avg(printed.cast("double")).alias("printed"))
    trained = stored(classify.evaluate(model, rows.where("NOT held_out")))
    hits = trained.agg(F.count("*").alias("n_trained"), F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("hits"))
    largest = trained.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    both = counted.crossJoin(classify.accuracy(evaluated)).crossJoin(hits).crossJoin(largest)  # one row each
    return both.select(
        "n",
        "n_trained",
        "largest",
        (F.abs(F.col("printed") - F.col("accuracy")) < 1e-9).alias("as_printed"),
        (F.col("hits") > F.col("largest")).alias("learned"),
    )


QUERIES = {
    "q_kb_sink": kb_sink,
    "q_record_upsert": record_upsert,
    "q_record_json": record_json,
    "q_bucket_lookup": bucket_lookup,
    "q_bucket_upsert": bucket_upsert,
    "q_word_lists": word_lists,
    "q_typed_scan": typed_scan,
    "q_model_reload": model_reload,
    "q_accuracy": accuracy,
}


#: Parts of the records that have a match, and part 0 of every target.
P = "p AS (SELECT object_id, part FROM dealt UNION SELECT object_id, 0 FROM targets)"
PARTS = f"""
    {RECORD_DEALT},
    {P}"""
CLASS_PARTS = f"""
    {CLASS_RECORD_DEALT},
    {P}"""


def _has(feature: str) -> str:
    return f"p.object_id IN (SELECT object_id FROM kb WHERE feature_type = '{feature}')"


def _size(feature: str) -> str:
    n = f"CAST(count(e.other_id) FILTER (WHERE e.feature_type = '{feature}') AS INTEGER)"
    return f"CASE WHEN {n} > 0 THEN {n} WHEN p.part = 0 AND {_has(feature)} THEN 0 ELSE -1 END AS n_{feature}"


def _json(feature: str) -> str:
    one = """'{"sha256":"' || e.other_id || '","weight":' || CAST(e.weight AS VARCHAR) || '}'"""
    some = f"string_agg({one}, ',' ORDER BY e.other_id) FILTER (WHERE e.feature_type = '{feature}')"
    return f"coalesce('[' || {some} || ']', CASE WHEN p.part = 0 AND {_has(feature)} THEN '[]' END) AS {feature}"


ORACLE = {
    "q_kb_sink": f"""
        SELECT object_id, feature_type, feature_value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
        FROM ({EVENT_KB}) WHERE feature_type IN ('view', 'purchase') AND feature_value IS NOT NULL""",
    "q_record_upsert": f"""
        WITH {WHOLE_EDGES}, {CLASS_PARTS}
        SELECT p.object_id, p.part, '2024-06-02' AS day, {", ".join(map(_size, EXACT))}
        FROM p LEFT JOIN dealt e ON e.object_id = p.object_id AND e.part = p.part GROUP BY p.object_id, p.part""",
    "q_record_json": f"""
        WITH {ALL_EDGES}, {PARTS}
        SELECT p.object_id, p.part, {", ".join(map(_json, EXACT))}
        FROM p LEFT JOIN dealt e ON e.object_id = p.object_id AND e.part = p.part GROUP BY p.object_id, p.part""",
    "q_bucket_lookup": f"""
        SELECT object_id, feature_type, feature_value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
        FROM ({EVENT_KB}) WHERE CAST(object_id AS BIGINT) % {EVERY} = 0""",
    "q_bucket_upsert": """
        SELECT CAST(user_id AS VARCHAR) AS object_id, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r = 1""",
    "q_word_lists": "SELECT lower(n_name) AS term FROM nation",
    "q_typed_scan": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice
        FROM orders WHERE o_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32)""",
    "q_model_reload": "SELECT 'vec-' || vec_id AS object_id, true AS same FROM embeddings",
    "q_accuracy": """
        SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS n, CAST(sum(n) AS BIGINT) AS n_trained,
               max(n) AS largest, true AS as_printed, true AS learned
        FROM (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label)""",
}
