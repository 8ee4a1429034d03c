"""Scans, filters, joins with metadata, latest values, encodings of single columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from relspark.bindings.derived import LINK, links, table, yara_results
from relspark.functions import json_fields as J
from relspark.functions import vectors as V
from relspark.functions.gzip_text import gunzip_text, gzip_text
from relspark.functions.text import clean_rules, overlap_score
from relspark.functions.time_ids import time_uuid, uuid_timestamp
from relspark.operators.latest import latest_rows, latest_values
from relspark.plans.features import min_max
from relspark.plans.app import object_batch
from relspark.plans.knowledge import listed
from relspark.sources.tables import current_relationships, kb_by_feature, only_batch

TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def time_text(column: str = "ts"):
    return F.date_format(column, TIME).alias("ts")


def event_results(spark, sf_dir):
    """Events as results: the user is the object, the event type the service."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("object_id"),
        F.col("event_type").alias("service_name"),
        "event_id",
        "value",
        "props",
        "ts",
    )


def event_knowledge(spark, sf_dir):
    """Events as a knowledge base with history: the whole part of the value is the feature value."""
    return event_results(spark, sf_dir).select(
        "object_id",
        F.col("service_name").alias("feature_type"),
        F.floor("value").cast("string").alias("feature_value"),
        "ts",
    )


EVENT_KB = """
    SELECT CAST(user_id AS VARCHAR) AS object_id, event_type AS feature_type,
           CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS feature_value, ts FROM events"""


def scan_filter_project(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    batch = customers.select(F.col("c_custkey").cast("string").alias("object_id"))
    clicks = event_results(spark, sf_dir).where(F.col("service_name") == "click")
    rows = only_batch(clicks, batch, "object_id", ["event_id"])
    return rows.select("object_id", "service_name", "event_id")


def meta_data_join(spark, sf_dir):
    results = event_results(spark, sf_dir)
    meta = results.where(F.col("value") > 100).select("object_id", "service_name")
    return listed(results, meta, results, ["event_id"]).select("object_id", "service_name", "event_id").distinct()


def json_member(spark, sf_dir):
    events = event_results(spark, sf_dir)
    return events.select("event_id", J.member_or(F.col("props"), "$.k", 0.0).alias("k"))


def by_feature(spark, sf_dir):
    rows = kb_by_feature(event_knowledge(spark, sf_dir), "purchase")
    return rows.select("feature_type", "object_id", "feature_value", time_text())


def latest_value(spark, sf_dir):
    latest = latest_values(event_knowledge(spark, sf_dir))
    return latest.select("object_id", "feature_type", "feature_value", time_text())


def newest_rows(spark, sf_dir):
    keys = ["object_id", "service_name"]
    rows = latest_rows(event_results(spark, sf_dir), keys, [F.desc("ts"), F.desc("event_id")])
    return rows.select(*keys, "event_id", "value", time_text())


def upsert_view(spark, sf_dir):
    rows = current_relationships(event_results(spark, sf_dir))
    return rows.select("object_id", "service_name", "event_id", time_text())


def topn_ids(spark, sf_dir):
    return object_batch(event_results(spark, sf_dir), 100)


def rule_cleanup(spark, sf_dir):
    """The rule lists of the matches found on each page."""
    results = yara_results(table(spark, sf_dir, "pages"))
    return results.select("object_id", clean_rules(F.col("results")).alias("rules"))


def overlap_in_row(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.array_join(links(), ",").alias("a"))
    plain = F.regexp_replace("a", "[^a-zA-Z0-9,/]", "")
    return pages.select("page_id", F.round(overlap_score(F.col("a"), plain), 6).alias("weight"))


def gzip_roundtrip(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    packed = documents.select("doc_id", gzip_text("text").alias("blob"))
    return packed.select("doc_id", F.md5(gunzip_text("blob")).alias("text_md5"))


def json_find_all(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    inner = F.struct(F.struct("role").alias("none"), F.struct(F.col("role").alias("text")).alias("some"))
    nested = F.struct(
        F.struct("text", inner.alias("more"), F.struct(F.col("turn").alias("text")).alias("n")).alias("t")
    )
    found = J.json_find_all(F.to_json(nested), "text")
    rows = turns.select("conv_id", "turn", F.posexplode(found).alias("pos", "text"))
    return rows.where(F.col("text").isNotNull())


def signature(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    key = F.when(F.col("role") == "user", F.lit("UserSignature")).otherwise(F.col("role"))
    info = F.array(
        F.struct(key.alias("key"), F.col("text").alias("value")),
        F.struct(F.lit("Signature").alias("key"), F.col("role").alias("value")),
    )
    text = turns.select("conv_id", "turn", F.to_json(F.struct(info.alias("version_info"))).alias("j"))
    value = J.first_signature(F.col("j"), J.parse_peinfo(F.col("j"), "version_info")["version_info"])
    return text.select("conv_id", "turn", value.alias("signature"))


def uuid_time(spark, sf_dir):
    """Event times turned into time-based ids and read back."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ids = events.select("event_id", time_uuid(F.col("ts"), "event_id").alias("uuid"))
    return ids.select(
        "event_id",
        F.substring("uuid", 15, 1).alias("version"),
        F.date_format(uuid_timestamp(F.col("uuid")), TIME).alias("ts"),
    )


def minmax(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    arrays = part.select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice", F.lit(3.0)).alias("features"))
    scaled = min_max(arrays)
    names = ["size_scaled", "price_scaled", "constant_scaled"]
    return scaled.select(
        "p_partkey", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)]
    )


def onehot_label(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.one_hot(F.col("label"), 10).alias("h"))
    text = F.array_join(F.transform("h", lambda x: x.cast("int")), "")
    return rows.select("vec_id", text.alias("one_hot"), V.arg_max(F.col("h")).alias("label"))


QUERIES = {
    "q_scan_filter_project": scan_filter_project,
    "q_meta_data_join": meta_data_join,
    "q_json_member": json_member,
    "q_kb_by_feature": by_feature,
    "q_latest_value": latest_value,
    "q_newest_rows": newest_rows,
    "q_upsert_view": upsert_view,
    "q_topn_ids": topn_ids,
    "q_rule_cleanup": rule_cleanup,
    "q_overlap_in_row": overlap_in_row,
    "q_gzip_roundtrip": gzip_roundtrip,
    "q_json_find_all": json_find_all,
    "q_signature": signature,
    "q_uuid_time": uuid_time,
    "q_minmax": minmax,
    "q_onehot_label": onehot_label,
}

_TOKENS = """CASE WHEN {v} = '' THEN [''] WHEN regexp_replace({v}, ',+$', '') = '' THEN []
        ELSE string_split(regexp_replace({v}, ',+$', ''), ',') END"""


def sql_tokens(value: str) -> str:
    return _TOKENS.format(v=value)


ORACLE = {
    "q_scan_filter_project": """
        SELECT CAST(user_id AS VARCHAR) AS object_id, event_type AS service_name, event_id
        FROM events WHERE event_type = 'click' AND user_id IN (SELECT c_custkey FROM customer)""",
    "q_meta_data_join": """
        SELECT DISTINCT CAST(e.user_id AS VARCHAR) AS object_id, e.event_type AS service_name, e.event_id
        FROM events e JOIN events m ON e.user_id = m.user_id AND e.event_type = m.event_type
        WHERE m.value > 100""",
    "q_json_member": """
        SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k
        FROM events""",
    "q_kb_by_feature": f"""
        SELECT feature_type, object_id, feature_value, strftime(ts, {SQL_TIME}) AS ts
        FROM ({EVENT_KB}) WHERE feature_type = 'purchase' AND object_id IS NOT NULL
        AND feature_value IS NOT NULL AND ts IS NOT NULL""",
    "q_latest_value": f"""
        SELECT object_id, feature_type, feature_value, strftime(ts, {SQL_TIME}) AS ts FROM (
          SELECT *, row_number() OVER (PARTITION BY object_id, feature_type
                                       ORDER BY ts DESC, feature_value DESC) AS r
          FROM ({EVENT_KB})) WHERE r = 1""",
    "q_newest_rows": f"""
        SELECT CAST(user_id AS VARCHAR) AS object_id, event_type AS service_name, event_id, value,
               strftime(ts, {SQL_TIME}) AS ts
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                           ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r = 1""",
    "q_upsert_view": f"""
        SELECT CAST(user_id AS VARCHAR) AS object_id, event_type AS service_name, event_id,
               strftime(ts, {SQL_TIME}) AS ts
        FROM events e WHERE ts = (SELECT max(ts) FROM events m WHERE m.user_id = e.user_id)""",
    "q_topn_ids": """
        SELECT DISTINCT CAST(user_id AS VARCHAR) AS object_id FROM events ORDER BY 1 LIMIT 100""",
    "q_rule_cleanup": f"""
        SELECT 'page-' || page_id AS object_id, coalesce(replace(array_to_string(
          ['rule' || regexp_replace(l, '[^a-zA-Z0-9.,_]', '', 'g') FOR l IN links], ','), 'yara', ''), '') AS rules
        FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS links FROM pages)""",
    "q_overlap_in_row": f"""
        WITH v AS (SELECT page_id, array_to_string(regexp_extract_all(html, '{LINK}', 1), ',') AS a
                   FROM pages),
        w AS (SELECT page_id, a, regexp_replace(a, '[^a-zA-Z0-9,/]', '', 'g') AS b FROM v),
        ta AS (SELECT page_id, token, count(*) AS n FROM (
                 SELECT page_id, unnest({sql_tokens('a')}) AS token FROM w) GROUP BY ALL),
        tb AS (SELECT page_id, token, count(*) AS n FROM (
                 SELECT page_id, unnest({sql_tokens('b')}) AS token FROM w) GROUP BY ALL),
        s AS (SELECT page_id, sum(least(coalesce(ta.n, 0), coalesce(tb.n, 0))) AS shared,
                     count(*) AS u, count(ta.n) AS na, count(tb.n) AS nb
              FROM ta FULL JOIN tb USING (page_id, token) GROUP BY page_id)
        SELECT page_id, round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN shared / u END, 0.0), 6) AS weight
        FROM pages LEFT JOIN s USING (page_id)""",
    "q_gzip_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "q_json_find_all": """
        SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, text FROM conversations
        UNION ALL SELECT conv_id, turn, 1, role FROM conversations
        UNION ALL SELECT conv_id, turn, 2, CAST(turn AS VARCHAR) FROM conversations""",
    "q_signature": """
        SELECT conv_id, turn, replace(CASE WHEN role = 'user' THEN text ELSE role END, '"', '') AS signature
        FROM conversations""",
    "q_uuid_time": f"""
        SELECT event_id, '1' AS version, strftime(ts, {SQL_TIME}) AS ts FROM events""",
    "q_minmax": """
        SELECT p_partkey,
          round(CASE WHEN max(p_size) OVER () = min(p_size) OVER () THEN 0.5
            ELSE (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) END, 6)
            AS size_scaled,
          round(CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 0.5
            ELSE (p_retailprice - min(p_retailprice) OVER ())
                 / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) END, 6) AS price_scaled,
          CAST(0.5 AS DOUBLE) AS constant_scaled
        FROM part""",
    "q_onehot_label": """
        SELECT vec_id, repeat('0', label) || '1' || repeat('0', 9 - label) AS one_hot,
               CAST(label AS BIGINT) AS label FROM embeddings""",
}
