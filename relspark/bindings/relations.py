"""Knowledge base and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from relspark.bindings.basics import EVENT_KB, SQL_TIME, event_knowledge, sql_tokens, time_text
from relspark.bindings.derived import (
    LINK,
    documents_of,
    knowledge_inputs,
    page_id,
    pages_of,
    table,
)
from relspark.functions.vectors import bind
from relspark.operators import classes as C
from relspark.operators import relationships as R
from relspark.operators import similarity as S
from relspark.operators.joins import semi_join
from relspark.plans import app
from relspark.plans.knowledge import build_knowledge_base
from relspark.sources.schemas import FEATURES, Feature
from relspark.sources.stored import stored

STAMP = "2024-01-01 00:00:00.000000"

# every event type relates users with an equal value
EVENT_FEATURES = [
    Feature("click", 0.5, "click"),
    Feature("error", 0.5, "error"),
    Feature("purchase", 1.0, "purchase"),
    Feature("signup", 1.0, "signup"),
    Feature("view", 0.5, "view"),
]
WORDS = [Feature("words", None, "words")]
SHINGLE = 5
#: Values of more objects, and tokens of more lists, are linked as classes; matches in a cell of a record.
MOST, CELL = 10, 64
#: Objects asked about: those whose number it divides.
EVERY = 50
#: Least weight of similar lists.
SIMILAR = 0.3


def stamp():
    return F.to_timestamp_ntz(F.lit(STAMP))


def knowledge(spark, sf_dir):
    _, meta, data = knowledge_inputs(spark, sf_dir)
    return build_knowledge_base(meta, data, ts=stamp())


def asked_for(spark, sf_dir, *names: str):
    """Ids of every document or page whose number EVERY divides."""
    tables = {"doc": ("documents", "doc_id"), "page": ("pages", "page_id")}
    found = None
    for name in names:
        source, key = tables[name]
        numbers = table(spark, sf_dir, source).select(key).where(F.col(key) % EVERY == 0)
        ids = numbers.select(F.concat(F.lit(name + "-"), key).alias("object_id"))
        found = ids if found is None else found.unionByName(ids)
    return found


def word_knowledge(spark, sf_dir):
    """Every run of SHINGLE words of documents and benchmark items, as comma lists.

    A text of fewer words is one run.
    """
    words = F.split(F.trim(F.regexp_replace("text", "[ \n\t,]+", " ")), " ")

    def runs(w):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - SHINGLE + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))

    value = F.array_join(bind(words, runs), ",").alias("feature_value")

    def rows(df, prefix: str, key: str):
        return df.select(
            F.concat(F.lit(prefix), key).alias("object_id"),
            F.lit("words").alias("feature_type"),
            value,
            stamp().alias("ts"),
        )

    documents = documents_of(spark, sf_dir, "text")
    return rows(documents, "doc-", "doc_id").unionByName(
        rows(table(spark, sf_dir, "benchmark"), "item-", "item_id")
    )


def edge_columns(edges):
    return edges.select("object_id", "other_id", "feature_type", F.round("weight", 6).alias("weight"))


def kb_build(spark, sf_dir):
    return knowledge(spark, sf_dir).select("object_id", "feature_type", "feature_value", time_text())


def related_counts(spark, sf_dir):
    return R.related_counts(event_knowledge(spark, sf_dir), EVENT_FEATURES)


def rel_groups(spark, sf_dir):
    groups = R.exact_groups(event_knowledge(spark, sf_dir), EVENT_FEATURES)
    return groups.select("feature_type", "feature_value", "object_id", time_text())


def rel_tokens(spark, sf_dir):
    index = R.token_index(word_knowledge(spark, sf_dir), WORDS)
    return index.select("object_id", "token", "n", "distinct")


def link_columns(links):
    return links.select(
        "object_id", "other_id", "class_id", "feature_type", F.round("weight", 6).alias("weight"), "n_links"
    )


def rel_exact(spark, sf_dir):
    """Every 50th user, and all users with an equal value: as pairs, or as the class of a frequent value.

    The members of these classes follow, with no object_id.
    """
    kb = stored(event_knowledge(spark, sf_dir))
    targets = kb.select("object_id").where(F.col("object_id").cast("long") % EVERY == 0).distinct()
    wanted = R.target_values(kb, targets, EVENT_FEATURES)
    links = C.exact_links(kb, wanted, EVENT_FEATURES, MOST).links
    # who is in the classes since when
    key = ["feature_type", "feature_value"]
    held = stored(R.exact_groups(kb, EVENT_FEATURES))
    heavy = held.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > MOST)
    members = semi_join(held, heavy, key, ["object_id"]).select(
        F.lit(None).cast("string").alias("object_id"),
        F.col("object_id").alias("other_id"),
        C.class_of("value", *key).alias("class_id"),
        "feature_type",
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("long").alias("n_links"),
        "ts",
    )
    rows = links.unionByName(members)
    return rows.select("object_id", "other_id", "class_id", "feature_type", "weight", "n_links", time_text())


def rel_overlap(spark, sf_dir):
    """Which documents share runs of words with each benchmark item, over all items and documents."""
    kb = word_knowledge(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark")
    targets = items.select(F.concat(F.lit("item-"), "item_id").alias("object_id"))
    return edge_columns(R.overlap_edges(kb, targets, WORDS))


def rel_links(spark, sf_dir):
    """Every 50th page, and all lists of links or rules that share some with its own; then the pages with these lists."""
    kb = stored(knowledge(spark, sf_dir))
    wanted = R.target_values(kb, asked_for(spark, sf_dir, "page"))
    return link_columns(C.whole_links(C.overlap_links(kb, wanted, FEATURES, MOST, score_all=True)))


def all_links(spark, sf_dir, score_all: bool = True):
    """All links of every 50th document and page over all features; lists that meet are scored."""
    kb = stored(knowledge(spark, sf_dir))
    targets = stored(asked_for(spark, sf_dir, "doc", "page"))
    linked = C.primary_links(kb, targets, most=MOST, score_all=score_all)
    return kb, targets, linked


def all_edges(spark, sf_dir):
    """The same as edges to objects and classes."""
    kb, targets, linked = all_links(spark, sf_dir)
    return kb, targets, stored(C.as_edges(linked.links))


def whole_edges(spark, sf_dir):
    """The same, and edges from the classes to their members."""
    kb, targets, linked = all_links(spark, sf_dir)
    return kb, targets, stored(C.whole_edges(linked))


def rel_members(spark, sf_dir):
    """Who is in the classes that the links of documents and pages lead to."""
    return all_links(spark, sf_dir, score_all=False)[2].members


def similar_pages(spark, sf_dir):
    """All pairs of lists of links or rules above a weight, over all pages; equal lists as classes."""
    kb = stored(knowledge(spark, sf_dir))
    pairs, holders = S.similar_lists(kb, SIMILAR)
    classes = S.similar_classes(pairs, holders)
    return classes.select("feature_type", "a", "b", "n_a", "n_b", F.round("weight", 6).alias("weight"))


def similar_counts(spark, sf_dir):
    """How many other pages each page is linked to by lists above that weight."""
    kb = stored(knowledge(spark, sf_dir))
    pairs, holders = S.similar_lists(kb, SIMILAR)
    return S.linked_objects(stored(S.similar_classes(pairs, holders)), holders)


def rel_record(spark, sf_dir):
    """Records of every 50th document and page, and of the classes they are linked to: who is in these."""
    kb, targets, edges = whole_edges(spark, sf_dir)
    records = R.relationship_records(kb, targets, edges, stamp(), most=CELL)
    match = "transform({c}, m -> concat(m.sha256, '=', cast(round(m.weight, 6) as decimal(12, 6))))"
    texts = [
        F.expr(f"array_join({match.format(c=f.column)}, ' ')").alias(f.column) for f in FEATURES
    ]
    return records.select("object_id", "part", *texts)


def edge_views(spark, sf_dir):
    """Threshold, feature filter, histogram and totals of one edge table: of all pairs, the classes written out."""
    _, _, linked = all_links(spark, sf_dir)
    links = stored(linked.links)
    members = C.linked_members(C.Linked(links, linked.members))
    edges = C.as_edges(links)
    shaped = [
        ("threshold", R.related_numbers(R.above(edges, 0.5))),
        ("features", R.related_numbers(R.with_features(edges, ["pehash", "yara_rules"]))),
        (
            "histogram",
            R.weight_histogram(edges, 0.0, 1.0, 10, stored(members)).select(
                F.concat(F.lit("segment-"), "segment").alias("object_id"),
                F.col("n_edges").alias("n"),
                F.col("n_objects"),
            ),
        ),
        (
            "total",
            # rounded twice, so that the order of the sum does not show
            R.total_weights(edges).groupBy("object_id").agg(
                F.round(F.round(F.sum("weight"), 6) * 1000).cast("bigint").alias("n")
            ),
        ),
    ]
    out = None
    for name, df in shaped:
        objects = F.col("n_objects") if "n_objects" in df.columns else F.lit(None).cast("bigint")
        df = df.select(F.lit(name).alias("view"), "object_id", "n", objects.alias("n_objects"))
        out = df if out is None else out.unionByName(df)
    return out


def app_run(spark, sf_dir):
    """The whole job over all objects, reporting on every 50th document and page, and on the classes they are linked to."""
    objects, meta, data = knowledge_inputs(spark, sf_dir)
    _, edges, _ = app.run(objects, meta, data, asked_for(spark, sf_dir, "doc", "page"), ts=stamp(), most=MOST, score_all=True)
    return edge_columns(edges)


def flagship(spark, sf_dir):
    """All links of every 50th document and page, over the knowledge base of all; then the members of their classes."""
    return link_columns(C.whole_links(all_links(spark, sf_dir)[2]))


QUERIES = {
    "q_kb_build": kb_build,
    "q_related_counts": related_counts,
    "q_rel_groups": rel_groups,
    "q_rel_tokens": rel_tokens,
    "q_rel_exact": rel_exact,
    "q_rel_overlap": rel_overlap,
    "q_rel_links": rel_links,
    "q_rel_all_features": flagship,
    "q_rel_members": rel_members,
    "q_similar_pages": similar_pages,
    "q_similar_counts": similar_counts,
    "q_rel_record": rel_record,
    "q_edge_views": edge_views,
    "q_app_run": app_run,
}

KB = f"""
    pg AS (SELECT 'page-' || page_id AS object_id, regexp_extract_all(html, '{LINK}', 1) AS links
           FROM pages),
    kb AS (
      SELECT 'doc-' || doc_id AS object_id, 'pehash' AS feature_type, md5(text) AS feature_value
      FROM documents WHERE lang <> 'fr'
      UNION ALL SELECT 'doc-' || doc_id, 'imphash', source FROM documents WHERE lang <> 'de'
      UNION ALL SELECT 'doc-' || doc_id, 'binary_signature', lang || '-' || source
      FROM documents WHERE lang <> 'es'
      UNION ALL SELECT object_id, 'yara_rules', coalesce(replace(array_to_string(
        ['rule' || regexp_replace(l, '[^a-zA-Z0-9.,_]', '', 'g') FOR l IN links], ','), 'yara', ''), '')
      FROM pg
      UNION ALL SELECT object_id, 'called_domains', array_to_string(links, ',') FROM pg
      WHERE array_to_string(links, ',') <> '')"""

WEIGHTS = """CASE feature_type WHEN 'pehash' THEN 0.5 WHEN 'imphash' THEN 0.5
             WHEN 'binary_signature' THEN 1.0 END"""

WORD_KB = f"""
    kb AS (
      SELECT object_id, 'words' AS feature_type, array_to_string(
               [array_to_string(w[i:i + {SHINGLE} - 1], ' ')
                FOR i IN range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)], ',') AS feature_value
      FROM (SELECT object_id, string_split(trim(regexp_replace(text, '[ \\n\\t,]+', ' ', 'g'), ' '), ' ') AS w
            FROM (SELECT 'doc-' || doc_id AS object_id, text FROM documents
                  UNION ALL SELECT 'item-' || item_id, text FROM benchmark)))"""

TOKENS = f"""
    tok AS (SELECT object_id, feature_type, unnest({sql_tokens('feature_value')}) AS token
            FROM kb WHERE feature_type IN ('yara_rules', 'called_domains', 'words')),
    cnt AS (SELECT object_id, feature_type, token, count(*) AS n FROM tok GROUP BY ALL),
    siz AS (SELECT object_id, feature_type, count(*) AS d FROM cnt GROUP BY ALL)"""

OVERLAP = f"""
    {TOKENS},
    overlap AS (
      SELECT a.object_id, b.object_id AS other_id, a.feature_type,
             CAST(sum(least(a.n, b.n)) AS DOUBLE) / (sa.d + sb.d - count(*)) AS weight
      FROM cnt a JOIN targets t ON a.object_id = t.object_id
      JOIN cnt b ON a.feature_type = b.feature_type AND a.token = b.token
                AND a.object_id <> b.object_id
      JOIN siz sa ON sa.object_id = a.object_id AND sa.feature_type = a.feature_type
      JOIN siz sb ON sb.object_id = b.object_id AND sb.feature_type = b.feature_type
      GROUP BY a.object_id, b.object_id, a.feature_type, sa.d, sb.d)"""

ASKED = f"""
    targets AS (SELECT 'doc-' || doc_id AS object_id FROM documents WHERE doc_id % {EVERY} = 0
                UNION ALL SELECT 'page-' || page_id FROM pages WHERE page_id % {EVERY} = 0)"""


def _class(kind: str, value: str) -> str:
    return f"substr(sha256('{kind}:' || feature_type || ':' || {value}), 1, 32)"


#: Links of the targets, frequent values and equal lists as classes (`spread`: the tokens of many lists); `edges` is their form for records and views.
LINKS = f"""
    {KB}, {ASKED},
    held AS (SELECT DISTINCT feature_type, feature_value, object_id FROM kb
             WHERE feature_type IN ('pehash', 'imphash', 'binary_signature')),
    sizes AS (SELECT feature_type, feature_value, count(*) AS size FROM held GROUP BY ALL),
    mine AS (SELECT h.*, size, CAST({WEIGHTS} AS DOUBLE) AS weight FROM held h JOIN targets USING (object_id)
             JOIN sizes USING (feature_type, feature_value)),
    holders AS (SELECT DISTINCT feature_type, {_class("list", "feature_value")} AS list, feature_value, object_id
                FROM kb WHERE feature_type IN ('yara_rules', 'called_domains')),
    lists AS (SELECT feature_type, list, feature_value, count(*) AS size FROM holders GROUP BY ALL),
    words AS (SELECT feature_type, list, token, count(*) AS n FROM (
                SELECT feature_type, list, unnest({sql_tokens('feature_value')}) AS token FROM lists) GROUP BY ALL),
    spread AS (SELECT feature_type, token, count(*) AS lists FROM words GROUP BY ALL HAVING count(*) > {MOST}),
    owners AS (SELECT feature_type, list AS my, object_id FROM holders JOIN targets USING (object_id)),
    near AS (SELECT DISTINCT a.feature_type, a.list AS my, b.list FROM words a JOIN words b USING (feature_type, token)
             WHERE a.list IN (SELECT my FROM owners)),
    total AS (SELECT feature_type, list, count(*) AS d FROM words GROUP BY ALL),
    scored AS (
      SELECT n.feature_type, n.my, n.list, CAST(sum(least(a.n, b.n)) AS DOUBLE) / (x.d + y.d - count(*)) AS weight
      FROM near n JOIN words a ON a.feature_type = n.feature_type AND a.list = n.my
      JOIN words b ON b.feature_type = n.feature_type AND b.list = n.list AND b.token = a.token
      JOIN total x ON x.feature_type = n.feature_type AND x.list = n.my
      JOIN total y ON y.feature_type = n.feature_type AND y.list = n.list
      GROUP BY n.feature_type, n.my, n.list, x.d, y.d),
    links AS (
      SELECT m.object_id, h.object_id AS other_id, NULL AS class_id, feature_type, weight, 1 AS n_links
      FROM mine m JOIN held h USING (feature_type, feature_value)
      WHERE size <= {MOST} AND m.object_id <> h.object_id
      UNION ALL
      SELECT object_id, NULL, {_class("value", "feature_value")}, feature_type, weight, size - 1
      FROM mine WHERE size > {MOST}
      UNION ALL
      SELECT * FROM (
        SELECT o.object_id, NULL, s.list, feature_type, weight, size - CAST(s.list = o.my AS INTEGER) AS n
        FROM owners o JOIN scored s USING (feature_type, my) JOIN lists USING (feature_type, list)) WHERE n > 0)"""

ALL_EDGES = f"""
    {LINKS},
    edges AS (SELECT object_id, coalesce(other_id, class_id) AS other_id, feature_type,
                     coalesce(weight, 0) AS weight, n_links FROM links)"""

#: Who is in the classes that the links lead to.
CLASS_MEMBERS = f"""
    linked_classes AS (SELECT DISTINCT class_id, feature_type FROM links WHERE class_id IS NOT NULL),
    class_members AS (
      SELECT class_id, feature_type, member FROM linked_classes JOIN (
        SELECT {_class("value", "feature_value")} AS class_id, feature_type, object_id AS member FROM held
        UNION ALL SELECT list, feature_type, object_id FROM holders) USING (class_id, feature_type))"""

#: The same edges, and those from the classes to their members.
WHOLE_EDGES = f"""
    {LINKS}, {CLASS_MEMBERS},
    edges AS (SELECT object_id, coalesce(other_id, class_id) AS other_id, feature_type,
                     coalesce(weight, 0) AS weight, n_links FROM links
              UNION ALL SELECT class_id, member, feature_type, 1, 1 FROM class_members)"""

#: All pairs of the targets, without classes.
PLAIN_EDGES = f"""
    {KB}, {ASKED}, {OVERLAP},
    edges AS (
      SELECT DISTINCT a.object_id, b.object_id AS other_id, feature_type, CAST({WEIGHTS} AS DOUBLE) AS weight
      FROM kb a JOIN targets t ON a.object_id = t.object_id
      JOIN kb b USING (feature_type, feature_value)
      WHERE a.object_id <> b.object_id
        AND feature_type IN ('pehash', 'imphash', 'binary_signature')
      UNION ALL SELECT * FROM overlap)"""

EVENT_WEIGHT = "CASE WHEN feature_type IN ('purchase', 'signup') THEN 1.0 ELSE 0.5 END"

EVENT_COUNTS = f"""
    kb AS ({EVENT_KB}),
    held AS (SELECT feature_type, feature_value, object_id, max(ts) AS ts FROM kb GROUP BY ALL),
    grp AS (SELECT feature_type, feature_value, count(*) AS c FROM held GROUP BY ALL),
    latest AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY object_id, feature_type
                                   ORDER BY ts DESC, feature_value DESC) AS r FROM kb) WHERE r = 1),
    counts AS (SELECT object_id, feature_type, feature_value, c - 1 AS n_related,
                      CAST((c - 1) * {EVENT_WEIGHT} AS DOUBLE) AS total_weight
               FROM latest JOIN grp USING (feature_type, feature_value))"""


def record_dealt(powers: int) -> str:
    """Records are cut into the least power of two of parts that keeps every cell within CELL matches."""
    return f"""
    numbered AS (SELECT *, CAST('0x' || substr(md5(other_id), 1, 8) AS BIGINT) AS number FROM edges),
    tried AS (
      SELECT p, max(c) AS largest FROM (
        SELECT p, object_id, feature_type, number % p AS part, count(*) AS c
        FROM numbered, (SELECT unnest({[2**i for i in range(powers)]}) AS p) GROUP BY ALL)
      GROUP BY p),
    dealt AS (
      SELECT *, CAST(number % (SELECT coalesce(min(p), 1) FROM tried WHERE largest <= {CELL}) AS INTEGER) AS part
      FROM numbered)"""


RECORD_DEALT = record_dealt(12)
#: For the records of classes, which may have many members.
CLASS_RECORD_DEALT = record_dealt(18)


def _record_column(feature: Feature) -> str:
    mine = f"feature_type = '{feature.name}'"
    texts = (
        "string_agg(other_id || '=' || CAST(CAST(round(weight, 6) AS DECIMAL(12, 6)) AS VARCHAR), ' ' "
        f"ORDER BY other_id, weight) FILTER (WHERE {mine})"
    )
    owned = f"EXISTS (SELECT 1 FROM kb WHERE kb.object_id = p.object_id AND kb.{mine})"
    return f"coalesce({texts}, CASE WHEN p.part = 0 AND {owned} THEN '' END) AS {feature.column}"


SIMILAR_CLASSES = f"""
    {LINKS},
    every AS (
      SELECT a.feature_type, a.list AS a, b.list AS b, x.d AS da, y.d AS db,
             CAST(sum(least(a.n, b.n)) AS DOUBLE) / (x.d + y.d - count(*)) AS weight
      FROM words a JOIN words b ON a.feature_type = b.feature_type AND a.token = b.token AND a.list < b.list
      JOIN total x ON x.feature_type = a.feature_type AND x.list = a.list
      JOIN total y ON y.feature_type = b.feature_type AND y.list = b.list
      GROUP BY a.feature_type, a.list, b.list, x.d, y.d),
    classes AS (
      SELECT e.feature_type, a, b, m.size AS n_a, n.size AS n_b, round(weight, 6) AS weight
      FROM every e JOIN lists m ON m.feature_type = e.feature_type AND m.list = a
      JOIN lists n ON n.feature_type = e.feature_type AND n.list = b WHERE weight >= {SIMILAR}
      UNION ALL SELECT feature_type, list, list, size, size, NULL FROM lists WHERE size > 1)"""

ORACLE = {
    "q_kb_build": f"""
        WITH {KB} SELECT object_id, feature_type, feature_value, '{STAMP}' AS ts FROM kb""",
    "q_related_counts": f"""
        WITH {EVENT_COUNTS} SELECT object_id, feature_type, feature_value, n_related, total_weight
        FROM counts""",
    "q_rel_groups": f"""
        WITH {EVENT_COUNTS} SELECT feature_type, feature_value, object_id,
        strftime(ts, {SQL_TIME}) AS ts FROM held""",
    "q_rel_exact": f"""
        WITH {EVENT_COUNTS},
        best AS (SELECT l.*, c, CAST({EVENT_WEIGHT} AS DOUBLE) AS weight
                 FROM latest l JOIN grp USING (feature_type, feature_value)
                 WHERE CAST(object_id AS BIGINT) % {EVERY} = 0)
        SELECT l.object_id, h.object_id AS other_id, NULL AS class_id, feature_type, weight, 1 AS n_links,
               strftime(h.ts, {SQL_TIME}) AS ts
        FROM best l JOIN held h USING (feature_type, feature_value)
        WHERE l.object_id <> h.object_id AND c <= {MOST}
        UNION ALL
        SELECT object_id, NULL, {_class("value", "feature_value")}, feature_type, weight, c - 1, NULL
        FROM best WHERE c > {MOST}
        UNION ALL
        SELECT NULL, h.object_id, {_class("value", "feature_value")}, feature_type, NULL, NULL, strftime(h.ts, {SQL_TIME})
        FROM held h JOIN grp USING (feature_type, feature_value) WHERE c > {MOST}""",
    "q_rel_tokens": f"""
        WITH {WORD_KB}, {TOKENS}
        SELECT object_id, token, CAST(n AS INTEGER) AS n, CAST(d AS INTEGER) AS "distinct"
        FROM cnt JOIN siz USING (object_id, feature_type)""",
    "q_rel_overlap": f"""
        WITH {WORD_KB},
        targets AS (SELECT 'item-' || item_id AS object_id FROM benchmark), {OVERLAP}
        SELECT object_id, other_id, feature_type, round(weight, 6) AS weight FROM overlap""",
    "q_rel_links": f"""
        WITH {LINKS}, {CLASS_MEMBERS}
        SELECT object_id, other_id, class_id, feature_type, round(weight, 6) AS weight, n_links FROM links
        WHERE feature_type IN ('yara_rules', 'called_domains') AND object_id LIKE 'page-%'
        UNION ALL SELECT NULL, member, class_id, feature_type, NULL, NULL FROM class_members
        WHERE feature_type IN ('yara_rules', 'called_domains')""",
    "q_rel_all_features": f"""
        WITH {LINKS}, {CLASS_MEMBERS}
        SELECT object_id, other_id, class_id, feature_type, round(weight, 6) AS weight, n_links FROM links
        UNION ALL SELECT NULL, member, class_id, feature_type, NULL, NULL FROM class_members""",
    "q_rel_members": f"""
        WITH {LINKS}
        SELECT {_class("value", "feature_value")} AS class_id, 'value' AS kind, object_id AS member
        FROM held JOIN sizes USING (feature_type, feature_value) WHERE size > {MOST}
        UNION ALL SELECT list, 'list', object_id FROM holders
        UNION ALL SELECT {_class("token", "token")}, 'token', list FROM words JOIN spread USING (feature_type, token)""",
    "q_similar_pages": f"WITH {SIMILAR_CLASSES} SELECT * FROM classes",
    "q_similar_counts": f"""
        WITH {SIMILAR_CLASSES},
        ways AS (SELECT feature_type, a AS list, n_b - CAST(a = b AS INTEGER) AS n FROM classes
                 UNION ALL SELECT feature_type, b, n_a FROM classes WHERE a <> b)
        SELECT feature_type, object_id, CAST(sum(n) AS BIGINT) AS n_links
        FROM holders JOIN ways USING (feature_type, list) GROUP BY ALL""",
    "q_rel_record": f"""
        WITH {WHOLE_EDGES}
        , {CLASS_RECORD_DEALT},
        p AS (SELECT object_id, part FROM dealt UNION SELECT object_id, 0 FROM targets)
        SELECT p.object_id, p.part, {", ".join(map(_record_column, FEATURES))}
        FROM p LEFT JOIN dealt e ON e.object_id = p.object_id AND e.part = p.part
        GROUP BY p.object_id, p.part""",
    "q_edge_views": f"""
        WITH {PLAIN_EDGES}
        SELECT 'threshold' AS view, object_id, count(*) AS n, CAST(NULL AS BIGINT) AS n_objects
        FROM edges WHERE weight > 0.5
        GROUP BY object_id
        UNION ALL SELECT 'features', object_id, count(*), NULL FROM edges
        WHERE feature_type IN ('pehash', 'yara_rules') GROUP BY object_id
        UNION ALL SELECT 'histogram', 'segment-' || segment,
                  count(*), count(DISTINCT other_id)
        FROM (SELECT *, CASE WHEN weight < 0 THEN 0 WHEN weight >= 1 THEN 11
                        ELSE CAST(floor(weight * 10) AS INTEGER) + 1 END AS segment FROM edges)
        GROUP BY segment
        UNION ALL SELECT 'total', object_id, CAST(round(round(sum(weight), 6) * 1000) AS BIGINT), NULL FROM (
          SELECT object_id, other_id, sum(weight) AS weight FROM edges GROUP BY object_id, other_id)
        GROUP BY object_id""",
    "q_app_run": f"""
        WITH {WHOLE_EDGES}
        SELECT object_id, other_id, feature_type, round(weight, 6) AS weight FROM edges""",
}
