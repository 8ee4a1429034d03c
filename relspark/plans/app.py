"""The whole job: objects -> knowledge base -> relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators.classes import primary_links, whole_edges
from relspark.operators.relationships import primary_relationships, relationship_records
from relspark.plans.knowledge import build_knowledge_base
from relspark.sources.stored import stored
from relspark.sources.tables import append_knowledge_base, append_relationships


def object_batch(objects: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct object ids; the first n of them in id order if n is given."""
    ids = objects.select("object_id").distinct()
    return ids if n is None else ids.orderBy("object_id").limit(n)


def run(
    objects: DataFrame,
    meta: DataFrame,
    data: DataFrame,
    targets: DataFrame,
    batch_size: int | None = None,
    ts: Column | None = None,
    kb_path: str | None = None,
    records_path: str | None = None,
    parts: int | None = None,
    most: int | None = None,
    score_all: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Build the knowledge base of a batch and the relationships of the targets.

    Returns (knowledge base, edges, wide records); with paths they are also appended there. With `most`,
    values and tokens of more objects or lists than that are linked as classes (`operators.classes`), as it
    takes for many targets, and the classes have edges to their members, and records; with `score_all` as well, only
    values are, and lists are scored wherever they meet.
    """
    stamp = F.current_timestamp() if ts is None else ts
    batch = object_batch(objects, batch_size)
    kb = stored(build_knowledge_base(meta, data, batch, stamp))
    targets = stored(targets)
    if most is None:
        edges = stored(primary_relationships(kb, targets))
    else:
        edges = stored(whole_edges(primary_links(kb, targets, most=most, score_all=score_all)))
    records = relationship_records(kb, targets, edges, stamp, parts=parts)
    if kb_path is not None:
        append_knowledge_base(kb, kb_path)
    if records_path is not None:
        append_relationships(records, records_path)
    return kb, edges, records
