"""Schemas of the stored tables and the catalogue of features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING = T.StringType()

OBJECTS = T.StructType([T.StructField("object_id", STRING)])

RESULTS_META = T.StructType(
    [T.StructField("object_id", STRING), T.StructField("service_name", STRING)]
)

RESULTS_DATA = T.StructType(
    [
        T.StructField("object_id", STRING),
        T.StructField("service_name", STRING),
        T.StructField("results", T.BinaryType()),
    ]
)

KNOWLEDGE_BASE = T.StructType(
    [
        T.StructField("object_id", STRING),
        T.StructField("feature_type", STRING),
        T.StructField("feature_value", STRING),
        T.StructField("ts", T.TimestampType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("object_id", STRING),
        T.StructField("other_id", STRING),
        T.StructField("feature_type", STRING),
        T.StructField("weight", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

MATCHES = T.ArrayType(
    T.StructType(
        [T.StructField("sha256", STRING), T.StructField("weight", T.DoubleType())]
    )
)

FEATURE_ARRAY = T.StructType(
    [
        T.StructField("object_id", STRING),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)

TRAINING_SET = T.StructType(
    [
        T.StructField("object_id", STRING),
        T.StructField("label", T.ArrayType(T.DoubleType())),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass(frozen=True)
class Feature:
    """How one feature type relates two objects.

    ``weight`` set: objects with an equal value are related with that weight.
    ``weight`` None: the value is a comma list and the weight is the overlap score.
    ``column`` is the name of the feature in the wide relationship record.
    """

    name: str
    weight: float | None
    column: str

    @property
    def exact(self) -> bool:
        return self.weight is not None


# Feature types, their weights and record columns.
FEATURES = (
    Feature("pehash", 0.5, "pehash"),
    Feature("imphash", 0.5, "imphash"),
    Feature("binary_signature", 1.0, "binary_signature"),
    Feature("yara_rules", None, "yara_rules"),
    Feature("called_domains", None, "domain_requests"),
)


def relationships(features=FEATURES) -> T.StructType:
    """Schema of the wide relationship record for the given features."""
    return T.StructType(
        [
            T.StructField("object_id", STRING),
            T.StructField("part", T.IntegerType()),
            *[T.StructField(f.column, MATCHES) for f in features],
            T.StructField("ts", T.TimestampType()),
        ]
    )
