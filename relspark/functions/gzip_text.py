"""Gzip blobs to text and back, Arrow batches at a time. Spark has no such function.

`decode_results` hands texts on as they come, so what a batch unpacks to is never held, however well it was packed.
It takes a Python process of its own, so `gunzip_text` is there for several columns. A blob that cannot be unpacked, or is not UTF-8, gives NULL; `unreadable` counts such rows.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions.arrow_slices import SLICE_BYTES, by_slices

#: Bytes of blobs unpacked at once; texts are several times as long.
BLOB_BYTES = 1 << 18


def _unpacked(blob: bytes | None) -> str | None:
    try:
        return None if blob is None else gzip.decompress(blob).decode("utf-8")
    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
        return None


def _packed(text: str | None) -> bytes | None:
    return None if text is None else gzip.compress(text.encode("utf-8"), mtime=0)


@F.arrow_udf(T.StringType())
def gunzip_text(blobs: pa.Array) -> pa.Array:
    return by_slices(lambda some: pa.array([_unpacked(b) for b in some.to_pylist()], pa.string()), blobs, BLOB_BYTES)


@F.arrow_udf(T.BinaryType())
def gzip_text(texts: pa.Array) -> pa.Array:
    return by_slices(lambda some: pa.array([_packed(t) for t in some.to_pylist()], pa.binary()), texts)


def unpacked_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts of batches of blobs in order, about SLICE_BYTES at a time besides the longest one."""
    for blobs in batches:
        texts, size = [], 0
        for blob in blobs:
            texts.append(_unpacked(blob.as_py()))
            size += len(texts[-1] or "") + 64
            if size >= SLICE_BYTES:
                yield pa.array(texts, pa.string())
                texts, size = [], 0
        if texts:
            yield pa.array(texts, pa.string())


_gunzip_results = F.arrow_udf(unpacked_texts, T.StringType())


def decode_results(data: DataFrame) -> DataFrame:
    """Result rows with `results` as text; gzip blobs are unpacked, text is kept."""
    if isinstance(data.schema["results"].dataType, T.BinaryType):
        return data.withColumn("results", _gunzip_results("results"))
    return data


def unreadable(data: DataFrame) -> DataFrame:
    """(service_name, n_results, n_undecodable, n_unparsable) of the results of each service.

    Undecodable blobs are no gzip or no UTF-8 text, unparsable ones decode to something that is no JSON.
    """
    given = data.withColumn("_given", F.col("results").isNotNull())
    text = decode_results(given).select("service_name", "_given", "results")
    parsed = F.try_parse_json("results")
    return text.groupBy("service_name").agg(
        F.count_if("_given").alias("n_results"),
        F.count_if(F.col("_given") & F.col("results").isNull()).alias("n_undecodable"),
        F.count_if(F.col("results").isNotNull() & parsed.isNull()).alias("n_unparsable"),
    )
