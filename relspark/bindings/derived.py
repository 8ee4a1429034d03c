"""Service results that Spark derives from the given tables, row by row.

Documents and pages play the analysed objects. Their JSON results have the shapes the services
write, so the jobs run on them as they would on real results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.functions.gzip_text import gzip_text

LINK = 'href="([^"]*)"'
SECTION_NAMES = (".text\0\0\0", ".data\0\0\0", ".rsrc\0\0\0", ".rdata\0\0", ".reloc\0\0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small table out to all cores; a table with enough splits is left as is.

    For text that is costly to process but lies in fewer files than there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def pages_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", *columns), "page_id")


def doc_id() -> Column:
    return F.concat(F.lit("doc-"), F.col("doc_id"))


def page_id() -> Column:
    return F.concat(F.lit("page-"), F.col("page_id"))


def lines() -> Column:
    return F.split("text", "\n")


def links() -> Column:
    return F.regexp_extract_all("html", F.lit(LINK), F.lit(1))


def _rows(df: DataFrame, object_id: Column, service: str, results: Column) -> DataFrame:
    return df.select(
        object_id.alias("object_id"), F.lit(service).alias("service_name"), results.alias("results")
    )


def peinfo_results(documents: DataFrame) -> DataFrame:
    """Hashes, signature, timestamp, sections and imports of a document's text.

    French documents have an undefined pehash and no timestamp, German ones a numeric imphash, version
    records one level deeper, and sections and a timestamp spread over deeper members, Spanish ones no signature and no sections.
    """
    lang = F.col("lang")
    names = F.array(*[F.lit(n) for n in SECTION_NAMES])

    def section(line: Column, i: Column) -> Column:
        return F.struct(
            F.get(names, i % len(SECTION_NAMES)).alias("section_name"),
            (F.length(line) / 8).alias("entropy"),
            F.concat(F.lit("0x"), F.hex(F.length(line) * 4096 + i)).alias("virt_address"),
            F.size(F.split(line, " ")).alias("virt_size"),
            F.length(line).alias("size"),
        )

    key = F.when(lang == "es", F.lit("Comment")).otherwise(F.lit("Signature"))
    info = F.array(
        F.struct(F.lit("Language").alias("key"), lang.alias("value")),
        F.struct(key.alias("key"), F.concat_ws("-", lang, "source").alias("value")),
    )
    imports = F.transform(
        lines(),
        lambda l: F.struct(lang.alias("dll"), F.get(F.split(l, " "), F.lit(0)).alias("function")),
    )
    stamp = F.when(lang != "fr", F.struct(F.col("n_chars").alias("timestamp")))
    sections = F.when(lang != "es", F.transform(lines(), section))
    pehash = F.when(lang == "fr", F.lit("Undefined")).otherwise(F.md5("text"))

    def spread_out(line: Column, i: Column) -> Column:
        flat = section(line, i)
        header = F.struct(flat["section_name"].alias("section_name"), flat["virt_address"].alias("virt_address"))
        sizes = F.struct(flat["virt_size"].alias("virt_size"), flat["size"].alias("size"))
        stats = F.struct(flat["entropy"].alias("entropy"), sizes.alias("sizes"))
        return F.struct(header.alias("header"), stats.alias("stats"))

    deep_sections = F.array(F.struct(F.transform(lines(), spread_out).alias("entries")))
    deep_stamp = F.struct(F.struct(F.col("n_chars").alias("timestamp")).alias("header"))

    def result(imphash: str, info: Column, stamp: Column, sections: Column) -> Column:
        return F.to_json(
            F.struct(
                pehash.alias("pehash"),
                F.col(imphash).alias("imphash"),
                info.alias("version_info"),
                stamp.alias("timestamp"),
                sections.alias("pe_sections"),
                imports.alias("imports"),
            )
        )

    deeper = F.struct(F.array(F.struct(info.alias("StringFileInfo"))).alias("children"))
    text = F.when(lang == "de", result("n_chars", deeper, deep_stamp, deep_sections)).otherwise(
        result("source", info, stamp, sections)
    )
    return _rows(documents, doc_id(), "peinfo", text)


def yara_results(pages: DataFrame) -> DataFrame:
    """Each link of a page is a matched rule."""
    rules = F.transform(links(), lambda l: F.struct(l.alias("rule")))
    return _rows(pages, page_id(), "yara", F.to_json(F.struct(rules.alias("yara"))))


def sandbox_results(pages: DataFrame) -> DataFrame:
    """Each link of a page is a requested URL; every second record lies one level deeper."""

    def record(link: Column, i: Column) -> Column:
        data = F.struct(F.struct(link.alias("url")).alias("arguments"))
        return F.struct(
            F.when(i % 2 == 0, data).alias("Data"),
            F.when(i % 2 == 1, F.struct(data.alias("Data"))).alias("calls"),
        )

    behavior = F.transform(links(), record)
    return _rows(pages, page_id(), "CUCKOO", F.to_json(F.struct(behavior.alias("behavior"))))


def scan_results(documents: DataFrame) -> DataFrame:
    """Each line of a document is one vendor's detection name; empty lines are null.

    In French documents the names lie one level deeper.
    """
    vendors = F.transform(lines(), lambda l, i: F.concat(F.lit("Vendor"), i))
    names = F.transform(lines(), lambda l: F.struct(F.nullif(l, F.lit("")).alias("result")))
    deeper = F.transform(names, lambda n: F.struct(n.alias("detail")))

    def report(scans: Column) -> Column:
        return F.to_json(F.struct(F.map_from_arrays(vendors, scans).alias("scans")))

    text = F.when(F.col("lang") == "fr", report(deeper)).otherwise(report(names))
    return _rows(documents, doc_id(), "virustotal", text)


def disassembly_results(documents: DataFrame) -> DataFrame:
    """Each line of a document is a section whose opcodes are its words; empty lines are null."""
    sections = F.transform(
        lines(), lambda l: F.struct(F.when(l != "", F.split(l, " ")).alias("opcodes"))
    )
    options = {"ignoreNullFields": "false"}
    text = F.to_json(F.struct(sections.alias("sections")), options)
    return _rows(documents, doc_id(), "objdump", text)


def knowledge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, result metadata, gzip result data) of all documents and pages."""
    pages = pages_of(spark, sf_dir, "html")
    documents = documents_of(spark, sf_dir, "text", "lang", "source", "n_chars")
    data = peinfo_results(documents).unionByName(yara_results(pages))
    data = data.unionByName(sandbox_results(pages))
    ids = table(spark, sf_dir, "documents").select(doc_id().alias("object_id"))
    page_ids = table(spark, sf_dir, "pages").select(page_id().alias("object_id"))
    services = ((ids, "peinfo"), (page_ids, "yara"), (page_ids, "CUCKOO"))
    meta = None
    for objects, service in services:
        rows = objects.withColumn("service_name", F.lit(service))
        meta = rows if meta is None else meta.unionByName(rows)
    return ids.unionByName(page_ids), meta, data.withColumn("results", gzip_text("results"))


def document_inputs(
    spark: SparkSession, sf_dir: str, service: str, make
) -> tuple[DataFrame, DataFrame]:
    """(result metadata, result data as text) of one service over all documents."""
    data = make(documents_of(spark, sf_dir, "text", "lang", "source", "n_chars"))
    ids = table(spark, sf_dir, "documents").select(doc_id().alias("object_id"))
    return ids.withColumn("service_name", F.lit(service)), data
