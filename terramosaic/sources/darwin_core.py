"""Occurrence sources: Darwin Core archives and Parquet snapshots."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terramosaic.operators.occurrences import in_box
from terramosaic.types import Bbox

NAMESPACE = "{http://rs.tdwg.org/dwc/text/}"
CORE = ("decimalLatitude", "decimalLongitude", "scientificName", "taxonKey", "individualCount")
#: Columns with a type of their own; others are inferred.
TYPES = {"decimallatitude": "double", "decimallongitude": "double", "scientificname": "string", "taxonkey": "bigint", "individualcount": "int"}
#: Standard column names, found in lower case in Parquet snapshots.
STANDARD_NAMES = """
decimalLatitude decimalLongitude taxonKey scientificName individualCount catalogNumber hasGeospatialIssues speciesKey
acceptedTaxonKey kingdomKey phylumKey classKey orderKey familyKey genusKey subgenusKey verbatimScientificName countryCode
gbifID datasetKey occurrenceID eventDate basisOfRecord publishingOrgKey coordinateUncertaintyInMeters coordinatePrecision
stateProvince iucnRedListCategory
""".split()
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus")


@dataclass(frozen=True)
class Descriptor:
    """What an archive's meta.xml says of its core file."""

    location: str
    separator: str
    quote: str
    encoding: str
    has_header: bool
    columns: tuple[str, ...]
    defaults: dict[str, str]


def term_name(uri: str) -> str:
    """The last part of a term URI."""
    return uri.rsplit("/", 1)[-1].rsplit("#", 1)[-1]


def unescaped(value: str) -> str:
    return value.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r")


def parse_descriptor(xml: str) -> Descriptor:
    """Read a meta.xml text. A missing core or location is an error.

    Columns go by index; gaps are ``col_i``, and the id column is ``id`` unless
    a field names it. Fields without an index are constants.
    """
    root = ET.fromstring(xml)
    core = root.find(f"{NAMESPACE}core")
    core = root.find("core") if core is None else core
    if core is None:
        raise ValueError("the descriptor has no core")

    def child(node: ET.Element, name: str) -> list[ET.Element]:
        return node.findall(f"{NAMESPACE}{name}") + node.findall(name)

    locations = [x.text.strip() for files in child(core, "files") for x in child(files, "location") if x.text and x.text.strip()]
    if not locations:
        raise ValueError("the descriptor's core has no location")
    named, defaults = {}, {}
    for node in child(core, "field"):
        name = term_name(node.get("term", ""))
        if node.get("index") is not None:
            named[int(node.get("index"))] = name
        elif node.get("default") is not None:
            defaults[name] = node.get("default")
    for node in child(core, "id"):
        if node.get("index") is not None:
            named.setdefault(int(node.get("index")), "id")
    columns = tuple(named.get(i, f"col_{i}") for i in range(max(named, default=-1) + 1))
    return Descriptor(locations[0], unescaped(core.get("fieldsTerminatedBy", ",")), core.get("fieldsEnclosedBy", '"'), core.get("encoding", "UTF-8"), int(core.get("ignoreHeaderLines", "0") or 0) >= 1, columns, defaults)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file through Spark's file systems, or None if it is not there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    rows = spark.read.option("wholetext", True).text(path).head(1)
    return rows[0][0] if rows else ""


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """The core file of an archive with the descriptor's columns; UTF-8 only."""
    xml = read_text(spark, f"{path}/meta.xml")
    if xml is None:
        raise FileNotFoundError(f"{path}/meta.xml")
    meta = parse_descriptor(xml)
    if meta.encoding.replace("-", "").lower() != "utf8":
        raise ValueError(f"encoding {meta.encoding} is not supported")
    schema = ", ".join(f"`{c}` {TYPES.get(c.lower(), 'string')}" for c in meta.columns)
    df = spark.read.schema(schema).option("sep", meta.separator).option("header", meta.has_header).option("quote", meta.quote).option("escape", meta.quote or "\0").option("enforceSchema", True).csv(f"{path}/{meta.location}")
    for name, value in meta.defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(TYPES.get(name.lower(), "string")))
    return df


def rename_standard(df: DataFrame) -> DataFrame:
    """Lower-case standard names to their usual spelling; absent ones are ignored, unknown ones kept."""
    usual = {n.lower(): n for n in STANDARD_NAMES}
    return df.toDF(*(usual.get(c, c) if c == c.lower() else c for c in df.columns))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, folder or glob with usual names; taxonKey strictly a whole number."""
    df = rename_standard(spark.read.parquet(path))
    return df.withColumn("taxonKey", F.col("taxonKey").cast("bigint")) if "taxonKey" in df.columns else df


def scan(spark: SparkSession, path: str) -> DataFrame:
    """An archive if the folder holds a meta.xml, otherwise Parquet."""
    is_pattern = any(c in path for c in "*?[{")
    if not is_pattern and read_text(spark, f"{path.rstrip('/')}/meta.xml") is not None:
        return scan_archive(spark, path.rstrip("/"))
    return scan_parquet(spark, path)


def named_taxon(df: DataFrame, name: str) -> DataFrame:
    """Rows where one of the rank columns present equals ``name`` (opt-in)."""
    ranks = [c for c in df.columns if c.lower() in RANKS]
    if not ranks:
        raise ValueError("no rank column to filter by")
    test = F.lit(False)
    for rank in ranks:
        test = test | F.coalesce(F.col(f"`{rank}`") == name, F.lit(False))
    return df.where(test)


def occurrences(df: DataFrame, box: Bbox, limit: int | None = None, taxon: str = "") -> DataFrame:
    """Box filter, then limit, then the five core columns."""
    df = in_box(df, box)
    if taxon:
        df = named_taxon(df, taxon)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*CORE)
