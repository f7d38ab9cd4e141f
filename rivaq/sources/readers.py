"""JSON editions, metadata, raw float matrices, files; and what is written back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivaq.functions import text as X
from rivaq.session import shipped

SAYINGS = "hadiths ARRAY<STRUCT<hadithnumber: DOUBLE, text: STRING, grades: ARRAY<STRUCT<name: STRING, grade: STRING>>>>"
VERSES = "quran ARRAY<STRUCT<chapter: INT, verse: INT, text: STRING>>"
INFO = "chapters ARRAY<STRUCT<chapter: INT, name: STRING, arabicname: STRING, revelation: STRING, verses: ARRAY<STRUCT<verse: INT, page: INT, juz: INT>>>>"
BODY = "STRUCT<metin: STRING, konu: STRING, dil: STRING, cihaz: STRING, yerli: BOOLEAN, anahtar: STRING, lat: STRING, lng: STRING>"
LARGEST_BODY = 200_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _list(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(field).alias("pos", "r")).select("pos", "r.*")


def sayings_edition(spark: SparkSession, path: str) -> DataFrame | None:
    """pos, hadithnumber, text, grades; None where the edition is missing, no rows where its list is."""
    return _list(spark, path, SAYINGS, "hadiths") if exists(spark, path) else None


def verses_edition(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """pos, chapter, verse, text; a missing edition is an error unless optional."""
    if optional and not exists(spark, path):
        return None
    return _list(spark, path, VERSES, "quran")


def chapter_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INFO).json(path, multiLine=True)


def json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of one JSON array, or of one record a line, which splits into many tasks."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def request_body(body: Column) -> Column:
    """The fields of a call's JSON body; null where it is too large or cut off."""
    return F.from_json(F.when(F.octet_length(body) <= LARGEST_BODY, body), BODY)


def float_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """pos, v: rows of a file of little-endian 32-bit floats on any file system, read in splits of whole rows by many tasks."""
    shipped(spark)
    records = spark.sparkContext.binaryRecords(path, 4 * width).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.frombuffer(b"".join(map(bytes, batch.b)), "<f4").reshape(len(batch), width)
            yield pd.DataFrame({"pos": batch.pos, "v": list(m)})

    return spark.createDataFrame(records, "pos long, b binary").mapInPandas(run, "pos long, v array<float>")


def optional_float_matrix(spark: SparkSession, path: str, width: int) -> DataFrame | None:
    """float_matrix(), or None where the file is missing: callers then search without vectors."""
    return float_matrix(spark, path, width) if exists(spark, path) else None


def write_float_matrix(df: DataFrame, column: str, path: str, order: str = "pos") -> None:
    """The vectors in the order given as one file of little-endian 32-bit floats on any file system. One file has one writer: for readers that want this form; keep Parquet for large sets."""
    spark = df.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"b": [np.stack(batch.v.to_numpy()).astype("<f4").tobytes()] if len(batch) else []})

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for r in df.orderBy(order).select(F.col(column).alias("v")).mapInPandas(run, "b binary").toLocalIterator():
            out.write(bytes(r.b))
    finally:
        out.close()


def localized_links(spark: SparkSession, css: str, files: str, extension: str = ".woff2") -> tuple[DataFrame, str]:
    """Files (path, ad: name by content) and a style sheet's text with its links replaced by those names."""
    text = spark.read.text(css, wholetext=True).select(F.regexp_replace("value", r"\s+$", "").alias("value"))
    links = text.select(F.explode(F.array_distinct(X.links(F.col("value"), r"url\((https://[^)]+\.woff2)\)"))).alias("url"))
    names = spark.read.format("binaryFile").load(files).select("path", X.content_name(F.col("content"), extension).alias("ad"))
    pairs = links.join(names, F.substring_index("url", "/", -1) == F.substring_index("path", "/", -1))
    out = text.head()[0]
    for r in pairs.select("url", "ad").collect():  # the links of one style sheet
        out = out.replace(r.url, f"fonts/{r.ad}")
    return names, out


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")


def answers(df: DataFrame, name: str = "yanit") -> DataFrame:
    """Each row as one JSON text, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_records(df: DataFrame, path: str, as_json: bool = False) -> None:
    """The whole of df in place of what was there."""
    (df.write.mode("overwrite").json if as_json else df.write.mode("overwrite").parquet)(path)

