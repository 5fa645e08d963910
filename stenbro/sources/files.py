"""File sources and sinks in the formats of the domain's tables; all return DataFrames with string columns unless told.

Readers take folders as the writers leave them (one part a task) and single files alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def _headed(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """CSV with a header, of which a byte order mark is no part; values may hold line breaks, so a part is one task."""
    raw = spark.read.csv(path, sep=sep, header=True, encoding="UTF-8", inferSchema=False, escape='"', multiLine=True)
    return raw.toDF(*[c.replace(BOM, "") for c in raw.columns])


def labels(spark: SparkSession, path: str, *columns: str, joint: str = " - ") -> DataFrame:
    """The labels of a `;`-separated list: names of columns are trimmed and put in lower case, their values joined."""
    raw = _headed(spark, path, ";")
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return named.select(F.concat_ws(joint, *(columns or named.columns[:2])).alias("label"))


def postal_codes(spark: SparkSession, path: str) -> DataFrame:
    """`;`-separated list of codes and towns, plus the joined label."""
    raw = _headed(spark, path, ";")
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return named.withColumn("label", F.concat_ws(" ", *[F.trim(c) for c in named.columns[:2]]))


def all_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with every column a string and no NULLs."""
    return _headed(spark, path, sep).na.fill("")


def typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with the types of a stated schema; values that don't fit are NULL."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


def url_list(spark: SparkSession, path: str, column: str = "fundet_url") -> DataFrame:
    """`;`-separated list that must have the address column; rows without an address are left out."""
    raw = _headed(spark, path, ";")
    if column not in raw.columns:
        raise ValueError(f"no column {column!r}")
    return raw.na.drop(subset=[column])


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that begin with http, trimmed."""
    return spark.read.text(path).where(F.col("value").startswith("http")).select(F.trim("value").alias("url"))


def place_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines 'url[,name[,phone]]'; comments and blank lines are left out."""
    parts = F.split("value", ",")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("url", "name", "phone"))])


def _decoded(content: Column) -> Column:
    """Bytes as UTF-8 (without a byte order mark) if they are that, else as Windows-1252: Latin-1 with more letters."""
    more = [(chr(b), letter) for b in range(0x80, 0xA0) if (letter := bytes([b]).decode("cp1252", "ignore"))]
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in more), "".join(b for _, b in more))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), latin), f"^{BOM}", "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files in either encoding; a file is decoded as a whole, so files are small (lists, indexes)."""
    found = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike("/[_.][^/]*$"))
    return found.select(F.explode(F.split(_decoded(F.col("content")), r"\r?\n")).alias("value")).where("value <> ''")


def decoded_csv(spark: SparkSession, path: str, columns: list[str], defaults: dict[str, str], sep: str = ",") -> DataFrame:
    """Plain CSV without a header in either encoding, with columns that are missing added."""
    parts = F.split("value", sep)
    rows = _lines(spark, path).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in columns})


def decoded_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a line, in either encoding."""
    return _lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents as variants, one a line, zipped or not; lines that aren't JSON give NULL."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("document"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", bom: bool = False) -> None:
    """CSV with a header; with a column list: these columns in this order, missing ones and NULLs as ''.

    `bom`: each part begins with a byte order mark, as part of its first column's name.
    """
    if columns:
        df = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])
    if bom:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_text(df: DataFrame, path: str, encoding: str = "UTF-8", gzip: bool = False) -> None:
    """Lines of the one column `value`."""
    writer = df.select("value").write.mode("overwrite")
    if encoding == "UTF-8":
        writer.text(path, compression="gzip" if gzip else "none")
    else:
        writer.csv(path, encoding=encoding, quote="", sep="\x01", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key of both."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")
