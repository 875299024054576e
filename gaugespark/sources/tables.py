"""Readers with declared schemas, and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_lower(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (plain or gzip) with a header, all text, column names lower-cased."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.toDF(*[c.lower() for c in df.columns])


def csv_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of text whose empty fields stay empty texts."""
    df = spark.read.csv(path, header=True, schema=schema, emptyValue="")
    return df.na.fill("")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def layout(text: str) -> dict[str, tuple[int, int, bool]]:
    """name -> (first, last, is text) of the items of an INPUT statement (of the whole text without one).

    An item is a place, a name and a format ("@1 NAME $5."), or a name with a
    span or a single place ("NAME $ 1-5", "NAME 7"); the first of a name counts.
    """
    statement = text.upper().partition("INPUT")
    tokens = re.findall(r"@|-|;|\$|\d+\.\d*|\.\d+|\w+", statement[2] if re.search(r"\bINPUT\b", text.upper()) else text.upper())
    out, at = {}, 0
    while at < len(tokens) and tokens[at] != ";":
        if tokens[at] == "@" and len(tokens) > at + 3:
            first, name = int(tokens[at + 1]), tokens[at + 2]
            char = tokens[at + 3] == "$"
            width = tokens[at + 3 + char].split(".")[0]
            out.setdefault(name, (first, first + int(width) - 1, char))
            at += 4 + char
        elif re.fullmatch(r"[A-Z_]\w*", tokens[at]):
            name, char = tokens[at], tokens[at + 1 : at + 2] == ["$"]
            at += 1 + char
            if tokens[at : at + 1] and tokens[at].isdigit():
                first = last = int(tokens[at])
                at += 1
                if tokens[at : at + 1] == ["-"]:
                    last = int(tokens[at + 1])
                    at += 2
                out.setdefault(name, (first, last, char))
        else:
            at += 1
    return out


def fixed_width(spark: SparkSession, path: str, spans: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """Columns at 1-based places; numbers that are ".", blank or all 8s or 9s are missing."""
    columns = []
    for name, (first, last, text) in spans.items():
        raw = F.trim(F.substring("value", first, last - first + 1))
        filled = raw.rlike("^(8+|9+)$") & (F.length(raw) == last - first + 1) & F.lit(last > first)
        columns.append((F.when(raw != "", raw) if text else F.when(~filled, raw.try_cast("double"))).alias(name))
    return spark.read.text(path).select(*columns)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 and content of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def unverified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose hash the manifest (sha256) doesn't list."""
    return files.join(manifest.select("sha256"), "sha256", "left_anti")


def guarded(df: DataFrame, licence: str, most_rows: int, key: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """df, unless it may not be used: its licence file is missing or empty, it has more than most_rows
    rows, or a key that the allowed table (key) doesn't list."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(licence)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not folder.exists(path) or not folder.getFileStatus(path).getLen():
        raise PermissionError(f"no licence file {licence}")
    n = df.limit(most_rows + 1).count()
    if n > most_rows:
        raise PermissionError(f"more than {most_rows} rows")
    if allowed is not None and not df.join(allowed.select(key), key, "left_anti").isEmpty():
        raise PermissionError(f"a {key} that isn't allowed")
    return df


def to_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces only the partitions that df has, where by is given."""
    writer = df.write.option("compression", "zstd")
    if by:
        writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("overwrite").parquet(path)


def to_csv(df: DataFrame, path: str) -> None:
    """Intervals (arrays of two numbers) become columns name_low and name_high."""
    flat = []
    for name, kind in df.dtypes:
        flat += [F.col(name)[0].alias(f"{name}_low"), F.col(name)[1].alias(f"{name}_high")] if kind == "array<double>" else [F.col(name)]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def to_json(df: DataFrame, path: str) -> None:
    """NaN and infinite numbers become null."""
    clean = [F.when(~(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*clean).write.mode("overwrite").json(path, ignoreNullFields=False)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, length, sha256 and text of the members of ZIP archives.

    An archive is read whole by one task, so its size must fit one; archives
    are spread over tasks.
    """

    def unpacked(batches):
        import hashlib
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        data = archive.read(name)
                        yield pd.DataFrame({"path": [where], "member": [name], "length": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()], "text": [data.decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpacked, "path string, member string, length long, sha256 string, text string")


def xport(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SAS transport files, upper-cased columns; each file is read whole by one task."""
    names = [part.split()[0] for part in schema.split(",")]

    def read(batches):
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                df = pd.read_sas(io.BytesIO(content), format="xport", encoding="latin-1")
                df.columns = [c.upper() for c in df.columns]
                for c in df.select_dtypes("float").columns:  # zeros are read as the least number of the format
                    df[c] = df[c].mask(df[c].abs() < 1e-70, 0.0)
                yield df.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)
