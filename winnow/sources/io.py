"""Sources and sinks."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.operators.budget import ID

CHAT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


# File kind -> Spark format and its options; malformed rows fail instead of turning NULL.
_DELIMITED = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
READERS: dict[str, tuple[str, dict]] = {
    "jsonl": ("json", {"mode": "FAILFAST"}),
    "json": ("json", {"mode": "FAILFAST"}),
    "csv": ("csv", _DELIMITED),
    "tsv": ("csv", {**_DELIMITED, "sep": "\t"}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
}


def file_kind(path: str) -> str:
    """The last name's extension in lower case; a name without one holds JSON lines."""
    _, dot, ext = os.path.basename(path.rstrip("/")).rpartition(".")
    return ext.lower() if dot else "jsonl"


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank opens an array (else: one object per line)."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return line is not None and line[0].lstrip().startswith("[")


def read_records(spark: SparkSession, path: str, fmt: str | None = None,
                 schema: T.StructType | None = None) -> DataFrame:
    """A1: read one file (or folder) of the kind named by ``fmt`` or the extension.

    CSV and TSV have a header and may quote line breaks; their columns are strings
    unless ``schema`` says otherwise.  ``.json`` is an array (also over many lines) or one
    object per line.  A malformed row raises when it is read.
    """
    kind = fmt or file_kind(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r} files; known kinds: {', '.join(READERS)}")
    name, options = READERS[kind]
    if kind == "json" and _is_json_array(spark, path):
        options = {**options, "multiLine": True}
    r = spark.read.format(name).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def find_chat_source(spark: SparkSession, base: str, name: str) -> str:
    """``{base}/{name}_data.jsonl`` first, then ``{base}/{name}/{name}_data.jsonl``."""
    places = [f"{base}/{folder}{name}_data.jsonl" for folder in ("", f"{name}/")]
    found = [p for p in places if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"chat source {name!r} is at neither of {places}")
    return found[0]


def read_chat_sources(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    """A2: all named chat sources, tagged by name; blank lines skipped, bad JSON fails."""
    out = None
    for name in names:
        path = find_chat_source(spark, base, name)
        df = (spark.read.schema(CHAT_SCHEMA).option("mode", "FAILFAST").json(path)
                   .withColumn("dataset", F.lit(name)))
        out = df if out is None else out.unionByName(df)
    return out


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: one JSON object per line, UTF-8, NULL fields written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _publish(spark: SparkSession, aside: str, path: str) -> bool:
    """Move a written folder to its name in one rename; False if another builder was first."""
    jvm = spark.sparkContext._jvm
    options = jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    fs, src = _fs(spark, aside)
    dst = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    fs.mkdirs(dst.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(src), dst, none)      # fails if the name is taken
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False


def _write_note(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def _read_note(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)                                    # Spark's readers skip names with an underscore
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def build_if_missing(spark: SparkSession, base: str, key: str, build_fn, fingerprint: str | None = None) -> DataFrame:
    """A4: build once under ``{base}/{key}`` and reuse.

    The key should name everything the build depends on (source, seed,
    fraction), so a changed parameter builds a new table instead of
    silently reusing a stale one.  ``fingerprint`` says what the input was: a table that was
    built from another one raises ``ValueError``.

    A table is written aside and published by one rename, so readers see a whole table or
    none, of several builders one wins and the others use its table, and what a killed
    builder leaves aside is never read.
    """
    path = f"{base}/{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fs, p = _fs(spark, path)
        if fs.exists(p):                                        # left by something that died while writing in place
            fs.delete(p, True)
        aside = f"{base}/_building/{uuid.uuid4().hex}"
        build_fn().write.parquet(aside)
        if fingerprint is not None:
            _write_note(spark, f"{aside}/_fingerprint", fingerprint)
        if not _publish(spark, aside, path):
            fs.delete(_fs(spark, aside)[1], True)
    held = _read_note(spark, f"{path}/_fingerprint") if fingerprint is not None else None
    if held != fingerprint:
        raise ValueError(f"{path} was built from input {held!r}, not {fingerprint!r}")
    return spark.read.parquet(path)


def id_checksum(id_col: str = ID):
    """Order-free checksum of the ids: XOR of the first 60 bits of their md5."""
    return F.bit_xor(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long"))


def selection_manifest(sel: DataFrame, method: str, budget: float, ids_path: str | None = None,
                       id_col: str = ID) -> DataFrame:
    """A5: one summary row; the selected ids stay a table (written to ``ids_path``)."""
    if ids_path:
        sel.select(id_col).write.mode("overwrite").parquet(ids_path)
        sel = sel.sparkSession.read.parquet(ids_path)
    return sel.agg(F.count(F.lit(1)).alias("num_selected"),
                   id_checksum(id_col).alias("id_checksum"),
                   F.min(F.col(id_col)).alias("min_id"),
                   F.max(F.col(id_col)).alias("max_id")) \
              .select(F.lit(method).alias("method"), F.lit(float(budget)).alias("budget"),
                      "num_selected", "id_checksum", "min_id", "max_id")


def dataset_sizes(train: DataFrame, val: DataFrame | None = None) -> DataFrame:
    """``(split, n)`` row counts."""
    t = train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("split"), "n")
    if val is None:
        return t
    v = val.agg(F.count(F.lit(1)).alias("n")).select(F.lit("validation").alias("split"), "n")
    return t.unionByName(v)
