"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str,
               strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON lines with a declared schema -> (good, bad).

    Lenient (default): blank lines are skipped; a malformed line becomes a ``bad`` row
    with its raw text. Every key of the schema is read through VARIANT, so a missing key
    and an explicit null stay distinguishable: ``<col>__present`` says whether the key
    exists. Strict mode fails the job on the first line that is no JSON object.
    """
    raw, is_obj, cols = _json_lines(spark, path, schema)
    raw = raw.filter(F.length(py_strip("value")) > 0)
    if strict:
        v = F.when(is_obj, F.try_parse_json("value")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "value")))
        good = raw.withColumn("_v", v)
        bad = raw.limit(0).select("value", "_file")
    else:
        parsed = raw.withColumn("_v", F.try_parse_json("value")).withColumn("_ok", is_obj)
        bad = parsed.filter(~F.col("_ok")).select("value", "_file")
        good = parsed.filter(F.col("_ok"))
    return good.select(*cols, "_file"), bad


def _json_lines(spark: SparkSession, path: str, schema: T.StructType | str):
    """Lines with their file, whether a line is a JSON object, and the schema's columns of its variant ``_v``."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"))
    v = F.try_parse_json("value")
    cols = []
    for f in st.fields:
        path_ = "$." + f.name if f.name.isidentifier() else f"$['{f.name}']"
        present = F.variant_get(F.col("_v"), path_, "variant").isNotNull()
        cols.append(F.try_variant_get(F.col("_v"), path_, f.dataType.simpleString()).alias(f.name))
        cols.append(present.alias(f"{f.name}__present"))
    return raw, v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT")), cols


def split_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, out: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """S1 with its counts from the one scan: writes good and bad lines to folders of ``out`` (Parquet) in one job and
    returns (good, bad, {"lines", "good", "bad", "blank"}). Columns as in ``read_jsonl``."""
    from pyspark.sql import Observation
    raw, is_obj, cols = _json_lines(spark, path, schema)
    kind = F.when(F.length(py_strip("value")) == 0, "blank").when(is_obj, "good").otherwise("bad")
    seen = Observation("lines")
    lines = raw.withColumn("_kind", kind).withColumn("_v", F.try_parse_json("value")).observe(
        seen, F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("_kind") == k).alias(k) for k in ("good", "bad", "blank")])
    text = F.when(F.col("_kind") == "bad", F.col("value")).alias("value")
    (lines.where("_kind <> 'blank'").select(F.struct(*cols).alias("row"), text, "_file", "_kind")
        .write.mode("overwrite").partitionBy("_kind").parquet(out))
    back = spark.read.schema(lines.select(F.struct(*cols).alias("row"), text, "_file", "_kind").schema).parquet(out)
    return (back.where("_kind = 'good'").select("row.*", "_file"), back.where("_kind = 'bad'").select("value", "_file"),
            {k: int(n) for k, n in seen.get.items()})


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S3: dispatch on the extension: parquet, jsonl/json, csv, tsv; anything else is an error."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if ext == "parquet":
        return r.parquet(path)
    if ext in ("jsonl", "json"):
        return r.json(path)
    if ext == "csv":
        return r.option("header", True).csv(path)
    if ext == "tsv":
        return r.option("header", True).option("sep", "\t").csv(path)
    raise ValueError(f"unsupported file type: {path}")


def read_model_results(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """A glob of per-model result files; model = file name up to the first '_',
    method = 'cot' when the name contains it, else 'direct'."""
    df = spark.read.schema(schema).json(pattern)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return df.select("*", F.split_part(name, F.lit("_"), F.lit(1)).alias("model"),
                     F.when(name.contains("cot"), "cot").otherwise("direct").alias("method"))


def read_parquet_glob(spark: SparkSession, pattern: str, max_files: int | None = None) -> DataFrame:
    """Parquet files matching a glob, optionally only the first ``max_files`` (sorted)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = fs.globStatus(hpath) or []
    paths = sorted(str(s.getPath().toString()) for s in statuses)
    if max_files:
        paths = paths[:max_files]
    if not paths:
        raise FileNotFoundError(pattern)
    return spark.read.parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))


def nested_section(df: DataFrame, language: str, sections: str = "languages") -> DataFrame:
    """The items of the first ``languages[]`` entry whose language matches, as rows;
    a missing language gives no rows."""
    first = F.try_element_at(F.filter(F.col(sections), lambda s: s["language"] == F.lit(language)), F.lit(1))
    return df.select(F.inline(first["items"]))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one string (e.g. the instruction prompt)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


# ------------------------------------------------------------------ sinks ---------

def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """K1/K2/K5/K6: JSON lines, UTF-8, explicit nulls kept; ``partition_by=['split']``
    writes train/test folders; ``mode='append'`` adds rows as they are (see ``append_results`` for reruns)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def append_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """K5: adds finished results so that a rerun of the same work replaces what it wrote before.

    ``keys`` (a run, a batch) are folders; a write replaces the folders that it has rows for and leaves
    all others, and a job that fails on its way leaves none."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
       .partitionBy(*keys).json(path))


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """K3: predictions as CSV / TSV with a header."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K4: a one-row metrics summary as JSON (nested values such as a matrix stay nested)."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sentences(df: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """K7: sentence parquet, bounded file size."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(path)


def verify_count(spark: SparkSession, df_written: DataFrame, path: str, fmt: str = "json") -> tuple[int, int]:
    """K8: rows written (an Observation on the write) vs rows read back."""
    from pyspark.sql import Observation
    obs = Observation("written")
    observed = df_written.observe(obs, F.count(F.lit(1)).alias("n"))
    observed.write.mode("overwrite").format(fmt).option("ignoreNullFields", "false").save(path)
    back = spark.read.format(fmt).load(path).count()
    return int(obs.get["n"]), int(back)
