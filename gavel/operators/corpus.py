"""Sentence corpus and sampled translation prompts.

Neighbour sentences are read from the article's own line array (no window, no
shuffle), so one huge article costs one row's work, not one task's sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col_, paragraph
from .metrics import exact_percentiles
from .ordering import seeded_hash, top_n_per_group

# --- fixed values: few-shot prompt format -------------------------------------------
FEWSHOT_HEADER = "Translate the following {source_label} sentences to {target_label}.\n\n"
# --- end of fixed values ------------------------------------------------------------


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated text -> one row per article: (lines, file, group_id).

    Records end at ``\\n\\n``, or at ``\\n\\r\\n`` in files with CRLF line ends (each file is
    read by the separator that its first bytes show); more newlines in a row leave empty
    lines inside a record, which the line filter drops. ``group_id`` is the file's path, the
    record's content hash and its number among equal records of the file: it does not depend
    on how files are split.
    """
    names = F.col("_metadata.file_path").alias("file")
    # one flag per file, from its first record only
    crlf = (spark.read.option("lineSep", "\n").text(path).select("value", names, F.col("_metadata.file_block_start").alias("at"))
            .where("at = 0").groupBy("file").agg(F.max(F.col("value").endswith("\r")).alias("crlf")))
    parts = None
    for flag, sep in ((False, "\n\n"), (True, "\n\r\n")):
        part = (spark.read.option("lineSep", sep).text(path).select("value", names)
                .join(crlf.where(F.col("crlf") == flag).select("file"), "file", "left_semi"))
        parts = part if parts is None else parts.unionByName(part)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    arts = parts.select(lines.alias("lines"), "file").filter(F.size("lines") > 0)
    arts = arts.withColumn("_h", F.sha2(F.array_join("lines", "\n"), 256))
    again = F.row_number().over(Window.partitionBy("file", "_h").orderBy("_h"))
    return arts.withColumn("group_id", F.concat_ws("#", "file", "_h", again.cast("string"))).drop("_h")


def sentences_with_context(df: DataFrame, group_col: str, lines_col: str, keep: list[str] | None = None) -> DataFrame:
    """(group, pos, sentence, prev_sentence, next_sentence); null at article edges.

    The neighbours come from the line array itself, before any sampling."""
    arr = col_(lines_col)
    structs = F.transform(arr, lambda x, i: F.struct(
        i.alias("pos"), x.alias("sentence"),
        F.when(i > 0, F.element_at(arr, i)).alias("prev_sentence"),
        F.when(i + 1 < F.size(arr), F.element_at(arr, i + 2)).alias("next_sentence")))
    return df.select(*(keep or []), F.col(group_col), F.inline(structs))


def doc_lines(text_col: str) -> F.Column:
    """Non-empty lines of a text (the article's sentences)."""
    return F.filter(F.split(F.col(text_col), "\n"), lambda x: x != "")


def article_ids_by_blank_lines(lines: DataFrame, file_col: str, line_col: str, text_col: str) -> DataFrame:
    """W4 (parity form): group id = running count of blank lines per file.

    Prefer :func:`read_articles`, which needs no ordered window."""
    blank = (col_(text_col).isNull() | (col_(text_col) == "")).cast("long")
    w = Window.partitionBy(file_col).orderBy(line_col).rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumn("group_id", F.coalesce(F.sum(blank).over(w), F.lit(0)))
    return out.filter(~(col_(text_col).isNull() | (col_(text_col) == "")))


def stratified_sample(sentences: DataFrame, file_col: str, group_col: str, n_samples: int,
                      key_cols: list[str], seed: int = 42) -> DataFrame:
    """L4: quota per file = floor(N / files); per group = max(1, floor(quota / groups in
    file)); groups smaller than that are taken whole; order inside a group is
    md5(key | seed). Skew-safe top-n per group."""
    per_file = sentences.groupBy(file_col).agg(F.countDistinct(group_col).alias("_groups"))
    n_files = per_file.agg(F.count(F.lit(1)).alias("_files"))
    quota = per_file.crossJoin(n_files).select(
        file_col, F.greatest(F.lit(1), F.floor(F.floor(F.lit(n_samples) / F.col("_files")) / F.col("_groups")))
        .cast("long").alias("_q"))
    # a file may hold most sentences: its rows are dealt to several join keys
    salts = 32
    quota = quota.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = sentences.withColumn("_salt", F.pmod(F.xxhash64(*key_cols), F.lit(salts)).cast("int"))
    s = salted.join(quota, [file_col, "_salt"]).drop("_salt").withColumn("_h", seeded_hash(*key_cols, seed=seed))
    out = top_n_per_group(s, [file_col, group_col], ["_h"] + key_cols, "_q", name="_rn", salt_cols=key_cols)
    return out.drop("_q", "_h", "_rn")


def with_paragraph(df: DataFrame) -> DataFrame:
    """X27 + X38: paragraph = prev + sentence + next, and its length."""
    out = df.withColumn("paragraph", paragraph("prev_sentence", "sentence", "next_sentence"))
    return out.withColumn("lenght", F.length("paragraph"))


def length_band(df: DataFrame, col: str = "lenght", lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """A16 + F10: keep rows strictly between the lower and upper exact percentiles."""
    q = exact_percentiles(df, col, [lower, upper])
    lo, hi = q.columns
    return (df.crossJoin(F.broadcast(q))  # one row
              .filter((F.col(col) > F.col(lo)) & (F.col(col) < F.col(hi))).drop(lo, hi))


def fewshot_header(aligned: DataFrame, src_col: str, tgt_col: str, order_col: str, k: int,
                   source_label: str, target_label: str) -> DataFrame:
    """A one-row frame with the header built from the first k aligned rows."""
    first = aligned.orderBy(order_col).limit(k)  # k rows: a parameter
    ex = F.concat(F.lit(f"{source_label}: "), F.col(src_col), F.lit(f"\n{target_label}: "), F.col(tgt_col), F.lit("\n\n"))
    rows = first.select(F.col(order_col).alias("_o"), ex.alias("_ex"))
    head = FEWSHOT_HEADER.format(source_label=source_label, target_label=target_label)
    agg = rows.agg(F.sort_array(F.collect_list(F.struct("_o", "_ex"))).alias("_l"))
    return agg.select(F.concat(F.lit(head), F.array_join(F.transform("_l", lambda x: x["_ex"]), "")).alias("fewshot"))


def translation_prompts(df: DataFrame, header: DataFrame, source_label: str, target_label: str) -> DataFrame:
    """Few-shot header + ``<src>: paragraph\\n<tgt>: `` (the header is one row)."""
    cue = F.concat(F.col("fewshot"), F.lit(f"{source_label}: "), F.col("paragraph"), F.lit(f"\n{target_label}: "))
    return df.crossJoin(F.broadcast(header)).withColumn("prompt", cue).drop("fewshot")
