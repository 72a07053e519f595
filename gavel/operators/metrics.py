"""Agreement metrics between judge and human labels.

All are one-pass aggregates (partial aggregation before the shuffle). Ranks, quantiles
and histograms go through value histograms: the scores and lengths they run on have a
bounded number of distinct values, and exact ``percentile`` keeps one counter per
distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_


def _ratio(num: Column, den: Column, zero=0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(zero) if zero is not None else F.lit(None))


def ab_metrics_with_ties(df: DataFrame, pred="predicted", true="correct", tie="is_tie") -> DataFrame:
    """A3: accuracy counts ties as ordinary predictions; tie and A/B rates."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"),
        F.count_if(col_(pred) == col_(true)).alias("correct"),
        F.count_if(col_(tie)).alias("ties"),
        F.count_if(col_(pred) == "A").alias("pred_a"),
        F.count_if(col_(pred) == "B").alias("pred_b"),
    ).select("*",
             _ratio(F.col("correct"), F.col("total"), None).alias("accuracy"),
             _ratio(F.col("ties"), F.col("total"), None).alias("tie_rate"),
             _ratio(F.col("pred_a"), F.col("total"), None).alias("a_rate"),
             _ratio(F.col("pred_b"), F.col("total"), None).alias("b_rate"))


def ab_metrics_without_ties(df: DataFrame, pred="predicted", true="correct", tie="is_tie") -> DataFrame:
    """A4: accuracy over non-tie rows only (0.0 if none); tie share null if no rows."""
    nt = ~col_(tie)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(col_(tie)).alias("tie_count"),
        F.count_if(nt).alias("non_tie"),
        F.count_if(nt & (col_(pred) == col_(true))).alias("correct_non_tie"),
        F.count_if(nt & (col_(pred) == "A")).alias("pred_a"),
        F.count_if(nt & (col_(pred) == "B")).alias("pred_b"),
        F.count_if(nt & (col_(true) == "A")).alias("true_a"),
        F.count_if(nt & (col_(true) == "B")).alias("true_b"),
    ).select("*",
             _ratio(F.col("correct_non_tie"), F.col("non_tie"), 0.0).alias("accuracy"),
             _ratio(F.col("tie_count"), F.col("total"), None).alias("tie_share"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """A5: zero-filled (actual, predicted, n) over a fixed label list; other labels dropped."""
    spark = df.sparkSession
    grid_rows = [(a, p) for a in labels for p in labels]
    grid = spark.createDataFrame(grid_rows, f"actual {_ddl(labels)}, predicted {_ddl(labels)}")
    counts = (df.filter(col_(actual).isin(labels) & col_(predicted).isin(labels))
                .groupBy(col_(actual).alias("actual"), col_(predicted).alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))
    # the grid is len(labels)**2 rows (a parameter), so it is broadcast
    return (F.broadcast(grid).join(counts, ["actual", "predicted"], "left")
             .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _ddl(labels: list) -> str:
    return "int" if all(isinstance(x, int) for x in labels) else "string"


def classification_report(conf: DataFrame, labels: list) -> DataFrame:
    """Per label precision / recall / f1 / support, then accuracy, macro and weighted
    averages (empty denominators give 0, like scikit-learn's default).

    The cells of the (zero-filled) confusion are folded into one row; all report rows are
    read off it, so the input is planned once."""
    def at(actual=None, predicted=None):
        c = F.lit(True)
        for name, v in (("actual", actual), ("predicted", predicted)):
            c = c if v is None else c & (F.col(name) == F.lit(v))
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))

    one = conf.agg(*[x.alias(f"{n}{i}") for i, v in enumerate(labels)
                     for n, x in (("tp", at(v, v)), ("sup", at(v)), ("prd", at(None, v)))])
    per = []
    for i, v in enumerate(labels):
        tp, sup, prd = (F.col(f"{n}{i}") for n in ("tp", "sup", "prd"))
        per.append((str(v), _ratio(tp, prd), _ratio(tp, sup), sup, tp))
    per = [(v, p, r, _ratio(2 * p * r, p + r), s, tp) for v, p, r, s, tp in per]
    total = sum((x[4] for x in per), F.lit(0))

    def mean(k):
        return sum((x[k] for x in per), F.lit(0.0)) / len(per)

    def weighted(k):
        return _ratio(sum((x[k] * x[4] for x in per), F.lit(0.0)), total)

    rows = [x[:5] for x in per] + [
        ("accuracy", F.lit(None), F.lit(None), _ratio(sum((x[5] for x in per), F.lit(0)), total), total),
        ("macro avg", mean(1), mean(2), mean(3), total), ("weighted avg", weighted(1), weighted(2), weighted(3), total)]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("label"), *[F.round(c.cast("double"), 9).alias(n) for n, c in (("precision", p), ("recall", r), ("f1", f))],
                 s.cast("long").alias("support")) for v, p, r, f, s in rows])))


def _pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; null where one side does not vary (``corr`` fails there in ANSI mode)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def regression_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """A7 + A8: MAE, MSE, RMSE, exact, within 1/2, Pearson (rows with both values)."""
    ok = df.filter(col_(true).isNotNull() & col_(pred).isNotNull())
    e = (col_(pred) - col_(true)).cast("double")
    return ok.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg((e == 0).cast("double")).alias("exact"),
        F.avg((F.abs(e) <= 1).cast("double")).alias("within_1"),
        F.avg((F.abs(e) <= 2).cast("double")).alias("within_2"),
        _pearson(col_(true).cast("double"), col_(pred).cast("double")).alias("pearson"),
    ).withColumn("rmse", F.sqrt("mse"))


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average rank with ties (1-based), via the value histogram."""
    by = by or []
    return df.join(_value_ranks(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), value, out, by), by + [value])


def _value_ranks(hist: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    counts = hist.groupBy(*by, value).agg(F.sum("_n").alias("n"))
    return running_sums(counts, value, by).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Spearman correlation = Pearson of average ranks, on pairwise-complete rows.

    Rows are counted per (x, y) first; ranks and the weighted correlation run on those counts.
    ``by`` gives one row a group (e.g. per model)."""
    by = by or []
    cells = (df.filter(col_(x).isNotNull() & col_(y).isNotNull()).groupBy(*by, col_(x).alias("_x"), col_(y).alias("_y"))
             .agg(F.count(F.lit(1)).alias("_n")))
    r = (cells.join(_value_ranks(cells, "_x", "_rx", by), by + ["_x"])
              .join(_value_ranks(cells, "_y", "_ry", by), by + ["_y"]))
    n, a, b = F.col("_n"), F.col("_rx"), F.col("_ry")
    sums = (r.groupBy(*by) if by else r).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("_a"), F.sum(n * b).alias("_b"), F.sum(n * a * a).alias("_aa"),
        F.sum(n * b * b).alias("_bb"), F.sum(n * a * b).alias("_ab"))
    m = F.col("n")
    cov = m * F.col("_ab") - F.col("_a") * F.col("_b")
    var = (m * F.col("_aa") - F.col("_a") * F.col("_a")) * (m * F.col("_bb") - F.col("_b") * F.col("_b"))
    return sums.select(*by, F.when(var > 0, cov / F.sqrt(var)).alias("spearman"),  # null where a side does not vary
                       F.coalesce(m, F.lit(0)).alias("n"))


def pearson_by(df: DataFrame, x: str, others: list[str], by: list[str] | None = None) -> DataFrame:
    """A8 per group and one column to many: (by..., column, pearson, n) on pairwise-complete rows."""
    by = by or []
    long = df.select(*by, col_(x).cast("double").alias("_x"), *[col_(c).cast("double").alias(c) for c in others])
    long = long.unpivot(by + ["_x"], others, "column", "_y").where("_x is not null and _y is not null")
    return long.groupBy(*by, "column").agg(_pearson(F.col("_x"), F.col("_y")).alias("pearson"), F.count(F.lit(1)).alias("n"))


def threshold_metrics(df: DataFrame, true: str, pred: str, thresholds: list) -> DataFrame:
    """positive = score > t; TN/FP/FN/TP, precision, recall, F1 per threshold.

    One aggregate with four counters a threshold (a short parameter list)."""
    ok = df.filter(col_(true).isNotNull() & col_(pred).isNotNull()).select(col_(true).alias("_t"), col_(pred).alias("_p"))
    counts = []
    for i, t in enumerate(thresholds):
        a, p = F.col("_t") > float(t), F.col("_p") > float(t)
        counts += [F.count_if(c).alias(f"{n}{i}") for n, c in (("tn", ~a & ~p), ("fp", ~a & p), ("fn", a & ~p), ("tp", a & p))]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tn", "fp", "fn", "tp")])
                     for i, t in enumerate(thresholds)])
    m = ok.agg(*counts).select(F.inline(rows))
    m = m.select("*", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                 _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return m.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_distribution(df: DataFrame, human: str, judge: str, threshold: float,
                           values: list[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Human-score counts for rows the judge puts above / at-or-below the threshold,
    zero-filled over ``values``."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, v) for s in ("high", "low") for v in values], "side string, human_score int")
    side = F.when(col_(judge) > threshold, "high").when(col_(judge) <= threshold, "low")
    c = (df.select(side.alias("side"), col_(human).cast("int").alias("human_score"))
           .filter(F.col("side").isNotNull())
           .groupBy("side", "human_score").agg(F.count(F.lit(1)).alias("n")))
    return F.broadcast(grid).join(c, ["side", "human_score"], "left").select(
        "side", "human_score", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def melt(df: DataFrame, id_cols: list[str], value_cols: list[str], name="column", value="value") -> DataFrame:
    return df.unpivot(id_cols, value_cols, name, value)


def melt_means(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and sample std per key after melting."""
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                   F.count(value).alias("n"))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 20, density: bool = False) -> DataFrame:
    """A14 (i): ``bins`` equal bins from min to max, the last one closed."""
    spark = df.sparkSession
    v = col_(value).cast("double")
    ok = df.select(v.alias("_v")).filter(F.col("_v").isNotNull())
    mm = ok.agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    b = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_mn")) * bins / (F.col("_mx") - F.col("_mn"))), F.lit(bins - 1)))
    counts = ok.crossJoin(F.broadcast(mm)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm))
    width = (F.col("_mx") - F.col("_mn")) / bins
    out = grid.join(counts, "bin", "left").select(
        "bin", (F.col("_mn") + F.col("bin") * width).alias("lo"), (F.col("_mn") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("_n"), width.alias("_w"))
    if density:
        out = out.withColumn("density", F.col("n") / (F.col("_n") * F.col("_w")))
    return out.drop("_n", "_w")


def integer_histogram(df: DataFrame, value: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """A14 (ii): bins [k-0.5, k+0.5) for k in lo..hi, the last one closed; values outside are dropped."""
    spark = df.sparkSession
    grid = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("value"))
    v = col_(value).cast("double")
    k = F.least(F.floor(v + 0.5), F.lit(hi)).cast("int")
    counts = (df.select(k.alias("value"), v.alias("_v"))
                .filter((F.col("_v") >= lo - 0.5) & (F.col("_v") <= hi + 0.5))
                .groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    return grid.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation), max."""
    v = col_(value).cast("double")
    q = exact_percentiles(df, value, [0.25, 0.5, 0.75])
    return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                  F.min(v).alias("min"), F.max(v).alias("max")).crossJoin(F.broadcast(q)).select(  # one row each
        "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def exact_percentiles(df: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated percentiles, one row with one column per prob.

    Values are counted, the counts summed in value order (``running_counts``), and the two
    neighbours of each position picked: no buffer holds all distinct values."""
    spread = running_counts(df.select(col_(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()), "_v")
    total = spread.agg(F.sum("n").alias("_n"))
    at = spread.crossJoin(F.broadcast(total))  # one row
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for name, k in ((f"_lo{i}", F.floor(pos)), (f"_hi{i}", F.ceil(pos))):
            picks.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("_v"))).alias(name))
    r = at.agg(*picks, F.max("_n").alias("_n"))
    out = []
    for i, p in enumerate(probs):
        part = F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(f"p{int(round(p * 100)):02d}"))
    return r.select(*out)


def running_counts(df: DataFrame, value: str, cells: int = 1024) -> DataFrame:
    """Distinct values with their count ``n`` and the count ``before`` of all smaller ones."""
    return running_sums(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, cells=cells)


def running_sums(hist: DataFrame, value: str, by: list[str] | None = None, cells: int = 1024) -> DataFrame:
    """Adds ``before``, the sum of ``n`` over a group's smaller values, to rows of one value each.

    Values fall into ``cells`` ranges cut at their own quantiles, so the ranges hold about as
    many values each whatever the distribution; a running sum over the ranges (at most that many rows
    a group) and one inside each range replace a sort of all values in one task. The cuts decide
    who sorts what, never the result."""
    by, step = by or [], int(cells ** 0.5)
    v = F.col(value).cast("double")
    cuts = hist.agg(F.percentile_approx(v, [i / cells for i in range(1, cells)], 10 * cells).alias("_cuts"))
    cuts = cuts.select("_cuts", F.expr(f"filter(_cuts, (c, i) -> i % {step} = {step - 1})").alias("_coarse"))  # one row
    # which cut comes last before the value: a coarse step, then inside it
    first = F.size(F.filter("_coarse", lambda c: c <= v)) * step
    placed = hist.crossJoin(F.broadcast(cuts)).withColumn("_at", first)
    inner = F.size(F.filter(F.slice("_cuts", F.col("_at") + 1, step - 1), lambda c: c <= v))
    placed = placed.withColumn("_cell", F.col("_at") + inner).drop("_cuts", "_coarse", "_at")
    sums = placed.groupBy(*by, "_cell").agg(F.sum("n").alias("_cn"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_cell", F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(offsets if by else F.broadcast(offsets), [*by, "_cell"])  # at most ``cells`` rows without groups
            .select(*by, value, "n", (F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")))


def row_mean(cols: list) -> Column:
    """Mean of the non-null values among several columns (null if none)."""
    arr = F.filter(F.array(*[col_(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, s / F.size(arr))


def match_percentage(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows where the two labels agree, in percent."""
    return df.agg((F.avg((col_(a) == col_(b)).cast("double")) * 100).alias("match_pct"))


def squared_errors(long: DataFrame, human: str, value: str) -> DataFrame:
    """A10: squared error per row; null when the judge value did not parse."""
    return long.withColumn("squared_error", F.pow(col_(human).cast("double") - col_(value).cast("double"), 2))


def mse_by_model(long: DataFrame, keys: list[str], disagreements_only: bool = False) -> DataFrame:
    """A10: mean squared error per model over parsed rows. ``disagreements_only``
    reproduces the reference's mask (only rows with a non-zero error)."""
    se = F.col("squared_error")
    rows = long.filter(se.isNotNull())
    if disagreements_only:
        rows = rows.filter(se > 0)
    return rows.groupBy(*keys).agg(F.avg(se).alias("mse"), F.count(F.lit(1)).alias("n"))


def evaluable(df: DataFrame, top: str, answer: str, stored: str | None = None) -> tuple[DataFrame, DataFrame]:
    """F8: rows that can be evaluated (a non-empty top-logprob map or a stored prediction,
    and an answer) plus a one-row processed / skipped count."""
    has = (F.col(top).isNotNull() & (F.size(top) > 0))
    if stored:
        has = has | F.col(stored).isNotNull()
    ok = has & F.col(answer).isNotNull()
    counts = df.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"))
    return df.filter(ok), counts


def columns_by_suffix(df: DataFrame, suffixes: list[str]) -> DataFrame:
    """the columns of a wide table whose name ends with one of the suffixes."""
    pattern = "`.*(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$`"
    return df.select(df.colRegex(pattern))


def score_subset(df: DataFrame, value: str, keep: str = "imperfect", probe: int = 3) -> DataFrame:
    """rows by score: ``imperfect`` (not 5), ``equal`` (to ``probe``) or ``parsed`` (not 0)."""
    v = col_(value)
    return df.filter({"imperfect": v != 5, "equal": v == probe, "parsed": v != 0}[keep])


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows that miss one of the derived columns go."""
    return df.na.drop(subset=cols)


def attach_model_column(base: DataFrame, results: DataFrame, key: str, model: str, models: list[str],
                        value: str) -> DataFrame:
    """One column per model, joined by key from a long (key, model, value) table; the long
    table is pivoted over the given models first, so the base is joined once."""
    wide = results.groupBy(key).pivot(model, models).agg(F.max(value))
    return base.join(wide, key, "left")


def metrics_row(conf: DataFrame, metrics: DataFrame, labels: list) -> DataFrame:
    """K4: the one-row summary with the confusion as a nested matrix (rows: actual labels)."""
    cell = {(a, p): F.coalesce(F.sum(F.when((F.col("actual") == F.lit(a)) & (F.col("predicted") == F.lit(p)), F.col("n"))),
                               F.lit(0)).cast("long") for a in labels for p in labels}
    matrix = conf.agg(F.array(*[F.array(*[cell[a, p] for p in labels]) for a in labels]).alias("confusion_matrix"))
    return metrics.crossJoin(F.broadcast(matrix))  # one row each


def union_long(frames: list[DataFrame]) -> DataFrame:
    """Union per-model result tables by name into one long table (missing columns null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
