"""All chart data in one call (CH10).

The charts of the analysed project all read the same feature frame.
``chart_data`` persists the columns they need once (memory, spilling to disk)
and returns the lazy DataFrames behind each chart; ``release()`` unpersists it.
Drawing is left to the caller: these are the numbers a plot needs.

``chart_table`` is the same data as one long table from one scan: GROUPING SETS
count every segment and every value distribution at once, and the co-moments of
the correlation matrix ride along as a partial state (``comoments``).  The
cells are written once; the charts are cut out of them by their grouping id.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import pct
from churnscope.functions.schemas import CORR_FEATURES, INTERNET_VALUES
from churnscope.operators import comoments, distributions, stats
from churnscope.operators.segments import pivot_mean, segment_churn
from churnscope.sources import io


class ChartData(dict):
    """``name -> DataFrame``; holds the persisted base frame until released."""

    def __init__(self, base: DataFrame, frames: dict[str, DataFrame]):
        super().__init__(frames)
        self._base = base

    def release(self) -> None:
        self._base.unpersist()


def chart_data(feat: DataFrame) -> ChartData:
    needed = ["churn_flag", "contract", "internet_service", "payment_method", *CORR_FEATURES]
    base = feat.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    churned = F.sum("churn_flag")
    total = F.count(F.lit(1))
    frames = {
        "overview": base.agg(
            total.cast("bigint").alias("total_customers"),
            churned.cast("bigint").alias("churned"),
            pct(churned, total, 1).alias("churn_rate_pct"),
        ),
        "contract": segment_churn(base, ["contract"], drop_null_keys=True),
        "tenure_density": distributions.kde_on_grid(base, "churn_flag", "tenure", 0, 75),
        "charges_density": distributions.kde_on_grid(base, "churn_flag", "monthly_charges"),
        "correlation": stats.corr_matrix(base, [*CORR_FEATURES, "churn_flag"]),
        "charges_box": distributions.box_stats(base, "churn_flag", "monthly_charges"),
        "heatmap": pivot_mean(
            base.where(F.col("contract").isNotNull()),
            "contract",
            "internet_service",
            INTERNET_VALUES,
            pct(churned, total, 1),
        ),
        "health_hist": distributions.equal_width_histogram(base, "churn_flag", "health_score", 20),
        "payment": segment_churn(base, ["payment_method"], drop_null_keys=True),
        "services": segment_churn(base, ["num_services"], drop_null_keys=True),
    }
    return ChartData(base, frames)


SEGMENTS = {"contract": ["contract"], "payment": ["payment_method"], "services": ["services"], "heatmap": ["contract", "internet_service"]}
VALUES = {"tenure": "tenure", "charges": "monthly_charges", "health": "health_score"}
MATRIX = [*CORR_FEATURES, "churn_flag"]
PAIRS = [(a, b) for i, a in enumerate(MATRIX) for b in MATRIX[:i]]


def chart_cells(feat: DataFrame) -> DataFrame:
    """One row per cell of every chart: ``cell`` (its name), the keys, ``n``,
    ``churned``, and in the row of the whole table the blocks of co-moments."""
    labels = ["contract", "internet_service", "payment_method", "services"]
    base = feat.withColumn("services", F.col("num_services").cast("string")).select(
        *labels, *[F.col(c).cast("double").alias(c) for c in MATRIX], F.col("churn_flag").cast("int").alias("series"), F.lit(1).alias("one")
    )
    sets = {"all": [], **SEGMENTS, **{name: ["series", value] for name, value in VALUES.items()}}
    keys = [*labels, "series", *VALUES.values()]
    rows = comoments.with_blocks(base, PAIRS)
    cells = rows.groupingSets([[F.col(c) for c in own] for own in sets.values()], *keys).agg(
        F.grouping_id().alias("gid"), F.count("one").alias("n"), F.sum("churn_flag").cast("bigint").alias("churned"), F.collect_list("block").alias("blocks")
    )
    name = F.lit(None).cast("string")
    for cell, own in sets.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        name = F.when(F.col("gid") == gid, cell).otherwise(name)
    whole = F.col("cell") == "all"
    return cells.withColumn("cell", name).where((F.col("n") > 0) | whole).withColumn("blocks", F.when(whole, F.col("blocks"))).drop("gid")


def chart_table(feat: DataFrame) -> DataFrame:
    """All charts as (chart, series, label, x, n, churned, value); rows with a
    NULL key are left out, as in ``chart_data``."""
    spark = feat.sparkSession
    path = f"{io.scratch_dir(spark, 'chart-cells')}/cells"
    made = chart_cells(feat)
    made.write.parquet(path)
    cells = spark.read.schema(made.schema).parquet(path)
    nothing = lambda kind: F.lit(None).cast(kind)

    def rows(df: DataFrame, chart: str, **columns) -> DataFrame:
        kinds = {"series": "string", "label": "string", "x": "double", "n": "bigint", "churned": "bigint", "value": "double"}
        return df.select(F.lit(chart).alias("chart"), *[columns.get(c, nothing(kind)).cast(kind).alias(c) for c, kind in kinds.items()])

    def counts(name: str) -> DataFrame:
        own = cells.where((F.col("cell") == name) & F.col("series").isNotNull() & F.col(VALUES[name]).isNotNull())
        return own.select(F.col("series").alias("churn_flag"), F.col(VALUES[name]).alias("v"), F.col("n").alias("cnt"))

    n, churned = F.col("n"), F.col("churned")
    rate = {"n": n, "churned": churned, "value": pct(churned, n, 1)}
    parts = [rows(cells.where("cell = 'all'"), "overview", **rate)]
    for chart, keys in SEGMENTS.items():
        own = cells.where(F.col("cell") == chart)
        for k in keys:
            own = own.where(F.col(k).isNotNull())
        parts.append(rows(own, chart, series=F.col(keys[0]) if len(keys) > 1 else nothing("string"), label=F.col(keys[-1]), **rate))
    series = F.col("churn_flag")
    for chart, density in (
        ("tenure_density", distributions.kde_of_counts(counts("tenure"), "churn_flag", 0, 75)),
        ("charges_density", distributions.kde_of_counts(counts("charges"), "churn_flag")),
    ):
        parts.append(rows(density, chart, series=series, x=F.col("x"), value=F.col("density")))
    quarter = distributions.quartiles_of_counts(counts("charges"), "churn_flag")
    box = distributions.box_of_counts(counts("charges"), quarter, "churn_flag")
    figures = ["min", "q1", "median", "q3", "max", "iqr", "lower_whisker", "upper_whisker"]
    box = box.select("churn_flag", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("label"), F.col(f).alias("value")) for f in figures])).alias("f"))
    parts.append(rows(box, "charges_box", series=series, label=F.col("f.label"), n=n, value=F.col("f.value")))
    bars = distributions.histogram_of_counts(counts("health"), "churn_flag", 20)
    parts.append(rows(bars, "health_hist", series=series, label=F.col("bin"), x=F.col("bin_start"), n=F.col("count"), value=F.col("bin_end")))
    matrix = comoments.pair_moments(cells.where("cell = 'all'").select(F.explode("blocks").alias("block")))
    pearson = stats.correlation_rows(matrix, PAIRS)
    parts.append(rows(pearson, "correlation", series=F.col("a"), label=F.col("b"), value=F.col("r")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
