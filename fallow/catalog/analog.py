"""Panel inputs derived from the sales tables.

crop = market segment, entity = supplier, year = order year, state = region of
the supplier; a cell holds the lines of one (crop, entity, year).  Money is
summed in decimals, so every engine gets the same cell values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallow.session import settle

YEAR0 = 1995
KEYS = ["crop", "GEOID", "YEAR"]
MONEY = "decimal(15,2)"
GRID = 25  # suppliers per row of the map of unit squares

_stages: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    """A stage by application, name and state of its table folder: changed files make another key."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = sorted(f"{f.getPath().getName()}:{f.getModificationTime()}:{f.getLen()}" for f in files)
    return spark.sparkContext.applicationId, f"{sf_dir} {hash(tuple(state))}", name


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table, written once per application and state of the table folder."""
    key = stage_key(spark, sf_dir, name)
    if key not in _stages:
        _stages[key] = settle(build())
    return _stages[key]


def lines(spark: SparkSession, sf_dir: str, crop: bool = True, parts: bool = True) -> DataFrame:
    """Order lines with entity and year, and with crop or part where a result reads them.

    Orders meet their customers before the lines, of which there are several to an order, and what is
    derived from a line is derived behind the joins, so that a line is shuffled as few short columns.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("YEAR"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
    )
    if crop:
        customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("crop"))
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast(MONEY).alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_discount").cast(MONEY).alias("discount"), F.col("l_tax").cast(MONEY).alias("tax"),
    )
    out = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        out = out.join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return out.withColumns({"GEOID": F.col("l_suppkey").cast("string"), "net": F.col("price") * (1 - F.col("discount"))})


def _where(condition: Column, value: str) -> Column:
    return F.when(condition, F.col(value)).otherwise(F.lit(0).cast(MONEY))


def build_input_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell that has crop, entity and year.

    The lines are shuffled once, by entity and year; classes, cells and the entity's total are grouped where
    they then lie.  A task holds sums per class of its cells, never their lines.
    """
    from fallow.operators.diversity import diversity_indices

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    values = {
        "lines": F.lit(1),
        "qty": F.col("qty"),
        "net_rf": _where((flag == "R") & (status == "F"), "net"),
        "qty_rf": _where((flag == "R") & (status == "F"), "qty"),
        "qty_o": _where(status == "O", "qty"),
        "discount": F.col("discount"),
        "tax": F.col("tax"),
        "total": F.col("total"),
        "size": F.col("p_size"),
    }
    own = lines(spark, sf_dir).repartition("GEOID", "YEAR")
    own = own.select(*KEYS, "p_type", *[value.alias(name) for name, value in values.items()])
    cells = diversity_indices(own, KEYS, "p_type", "qty", sums=list(values))
    # cells without a crop count for their entity's total and are no rows of the panel
    acres = F.sum("qty").over(Window.partitionBy("GEOID", "YEAR")).cast("double")
    cells = cells.withColumn("TOTAL_ACRES", acres).withColumns({c: F.col(c).cast("double") for c in values})
    cells = cells.where("crop is not null and GEOID is not null and YEAR is not null")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("GEOID"),
            F.col("r_name").alias("STATE"),
            (F.col("s_acctbal") / 1000).alias("SOIL"),
        )
    )
    panel = (
        cells.join(places, "GEOID")
        .select(
            *KEYS,
            "STATE",
            F.try_divide("net_rf", "qty_rf").alias("YIELD"),
            F.col("simpson").alias("LSM_SIDI_ALL"),
            F.col("shannon").alias("LSM_SHDI_ALL"),
            F.col("richness").cast("double").alias("LSM_RICH_ALL"),
            (F.col("size") / F.col("lines")).alias("LSM_ENN_ALL"),
            (F.col("tax") / F.col("lines")).alias("GDD"),
            (F.col("total") / F.col("lines") / 1000).alias("SDD"),
            (F.col("discount") / F.col("lines")).alias("TP"),
            "SOIL",
            (100 * F.col("qty_o") / F.col("qty")).alias("PERC_IRR"),
            F.col("qty").alias("ACRES"),
            "TOTAL_ACRES",
        )
    )
    # Measures are stored with twelve decimals.
    measures = [f.name for f in panel.schema.fields if f.dataType.typeName() == "double"]
    return panel.withColumns({c: F.round(c, 12) for c in measures})


def input_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "input_panel", lambda: build_input_panel(spark, sf_dir))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water per cell with the amount as text."""

    def build() -> DataFrame:
        cells = (
            lines(spark, sf_dir, parts=False)
            .where(F.col("l_returnflag") == "A")
            .groupBy(*KEYS)
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("price").alias("amount"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
            )
        )
        return cells.select(
            "crop",
            "GEOID",
            (F.col("YEAR") - YEAR0).alias("Yr"),
            (F.col("amount").cast("double") / F.col("n")).alias("avg_water"),
            (F.col("high") - F.col("low")).cast("double").alias("range_water"),
            F.col("amount").cast("string").alias("volume"),
        )

    return stage(spark, sf_dir, "water", build)


def headers(spark: SparkSession, sf_dir: str) -> list[str]:
    """The year columns of the expense files: every year with an order."""
    years = stage(spark, sf_dir, "years", lambda: table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct())
    return [f"X{r.y}" for r in years.where("y is not null").orderBy("y").collect()]


def expenses(spark: SparkSession, sf_dir: str, priority: str) -> DataFrame:
    """Spending per supplier, wide by year, like an expense file."""

    def sums() -> DataFrame:
        rows = lines(spark, sf_dir, crop=False, parts=False)
        return rows.groupBy("o_orderpriority", F.col("GEOID").alias("X"), "YEAR").agg(F.sum("price").alias("price"))

    def build() -> DataFrame:
        years = headers(spark, sf_dir)
        own = stage(spark, sf_dir, "expense sums", sums).where(F.col("o_orderpriority") == priority)
        wide = own.groupBy("X").pivot("YEAR", [int(h[1:]) for h in years]).agg(F.sum("price").cast("double"))
        return wide.withColumnsRenamed({h[1:]: h for h in years})

    return stage(spark, sf_dir, f"expenses {priority}", build)


def fertilizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expenses(spark, sf_dir, "1-URGENT")


def herbicide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expenses(spark, sf_dir, "2-HIGH")


def county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed unit square per supplier, as vertex rows."""
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    ring = F.array(
        *[F.struct(F.lit(s).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
          for s, (dx, dy) in enumerate(corners)]
    )
    key = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(key, "n_regionkey", F.explode(ring).alias("v"))
        .select(
            key.cast("string").alias("GEOID"),
            F.col("n_regionkey").alias("STATEFP"),
            F.lit(1).alias("part"),
            F.lit(1).alias("ring"),
            F.col("v.seq").alias("seq"),
            (key % GRID + F.col("v.dx")).cast("double").alias("x"),
            (F.floor(key / GRID) + F.col("v.dy")).cast("double").alias("y"),
        )
    )
