"""Readers and writers of product, factor, mode and category tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.constants import NOISE_PREFIXES
from weftline.functions.columns import nan_to_null, once
from weftline.functions.hashing import HASH_BITS
from weftline.functions.ranking import hash_rank_thresholds
from weftline.schema import CATEGORY_SCHEMA, NUMERICS, PRODUCT_COLUMNS, SPLIT_COLUMNS, TARGETS

REJECT = "_reject"
_CSV = {"quote": '"', "escape": '"'}


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _typed(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Blank text and NaN become NULL, unreadable numbers too."""
    blank = df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in df.columns if c not in numeric})
    number = {c: F.col(c).try_cast("double") for c in numeric}
    return blank.withColumns({c: F.when(~F.isnan(n), n) for c, n in number.items()})


def read_products(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    numeric: list[str] | None = None,
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Product CSV with JSON in a quoted field: (rows, rejects).

    Every field is read as text, so only a wrong number of fields makes a line malformed.
    Lines with too few fields are rejects and keep their text; surplus fields are ignored.
    Pruning inside the CSV parser is off, because a pruned read does not count fields.
    """
    names = PRODUCT_COLUMNS if columns is None else columns
    schema = _text_schema(names).add(REJECT, T.StringType())
    raw = (
        spark.read.schema(schema)
        .options(**_CSV, header=str(header).lower(), mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT, columnPruning="false")
        .csv(path)
    )
    short = F.col(REJECT).isNotNull() & F.col(names[-1]).isNull()
    rows = _typed(raw.where(~short).drop(REJECT), NUMERICS if numeric is None else numeric)
    return rows, raw.where(short).select(F.col(REJECT).alias("line"))


def read_material_factors(
    spark: SparkSession,
    path: str,
    positions: tuple[int, int, int] = (0, 7, 10),
    width: int = 11,
    order_position: int | None = None,
) -> DataFrame:
    """(material, carbon, water) picked by position from a headed CSV.

    An empty or unreadable factor is skipped per metric, and the first usable row of a name
    wins. Row order is the file order unless a column with a number is named for it.
    """
    raw = spark.read.schema(_text_schema([f"c{i}" for i in range(width)])).options(**_CSV, header="true").csv(path)
    # splits of one file are read by any task: file and offset come before the row's number
    order = (
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        if order_position is None
        else F.col(f"c{order_position}").try_cast("bigint")
    )
    name, carbon, water = (f"c{p}" for p in positions)
    usable = raw.select(
        F.col(name).alias("material"),
        F.col(carbon).try_cast("double").alias("carbon"),
        F.col(water).try_cast("double").alias("water"),
        order.alias("_order"),
    ).where(F.length("material") > 0)
    first = {
        c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in ("carbon", "water")
    }
    return usable.groupBy("material").agg(*first.values())


def mode_params(factors: DataFrame, utility: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(modes, rejects) from (mode, ef) and long (mode, param, value) tables.

    Names are compared in lower case; factors must be positive; a missing beta is zero. Rows
    with an unknown mode are rejected.
    """
    mode = F.lower(F.trim("mode"))
    names = [k.lower() for k in known]
    clean_factors = factors.select(mode.alias("mode"), F.col("ef").cast("double").alias("ef"))
    clean_utility = utility.select(mode.alias("mode"), F.lower("param").alias("param"), F.col("value").cast("double"))
    betas = clean_utility.groupBy("mode").pivot("param", ["beta0", "beta1"]).agg(F.max("value"))
    modes = (
        clean_factors.where((F.col("ef") > 0) & F.col("mode").isin(names))
        .join(betas, "mode", "left")
        .na.fill(0.0, ["beta0", "beta1"])
    )
    unknown = ~F.col("mode").isin(names)
    rejects = clean_factors.where(unknown).select("mode", F.lit("factor").alias("source")).unionByName(
        clean_utility.where(unknown).select("mode", F.lit("utility").alias("source"))
    )
    return modes, rejects


def read_mode_params(
    spark: SparkSession, factors_path: str, utility_path: str, known: list[str]
) -> tuple[DataFrame, DataFrame]:
    """As :func:`mode_params`, from two headed CSV files."""
    factors = spark.read.schema("mode string, ef double").options(**_CSV, header="true").csv(factors_path)
    utility = spark.read.schema("mode string, param string, value double").options(**_CSV, header="true").csv(utility_path)
    return mode_params(factors, utility, known)


def read_split(
    spark: SparkSession,
    path: str,
    required: list[str] | None = None,
    n: int | None = None,
    fmt: str = "parquet",
    seed: int = 42,
) -> DataFrame:
    """Wide model table; missing columns are an error.

    ``n`` takes a sample: the rows with the n smallest seeded hashes of all their values, the
    same in every run. The cut is an order statistic, so no task sees more than its own rows;
    rows that are equal in every column and sit on the cut stay together.
    """
    if fmt == "csv":
        df = spark.read.options(**_CSV, header="true").csv(path)
        numeric = [c for c in df.columns if c in SPLIT_COLUMNS[5:] or c in NUMERICS]
        df = _typed(df, numeric)
    else:
        df = nan_to_null(spark.read.format(fmt).load(path))
    missing = sorted(set(SPLIT_COLUMNS if required is None else required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if n is None:
        return df
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << HASH_BITS)))
    cut = hash_rank_thresholds(hashed.select("_hash"), "_hash", {"cut": n}, as_rows=True).first()
    if cut is None or cut["n_rows"] is None or n >= cut["n_rows"]:
        return df
    return hashed.where(F.col("_hash") <= cut["cut"]).drop("_hash")


def read_train_validation(spark: SparkSession, train: str, validation: str, n: int | None = None):
    """Both parts; a sample of n training rows goes with n/4 validation rows."""
    return read_split(spark, train, n=n), read_split(spark, validation, n=None if n is None else n // 4)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORY_SCHEMA).option("multiLine", "true").json(path)


def category_hierarchy(nodes: DataFrame) -> DataFrame:
    """Leaves of an adjacency list (id, name, parent_id) with the names on their path.

    The tree has at most three levels, so the path is two equi-joins on the parent id.
    """
    node = nodes.select("id", "name", "parent_id")
    inner = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    leaves = node.join(inner, "id", "left_anti")
    above = node.select(
        F.col("id").alias("parent_id"), F.col("name").alias("_name1"), F.col("parent_id").alias("_parent1")
    )
    top = node.select(F.col("id").alias("_parent1"), F.col("name").alias("_name2"))
    path = leaves.join(above, "parent_id", "left").join(top, "_parent1", "left")
    levels = F.array_compact(F.array("_name2", "_name1", "name"))
    return path.select(
        F.get(levels, F.lit(0)).alias("gender"),
        F.get(levels, F.lit(1)).alias("parent_category"),
        F.col("name").alias("category"),
        F.array_join(levels, " > ").alias("full_path"),
    )


def write_products(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet, or CSV with every field quoted and footprint columns at six decimals."""
    if fmt != "csv":
        df.write.mode(mode).format(fmt).save(path)
        return
    printed = {c: F.format_string("%.6f", F.col(c)) for c in TARGETS if c in df.columns}
    shown = df.withColumns({c: F.when(F.col(c).isNotNull(), e) for c, e in printed.items()}) if printed else df
    shown.write.mode(mode).options(**_CSV, header="true", quoteAll="true").csv(path)


def report_rows(section: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """A metrics frame as long (section, key, value) rows; values are text."""
    metrics = [c for c in df.columns if c != key]
    label = F.lit("") if key is None else F.concat(F.col(key).cast("string"), F.lit("."))
    cells = F.array(
        *[
            F.struct(F.concat(label, F.lit(m)).alias("key"), F.col(f"`{m}`").cast("string").alias("value"))
            for m in metrics
        ]
    )
    return df.select(F.explode(cells).alias("c")).select(F.lit(section).alias("section"), "c.key", "c.value")


def write_report(sections: dict[str, tuple[DataFrame, str | None]], path: str, mode: str = "errorifexists") -> DataFrame:
    """Write named metric frames as JSON lines of (section, key, value)."""
    parts = [report_rows(name, df, key) for name, (df, key) in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.write.mode(mode).json(path)
    return read_report(out.sparkSession, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, key string, value string").json(path)


def parse_generated_lines(
    lines: DataFrame,
    column: str = "value",
    columns: list[str] | None = None,
    noise: list[str] | None = None,
) -> DataFrame:
    """Raw generated text lines to product rows; prose, headers and malformed lines are dropped.

    Fields are counted by commas left after removing the quoted sections, which is linear in
    the length of the line.
    """
    names = PRODUCT_COLUMNS if columns is None else columns
    line = F.col("_line")
    prefixes = NOISE_PREFIXES if noise is None else noise
    # what is left after the quoted sections and everything else that is no comma
    commas = F.length(F.regexp_replace(line, r'"(?:[^"\\]++|\\.|"")*+"|[^,"]++|"', ""))
    kept = (
        lines.select(once(F.trim(F.col(column))).alias("_line"))
        .where(line.contains(","))
        .where(~F.lower(line).rlike("^(" + "|".join(prefixes) + ")"))
        .where(commas == len(names) - 1)
    )
    unescaped = F.replace(line, F.lit('\\"'), F.lit('""'))
    schema = ", ".join(f"{c} string" for c in names)
    fields = kept.select(F.from_csv(unescaped, F.lit(schema), _CSV).alias("r")).select("r.*")
    return _typed(fields, [c for c in names if c in NUMERICS])


def csv_line(columns: list[str]):
    """One fully quoted CSV line per row; NULL gives an empty field."""
    quoted = [
        F.concat(
            F.lit('"'),
            F.coalesce(F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit("")),
            F.lit('"'),
        )
        for c in columns
    ]
    return F.concat_ws(",", *quoted)
