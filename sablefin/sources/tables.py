"""Readers, writers and small made-up tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.errors import ConfigError


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its input is too small to be read by all of them, for costly expressions on each row.

    A Parquet file is read by as many tasks as it has row groups; from a split for each core on, rows stay where they are
    read and nothing is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A CSV file or folder with all columns as strings; malformed rows are kept with what could be read."""
    return spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, mode="PERMISSIVE", multiLine=False)


def csv_stream(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = True, files_per_trigger: int = 1) -> DataFrame:
    """A folder of CSV files as a stream; each file is read once, however far the stream has come."""
    reader = spark.readStream.schema(schema).option("sep", delimiter).option("header", header)
    return reader.option("maxFilesPerTrigger", files_per_trigger).csv(path)


def jdbc(
    spark: SparkSession, url: str, query: str, fetch_size: int = 1000, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 1, **options: str
) -> DataFrame:
    """A query's rows from a database; limits and filters put on the result are pushed down to it.

    With a whole-number ``column`` and its bounds the rows are read by ``partitions`` tasks, each a range of the column; rows
    beyond the bounds are in the first and last ranges. Without, one task reads all rows.
    """
    reader = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **options)
    if column is None:
        return reader.option("query", query).load()
    if lower is None or upper is None or partitions < 1:
        raise ConfigError("a column to read by needs both bounds and a number of partitions")
    ranges = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return reader.options(dbtable=f"({query}) rows_of_query", **ranges).load()


def memory(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Records that the caller holds."""
    return spark.createDataFrame(records, schema)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest key: every sample asks for an order, so that it can be repeated."""
    return df.orderBy(key).limit(n)


def write(df: DataFrame, path: str, kind: str) -> None:
    """Write as ``json`` (one object a line), ``csv`` (with header) or ``parquet``."""
    {"json": lambda w: w.json(path), "csv": lambda w: w.csv(path, header=True), "parquet": lambda w: w.parquet(path)}[kind](df.write.mode("overwrite"))


def long_form(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Rows (row_id, column_name, value): the given columns as strings, one below the other."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.col(id_column).alias("row_id"), F.explode(pairs).alias("p")).select("row_id", "p.*")


def _number(pattern: str, *parts: Column) -> Column:
    return F.format_string(pattern, *parts)


def _ssn(i: Column) -> Column:
    return _number("%03d-%02d-%04d", i % 900 + 100, i % 99 + 1, i % 9000 + 1000)


def _phone(i: Column) -> Column:
    return _number("555-%03d-%04d", i % 900 + 100, i % 10000)


def contacts(customer: DataFrame) -> DataFrame:
    """A table with personal data in several columns, made from the customers' keys."""
    i = F.col("c_custkey")
    email = F.concat(F.lit("customer"), i.cast("string"), F.lit("@example.com"))
    note = F.concat(F.lit("Call 555-123-"), F.lpad((i % 10000).cast("string"), 4, "0"), F.lit(" or write to customer"), (i % 50).cast("string"), F.lit("@example.com"))
    return customer.select(i.alias("id"), email.alias("email"), _ssn(i).alias("ssn"), _phone(i).alias("phone"), note.alias("note"))


def churn_customers(rows: DataFrame, key: str) -> DataFrame:
    """Made-up customers by modular arithmetic on a table's keys, one for each row."""
    i = F.col(key)
    return rows.select(
        _number("CUST-%06d", i).alias("customer_id"),
        F.concat(F.lit("customer"), i.cast("string"), F.lit("@example.com")).alias("email"),
        _phone(i).alias("phone"),
        _number("2024-%02d-%02d", i % 12 + 1, i % 28 + 1).alias("last_purchase"),
        (i % 7).alias("support_tickets"),
        F.when(i % 4 == 0, i % 4).otherwise(F.lit(0).cast("long")).alias("payment_delays"),
        (i % 200 + 50).alias("monthly_usage"),
    )


# What the made-up records name.
DIAGNOSES = ["E11.9", "I10", "Z00.00", "J44.1", "M79.3", "F32.9", "K21.9", "I25.10"]
MERCHANTS = ["Amazon", "Walmart", "Target", "Starbucks", "Shell", "McDonalds", "Home Depot", "Best Buy"]
LOCATIONS = ["New York,NY", "Los Angeles,CA", "Chicago,IL", "Houston,TX", "Phoenix,AZ", "Philadelphia,PA"]


def _one_of(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def patients(rows: DataFrame, key: str) -> DataFrame:
    """Made-up patient records by modular arithmetic on a table's keys, one for each row."""
    i = F.col(key)
    return rows.select(
        _number("PAT-%06d", i).alias("patient_id"),
        _ssn(i).alias("ssn"),
        _phone(i).alias("phone"),
        _number("%d-%02d-%02d", i % 50 + 1950, i % 12 + 1, i % 28 + 1).alias("date_of_birth"),
        _one_of(DIAGNOSES, i).alias("diagnosis_codes"),
        (i % 12 + 1).alias("visit_count"),
        _number("2024-%02d-%02d", i % 12 + 1, i % 28 + 1).alias("last_visit"),
    )


def transactions(rows: DataFrame, key: str) -> DataFrame:
    """Made-up card transactions by modular arithmetic; every fiftieth has a suspiciously high amount on a table's keys, one for each row."""
    i = F.col(key)
    group = i % 9000 + 1000
    return rows.select(
        _number("TXN-%08d", i).alias("transaction_id"),
        _number("%04d-%04d-%04d-%04d", i % 1000 + 4000, group, group, group).alias("credit_card"),
        _ssn(i).alias("ssn"),
        _phone(i).alias("phone"),
        F.when(i % 50 == 0, i * 10.0 + 5000.0).otherwise(i % 500 + 10.0).alias("amount"),
        _one_of(MERCHANTS, i).alias("merchant"),
        _number("2024-%02d-%02dT%02d:%02d:00Z", i % 12 + 1, i % 28 + 1, i % 24, i * 7 % 60).alias("timestamp"),
        _one_of(LOCATIONS, i).alias("location"),
    )
