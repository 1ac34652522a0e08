"""Mixed timestamp notations and zones to one instant, by a persistent dictionary of distinct spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timeparse import instant_us
from tidegauge.operators.lookup import lookup
from tidegauge.session import exists, materialise, scratch, shared_dir

KEYS = ["field", "raw", "zone"]
_SCHEMA = "field string, raw string, zone string, utc_us long"
#: Raised whenever ``instant_us`` reads something otherwise: an instant stands for a spelling only as long as the reading is the same.
READING = 2


class InstantDictionary:
    """Distinct (field, raw text, zone) with the instant each means, kept as a table that only grows.

    Each spelling is parsed once, when it is first seen; ``update`` reads the spellings it is given, leaves out those already in the
    table (anti-join) and appends the rest. ``utc_us`` is null for spellings without an instant, so that junk isn't tried again."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "instants")

    @classmethod
    def kept(cls, spark: SparkSession) -> InstantDictionary:
        """The dictionary that stays in the shared folder from run to run. What a spelling means depends on it alone, so tables can share one; should two runs add a spelling at
        the same time it is there twice, with the same instant, which ``normalise`` allows for."""
        return cls(spark, f"{shared_dir(spark)}/tidegauge/instants-{READING}")

    def table(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def update(self, spellings: DataFrame) -> None:
        """Add the new ones among ``spellings`` (field, raw, zone; may repeat)."""
        new = spellings.select(*KEYS).distinct()
        if exists(self.spark, self.path):
            new = new.join(self.table().select(*KEYS), KEYS, "left_anti")
        new.withColumn("utc_us", instant_us(self.spark, F.col("raw"), F.col("zone"))).write.mode("append").parquet(self.path)


def spellings(df: DataFrame, row_id: str, utc: str, local: str, zone: str) -> DataFrame:
    """The two time texts of each row as rows ``row_id, field, raw, zone``; texts without a digit mean nothing and are left out.
    A null or blank zone is written ''."""
    given = F.coalesce(F.trim(F.col(zone)), F.lit(""))
    both = F.array(
        F.struct(F.lit("utc").alias("field"), F.trim(F.col(utc)).alias("raw"), F.lit("UTC").alias("zone")),
        F.struct(F.lit("local").alias("field"), F.trim(F.col(local)).alias("raw"), given.alias("zone")),
    )
    return df.select(F.col(row_id).alias("row_id"), F.inline(both)).where(F.col("raw").rlike("[0-9]"))


def normalise(df: DataFrame, row_id: str, utc: str, local: str, zone: str, dictionary: InstantDictionary | None = None) -> DataFrame:
    """``row_id, utc_us`` of each row whose instant can be told: what ``utc`` says (UTC unless it states a zone), else what ``local``
    says in the zone it states or else in ``zone``. See ``functions.timeparse.instant_us`` for notations, repeated and skipped
    local times. Rows without an instant don't come out; ``row_id`` must be unique and not null; an empty table gives an empty result.
    One spelling may have any share of the rows. Without a ``dictionary`` a new one is made for this call."""
    spark = df.sparkSession
    dictionary = dictionary or InstantDictionary(spark)
    texts = spellings(df, row_id, utc, local, zone)
    weights = materialise(texts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "spellings")
    dictionary.update(weights)
    known = dictionary.table().where("utc_us is not null").groupBy(*KEYS).agg(F.min("utc_us").alias("utc_us"))
    entries = known.join(weights, KEYS)
    total = weights.agg(F.sum("n")).first()[0] or 0
    instants = lookup(texts, entries, KEYS, "n", total)
    best = F.coalesce(F.max(F.when(F.col("field") == "utc", F.col("utc_us"))), F.max(F.when(F.col("field") == "local", F.col("utc_us"))))
    return instants.groupBy("row_id").agg(best.alias("utc_us")).withColumnRenamed("row_id", row_id)
