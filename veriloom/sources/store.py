"""Facts and extraction results on disk: Parquet tables that are only appended to, and read by key.

Appends are idempotent: what has an id that is stored already is left out by an anti join on ids alone.  A table is a folder; its writers are
serial (one ingest at a time), its readers see whole files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fact_type", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_str", T.StringType()),
        T.StructField("value_bool", T.BooleanType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("entity", T.StringType()),
        T.StructField("time_period", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("source_document", T.StringType()),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("source_snippet", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only on one machine may it be unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='veriloom-')).rstrip('/')}/store-{uuid.uuid4().hex}"


def iso(timestamp: str) -> F.Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id of the batch that isn't stored."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


class FactStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def facts(self) -> DataFrame:
        """All facts; an empty table where nothing is stored yet."""
        try:
            return self.spark.read.schema(FACT_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], FACT_SCHEMA)

    def facts_of(self, document: str) -> DataFrame:
        """One document's facts; the filter reaches the Parquet scan."""
        return self.facts().where(F.col("source_document") == document)

    def append(self, facts: DataFrame) -> DataFrame:
        """Store what is new; gives the ids of the whole batch."""
        batch = facts.select(*[F.col(f.name).cast(f.dataType) for f in FACT_SCHEMA.fields])
        new_rows(batch, self.facts()).write.mode("append").parquet(self.path)
        return batch.select("id").distinct()

    def clear(self) -> int:
        """Delete all facts; gives how many there were."""
        n = self.facts().count()
        self.spark.createDataFrame([], FACT_SCHEMA).write.mode("overwrite").parquet(self.path)
        return n

    @staticmethod
    def as_rows(facts: DataFrame) -> DataFrame:
        """For display: the time of creation as ISO text."""
        return facts.withColumn("created_at", iso("created_at"))


class ExtractionCache:
    """Facts by content hash and configuration signature, so that bytes seen before under any name need no model.

    A content is stored once, whatever names it has; a fact's id is made anew for each name from the name, the content and the fact's place
    in it, so twins and later copies have all their facts under ids of their own, in whatever order they come.
    """

    def __init__(self, spark: SparkSession, path: str, signature: str):
        self.spark, self.path, self.signature = spark, path, signature

    def _all(self) -> DataFrame:
        schema = T.StructType([T.StructField("content_sha16", T.StringType()), *FACT_SCHEMA.fields, T.StructField("signature", T.StringType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path).where(F.col("signature") == self.signature)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def hits(self, documents: DataFrame) -> DataFrame:
        """Cached facts of documents (source_document, content_sha16), under the names that these now have."""
        names = documents.select("content_sha16", F.col("source_document").alias("__name")).distinct()
        found = self._all().join(names, "content_sha16").where("id is not null").withColumn("source_document", F.col("__name"))
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_document", "content_sha16", "source_page", "chunk_no", "ordinal", "text", "source_snippet")]
        return found.withColumn("id", F.sha2(F.concat_ws("\u0001", *parts), 256)).select(*[f.name for f in FACT_SCHEMA.fields])

    def misses(self, documents: DataFrame) -> DataFrame:
        return documents.join(self._all().select("content_sha16").distinct(), "content_sha16", "left_anti")

    def put(self, contents: DataFrame, facts: DataFrame) -> None:
        """Store the facts (with content_sha16) of contents; one without facts is kept as a row with a null id, so that it is a hit next time."""
        rows = contents.select("content_sha16").distinct().join(facts.select("content_sha16", *[f.name for f in FACT_SCHEMA.fields]), "content_sha16", "left")
        rows.withColumn("signature", F.lit(self.signature)).write.mode("append").partitionBy("signature").parquet(self.path)
