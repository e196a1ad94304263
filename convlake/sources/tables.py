"""Scans: captured pages, raw turns, and API dumps with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A provider's conversation dump; the block struct is the union of all kinds of blocks.
API_SCHEMA = (
    "uuid string, name string, summary string, created_at string, updated_at string, project_uuid string, "
    "chat_messages array<struct<uuid:string,text:string,sender:string,index:int,created_at:string,updated_at:string,"
    "content:array<struct<type:string,text:string,thinking:string,name:string,"
    "input:struct<id:string,type:string,title:string,content:string,language:string,version_uuid:string>>>>>"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured page snapshots (page_id, url, html)."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def spread(pages: DataFrame) -> DataFrame:
    """Scanned pages over all cores, where their files make fewer partitions than that.

    To parse a page takes far more than to move it.  Only for scans: counting partitions runs nothing there.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if not pages.isStreaming and pages.rdd.getNumPartitions() < cores else pages


def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw turns as messages (conv_id, turn, role, content)."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def parse_api(text: Column) -> Column:
    """A dump's JSON as a struct; unknown fields are ignored, and what can't be read is null."""
    return F.from_json(text, API_SCHEMA, {"mode": "PERMISSIVE"})


def read_api_dump(spark: SparkSession, path: str) -> DataFrame:
    """Dumps stored as JSON lines; rows that can't be read keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{API_SCHEMA}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def explode_api_messages(dumps: DataFrame, api: str = "api") -> DataFrame:
    """One row for each message of each dump, with its place."""
    return dumps.select("*", F.posexplode_outer(f"{api}.chat_messages").alias("message_pos", "message"))


def explode_api_blocks(dumps: DataFrame, api: str = "api") -> DataFrame:
    """One row for each content block of each message; a message without content gives none."""
    return explode_api_messages(dumps, api).select("*", F.posexplode("message.content").alias("block_pos", "block"))
