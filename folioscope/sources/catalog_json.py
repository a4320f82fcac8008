"""JSON catalogue files to rows. ``docs`` hold one JSON text per row in the named column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = ("map<string,struct<text:string,filename:string,source_id:string,section_title:string,"
         "parent_section:string,language:string>>")
GROUP = "map<string,struct<name:string,description:string,group_admins:array<string>,created_at:string>>"
RETRIEVAL = "struct<chunks_per_doc:int,max_total_chunks:int,similarity_threshold:double,default_language:string>"
SETTINGS = f"struct<default:string,groups:map<string,string>,retrieval_params:map<string,{RETRIEVAL}>>"


#: Stands before each text of a JSON text sequence (RFC 7464); no JSON text holds it unescaped.
RECORD = "\x1e"


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, value — one row per JSON text, of any number of lines: a whole file, or one of the texts of a JSON text sequence."""
    texts = spark.read.text(path, lineSep=RECORD).filter(F.trim("value") != "")
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


def write_json_sequences(texts: DataFrame, path: str, *partition: str) -> None:
    """The JSON texts in column ``value`` as text sequences in a folder per value of ``partition``: many texts share a file."""
    texts.select(*partition, "value").write.partitionBy(*partition).option("lineSep", RECORD).text(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value — one row per line; blank lines are skipped."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), "value")


def chunk_maps(docs: DataFrame, column: str = "value") -> DataFrame:
    keep = [c for c in docs.columns if c != column]
    rows = docs.select(*keep, F.explode(F.from_json(column, CHUNK)).alias("chunk_key", "c"))
    return rows.select(*keep, "chunk_key", "c.*")


def group_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    rows = docs.select(F.explode(F.from_json(column, GROUP)).alias("group_id", "g"))
    return rows.select("group_id", "g.name", "g.description", F.col("g.group_admins").alias("admins"),
                       F.to_timestamp("g.created_at").alias("created_at"))


def membership_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    """user_id, ord, group_id."""
    users = docs.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("user_id", "gs"))
    return users.select("user_id", F.posexplode("gs").alias("ord", "group_id"))


def document_tag_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    tags = docs.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("doc_id", "ts"))
    return tags.select("doc_id", F.explode("ts").alias("tag"))


def user_tag_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    return docs.select(F.explode(F.from_json(column, "map<string,string>")).alias("user_id", "user_tag"))


def settings_rows(docs: DataFrame, column: str = "value") -> DataFrame:
    """group_id, provider and retrieval limits; the fallback is the row 'default'."""
    s = docs.select(F.from_json(column, SETTINGS).alias("s"))
    named = F.map_concat(F.map_from_arrays(F.array(F.lit("default")), F.array("s.default")), F.coalesce(
        "s.groups", F.create_map().cast("map<string,string>")))
    params = F.coalesce("s.retrieval_params", F.create_map().cast(f"map<string,{RETRIEVAL}>"))
    ids = F.array_union(F.map_keys(named), F.map_keys(params))
    rows = s.select(named.alias("named"), params.alias("params"), F.explode(ids).alias("group_id"))
    return rows.select("group_id", F.try_element_at("named", F.col("group_id")).alias("provider"),
                       F.try_element_at("params", F.col("group_id")).alias("p")).select("group_id", "provider", "p.*")
