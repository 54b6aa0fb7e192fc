"""Chat exports in JSON to turns: lists of messages, threads, and trees of messages by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MESSAGE = "struct<id string, role string, sender string, author struct<role string>, content string, text string, create_time double, timestamp double, time double>"
_TREE = "map<string, struct<id string, message struct<id string, author struct<role string>, content struct<parts array<string>>, create_time double>>>"
_CHAT = f"struct<id string, title string, name string, messages array<{_MESSAGE}>, mapping {_TREE}>"
_EXPORT = f"struct<threads array<{_CHAT}>, conversations array<{_CHAT}>, messages array<{_MESSAGE}>, mapping {_TREE}, title string, name string, id string, memories array<struct<text string, content string>>>"


def _turn(m: Column) -> Column:
    when = F.coalesce(m["create_time"], m["timestamp"], m["time"])
    role = F.coalesce(m["role"], m["sender"], m["author"]["role"], F.lit("unknown"))
    return F.struct(role.alias("role"), F.coalesce(m["content"], m["text"], F.lit("")).alias("text"), when.alias("at"))


def _node(n: Column) -> Column:
    m = n["message"]
    return F.struct(F.coalesce(m["author"]["role"], F.lit("unknown")).alias("role"), F.array_join(F.coalesce(m["content"]["parts"], F.array().cast("array<string>")), "\n").alias("text"), m["create_time"].alias("at"))


def _turns(chat: Column) -> Column:
    listed = F.transform(F.coalesce(chat["messages"], F.from_json(F.lit("[]"), f"array<{_MESSAGE}>")), _turn)
    nodes = F.filter(F.map_values(F.coalesce(chat["mapping"], F.from_json(F.lit("{}"), _TREE))), lambda n: n["message"].isNotNull())
    return F.concat(listed, F.transform(nodes, _node))


def turns(files: DataFrame) -> DataFrame:
    """(source_name, content) -> source_name, thread (from 1), title, turn (from 1), role, text, at.

    An export is a list of conversations, an object with threads or conversations, or one conversation; each holds messages
    or a tree of them. Turns are by time, those without one last, then in the order they stand; empty ones go.
    """
    whole = F.from_json(F.when(F.ltrim("content").startswith("["), F.concat(F.lit('{"conversations":'), "content", F.lit("}"))).otherwise(F.col("content")), _EXPORT)
    rows = files.select("source_name", whole.alias("e"))
    alone = F.struct("e.id", "e.title", "e.name", "e.messages", "e.mapping")
    one = F.when(F.col("e.messages").isNotNull() | F.col("e.mapping").isNotNull(), F.array(alone)).otherwise(F.array().cast(f"array<{_CHAT}>"))
    none = F.array().cast(f"array<{_CHAT}>")
    chats = rows.select("source_name", F.posexplode(F.concat(F.coalesce("e.threads", none), F.coalesce("e.conversations", none), one)).alias("k", "c"))
    said = chats.select("source_name", (F.col("k") + 1).alias("thread"), F.coalesce("c.title", "c.name", F.lit("")).alias("title"), F.posexplode(_turns(F.col("c"))).alias("p", "t"))
    said = said.where(F.trim("t.text") != "")
    order = F.row_number().over(W.partitionBy("source_name", "thread").orderBy(F.col("t.at").asc_nulls_last(), "p"))
    return said.select("source_name", "thread", "title", order.alias("turn"), "t.role", "t.text", "t.at")


def memories(files: DataFrame) -> DataFrame:
    """source_name, at, text of an export's memories."""
    rows = files.select("source_name", F.posexplode(F.from_json("content", _EXPORT)["memories"]).alias("at", "m"))
    return rows.select("source_name", "at", F.coalesce("m.text", "m.content").alias("text")).where("text <> ''")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """source_name and content of the JSON files under a path."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_name").alias("source_name"), F.col("value").alias("content"))
