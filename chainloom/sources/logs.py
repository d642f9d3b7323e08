"""Scans of browser logs: one printed Python dict a line, in a folder for each sample."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.urls import start_url
from chainloom.sources.schemas import MESSAGE

LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}


@F.pandas_udf(T.StringType())
def _literal_as_json(line: pd.Series) -> pd.Series:
    """A printed dict as JSON text, by Python's literal grammar; null where it is something else."""

    def one(x):
        try:
            return None if x is None else json.dumps(ast.literal_eval(x))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return line.map(one)


def parse_lines(line: Column, schema: str) -> Column:
    """Printed dicts as structs. Built-in JSON where it reads them right; lines with escapes or literals that it would
    change or miss go through Python's literal grammar. Nothing is ever evaluated."""
    odd = line.rlike(r"\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\'|\b(True|False|None)\b")
    quick = F.from_json(F.when(~odd, line), schema, LENIENT)
    careful = F.from_json(_literal_as_json(F.when(odd, line)), schema)
    return F.when(odd, careful).otherwise(quick)


def log_lines(spark: SparkSession, paths) -> DataFrame:
    """(folder, seq, line) of text files; seq is the line's place in its file. Folders are named as they are or as ``save_lines`` names them."""
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = decoded(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    folder = F.when(name.startswith("folder="), decoded(F.substring(name, 8, 1000))).otherwise(name)
    files = spark.read.text(paths, wholetext=True).select(folder.alias("folder"), "value")
    lines = files.select("folder", F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return lines.where(F.trim("line") != "").select("folder", F.col("seq").cast("long").alias("seq"), "line")


def events(lines: DataFrame, domain: Column | None = None) -> DataFrame:
    """Flat log events (schemas.LOG) of (folder, seq, line). ``domain``: that of the sample, by default the folder's name up to its time stamp."""
    domain = F.regexp_replace("folder", r"_\d{4}(-\d{2}){5}$", "") if domain is None else domain
    record = parse_lines(F.col("line"), "struct<message:string,timestamp:long>")
    parsed = lines.select("folder", "seq", domain.alias("domain"), record.alias("r")).select("folder", "seq", "domain", F.col("r.timestamp").alias("ts"), F.from_json("r.message", MESSAGE)["message"].alias("m"))
    p = lambda name: F.col(f"m.params.{name}")
    frames = F.transform(p("initiator.stack.callFrames"), lambda f: f["url"])
    return parsed.where(F.col("m.method").isNotNull()).select(
        F.col("folder").alias("sample_id"), start_url(F.col("domain")).alias("start_url"), "seq", "ts", F.col("m.method").alias("method"),
        p("requestId").alias("request_id"), p("frameId").alias("frame_id"), p("parentFrameId").alias("parent_frame_id"), p("loaderId").alias("loader_id"),
        p("type").alias("resource_type"), p("documentURL").alias("document_url"), F.coalesce(p("request.url"), p("url")).alias("url"),
        p("request.urlFragment").alias("url_fragment"), p("request.method").alias("http_method"), p("request.headers").alias("request_headers"),
        p("initiator.type").alias("initiator_type"), p("initiator.url").alias("initiator_url"), p("initiator.stack").isNotNull().alias("has_stack"),
        F.array_distinct(F.filter(frames, lambda u: u.isNotNull() & (u != ""))).alias("call_urls"),
        p("redirectResponse.url").alias("redirect_url"), p("redirectResponse.status").alias("redirect_status"), p("redirectResponse.headers").alias("redirect_headers"),
        p("response.status").alias("status"), p("response.headers").alias("response_headers"), p("reason").alias("reason"),
    )


def save_lines(lines: DataFrame, root: str) -> None:
    """Lines (folder, seq, line) as one text file for each folder, in the order of seq."""
    ordered = lines.repartition("folder").sortWithinPartitions("folder", "seq")
    ordered.select("folder", F.col("line").alias("value")).write.mode("overwrite").partitionBy("folder").text(root)


def read_logs(spark: SparkSession, root: str, files: str = "performance_log.txt", domain: Column | None = None) -> DataFrame:
    """Events of every sample folder under ``root``; ``files`` names the log in each."""
    return events(log_lines(spark, f"{root}/*/{files}"), domain)


def read_responses(spark: SparkSession, root: str, request_ids: DataFrame | None = None, files: str = "response_log.txt") -> DataFrame:
    """(sample_id, request_id, body, ts): the last body of each request. ``request_ids`` (request_id): the wanted ones; none means all."""
    lines = log_lines(spark, f"{root}/*/{files}")
    record = parse_lines(F.col("line"), "struct<requestId:string,body:string,timestamp:long>")
    rows = lines.select(F.col("folder").alias("sample_id"), "seq", record.alias("r")).select("sample_id", "seq", F.col("r.requestId").alias("request_id"), F.col("r.body").alias("body"), F.col("r.timestamp").alias("ts"))
    if request_ids is not None:
        rows = rows.join(request_ids.select("request_id").distinct(), "request_id", "left_semi")
    return rows.where(F.col("request_id").isNotNull()).groupBy("sample_id", "request_id").agg(F.max_by("body", "seq").alias("body"), F.max_by("ts", "seq").alias("ts"))
