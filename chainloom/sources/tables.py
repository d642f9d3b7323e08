"""Scans and sinks of manifests, entries, chains, initiators, nodes, tags and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.sources import schemas

TSV = {"sep": "\t", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def read_tsv(spark: SparkSession, path, schema: str, place: str | None = None) -> DataFrame:
    """A headerless TSV; absent texts are empty, not null. place: a column with each line's place in the order of files and lines."""
    df = spark.read.options(**TSV, nullValue="\u0000").schema(schema).csv(path)
    at = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias(place)] if place else []
    return df.select(*at, *[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def sample_id(domain: Column, source: Column) -> Column:
    return F.concat_ws(":", domain, source)


def read_union(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Files of one layout under each other, with their ``origin`` (the key of ``paths``)."""
    parts = [read_tsv(spark, p, schema).withColumn("origin", F.lit(k)) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def manifest_samples(spark: SparkSession, path: str) -> DataFrame:
    """Crawled samples with the fields that later steps use."""
    return read_tsv(spark, path, schemas.MANIFEST).select("domain", "sample_tag", "start_url", "end_url", sample_id(F.col("domain"), F.col("sample_tag")).alias("sample_id"))


def with_redirects(chains: DataFrame) -> DataFrame:
    """Samples that redirect at least once."""
    return chains.where(F.col("hops") > 0)


# Which files hold a label's chains, in the order in which they are read.
CHAIN_FILES = {None: ("malicious", "current", "benign"), "malicious": ("malicious", "current"), "benign": ("benign",)}


def last_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that stands last in the given order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("row of key", F.row_number().over(w)).where(F.col("row of key") == 1).drop("row of key")


def load_chains(spark: SparkSession, paths: dict[str, str], sample: str | None = None, label: str | None = None) -> DataFrame | None:
    """(sample_id, label, urls array) of chain files; a sample that is there twice counts as last read. Unknown labels give None."""
    if label not in CHAIN_FILES:
        return None
    parts = []
    for k, origin in enumerate(CHAIN_FILES[label]):
        if origin in paths:
            parts.append(read_tsv(spark, paths[origin], schemas.CHAINS, "line_no").select(sample_id(F.col("domain"), F.col("source")).alias("sample_id"), "label", F.split("urls", " ").alias("urls"), F.lit(k).alias("file_no"), "line_no"))
    rows = reduce(DataFrame.unionByName, parts)
    if sample:
        rows = rows.where(F.col("sample_id") == sample)
    return last_of_key(rows, "sample_id", "file_no", "line_no").drop("file_no", "line_no")


# Which files hold a label's nodes, in the order in which they are read.
NODE_FILES = {None: ("benign", "malicious", "current"), "malicious": ("malicious", "current"), "benign": ("benign",)}


def load_nodes(spark: SparkSession, paths: dict[str, str], sample: str | None = None, label: str | None = None) -> DataFrame | None:
    """Node rows (sample_id and the columns of schemas.NODES) of node files, for ``tree.recover_trees``. ``sample``: only that one, from the first
    file that has it. Unknown labels give None."""
    if label not in NODE_FILES:
        return None
    parts = [read_tsv(spark, paths[origin], schemas.NODES).withColumn("file_no", F.lit(k)) for k, origin in enumerate(NODE_FILES[label]) if origin in paths]
    rows = reduce(DataFrame.unionByName, parts).withColumn("sample_id", sample_id(F.col("domain"), F.col("source")))
    if sample:
        rows = rows.where(F.col("sample_id") == sample)
        rows = rows.withColumn("first file", F.min("file_no").over(Window.partitionBy("sample_id"))).where(F.col("file_no") == F.col("first file")).drop("first file")
    return rows.drop("file_no")


def load_initiators(spark: SparkSession, path) -> DataFrame:
    """(sample_id, initiators array of hop and initiator): the rows of each sample together."""
    rows = read_tsv(spark, path, schemas.INITIATORS)
    return rows.groupBy(sample_id(F.col("domain"), F.col("source")).alias("sample_id")).agg(F.collect_list(F.struct("hop_url", "hop_ts", "init_url", "init_ts")).alias("initiators"))


def sample_paths(entries: DataFrame, roots: DataFrame, default_root: str) -> DataFrame:
    """Entries with the folder of their sample; ``roots`` (source, root) is a dimension that Spark may broadcast if it finds it small."""
    return entries.join(roots, "source", "left").withColumn("path", F.concat_ws("/", F.coalesce("root", F.lit(default_root)), F.when(F.col("root").isNull(), F.col("source")).otherwise(F.col("domain")))).drop("root")


def read_tags(spark: SparkSession, root: str, files: str = "redirection_tags.txt") -> DataFrame:
    """Tags of every sample and nested frame, of files with four columns (as written) or five (with the type). ``files`` names them."""
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=files).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("f"))
    typed = ~F.get("f", F.lit(1)).rlike("^[01]$")
    at = lambda i: F.when(typed, F.get("f", F.lit(i + 1))).otherwise(F.get("f", F.lit(i)))
    relative = F.regexp_extract("file", r"(?:^|/)" + root.rstrip("/").rsplit("/", 1)[-1] + r"/(.*)/[^/]+\.txt$", 1)
    relative = F.regexp_replace(relative, "sample_id=", "")
    return lines.where(F.size("f") >= 4).select(
        F.split_part(relative, F.lit("/"), F.lit(1)).alias("sample_id"), F.regexp_extract(relative, "^[^/]+/(.*)$", 1).alias("frame_path"), F.get("f", F.lit(0)).alias("tag_id"),
        F.when(typed, F.get("f", F.lit(1))).otherwise(F.regexp_extract(F.get("f", F.lit(0)), r"^(.*)_\d+$", 1)).alias("tag_type"), (at(1).try_cast("int") == 1).alias("visible"),
        F.from_json(at(2), "array<struct<x:double,y:double,width:double,height:double>>", {"allowSingleQuotes": "true"}).alias("rects"), at(3).alias("outer_html"),
    )


def read_features(spark: SparkSession, path) -> DataFrame:
    return read_tsv(spark, path, schemas.HMG)


# ---- sinks


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**TSV, nullValue="").csv(path)


def save_tags(tags: DataFrame, path: str) -> None:
    """Tag rows (sample_id, frame_path, tag_type, seq, visible, rects, outer_html), appended by tag type; ids count from 0 in each page."""
    w = Window.partitionBy("sample_id", "frame_path", "tag_type").orderBy("seq")
    kind = F.when(F.col("tag_type").isin("a", "area", "onclick", "iframe"), F.col("tag_type")).otherwise("iframe")
    out = tags.withColumn("tag_type", kind).withColumn("tag_id", F.concat_ws("_", "tag_type", F.row_number().over(w) - 1)).drop("seq")
    out.write.mode("append").partitionBy("tag_type").parquet(path)


def save_tag_files(tags: DataFrame, path: str) -> None:
    """Tag rows as ``save_tags`` takes them, with rects as text, in one four-column text file for each sample, types in their order."""
    w = Window.partitionBy("sample_id", "tag_type").orderBy("seq")
    kind = F.when(F.col("tag_type").isin("a", "area", "onclick", "iframe"), F.col("tag_type")).otherwise("iframe")
    named = tags.withColumn("tag_type", kind).withColumn("n", F.row_number().over(w) - 1)
    line = F.concat_ws("\t", F.concat_ws("_", "tag_type", "n"), F.col("visible").cast("int").cast("string"), "rects", "outer_html")
    ordered = named.select("sample_id", "tag_type", "n", line.alias("value")).repartition("sample_id").sortWithinPartitions("sample_id", "tag_type", "n")
    ordered.select("sample_id", "value").write.mode("overwrite").partitionBy("sample_id").text(path)


def save_manifest(samples: DataFrame, path: str) -> None:
    """Crawled samples (the columns of schemas.MANIFEST), appended."""
    write_tsv(samples.select(*[c.split()[0] for c in schemas.MANIFEST.split(", ")]), path, "append")


def save_failures(failures: DataFrame, path: str) -> None:
    """Crawls that failed (the columns of schemas.FAILURES), appended; texts on one line."""
    one = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "\t\n\r", "   ")
    write_tsv(failures.select(one("domain").alias("domain"), one("exception").alias("exception")), path, "append")


def save_chains(chains: DataFrame, path: str) -> None:
    """Chains as the ten columns of an entries file."""
    write_tsv(
        chains.select(
            "domain", "label", "source", "end_url", F.array_join("urls", " ").alias("urls"), F.array_join("methods", ";").alias("methods"), "hops",
            F.when(F.col("has_iframe"), "has_iframe").otherwise("no_iframe"), F.when(F.col("has_download"), "has_download").otherwise("no_download"), F.coalesce("download_url", F.lit("")),
        ), path,
    )


def save_initiators(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("label").parquet(path)


def node_rows(tree: DataFrame) -> DataFrame:
    """A tree table as rows of a node file: ids in breadth-first order, parent ids and child ids."""
    bfs = Window.partitionBy("sample_id").orderBy("depth", "path_ord")
    named = tree.withColumn("bfs", F.row_number().over(bfs) - 1)
    name = lambda c: F.concat(F.lit("node_"), F.col(c))
    parents = named.select("sample_id", F.col("node_seq").alias("parent_seq"), F.col("bfs").alias("parent_bfs"))
    children = named.where(F.col("parent_seq").isNotNull()).groupBy("sample_id", F.col("parent_seq").alias("node_seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("bfs")), lambda b: F.concat(F.lit("node_"), b)), " ").alias("children"))
    full = named.join(parents, ["sample_id", "parent_seq"], "left").join(children, ["sample_id", "node_seq"], "left")
    return full.select(
        "sample_id", name("bfs").alias("node_id"), F.concat("url", "url_fragment").alias("url"), F.coalesce(name("parent_bfs"), F.lit("")).alias("parent_id"),
        "parent_source", "resource_type", "ts", F.coalesce("children", F.lit("")).alias("children"),
    )


def save_nodes(tree: DataFrame, path: str) -> None:
    node_rows(tree).write.mode("overwrite").parquet(path)


def save_node_file(tree: DataFrame, entries: DataFrame, path: str) -> None:
    """Trees of samples (sample_id, domain, label, source) as a node file."""
    rows = node_rows(tree).join(entries, "sample_id")
    write_tsv(rows.select(*[c.split()[0] for c in schemas.NODES.split(", ")]), path)


def save_features(features: DataFrame, path: str) -> int:
    """Feature rows of samples with more than one node; their number."""
    kept = features.where(F.col("node_cnt") > 1)
    write_tsv(kept, path)
    return kept.count()


def save_roc(points: DataFrame, path: str) -> None:
    write_tsv(points.select("fp", "tp", "threshold"), path)


def printed_tree(tree: DataFrame) -> DataFrame:
    """(sample_id, path_ord, line): the tree as text, one line a node in depth-first order."""
    url = F.concat("url", "url_fragment")
    line = F.when(F.col("depth") == 1, url).otherwise(F.concat(F.repeat(F.lit("--"), F.col("depth") - 2), F.lit("-> "), url, F.lit(" (Type: "), "resource_type", F.lit("; Method: "), "parent_source", F.lit("; Timestamp: "), F.col("ts").cast("string"), F.lit(")")))
    return tree.select("sample_id", "path_ord", line.alias("line")).orderBy("sample_id", "path_ord")
