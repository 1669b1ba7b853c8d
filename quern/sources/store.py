"""Content-addressed documents: keys, hashes, verified reads, versions that serve; and the tables' writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text


def valid_key(key: Column) -> Column:
    """Whether a key is a plain relative path: no empty, `.` or `..` parts, no leading or trailing slash, no backslash."""
    parts = F.split(key, "/")
    return key.isNotNull() & (key != "") & ~key.contains("\\") & ~F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, content of stored objects."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def addressed(documents: DataFrame, extension: str = "html") -> DataFrame:
    """Documents (celex, resolved_celex, html) with the stored text (scripts gone), its sha256, size and key; empty ones raise."""
    stored = documents.withColumn("stored", text.without_scripts("html"))
    guarded = F.when(F.trim(F.coalesce("stored", F.lit(""))) == "", F.raise_error(F.concat(F.lit("empty document: "), "celex")).cast("string")).otherwise(F.col("stored"))
    stored = stored.withColumn("stored", guarded).withColumns({"sha256": F.sha2("stored", 256), "size_bytes": F.octet_length("stored").cast("long")})
    return stored.withColumn("key", F.concat_ws("/", "celex", "resolved_celex", F.concat("sha256", F.lit(f".{extension}"))))


def verified(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (content, sha256) whose bytes still have their recorded hash, and those that don't."""
    same = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    return contents.where(same), contents.where(~same)


def serving_versions(documents: DataFrame, held: DataFrame) -> DataFrame:
    """celex, version: the first of a document's candidate versions, then itself, that the store (version) holds; null if none."""
    tries = documents.select("celex", F.posexplode(F.concat("candidates", F.array("celex"))).alias("place", "version"))
    served = tries.join(held.select("version").distinct(), "version", "left_semi").groupBy("celex").agg(F.min_by("version", "place").alias("version"))
    return documents.select("celex").join(served, "celex", "left")


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def updated(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored rows with the fields that a change sets; `set_fields` names them, so that a null can be set too."""
    columns = [c for c in stored.columns if c != key]
    c = changes.select(F.col(key), "set_fields", *(F.col(x).alias(f"_{x}") for x in columns if x in changes.columns))
    joined = stored.join(c, key, "left")
    new = [F.when(F.coalesce(F.array_contains("set_fields", x), F.lit(False)), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns else F.col(x) for x in columns]
    return joined.select(key, *new)


def swap_periods(df: DataFrame, path: str, by: str = "period") -> None:
    """Replaces the periods that df holds, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def files_to_load(published: DataFrame, loaded: DataFrame) -> DataFrame:
    """Published files (period, version) whose version isn't the loaded one."""
    have = loaded.select("period", F.col("version").alias("_version")).distinct()
    return published.join(have, "period", "left").where(~F.col("version").eqNullSafe(F.col("_version"))).drop("_version")


def split_requests(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of runs, and a row for each of their steps (chat_request_id, position, step, ms, tokens, cost_usd, model)."""
    requests = states.drop("steps").withColumn("answer", F.when(F.col("answer") != "", F.col("answer")))
    steps = states.select(F.col("id").alias("chat_request_id"), F.posexplode("steps").alias("position", "s")).select("chat_request_id", "position", "s.*")
    return requests, steps


def voted(ledger: DataFrame, votes: DataFrame) -> DataFrame:
    """The ledger with votes (request_id, vote, voted_at); a null vote takes back. Votes for unknown requests raise."""
    lost = votes.join(ledger.select("request_id"), "request_id", "left_anti")
    if not lost.isEmpty():
        raise KeyError(f"no request {lost.first().request_id}")
    last = votes.withColumn("_n", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("voted_at")))).where("_n = 1")
    new = last.select("request_id", F.col("vote").alias("_vote"), F.when(F.col("vote").isNotNull(), F.col("voted_at")).alias("_at"), F.lit(True).alias("_set"))
    joined = ledger.join(new, "request_id", "left")
    pick = lambda a, b: F.when(F.col("_set"), F.col(a)).otherwise(F.col(b))
    return joined.withColumns({"vote": pick("_vote", "vote"), "voted_at": pick("_at", "voted_at")}).select(*ledger.columns)


def dump(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """A snapshot of tables; names sort by time."""
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")


def newest_dump(names: DataFrame) -> DataFrame:
    return names.agg(F.max("name").alias("name"))


def restored(spark: SparkSession, root: str, name: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot, to be written where they are wanted."""
    return {table: spark.read.parquet(f"{root}/{name}/{table}") for table in tables}
