"""Registered queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.llm import encoding, mixing, names, packing, splitting, tokens
from semframe.session import durable, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(table(spark, d, "cutv_export")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link(table(spark, d, "cutv_export"))


def p4_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(table(spark, d, "items"), table(spark, d, "limits")).drop("state_est", "ctx_total")


def p4_requests(spark: SparkSession, d: str) -> DataFrame:
    return packing.requests(packing.assign(table(spark, d, "items"), table(spark, d, "limits")))


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.assign(table(spark, d, "items"), table(spark, d, "limits")))


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Each item with what was placed of it, in how many parts, and whether one of its requests is over its protocol's total."""
    assigned = packing.assign(table(spark, d, "items"), table(spark, d, "limits"))
    over = packing.requests(assigned).select("request_id", F.coalesce((F.col("unused") < 0) & (F.col("status") == "packed"), F.lit(False)).alias("over"))
    return assigned.join(over, "request_id").groupBy("item_id").agg(F.sum("part_est").alias("est"), F.count(F.lit(1)).alias("parts"), F.max("over").alias("over"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(splitting.split_documents(table(spark, d, "doc_inputs"), table(spark, d, "limits")))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "doc_inputs"), table(spark, d, "limits"))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its lines and characters as its pieces hold them (shared lines once), and whether a piece is over the
    limit."""
    docs, limits = table(spark, d, "doc_inputs"), table(spark, d, "limits")
    pieces = splitting.split_documents(docs, limits)
    own = F.expr("slice(lines, shared_lines + 1, greatest(size(lines) - shared_lines, 0))")
    first = F.coalesce(F.col("start_char"), F.lit(0)) == 0
    sums = pieces.groupBy("input_id").agg(
        F.sum(F.when(first, F.size(own)).otherwise(0)).alias("n_lines"),
        F.sum(F.aggregate(own, F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit(""))))).alias("chars"), F.max("est").alias("largest"))
    room = docs.select("input_id", "protocol").join(limits.select("protocol", "ctx_state_q"), "protocol", "left")
    return sums.join(room, "input_id").select("input_id", "n_lines", "chars", F.coalesce(F.col("largest") > F.col("ctx_state_q"), F.lit(False)).alias("over"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.sizes_of(table(spark, d, "documents"))
    return mixing.mix(sizes, table(spark, d, "mix_targets")).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(mixing.sizes_of(table(spark, d, "documents")), targets), targets)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each target is met to half a per cent of the mix, without a document used too often."""
    got = p7_shares(spark, d)
    return got.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"))


def p8_routes(spark: SparkSession, d: str) -> DataFrame:
    """How the damaged documents were found, and how many of them came back."""
    return encoding.repair(table(spark, d, "documents")).groupBy("route").agg(F.count(F.lit(1)).alias("found"), F.count("restored").alias("restored"))


def p8_planted(spark: SparkSession, d: str) -> DataFrame:
    """Sound documents, misread once and twice on purpose: whether nearly all of them are found and come back as they were."""
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7F]"))
    sound = docs.join(encoding.repair(docs).select("doc_id"), "doc_id", "left_anti")
    again = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    planted = sound.select("doc_id", F.lit(1).alias("times"), F.col("text").alias("true"), again(F.col("text")).alias("text")).unionByName(
        sound.select("doc_id", F.lit(2).alias("times"), F.col("text").alias("true"), again(again(F.col("text"))).alias("text")))
    planted = durable(planted.withColumn("key", F.concat_ws("-", "doc_id", "times")))
    back = encoding.repair(planted.select("key", "text"), key="key")
    out = planted.join(back, "key", "left").groupBy("times").agg(F.avg(F.col("kind").isNotNull().cast("int")).alias("found"), F.avg(F.coalesce(F.col("restored") == F.col("true"), F.lit(False)).cast("int")).alias("same"))
    return out.select("times", (F.col("found") >= 0.99).alias("found"), (F.col("same") >= 0.95).alias("same"))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """How many accounts name more than one entity in a field."""
    linked = names.link(table(spark, d, "cutv_export"))
    return linked.groupBy("field", "cust_id").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.count_if(F.col("n") > 1).alias("twice"))


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p2_check, p4_assignments, p4_requests, p4_fill, p4_check, p5_found, p5_pieces, p5_check, p6_ids, p7_uses, p7_shares, p7_check, p8_found, p8_restored, p8_routes, p8_planted)}

SQL = {
    "p4_check": """
        WITH x AS (SELECT DISTINCT * FROM items), once AS (SELECT item_id, arg_min(r, (r.state_id, r.protocol, r.state_est, r.est)) AS r
            FROM (SELECT item_id, {'state_id': state_id, 'protocol': protocol, 'state_est': state_est, 'est': est} AS r FROM x) GROUP BY item_id),
        sized AS (SELECT item_id, r.est AS est, r.state_id AS state_id, l.ctx_total - r.state_est AS cap FROM once LEFT JOIN limits l ON l.protocol = r.protocol)
        SELECT item_id, CASE WHEN est >= 0 THEN CAST(est AS BIGINT) END AS est,
            CASE WHEN state_id IS NOT NULL AND cap > 0 AND est > cap THEN CAST(ceil(est / cap) AS BIGINT) ELSE CAST(1 AS BIGINT) END AS parts, false AS over FROM sized""",
    "p5_check": """
        SELECT input_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(list_sum([length(coalesce(x, '')) for x in lines]), 0) AS BIGINT) AS chars, false AS over
        FROM doc_inputs""",
    "p2_check": "SELECT field, CAST(0 AS BIGINT) AS twice FROM (VALUES ('acct_nm'), ('prim_cntct')) AS f(field)",
    "p8_planted": "SELECT times, true AS found, true AS same FROM (VALUES (1), (2)) AS t(times)",
    "p7_check": "SELECT source, true AS met, true AS within FROM mix_targets",
    "p5_found": """
        SELECT DISTINCT input_id FROM doc_inputs JOIN limits USING (protocol)
        WHERE list_sum(line_est) > ctx_state_q""",
}
