"""Secret scan with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content.  The ledger remembers which (blob, rule, rule
version) triples have been scanned; a run scans one copy of each blob, by the rules whose version the ledger lacks, and
joins the findings of its blobs back to every row that holds them.

A match's place follows from the pieces around it: ``split`` by the rule gives the text between the matches, so the
start of a match is the length of all pieces and matches before it, in code points: a running sum over the matches of one
rule in one blob, each a row.

Defined results: a null text is empty and has no secret; copies and repeated rows all get the findings of their blob;
matches of one rule never overlap; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import checkpoint_folder, row_identity, settled


@dataclass(frozen=True)
class Rule:
    """``pattern`` (leftmost, non-overlapping); a match counts if group ``part`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    part: int
    least: int


#: Fixed values, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)

FINDINGS = "blob string, kind string, rule_version int, rank int, start bigint, stop bigint"
SCANNED = "blob string, kind string, rule_version int"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct(rank, pos, gap, long, kept)> of a rule's matches in ``text``, in order; ``gap`` is the length of what is
    before a match and after the one before."""
    pattern = F.lit(rule.pattern)
    pieces = [F.regexp_extract_all(text, pattern, F.lit(0)).alias("w"), F.split(text, rule.pattern, -1).alias("g")]
    if rule.part:
        pieces.append(F.regexp_extract_all(text, pattern, F.lit(rule.part)).alias("p"))
    # zipped, so that a lambda looks at its own match only; the last piece has no match after it
    return F.transform(F.filter(F.arrays_zip(*pieces), lambda m: m["w"].isNotNull()), lambda m, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("pos"), F.char_length(m["g"]).alias("gap"),
        F.char_length(m["w"]).alias("long"), (F.char_length(m["p" if rule.part else "w"]) >= rule.least).alias("kept")))


def placed(found: DataFrame) -> DataFrame:
    """(blob, rank, start, stop) of the kept ones of ``found``(blob, rank, pos, gap, long, kept)."""
    so_far = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ended = found.withColumn("stop", F.sum(F.col("gap") + F.col("long")).over(so_far))
    return ended.where("kept").select("blob", "rank", (F.col("stop") - F.col("long")).alias("start"), "stop")


def ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def scanned(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger in ``folder`` up to date with ``docs``(doc_id, text); gives the rows with their blob.

    Findings are written before the scanned triples: a run that is lost in between is simply repeated, and findings
    are read once per (blob, rule, version, place).
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = settled(keyed.select("doc_id", "blob", row_identity("doc_id", "blob").alias("who")))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")
    blobs = paths.groupBy("blob").agg(F.min("who").alias("who"))
    known = ledger(spark, folder, "scanned", SCANNED).join(
        F.broadcast(wanted), ["kind", "rule_version"]).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    todo = settled(blobs.join(known, "blob", "left").withColumn(
        "done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size("done") < len(rules)))
    texts = keyed.withColumn("who", row_identity("doc_id", "blob")).join(
        todo, ["blob", "who"]).select("blob", "text", "done")
    nothing = F.array().cast("array<struct<rank:int,pos:int,gap:int,long:int,kept:boolean>>")
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    found = F.flatten(F.array(*[
        F.when(F.array_contains("done", rule.kind), nothing).otherwise(matches(F.col("text"), rule, rank))
        for rank, rule in enumerate(rules)]))
    spans = placed(texts.select("blob", F.explode(found).alias("f")).select("blob", "f.*"))
    spans.withColumn("rule", F.get(kinds, F.col("rank"))).select("blob", "rule.*", "rank", "start", "stop").write.mode(
        "append").parquet(f"{folder}/findings")
    todo.select("blob", F.explode(kinds).alias("r"), "done").select("blob", "r.*", "done").where(
        ~F.array_contains("done", F.col("kind"))).drop("done").write.mode("append").parquet(f"{folder}/scanned")
    return paths


def findings(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")
    return ledger(spark, folder, "findings", FINDINGS).join(F.broadcast(wanted), ["kind", "rule_version"]).distinct()


def secrets(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, n_<kind> per rule, spans), one row per row of ``docs``; spans are kind:start:stop in text order.

    Without ``folder`` the run starts a ledger of its own.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/blob-ledger-{uuid4().hex}"
    paths = scanned(docs, folder, rules)
    place = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop")))
    text = F.array_join(F.transform("f", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules]
    blobs = settled(findings(spark, folder, rules).groupBy("blob").agg(place.alias("f"), *counts).withColumn(
        "spans", text).drop("f"))
    return paths.join(blobs, "blob", "left").select(
        "doc_id", "blob", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules],
        F.coalesce("spans", F.lit("")).alias("spans"))
