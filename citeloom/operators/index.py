"""A stored inverted index and a top-k search that reads only the postings which can matter.

A score is the summed weight of the question's tokens that a chunk holds over the root of its token count.  Weights depend
on the whole collection and are taken at search time, so the index keeps what does not change: postings in order of token
count, in blocks that name their least count.  Segments are only ever added.

Three passes answer any number of questions at once:

1. The first postings of each asked token are scored as far as they go.  The k-th best such sum is a bar that the
   question's k-th best score cannot be below.
2. A token's postings can bring forth a candidate only if this token and all lighter ones of the question together could
   reach the bar: ``upto / sqrt(count) >= bar``, where the heaviest token that a chunk holds speaks for it.  Common words,
   light and long in postings, pass for the shortest chunks only.  Blocks whose least count fails are not opened.
3. Candidates are scored from the forward index, by their own tokens.

Hot tokens are cut by chunk hash, so that neither building nor reading gathers one word's postings in a task.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.operators import retrieval as R
from citeloom.plans.durable import settled

BUCKETS = 8
PART_POSTINGS = 8192
BLOCK_POSTINGS = 128
FIRST_POSTINGS = 32
SPREAD = 4
#: Bounds are compared in floating point, so a bar is lowered by far more than rounding can amount to.
SLACK = 1 - 1e-9


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def add_segment(chunk_rows: DataFrame, root: str, scope: str = "doc_id", part_postings: int = PART_POSTINGS,
                block_postings: int = BLOCK_POSTINGS, buckets: int = BUCKETS) -> str:
    """Index ``chunk_rows(doc_id, page, chunk_id, text)`` as a further segment of the index in ``root``; gives its name.

    A segment counts once its row in ``sizes`` is there, which is written last: what a lost run leaves is never read.
    Chunks are taken as new ones; one that is in several segments counts as often.  Tables lie in ``buckets`` folders by
    token or document, which the first segment fixes: as many as make a folder some hundred megabytes.
    """
    spark = chunk_rows.sparkSession
    name, buckets = uuid4().hex, _buckets(spark, root) or buckets
    forward = f"{root}/forward/segment={name}"
    R.token_sets(chunk_rows, scope).withColumn("home", _bucket(F.col("chunk.doc_id"), buckets)).repartition(
        F.col("home"), _bucket(F.col("chunk"), SPREAD)).write.partitionBy("home").parquet(forward)
    rows = spark.read.parquet(forward)

    single = R.exploded(rows.select("scope", "chunk", F.size("tokens").alias("n_tokens"), "tokens"))
    terms = single.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"))
    terms.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket").write.partitionBy(
        "bucket").parquet(f"{root}/terms/segment={name}")
    hot = spark.read.parquet(f"{root}/terms/segment={name}").where(F.col("df") > part_postings).select(
        "scope", "token", F.ceil(F.col("df") / part_postings).cast("int").alias("parts"))
    dealt = single.join(settled(hot), ["scope", "token"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int"), F.lit(0)))
    listed = dealt.groupBy("scope", "token", "part").agg(
        F.sort_array(F.collect_list(F.struct("n_tokens", "chunk"))).alias("entries"))
    starts = F.sequence(F.lit(0), F.floor((F.size("entries") - 1) / block_postings).cast("int"))
    blocks = listed.select("scope", "token", "part", F.posexplode(F.transform(
        starts, lambda i: F.slice("entries", i * block_postings + 1, block_postings))).alias("block", "entries"))
    blocks.withColumn("least", F.get("entries", F.lit(0))["n_tokens"]).withColumn(
        "bucket", _bucket(F.col("token"), buckets)).repartition("bucket", "part").sortWithinPartitions(
        "bucket", "token", "least").write.partitionBy("bucket").parquet(f"{root}/postings/segment={name}")
    # last, and one file
    R.collection_sizes(rows, "scope").withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{root}/sizes/segment={name}")
    return name


def _buckets(spark: SparkSession, root: str) -> int | None:
    """Number of folders of an index's tables; None where there is no index yet."""
    try:
        return spark.read.parquet(f"{root}/sizes").agg(F.max("buckets")).first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the index, of its finished segments alone."""
    finished = [r.segment for r in spark.read.parquet(f"{root}/sizes").select("segment").distinct().collect()]
    # one name per appended batch
    paths = [f"{root}/{name}/segment={segment}" for segment in finished]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths).drop("segment")


def weighed(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """(q_id, scope, token, df, units) for ``asked``(q_id, scope, token), over all segments."""
    buckets = _buckets(spark, root)
    wanted = asked.select("scope", "token", _bucket(F.col("token"), buckets).alias("bucket")).distinct().where("bucket >= 0")
    frequency = _table(spark, root, "terms").join(wanted, ["bucket", "scope", "token"], "left_semi").groupBy(
        "scope", "token").agg(F.sum("df").alias("df"))
    sizes = _table(spark, root, "sizes").groupBy("scope").agg(F.sum("n_chunks").alias("n_chunks"))
    return asked.join(frequency, ["scope", "token"]).join(sizes, "scope").select(
        "q_id", "scope", "token", "df", R.token_units(F.col("df"), F.col("n_chunks")).alias("units"))


def _score(units: Column, count: Column) -> Column:
    return units / F.lit(float(R.WEIGHT_UNIT)) / F.sqrt(F.greatest(count, F.lit(1)))


def _met(spark: SparkSession, root: str, weights: DataFrame) -> DataFrame:
    """Blocks of the asked tokens, a row per question that asks; read from the asked buckets alone."""
    wanted = weights.withColumn("bucket", _bucket(F.col("token"), _buckets(spark, root))).where("units > 0")
    return _table(spark, root, "postings").join(wanted, ["bucket", "scope", "token"])


def bars(spark: SparkSession, root: str, weights: DataFrame, k: int, first: int = FIRST_POSTINGS) -> DataFrame:
    """(q_id, bar): a score that the question's k-th best chunk reaches; no row where fewer than ``k`` chunks are met."""
    opened = _met(spark, root, weights).where("block = 0").select(
        "q_id", "units", F.explode(F.slice("entries", 1, first)).alias("e")).groupBy("q_id", "e.chunk").agg(
        F.sum("units").alias("units"), F.max("e.n_tokens").alias("n_tokens"))
    best = Window.partitionBy("q_id").orderBy(F.desc("reached"))
    placed = opened.select("q_id", _score(F.col("units"), F.col("n_tokens")).alias("reached")).withColumn(
        "place", F.row_number().over(best)).where(F.col("place") <= k)
    return placed.where(F.col("place") == k).select("q_id", (F.col("reached") * SLACK).alias("bar"))


def candidates(spark: SparkSession, root: str, weights: DataFrame, bar_rows: DataFrame) -> DataFrame:
    """(q_id, scope, chunk): every chunk whose score may reach its question's bar."""
    lighter = Window.partitionBy("q_id").orderBy("units", "token").rowsBetween(Window.unboundedPreceding, 0)
    # one question's tokens, never more
    bounded = settled(weights.withColumn("upto", F.sum("units").over(lighter)).join(bar_rows, "q_id", "left").withColumn(
        "bar", F.coalesce("bar", F.lit(0.0))))
    blocks = _met(spark, root, bounded).where(_score(F.col("upto"), F.col("least")) >= F.col("bar"))
    entries = blocks.select("q_id", "scope", "upto", "bar", F.explode("entries").alias("e"))
    return entries.where(_score(F.col("upto"), F.col("e.n_tokens")) >= F.col("bar")).select(
        "q_id", "scope", "e.chunk").distinct()


def scored(spark: SparkSession, root: str, weights: DataFrame, candidate_rows: DataFrame) -> DataFrame:
    """``candidate_rows`` with their ``lexical`` score, by the tokens the forward index has for them."""
    asked = weights.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "units"))).alias("asked"))
    homed = candidate_rows.withColumn("home", _bucket(F.col("chunk.doc_id"), _buckets(spark, root))).where("home >= 0")
    held = _table(spark, root, "forward").join(homed, ["home", "scope", "chunk"]).join(asked, "q_id")
    # The second array is the one that is hashed, for every candidate: the question's, which is the short one.
    shared = F.array_intersect(F.col("tokens"), F.map_keys("asked"))
    units = F.aggregate(shared, F.lit(0).cast("bigint"), lambda total, t: total + F.element_at("asked", t))
    return held.select("q_id", "chunk.*", _score(units, F.size("tokens")).alias("lexical"))


def search(spark: SparkSession, root: str, questions: DataFrame, k: int = fixed.DEFAULT_TOP_K,
           scope: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Ranked chunks per question and the token weights they were ranked with, as :func:`retrieval.search` gives them,
    from the index in ``root``."""
    weights = settled(weighed(spark, root, settled(R.question_tokens(questions, scope))))
    found = settled(candidates(spark, root, weights, bars(spark, root, weights, k)))
    return R.top_k(scored(spark, root, weights, found), k), weights
