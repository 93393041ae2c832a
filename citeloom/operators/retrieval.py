"""Lexical retrieval for batches of questions over one or many document collections.

A collection is whatever ``scope`` names: one document's chunks, or a whole corpus under one scope value.
Weights are summed as whole numbers, so a score does not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T
from citeloom.plans.durable import settled

WEIGHT_UNIT = 10**12
CHUNK_KEY = ["doc_id", "page", "chunk_id"]
LISTED_TOKENS = 256


def token_sets(chunk_rows: DataFrame, scope: str = "doc_id") -> DataFrame:
    """The forward index (scope, chunk, tokens): one row per chunk, its key as one column, its distinct tokens."""
    return chunk_rows.select(
        F.col(scope).alias("scope"), F.struct(*CHUNK_KEY).alias("chunk"), T.token_set(F.col("text")).alias("tokens"))


def exploded(rows: DataFrame) -> DataFrame:
    """One row per token.  The outer form keeps Spark from testing the array below the scan, tokenising twice."""
    kept = [name for name in rows.columns if name != "tokens"]
    return rows.select(*kept, F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())


def postings(index: DataFrame) -> DataFrame:
    """The inverted index: (scope, token) to the chunks holding it."""
    return exploded(index.select("scope", "chunk", F.size("tokens").alias("n_tokens"), "tokens"))


def document_frequency(index: DataFrame) -> DataFrame:
    return exploded(index.select("scope", "tokens")).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"))


def collection_sizes(chunk_rows: DataFrame, scope: str = "doc_id") -> DataFrame:
    return chunk_rows.groupBy(F.col(scope).alias("scope")).agg(F.count(F.lit(1)).alias("n_chunks"))


def question_tokens(questions: DataFrame, scope: str = "doc_id") -> DataFrame:
    """``questions(q_id, <scope>, question)`` to one row per distinct token."""
    return exploded(questions.select(
        "q_id", F.col(scope).alias("scope"), T.token_set(F.col("question")).alias("tokens")))


def token_units(df: Column, size: Column) -> Column:
    weight = F.ln((size + F.lit(1)) / (df + F.lit(0.5))) + F.lit(1.0)
    return F.round(weight * F.lit(float(WEIGHT_UNIT))).cast("bigint")


def matches(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the asked tokens alone: (scope, token, chunk, n_tokens).  Tokens that nobody asks for end here."""
    wanted = asked.select("scope", "token").distinct()
    return postings(index).join(wanted, ["scope", "token"], "left_semi")


def met(chunk_rows: DataFrame, asked: DataFrame, scope: str = "doc_id", listed_tokens: int = LISTED_TOKENS) -> DataFrame:
    """:func:`matches` of chunks that are not indexed yet.

    A collection asked for few tokens, such as a document with its questions, brings them to its chunks as one list: a chunk's
    row meets the list, a text that holds none of them is not tokenised and no other token ever becomes a row.
    Collections asked for more than ``listed_tokens`` are exploded, each token meeting its own postings.
    """
    lists = settled(asked.groupBy("scope").agg(F.collect_set("token").alias("asked")))
    few = lists.where(F.size("asked") <= listed_tokens)
    many = settled(lists.where(F.size("asked") > listed_tokens).select("scope"))
    tokens = T.let(T.casefold(F.col("text")), lambda folded: F.when(
        F.exists("asked", lambda token: F.contains(folded, token)), T.folded_token_set(folded)))
    listed = chunk_rows.select(F.col(scope).alias("scope"), F.struct(*CHUNK_KEY).alias("chunk"), "text").join(
        few, "scope").select("scope", "chunk", "asked", tokens.alias("tokens")).select(
        "scope", "chunk", F.size("tokens").alias("n_tokens"), F.array_intersect("tokens", "asked").alias("tokens"))
    crowded = token_sets(chunk_rows, scope).join(many, "scope", "left_semi")
    return exploded(listed).unionByName(matches(crowded, asked.join(many, "scope", "left_semi")))


def token_weights(found: DataFrame, sizes: DataFrame, asked: DataFrame) -> DataFrame:
    """(q_id, scope, token, df, units) for question tokens that occur in their collection."""
    frequency = found.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(frequency, ["scope", "token"]).join(sizes, "scope").select(
        "q_id", "scope", "token", "df", token_units(F.col("df"), F.col("n_chunks")).alias("units"))


def scores(found: DataFrame, weights: DataFrame) -> DataFrame:
    """Every (question, chunk) sharing a token, with ``lexical`` = summed weight / sqrt(chunk tokens) and the tokens ``met``."""
    matched = found.join(weights.select("q_id", "scope", "token", "units"), ["scope", "token"])
    summed = matched.groupBy("q_id", "chunk").agg(
        F.sum("units").alias("units"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("token")).alias("met"))
    lexical = F.col("units") / F.lit(float(WEIGHT_UNIT)) / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    return summed.select("q_id", "chunk.*", lexical.alias("lexical"), "met")


def top_k(scored: DataFrame, k: int = fixed.DEFAULT_TOP_K) -> DataFrame:
    """Best ``k`` chunks per question: score, then page, then chunk id as text."""
    order = Window.partitionBy("q_id").orderBy(F.desc("lexical"), "page", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    chunk_rows: DataFrame,
    questions: DataFrame,
    k: int = fixed.DEFAULT_TOP_K,
    scope: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Ranked chunks per question and the token weights they were ranked with.

    For collections that are asked once, or small ones such as single documents: chunks are tokenised here, and every chunk
    that shares a token is scored (:mod:`index` keeps an index and scores what can matter).  There is one plan for any
    number of questions: asked tokens are written down, so that Spark knows their size and broadcasts them where they
    are few; the postings they meet are written down once, and document frequencies and scores are taken from those.
    """
    asked = settled(question_tokens(questions, scope))
    found = settled(met(chunk_rows, asked, scope))
    weights = settled(token_weights(found, collection_sizes(chunk_rows, scope), asked))
    return top_k(scores(found, weights), k), weights

