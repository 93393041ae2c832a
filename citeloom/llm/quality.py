"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Two questions are judged alike: is a text of low quality, is it toxic.  A logistic model on presence features (words,
and the shares of token shapes such as capitals with exclamation marks) gives the document's log-odds; it is fitted on
at most ``SAMPLE`` labelled rows, drawn by hash.  All labels then count by path and host: the spread between hosts, and
between the paths of a host, beyond what chance explains says how strongly a host shrinks toward the global rate and a
path toward its host.  A document's posterior log-odds are its evidence plus its path's deviation from the global rate.
Counts are grouped sums with partial aggregation; a hot host is one row after them.

Defined results: a null text is empty; null hosts or paths are sites of their own; labels of a doc_id are averaged, a
tie counts as good, null labels are ignored; without labels nothing is rejected; a site without labels has its parent's
rate; repeated rows are judged alike; an empty table gives no rows; further columns play no part (``accepted`` passes
them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import (
    carried, in_small_batches, ALNUM_WORDS, MULTIPLIER, SPACE_WORDS, hashed_words, row_identity, row_runs, scrambled, settled, text_bytes)

#: Most labelled rows that the document model is fitted on.
SAMPLE = 20_000
#: Features per question.
FEATURES = 256
#: Features that chance alone may bring into a question's model, over all that are tested in the sample.
CHANCE = 0.05
QUESTIONS = ("low", "toxic")
#: A text is rejected from this posterior on; letting toxic text pass costs more than asking for a second look.
REJECT = {"low": 0.5, "toxic": 0.35}

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x30:0x3A] = 1, 2, 3
SHAPE[0x09:0x0E] = 0x20
SHAPE[0x00:0x09] = SHAPE[0x0E:0x20] = 4
SHAPE[0x80:] = 0


def _distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, row, times), by row."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])])[:len(values)])
    return values[fresh], rows[fresh], np.diff(np.concatenate([fresh, [len(values)]]))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) pairs, each once, of texts that lie one after the other in ``data``.

    Words are even numbers; the shares of token shapes, variety, echoes and length are odd.
    """
    n = len(bounds) - 1
    words, counts = hashed_words(data, bounds, ALNUM_WORDS)
    word, word_row, _ = _distinct(words, np.repeat(np.arange(n), counts))

    shapes = SHAPE[data]
    on = shapes != 0
    at = np.concatenate([[0], np.cumsum(on)])
    shapes, inner = shapes[on], at[bounds]
    keep = np.ones(len(shapes), dtype=bool)
    keep[1:] = shapes[1:] != shapes[:-1]
    keep[inner[:-1][inner[:-1] < len(shapes)]] = True
    inner = np.concatenate([[0], np.cumsum(keep)])[inner]
    tokens, sizes = hashed_words(shapes[keep], inner, SPACE_WORDS)
    shape, shape_row, times = _distinct(tokens, np.repeat(np.arange(n), sizes))
    share = np.floor(np.log2(times / sizes[shape_row])).clip(-8, 0) + 9 if len(times) else times
    shape = scrambled(shape + share.astype(np.uint64) * MULTIPLIER)

    row = np.repeat(np.arange(n), counts)
    echo = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n)
    each = np.maximum(counts, 1)
    whole = [np.bincount(word_row, minlength=n) * 8 // each, -(-echo * 8 // each), np.floor(np.log2(counts + 1))]
    whole = [scrambled((w.astype(np.uint64) + np.uint64(64 * i)) * MULTIPLIER + np.uint64(5))
             for i, w in enumerate(whole)]
    odd = np.uint64(1)
    return (np.concatenate([word & ~odd, *[w | odd for w in (shape, *whole)]]),
            np.concatenate([word_row, shape_row, *[np.arange(n)] * len(whole)]))


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes and, per question, a weight for each and a bias; the bias is the rate's log-odds alone
    where nothing could be fitted."""

    names: np.ndarray
    weights: dict[str, np.ndarray]
    bias: dict[str, float]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for low, high in row_runs(offsets):
        yield low, high, *features(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, low, toxic) as 0 or 1, one row per labelled document; null where nobody said."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") < 0.5).cast("int").alias("low"), (F.avg("toxic") > 0.5).cast("int").alias("toxic"))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, n, low, toxic): in how many rows of ``sample``(low, toxic, text) a feature is, by label."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [batch.column(i).fill_null(0).to_numpy() for i in (0, 1)]
            for low, high, names, rows in _pieces(batch.column(2)):
                names, back = np.unique(names, return_inverse=True)
                sums = [np.bincount(back, weights=m[low:high][rows]).astype(np.int64) for m in marks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(back).astype(np.int64)), *map(pa.array, sums)],
                    names=["feature", "n", "low", "toxic"])

    parts = sample.select("low", "toxic", "text").mapInArrow(work, "feature bigint, n bigint, low bigint, toxic bigint")
    return parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")])


def likelihood_ratio(n: Column, k: Column, rows: float, hits: float) -> Column:
    """G2 of the two-by-two table of a feature (n rows, k of them marked) in ``rows`` rows, ``hits`` marked."""
    def part(seen: Column, wanted: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)

    rate = hits / rows
    return 2 * (part(k, n * rate) + part(n - k, n * (1 - rate)) + part(hits - k, (rows - n) * rate) + part(
        rows - n - hits + k, (rows - n) * (1 - rate)))


def least_ratio(tested: int) -> float:
    """The G2 that CHANCE of ``tested`` features without any bearing reach: a quantile of chi-square, one degree."""
    return NormalDist().inv_cdf(CHANCE / max(tested, 1) / 2) ** 2


def bar(features: DataFrame, rows: float, hits: float) -> float:
    """The G2 that a feature of ``features``(n) needs.  Those in so few rows that no label could lift them over it are
    not tested and do not raise it."""
    n = F.col("n")
    most = F.greatest(*[likelihood_ratio(n, k, rows, hits) for k in (
        F.least(n, F.lit(hits)), F.greatest(n - F.lit(rows - hits), F.lit(0.0)))])
    sizes = features.groupBy("n").agg(F.count("*").alias("c")).select("n", "c", most.alias("most")).orderBy("n").collect()
    tested = sum(r.c for r in sizes)
    for r in sizes:  # at most a row for each number of sampled rows
        if r.most >= least_ratio(tested):
            break
        tested -= r.c
    return least_ratio(tested)


def fitted_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) by penalised Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fitted(docs: DataFrame, marks: DataFrame, most: int = SAMPLE, top: int = FEATURES) -> Model:
    """The document model from at most ``most`` labelled rows of ``docs``."""
    chosen = settled(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most ``most`` rows of three numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    sample = settled(sample.select("low", "toxic", "text"))
    said = sample.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    counts = settled(feature_counts(sample).where("n > 1"))  # a single row shows nothing
    names: set[int] = set()
    own: dict[str, set[int]] = {}
    for question in QUESTIONS:
        hits = said[question] or 0
        if 0 < hits < said.n:
            score = likelihood_ratio(F.col("n"), F.col(question), float(said.n), float(hits))
            tested = counts.select("feature", "n", F.col(question).alias("k"), score.alias("g"))
            if question == "toxic":  # a matter of what is said: words
                tested = tested.where(F.col("feature") % 2 == 0)
            told = tested.where(F.col("g") >= bar(tested, float(said.n), float(hits)))
            if question == "toxic":  # that speak for it
                told = told.where(F.col("k") * said.n > F.col("n") * hits)
            own[question] = {r.feature for r in told.orderBy(F.desc("g"), "feature").limit(top).collect()}
            names |= own[question]
    sorted_names = np.sort(np.array(sorted(names), dtype=np.int64).view(np.uint64))
    weights, bias = {}, {}
    rows = presence(sample, sorted_names).collect()  # at most ``most`` rows of at most 2 * ``top`` numbers
    x = np.zeros((len(rows), len(sorted_names)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r.on] = 1
    for question in QUESTIONS:
        known = np.array([r[question] is not None for r in rows], dtype=bool)
        y = np.array([r[question] or 0 for r in rows], dtype=np.float64)
        if known.any() and 0 < y[known].sum() < known.sum():
            used = np.isin(sorted_names.view(np.int64), np.array(sorted(own.get(question, ())), dtype=np.int64))
            w = fitted_logistic(x[known][:, used], y[known])
            weights[question], bias[question] = np.zeros(len(sorted_names)), float(w[-1])
            weights[question][used] = w[:-1]
        else:
            weights[question], bias[question] = np.zeros(len(sorted_names)), -30.0
    return Model(sorted_names, weights, bias)


def _present(names: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of ``found`` is in the sorted ``names``, where)."""
    if not len(names):
        return np.zeros(len(found), dtype=bool), np.zeros(len(found), dtype=np.int64)
    at = np.searchsorted(names, found).clip(0, len(names) - 1)
    return names[at] == found, at


def presence(sample: DataFrame, names: np.ndarray) -> DataFrame:
    """(low, toxic, on): which of ``names`` each sampled row has."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found, rows in _pieces(batch.column(2)):
                has, at = _present(names, found)
                at, rows = at[has], rows[has]
                order = np.argsort(rows, kind="stable")
                offsets = np.searchsorted(rows[order], np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32)))],
                    names=["low", "toxic", "on"])

    return sample.select("low", "toxic", "text").mapInArrow(work, "low int, toxic int, on array<int>")


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """(doc_id, who, host, path, e_low, e_toxic): every row's site and document log-odds."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found, rows in _pieces(batch.column(4)):
                has, at = _present(model.names, found)
                sums = [model.bias[q] + np.bincount(rows[has], weights=model.weights[q][at[has]], minlength=high - low)
                        if len(model.names) else np.full(high - low, model.bias[q]) for q in QUESTIONS]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(low, high - low) for i in range(4)], *map(pa.array, sums)],
                    names=["doc_id", "who", "host", "path", "e_low", "e_toxic"])

    site = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in (host, path)]
    rows = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), site[0].alias("host"),
                       site[1].alias("path"), "text")
    return in_small_batches(rows).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, who bigint, host string, path string, "
                                 "e_low double, e_toxic double")


def strength(spread: Column, chance: Column, groups: Column, weight: Column, rate: Column) -> Column:
    """Prior observations that a parent's rate is worth, by moments: ``spread`` is the weighted squared deviation of
    ``groups`` free children, ``chance`` its binomial part per child."""
    variance = F.greatest((spread - groups * chance) / F.greatest(weight, F.lit(1e-9)), F.lit(0.0))
    return F.when(variance > 0, F.least(F.greatest(rate * (1 - rate) / variance - 1, F.lit(1.0)), F.lit(1e9))).otherwise(
        1e9)


def posteriors(scored: DataFrame, marks: DataFrame) -> DataFrame:
    """(host, path, n_docs, d_<question>): per path, how far its posterior log-odds are from the global rate's."""
    said = scored.select("doc_id", "host", "path").join(marks, "doc_id")
    sums = [F.count(q).alias(f"n_{q}") for q in QUESTIONS] + [F.sum(q).alias(f"k_{q}") for q in QUESTIONS]
    counted = said.groupBy("host", "path").agg(*sums)
    names = [f"{a}_{q}" for a in "nk" for q in QUESTIONS]
    paths = settled(scored.groupBy("host", "path").agg(F.count("*").alias("n_docs")).join(
        counted, ["host", "path"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in names}))
    hosts = settled(paths.groupBy("host").agg(
        *[F.sum(c).alias(f"h{c}") for c in names],
        *[F.sum(F.col(f"n_{q}") ** 2).alias(f"s_{q}") for q in QUESTIONS],
        *[F.count(F.when(F.col(f"n_{q}") > 0, 1)).alias(f"c_{q}") for q in QUESTIONS]))
    both = settled(paths.join(hosts, "host"))
    result = both
    for q in QUESTIONS:
        n, k, hn, hk = (F.col(f"{p}_{q}") for p in ("n", "k", "hn", "hk"))
        top = hosts.agg(F.sum(hn).alias("n"), F.sum(hk).alias("k")).first()
        if not top.n or not top.k:  # nothing known, or nothing bad: sites say nothing
            result = result.withColumn(f"d_{q}", F.lit(0.0))
            continue
        rate = min(top.k / top.n, 1 - 0.5 / (top.n + 1))
        chance = rate * (1 - rate)
        a = hosts.where(hn > 0).agg(
            F.sum(hn * (hk / hn - rate) ** 2).alias("q"), F.count("*").alias("g"), F.sum(hn * hn).alias("s")).first()
        b = both.where(n > 0).agg(F.sum(n * (k / n - hk / hn) ** 2).alias("q")).first()
        c = hosts.where(hn > 0).agg(
            F.sum(hn - F.col(f"s_{q}") / hn).alias("w"), F.sum(F.col(f"c_{q}") - 1).alias("g")).first()
        for_host = strength(*map(F.lit, (a.q, chance, a.g - 1.0, top.n - a.s / top.n, rate)))
        for_path = strength(*map(F.lit, (b.q or 0.0, chance, float(c.g), c.w, rate)))
        host_rate = (hk + for_host * rate) / (hn + for_host)
        path_rate = (k + for_path * host_rate) / (n + for_path)
        result = result.withColumns({
            f"host_{q}": host_rate, f"path_{q}": path_rate,
            f"d_{q}": F.log(path_rate / (1 - path_rate)) - F.lit(math.log(rate / (1 - rate)))})
    return settled(result.select("host", "path", "n_docs", *[f"d_{q}" for q in QUESTIONS]))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = SAMPLE) -> DataFrame:
    """(doc_id, who, host, path, e_low, e_toxic, p_low, p_toxic, keep), one row per row of ``docs``(doc_id, text)."""
    marks = settled(labelled(labels))
    scored = settled(evidence(docs, fitted(docs, marks, most), host, path))
    sites = posteriors(scored, marks)
    odds = {q: F.col(f"e_{q}") + F.col(f"d_{q}") for q in QUESTIONS}
    return scored.join(sites, ["host", "path"]).select(
        "doc_id", "who", "host", "path", "e_low", "e_toxic",
        *[(1 / (1 + F.exp(-odds[q]))).alias(f"p_{q}") for q in QUESTIONS],
        ((odds["low"] < math.log(REJECT["low"] / (1 - REJECT["low"])))
         & (odds["toxic"] < math.log(REJECT["toxic"] / (1 - REJECT["toxic"])))).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``docs`` without the rejected rows."""
    bad = settled(classified(docs, labels, host, path).where("NOT keep").select("who").distinct())
    return carried(docs).join(bad, "who", "left_anti").select("row.*")
