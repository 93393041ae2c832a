"""The operators as named queries over the given tables: production parameters, whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import (decontamination, divergence, exact_dedup, license_scan, lm_scoring, mixing, ngram_join,
                          periodic_runs, personal_data, quality, secret_scan, sharding, suffix_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
MIX = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "most": 2.0}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sites() -> dict[str, Column]:
    """``documents`` name no address: the source stands for the host, its part in one language for the path."""
    return {"host": F.col("source"), "path": F.col("lang")}


@query
def op1_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"), **sites())
    return rows.select("doc_id", "p_low", "p_toxic", "e_low", "e_toxic", "keep")


@query
def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"), **MIX)


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = license_scan.matched(table(spark, folder, "documents"))
    listed = F.transform("matches", lambda m: F.concat_ws(
        ":", m["license"], F.floor(m["containment"] * 1000).cast("bigint"), m["word"]))
    return rows.select("doc_id", F.size("matches").cast("bigint").alias("n_licenses"),
                       F.array_join(listed, ",").alias("licenses"))


def _license_sql() -> str:
    notices = ", ".join("('{}', '{}')".format(*[x.replace("'", "''") for x in pair]) for pair in license_scan.NOTICES)
    return rf"""
WITH notice(license, text) AS (VALUES {notices}),
worded AS (
    SELECT doc_id, NULL AS license, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents
    UNION ALL SELECT NULL, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') FROM notice),
brief AS (SELECT license, len(w) AS size, array_to_string(w, ' ') AS s FROM worded
          WHERE license IS NOT NULL AND len(w) BETWEEN 1 AND 4),
said AS (
    SELECT doc_id, brief.license, min(i) - 1 AS start
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM worded, (SELECT DISTINCT size FROM brief) WHERE doc_id IS NOT NULL) d
    JOIN brief ON brief.size = d.size AND array_to_string(w[i:i + d.size - 1], ' ') = brief.s
    GROUP BY doc_id, brief.license),
shingle AS (
    SELECT doc_id, license, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, license, w, unnest(range(1, len(w) - 3)) AS i FROM worded)),
own AS (SELECT DISTINCT license, s FROM shingle WHERE license IS NOT NULL),
kind AS (
    SELECT license, m, CASE WHEN m > 1 THEN greatest(4, CAST(pow(2, ceil(log2((m - 1) / 0.75 + 1e-9))) AS INTEGER))
        ELSE 4 END AS size FROM (SELECT license, count(*) AS m FROM own GROUP BY license)),
met AS (SELECT d.doc_id, own.license, d.p, d.s, m, size, size // 4 AS step
        FROM shingle d JOIN own USING (s) JOIN kind ON kind.license = own.license WHERE d.doc_id IS NOT NULL),
windowed AS (
    SELECT doc_id, license, m, s, p, size, step, k * step AS start
    FROM (SELECT *, unnest(range(greatest(0, p // step - 4), p // step + 1)) AS k FROM met)),
contained AS (
    SELECT doc_id, license, start, count(DISTINCT s) / m AS c FROM windowed WHERE p < start + size
    GROUP BY doc_id, license, m, start),
best AS (
    SELECT doc_id, license, c, start FROM contained
    WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY c DESC, start) = 1
    UNION ALL SELECT doc_id, license, 1, start FROM said),
listed AS (
    SELECT doc_id, count(*) AS n, string_agg(license || ':' || CAST(floor(c * 1000) AS BIGINT) || ':' || start, ','
        ORDER BY license) AS t FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(t, '') AS licenses
FROM documents LEFT JOIN listed USING (doc_id)"""


ORACLES["op3_license_scan"] = _license_sql()


@query
def op4_backoff_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = lm_scoring.scored(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"),
                       F.round(F.col("log_score") / F.col("n_tokens"), 4).alias("mean_log_score"))


ORACLES["op4_backoff_score"] = r"""
WITH worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w[i] AS w, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS v
         FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded)),
word AS (SELECT w, count(*) AS n FROM spot GROUP BY w UNION ALL SELECT ' ', count(*) FROM worded WHERE len(w) > 0),
own AS (SELECT doc_id, w, count(*) AS n FROM spot GROUP BY ALL UNION ALL SELECT doc_id, ' ', 1 FROM worded),
own_pair AS (SELECT doc_id, v, w, count(*) AS n FROM spot GROUP BY ALL),
pair AS (SELECT v, w, sum(n) AS n FROM own_pair GROUP BY ALL),
score AS (
    SELECT p.doc_id, sum(p.n * CASE WHEN a.n > p.n THEN ln(a.n - p.n) - ln(v.n - o.n)
        ELSE ln(0.4) + ln(w.n) - ln((SELECT count(*) FROM spot)) END) AS s
    FROM own_pair p JOIN pair a ON a.v = p.v AND a.w = p.w JOIN word v ON v.w = p.v JOIN word w ON w.w = p.w
    JOIN own o ON o.doc_id = p.doc_id AND o.w = p.v GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 3) AS log_score,
    CASE WHEN len(d.w) > 0 THEN round(coalesce(s, 0) / len(d.w), 4) END AS mean_log_score
FROM worded d LEFT JOIN score ON score.doc_id = d.doc_id"""


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, folder, "documents"))


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(table(spark, folder, "documents"), keep_first=False)
    return rows.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(table(spark, folder, "documents"), 3, 90, 100).drop("who")


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM worded WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b USING (s)
         WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
         WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id,
    coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id
LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n_links FROM link GROUP BY x) k ON k.x = d.doc_id"""


@query
def op8_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.sharded(table(spark, folder, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "sub")


@query
def op9_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontamination.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op9_winnowing"] = r"""
WITH lowered AS (
    SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, doc_id,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL
    SELECT 'b', CAST(item_id AS VARCHAR), NULL,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
worded AS (
    SELECT side, id, doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM lowered),
asked AS (
    SELECT DISTINCT id AS item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
    FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM worded
          WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM asked),
had AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, sizes
          WHERE side = 'd' AND len(w) >= size)),
met AS (SELECT doc_id, i, had.size, item FROM had JOIN asked ON had.gram = asked.gram AND had.size = asked.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM worded w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN listed ON w.doc_id = listed.doc_id
WHERE side = 'd'"""


@query
def op10_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


ORACLES["op10_blob_ledger"] = r"""
WITH whole AS (
    SELECT doc_id, text, 'assign' AS kind, 0 AS rank, 8 AS least,
        regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS w,
        regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS p
    FROM documents
    UNION ALL
    SELECT doc_id, text, 'access', 1, 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+')
    FROM documents
    UNION ALL
    SELECT doc_id, text, 'hex', 2, 32, regexp_extract_all(text, '[0-9a-f]{32,}'), regexp_extract_all(text, '[0-9a-f]{32,}')
    FROM documents),
gaps AS (
    SELECT doc_id, kind, rank, least, w, p, CASE kind
        WHEN 'assign' THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
        WHEN 'access' THEN string_split_regex(text, 'AKIA[A-Z0-9]+')
        ELSE string_split_regex(text, '[0-9a-f]{32,}') END AS g
    FROM whole WHERE len(w) > 0),
each AS (
    SELECT doc_id, kind, rank, least, i, length(g[i]) AS gap, length(w[i]) AS long, length(p[i]) AS part
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM gaps)),
placed AS (
    SELECT doc_id, kind, rank, least, long, part,
        sum(gap + long) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
found AS (
    SELECT doc_id, kind, rank, CAST(stop - long AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
    WHERE part >= least),
listed AS (
    SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h
    FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)"""


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(table(spark, folder, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
worded AS (SELECT doc_id, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM worded GROUP BY ALL
         HAVING count(DISTINCT doc_id) >= 10),
whole AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM worded JOIN kept USING (lang, term) GROUP BY ALL),
grouped AS (
    SELECT g.lang, g.source, coalesce(any_value(w.v), 0) AS v, coalesce(any_value(w.n), 0) AS all_n,
        coalesce(sum(u.n), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN whole w ON w.lang = g.lang
    LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
cell AS (
    SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS c,
        1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 2) // (g.n + 2 * g.v)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (k.total + 2) // (g.all_n + 2 * g.v)::HUGEINT AS q
    FROM grouped g JOIN kept k ON k.lang = g.lang
    LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
between_groups AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN between_groups x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cell WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10"""


@query
def op12_bootstrapped_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.extracted(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the contract's table for op13: texts whose doc_id hashes to a multiple of ten repeat their words
    from one place on, with a period that the hash chooses.  A null doc_id chooses nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.when(n > 0, F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # an array of one, so that the text is split once, not once for each of its words
    rewritten = F.get(F.transform(F.array(words), repeated), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, rewritten).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = periodic_runs.detected(planted(table(spark, folder, "documents")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
