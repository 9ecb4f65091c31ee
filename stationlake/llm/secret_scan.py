"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Base spans come from three patterns. Besides them, long opaque tokens are candidates. All candidates' values are
hashed and counted over the distinct repositories and owners that hold them: what many owners share was copied from
an example, what stays with one or two of them looks live. Opaque tokens that look live are spans of their own (kind
`own`); base spans stay whatever their counts say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Kind, pattern, group that the length counts for, least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
#: Runs below the least length never make a span here, so the patterns can ask for it and matches stay the same.
QUICK = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
OWN = len(BASE)  # the kind of opaque tokens
MATCH = "struct<kind:int, number:int, gap:int, size:int, value:bigint, counts:boolean>"
MOST_OWNERS = 2


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """All matches in order: kind, number, code points before the match since the last one, its code points, hash of the
    group's value, and whether the value counts (its length; in opaque tokens letters of both cases and digits, too)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)  # what lies before, between and behind the matches
    counts = lambda v: (F.length(v) >= least) & (mixed(v) if kind == OWN else F.lit(True))
    each = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"))), values,
        lambda s, v: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("number"), s["gap"].alias("gap"), s["size"].alias("size"), F.xxhash64(v).alias("value"), counts(v).alias("counts")))
    return F.transform(each, lambda x, i: x.withField("number", i))


def mixed(text: Column) -> Column:
    return text.rlike("[0-9]") & text.rlike("[A-Z]") & text.rlike("[a-z]")


def of_kind(kind: int):
    return lambda x: x["kind"] == kind


def shown(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "own")])
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, scratch: Scratch, owner: Column, repository: Column, most_owners: int = MOST_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) for every row of docs.

    n_live and n_copied split all spans by the owners of their values. A null text counts as empty; null owners count
    as one unknown owner; rows are kept one to one, with null and repeated ids; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    text, none = F.col("text"), F.expr(f"cast(array() as array<{MATCH}>)")
    has = {"assign": text.rlike("(?i)password|passwd|secret|token|api_?key"), "access": text.contains("AKIA"), "hex": text.rlike(QUICK["hex"])}
    parts = [F.when(has[k], matches(text, QUICK.get(k, p), g, n, i)).otherwise(none) for i, (k, p, g, n) in enumerate(BASE)]
    opaque = F.when(text.rlike(OPAQUE), matches(text, OPAQUE, 0, 20, OWN)).otherwise(none)
    found = docs.select("doc_id", "owner", "repository", F.concat(*parts, opaque).alias("items"))
    found = scratch.save(found.withColumn("row", F.monotonically_increasing_id()), "found")

    # Where matches stand: sums over those of their kind before them.
    each = found.select("row", "owner", "repository", F.inline("items"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("number")).cast("int")
    each = each.withColumn("end", end).where("counts")
    each = each.select("row", "owner", "repository", F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end", "value").alias("item"))
    each = scratch.save(each, "each")
    held = each.select(F.col("item.value").alias("value"), "owner", "repository").distinct()
    held = held.groupBy("value", "owner").agg(F.count("*").alias("repositories")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    held = held.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= 2 * most_owners)).select("value", "live")
    judged = each.select("row", F.col("item.value").alias("value"), "item").join(held, "value").where(f"live or item.kind < {OWN}")
    item = F.struct("item.start", "item.kind", "item.end", "live")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("judged"))
    none = F.expr("cast(array() as array<struct<start:int, kind:int, end:int, live:boolean>>)")
    done = found.select("doc_id", "row").join(judged, "row", "left").withColumn("judged", F.coalesce("judged", none))
    count = lambda test: F.size(F.filter("judged", test)).cast("long")
    return done.select(
        "doc_id", *[count(of_kind(i)).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(shown(F.filter("judged", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), shown(F.col("judged")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_copied"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner, and each of the source's languages a repository."""
    return scan_secrets(table(spark, sf_dir, "documents"), Scratch(spark, "op9"), F.col("source"), F.concat_ws("/", "source", "lang"))


#: The same result from matches of the plain patterns; places are sums of what lies before a match.
ORACLE_SQL = r"""
WITH texts AS (
    SELECT doc_id, text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents WHERE text IS NOT NULL
), found AS (
    SELECT doc_id, owner, repository, 0 AS kind, 'assign' AS name, 12 AS least,
        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
        regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals,
        string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps
    FROM texts
    UNION ALL
    SELECT doc_id, owner, repository, 1 AS kind, 'access' AS name, 18 AS least,
        regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS hits,
        NULL AS vals,
        string_split_regex(text, 'AKIA[A-Z0-9]+') AS gaps
    FROM texts
    UNION ALL
    SELECT doc_id, owner, repository, 2 AS kind, 'hex' AS name, 16 AS least,
        regexp_extract_all(text, '[0-9a-f]+') AS hits,
        NULL AS vals,
        string_split_regex(text, '[0-9a-f]+') AS gaps
    FROM texts
    UNION ALL
    SELECT doc_id, owner, repository, 3 AS kind, 'own' AS name, 20 AS least,
        regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}') AS hits,
        NULL AS vals,
        string_split_regex(text, '[A-Za-z0-9+/_-]{20,}') AS gaps
    FROM texts
), placed AS (
    SELECT doc_id, owner, repository, kind, name, least, hit, val,
        sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
    FROM (SELECT doc_id, owner, repository, kind, name, least, unnest(hits) AS hit, unnest(coalesce(vals, hits)) AS val,
        unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM found)
), spans AS MATERIALIZED (
    SELECT doc_id, owner, repository, kind, name, val, cast(stop - length(hit) AS BIGINT) AS start, cast(stop AS BIGINT) AS stop FROM placed
    WHERE length(val) >= least AND (kind < 3 OR regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]'))
), held AS (
    SELECT val, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, repository)) <= 4 AS live FROM spans GROUP BY val
), judged AS (
    SELECT doc_id, kind, start, name || ':' || start || ':' || stop AS shown, live FROM spans JOIN held USING (val) WHERE live OR kind < 3
), told AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
    FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN told USING (doc_id)
"""
