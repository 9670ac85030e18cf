r"""Line dedup: site-relative frequency, with DataFrame functions only.

Documents are grouped by host. A line's frequency is the share of the host's pages that contain it; lines over
:data:`MAX_SHARE` are boilerplate and dropped wherever they stand on that host. The share says little of few pages: on a host of two
each line would be in half of them. So a host needs :data:`MIN_PAGES` pages and a line :data:`MIN_HITS` of them; both are parameters,
and with 1 the share alone decides. Lines are compared without surrounding blanks, by 64-bit hash; blank
lines stay.

Each page's distinct line hashes are counted by (host, line) with partial sums before the shuffle, so a hot host or line is a
sum, never a group. A host has at most its mean number of lines / :data:`MAX_SHARE` boilerplate lines, one small array; the arrays
are written to the checkpoint folder, so that the planner knows their size: it broadcasts them within the session's broadcast
limit and otherwise joins by shuffle, where adaptive execution splits hot hosts. Texts are not shuffled in the broadcast form.

Defined results: null hosts are one host, the same as the empty name; null texts have no lines and stay null; repeated rows count
as pages; a share equal to the limit is no boilerplate; an empty table gives an empty table; all columns stay, whatever their names,
the text aside (``n_chars``, if there, follows it). A long text takes memory for its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import cut, spare, table

MAX_SHARE, MIN_PAGES, MIN_HITS = 0.05, 20, 5
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(docs: DataFrame, host: Column, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, min_hits: int = MIN_HITS) -> DataFrame:
    """Per host that has any: _host, _lines, the hashes of its boilerplate lines."""
    read = docs.select(F.coalesce(host, F.lit("")).alias("_host"), F.col("text").alias("_text"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("_text")), _bare), lambda x: x != ""), lambda x: F.xxhash64(x)))
    hits = read.select("_host", F.explode(hashes).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_hits")).where(F.col("_hits") >= min_hits)
    pages = read.groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    common = hits.join(pages, "_host").where(F.col("_hits") > F.lit(max_share) * F.col("_pages"))
    return common.groupBy("_host").agg(F.collect_set("_line").alias("_lines"))


def _kept(docs: DataFrame, host: Column, **limits: float) -> tuple[DataFrame, str]:
    """``docs`` and a last column with the lines that stay (null for a null text), and its name."""
    found = cut(boilerplate(docs, host, **limits))
    name, gone, kept = spare(docs, "page_host", "common_lines", "kept_lines")
    lines = _lines(F.col("text"))
    stays = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(gone, F.xxhash64(_bare(x))))
    found = found.select(F.col("_host").alias(name), F.col("_lines").alias(gone))
    joined = docs.withColumn(name, F.coalesce(host, F.lit(""))).join(found, name, "left")
    return joined.withColumn(kept, F.when(F.col(gone).isNull(), lines).otherwise(stays)).drop(name, gone), kept


def drop(docs: DataFrame, host: Column | None = None, **limits: float) -> DataFrame:
    """The documents without boilerplate lines."""
    names = docs.columns
    out, kept = _kept(docs, F.col("source") if host is None else host, **limits)
    out = out.withColumn("text", F.array_join(kept, "\n"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*names)


def page_host(url: Column) -> Column:
    """The host of a URL, in lower case, for tables of pages."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def digests(docs: DataFrame, **limits: float) -> DataFrame:
    """Per document: lines, lines dropped, digest of the text that stays."""
    out, kept = _kept(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), F.col("source"), **limits)
    n = F.size(_lines(F.col("text"))).cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped"), F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, l.i AS i, l.x AS line, trim(l.x, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'x': x, 'i': i}})) AS l FROM documents)
), pages AS (
  SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= {MIN_PAGES}
), common AS (
  SELECT host, bare FROM (SELECT host, bare, count(DISTINCT doc_id) AS hits FROM lines WHERE bare <> '' GROUP BY 1, 2) JOIN pages USING (host)
  WHERE hits >= {MIN_HITS} AND hits > {MAX_SHARE} * pages
), marked AS (
  SELECT lines.*, common.bare IS NOT NULL AS gone FROM lines LEFT JOIN common ON lines.host = common.host AND lines.bare = common.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
