"""Line dedup by site-relative frequency (operator 3).

The pages of a host that contain a line, divided by the pages of the host, is the line's ratio; lines above ``RATIO``
are boilerplate of that host and go. Pages with equal texts are one page, so a group of exact copies doesn't turn its own
lines into boilerplate. A line is compared without the spaces around it; blank lines are never counted and never go.
A document of which nothing but boilerplate and blank lines would remain keeps its text: it is a copy of other documents,
not a page in a frame, and near-dedup decides about it.

Lines travel as hashes, distinct by page, and are summed before they are shuffled. Which lines to drop is decided per
host and text and joined back to the documents; a host, line or text that holds a large share of the rows is split by the
adaptive skew join.

Defined results: a null text stays null and has no lines; a null host is the host of its own named ''; lines on
fewer than ``MIN_PAGES`` pages stay, whatever their ratio.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted
from fuelspark.operators.scale import materialize

RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, page (hash of a text) and the hashes of the lines that the page's texts lose."""
    text = F.col(quoted(text_col))
    pages = docs.filter(text.isNotNull()).select(F.coalesce(F.col(quoted(host_col)), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), text.alias("text"))
    hashes = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _hash)
    # an empty page still counts as a page of its host: hash 0 stands for the page itself
    found = pages.select("host", "page", F.explode(F.array_union(F.array(F.lit(0).cast("bigint")), hashes)).alias("line"))
    found = materialize(found.distinct(), "lines")
    total = found.filter("line = 0").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = found.filter("line <> 0").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") >= min_pages).join(total, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")
    held = found.join(frequent, ["host", "line"]).select("host", "page", "line")
    # rows of one page are few: its own lines
    return held.groupBy("host", "page").agg(F.collect_set("line").alias("drop"))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                counts: bool = True) -> DataFrame:
    """The documents' columns with the text without boilerplate and, if asked for, ``n_lines`` and ``n_dropped`` (which
    replace columns of these names)."""
    drops = boilerplate(docs, host_col, text_col, ratio, min_pages).select(F.col("host").alias("_host"), F.col("page").alias("_page"), F.col("drop").alias("_drop"))
    text = F.col(quoted(text_col))
    keyed = docs.withColumns({"_host": F.coalesce(F.col(quoted(host_col)), F.lit("")), "_page": F.xxhash64(text)})
    joined = keyed.join(drops, ["_host", "_page"], "left")
    goes = lambda x: (F.trim(x) != "") & F.array_contains("_drop", _hash(x))
    lines = _lines(text)
    kept = F.filter(lines, lambda x: ~goes(x))
    loses = F.col("_drop").isNotNull() & F.exists(kept, lambda x: F.trim(x) != "")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    new = [n_lines.alias("n_lines"), F.when(loses, n_lines - F.size(kept)).otherwise(0).cast("bigint").alias("n_dropped")] if counts else []
    cleaned = F.when(loses, F.array_join(kept, "\n")).otherwise(text)
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(quoted(c)) for c in names], *new)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    part = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(host_col)).alias("host"))
    return dedup_lines(part, "host").select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS host FROM documents),
 p AS (SELECT DISTINCT host, text FROM d WHERE text IS NOT NULL),
 x AS (SELECT host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p),
 l AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, text, trim(line) AS line FROM x) WHERE line <> '' GROUP BY host, line),
 t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
 b AS (SELECT host, line FROM l JOIN t USING (host) WHERE n >= 5 AND n > 0.1e0 * pages),
 y AS (SELECT x.host, x.text, x.line, x.k, b.line IS NOT NULL AS goes FROM x LEFT JOIN b ON b.host = x.host AND b.line = trim(x.line)),
 r AS (SELECT host, text, count(*) AS n_lines, count(*) FILTER (goes) AS n_goes, count(*) FILTER (NOT goes AND trim(line) <> '') AS n_stay,
  string_agg(line, chr(10) ORDER BY k) FILTER (NOT goes) AS kept FROM y GROUP BY host, text)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_stay > 0 THEN n_goes ELSE 0 END AS n_dropped,
 sha256(CASE WHEN n_stay > 0 THEN kept ELSE d.text END) AS kept_sha256
FROM d LEFT JOIN r ON r.host = d.host AND r.text = d.text
"""
