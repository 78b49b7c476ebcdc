"""Pages on their way into the library: duplicates, thin pages, and the address that relative links start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import normalize_url
from quern.operators.skew import merged

#: Characters from which on a body is an article.
THIN = 150


def capture(pages: DataFrame, index: DataFrame, on_duplicate: str = "abort") -> DataFrame:
    """``pages`` (``conv_id, ok, body, url``) with ``outcome`` and the ``doc_id`` that is overwritten, if any.

    ``index`` has ``normalized_url, doc_id``, one row per address. A page whose
    address is in the index, or came before among the pages, is a duplicate: with
    ``abort`` it stays out, with ``update`` it replaces the note, with ``new`` it
    becomes another one. Failed pages stay out; thin ones are kept as a fallback.
    Pages without an address are no duplicates.
    """
    if on_duplicate not in ("abort", "update", "new"):
        raise ValueError(on_duplicate)
    keyed = pages.withColumn("normalized_url", normalize_url(F.col("url")))
    met = merged(keyed, index.select("normalized_url", "doc_id"), "normalized_url", "left")
    before = F.row_number().over(W.partitionBy("normalized_url").orderBy("conv_id")) > 1
    known = F.col("url").isNotNull() & (F.col("doc_id").isNotNull() | before)
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "failed")
    if on_duplicate == "abort":
        outcome = outcome.when(known, "duplicate")
    outcome = outcome.when(F.length(F.coalesce("body", F.lit(""))) < THIN, "partial_fallback")
    if on_duplicate == "update":
        outcome = outcome.when(known, "updated")
    out = met.withColumn("outcome", outcome.otherwise("success"))
    return out.withColumn("doc_id", F.when(F.col("outcome") == "updated", F.col("doc_id")))


def with_base(page: Column, url: Column) -> Column:
    """A page whose relative links start from an address, unless it names one itself or the address is blank."""
    safe = F.replace(F.replace(F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.concat(F.lit('<base href="'), safe, F.lit('">'))
    head, root = F.regexp_extract(page, r"(?is)<head\b[^>]*>", 0), F.regexp_extract(page, r"(?is)<html\b[^>]*>", 0)

    def behind(mark: Column, more: Column) -> Column:
        at = F.position(mark, page) + F.length(mark)
        return F.concat(F.left(page, at - 1), more, F.substring(page, at, F.length(page)))

    put = F.when(head != "", behind(head, tag)).when(root != "", behind(root, F.concat(F.lit("<head>"), tag, F.lit("</head>")))).otherwise(F.concat(tag, page))
    return F.when((F.coalesce(url, F.lit("")) == "") | page.rlike(r"(?is)<base\b"), page).otherwise(put)
