"""The evidence side: files that were read become tagged, packed text within each sheet's budget.

Reading itself (document formats, text recognition) lies outside; its result is a table of
files with their pages. Everything is keyed by worksheet; no text of a sheet is ever one string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from veritab.operators import guards as G, ingest as I, pack as P
from veritab.operators.chunks import ONE_STRING
from veritab.session import materialize

SHEET = ["wb", "sheet"]
c = F.col


@dataclass
class Evidence:
    """``segments``: packed text in order. ``cuts``, ``problems`` and ``over`` say what is missing from it."""

    files: DataFrame
    shares: DataFrame
    segments: DataFrame
    batches: DataFrame
    cuts: DataFrame
    problems: DataFrame
    over: DataFrame


def texts_of(files: DataFrame, pages: DataFrame, most: int = ONE_STRING) -> DataFrame:
    """Files with the text of their pages and what the text layer is worth.

    ``files``: wb, sheet, ord, name, path, doc_id. A document longer than ``most`` characters has no single
    string; it counts as a file without text and so becomes a problem on record.
    """
    quality = I.text_layer_quality(pages).select("doc_id", "usable", "repaired", "pages")
    whole = I.assemble_pages(pages, most).select("doc_id", "text")
    read = files.join(quality, "doc_id", "left").join(whole, "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    return read.withColumns({
        "text": text, "n_chars": F.length(text), "no_text": F.trim(text) == "", "present": c("usable").isNotNull(),
        "layer_usable": F.coalesce("usable", F.lit(False)), "layer_repaired": F.coalesce("repaired", F.lit(False)), "pages": F.coalesce("pages", F.lit(0)),
    }).drop("usable", "repaired")


def prepare(files: DataFrame, pages: DataFrame, rows: DataFrame, allow_ocr: bool = False, limit: int | None = None,
            per_file: int = P.PER_FILE, keep=materialize) -> Evidence:
    """``rows``: wb, sheet, row, line (the claim as the model sees it)."""
    flagged = texts_of(files, pages).withColumns({"cached": F.lit(False), "allow_ocr": F.lit(allow_ocr)})
    routed = keep(I.route(flagged))
    good = routed.filter(c("status").isin(I.OK, I.EMPTY))
    tagged = G.file_tags(good.select(*SHEET, "ord", "name"))
    lengths = keep(good.select(*SHEET, "ord", F.length("text").cast("bigint").alias("len")))
    batched = G.row_batches(rows)
    asked = batched.groupBy(*SHEET, "batch").agg(F.sum(F.length("line") + 1).alias("own"))
    every = rows.groupBy(*SHEET).agg(F.sum(F.length("line") + 1).alias("chars"))
    totals = keep(P.fit_budgets(lengths, SHEET, every, keep, limit, per_file))
    # a batch repeats its own rows behind the text that all batches share
    batches = asked.join(every, SHEET).join(totals.select(*SHEET, "total", "per_file"), SHEET)
    fitted = keep(P.fit_batches(lengths, SHEET, batches.select(*SHEET, "batch", (c("chars") + c("own")).alias("chars"), "total", "per_file"), keep, limit))
    shares = keep(P.shares(lengths, SHEET, totals.select(*SHEET, "total", "per_file")))
    docs = good.select(*SHEET, "ord", "name", "text").join(tagged.select(*SHEET, "ord", "tag"), [*SHEET, "ord"])
    cuts = P.cut_log(shares).join(good.select(*SHEET, "ord", "name"), [*SHEET, "ord"])
    problems = routed.filter(c("status").isin(I.PROBLEMS)).select(*SHEET, "ord", "name", "status")
    return Evidence(tagged, shares, P.segments(docs, shares, SHEET), fitted, cuts, problems, fitted.filter(~c("fits")).select(*SHEET, "batch", "tokens"))
