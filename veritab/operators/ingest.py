"""Evidence files: identity, routing, text quality, page assembly and reading reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.text import WHITESPACE, base_name, file_ext, file_stem, nfc, safe_name, strip
from veritab.operators.chunks import MOST_CHARS, ONE_STRING, PIECES, in_chunks, one_string
from veritab.operators.first import keep_first, with_position

# Kinds of files, and the limits of a usable text layer.
NATIVE, PDF = [".hwp", ".hwpx", ".docx"], [".pdf"]
IMAGES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif", ".bmp"]
SUPPORTED = NATIVE + PDF + IMAGES
CHARS_PER_PAGE, JAMO_LIMIT = 40, 0.10
OK, EMPTY, SKIPPED, ERROR, UNSUPPORTED, OCR_NEEDED = "ok", "empty", "skipped", "error", "unsupported", "ocr needed"
PROBLEMS = [ERROR, EMPTY, UNSUPPORTED, OCR_NEEDED]
# What a leaked credential looks like, tried in this order.
SECRETS = [
    ("sk-[A-Za-z0-9_\\-]{20,}", "service key"),
    ("AIza[0-9A-Za-z_\\-]{30,}", "cloud key"),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key"),
    ("\"private_key\"\\s*:\\s*\"[^\"]{40,}", "service account key"),
]
SCANNED_TYPES = [".json", ".txt", ".env", ".cfg", ".ini", ".md", ".py", ".yaml", ".yml"]

c = F.col


def list_files(files: DataFrame) -> DataFrame:
    """Files of a folder by path: temporary and hidden ones out, the rest supported or not."""
    name = base_name(c("path"))
    return files.filter(~name.startswith("~$") & ~name.startswith(".")).withColumns(
        {"ext": file_ext(name), "supported": file_ext(name).isin(SUPPORTED)}
    )


def content_key(text: Column, name: Column) -> Column:
    """Twelve hex digits of the content hash and a safe stem."""
    return F.concat(F.substring(F.sha2(text, 256), 1, 12), F.lit("_"), safe_name(file_stem(name)))


def skip_unchanged(files: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content and stem were read before keep what was found then.

    Both sides: ``key`` and ``sha256``; the cache adds method, chars, pages.
    """
    known = keep_first(cache.select("key", "sha256", "ord", c("method"), c("chars"), c("pages")), ["key", "sha256"], ["ord"]).drop("ord")
    hit = c("method").isNotNull() & F.lit(not force)
    return files.join(known, ["key", "sha256"], "left").select(
        *files.columns, F.when(hit, SKIPPED).otherwise("to read").alias("status"),
        *[F.when(hit, c(n)).alias(n) for n in ("method", "chars", "pages")],
    )


def _jamo_counts(text: Column) -> tuple[Column, Column]:
    return (
        F.sum(F.regexp_count(text, F.lit("[\\u1100-\\u11ff\\u3130-\\u318f]"))),
        F.sum(F.regexp_count(text, F.lit("[\\uac00-\\ud7a3]"))),
    )


def _ratio(jamo: Column, syllables: Column) -> Column:
    return F.when(jamo + syllables > 0, jamo / (jamo + syllables)).otherwise(0.0)


def text_layer_quality(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, loose-jamo ratio, repaired, usable, reason.

    Counts add up page by page, so a document is never put together here. Composition
    runs only on pages of documents over the jamo limit.
    """
    jamo, syllables = _jamo_counts(c("text"))
    edges = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), jamo.alias("jamo_n"), syllables.alias("syllable_n"),
        F.min(F.when(strip(c("text")) != "", c("page"))).alias("first_page"), F.max(F.when(strip(c("text")) != "", c("page"))).alias("last_page"),
    ).withColumn("jamo", F.round(_ratio(c("jamo_n"), c("syllable_n")), 3))
    at = pages.join(edges.select("doc_id", "jamo", "first_page", "last_page"), "doc_id")
    ends = lambda side: F.length("text") - F.length(side(c("text")))
    left = lambda t: F.ltrim(t, F.lit(WHITESPACE))
    right = lambda t: F.rtrim(t, F.lit(WHITESPACE))
    inside = F.length("text") + 1 - F.when(c("page") == c("first_page"), ends(left)).otherwise(0) - F.when(c("page") == c("last_page"), ends(right)).otherwise(0)
    composed = nfc(F.when(c("jamo") > JAMO_LIMIT, c("text")))
    jamo2, syllables2 = _jamo_counts(composed)
    counts = at.groupBy("doc_id").agg(
        (F.sum(F.when(c("page").between(c("first_page"), c("last_page")), inside).otherwise(0)) - 1).alias("chars"),
        jamo2.alias("jamo_n2"), syllables2.alias("syllable_n2"),
    )
    after = _ratio(c("jamo_n2"), c("syllable_n2"))
    loose = c("jamo") > JAMO_LIMIT
    repaired = loose & (after <= JAMO_LIMIT)
    scattered, sparse = loose & ~repaired, c("chars") < CHARS_PER_PAGE * c("pages")
    return edges.join(counts, "doc_id").withColumn("chars", F.greatest("chars", F.lit(0))).select(
        "doc_id", "pages", "chars", F.when(repaired, F.round(after, 3)).otherwise(c("jamo")).alias("jamo"),
        F.coalesce(repaired, F.lit(False)).alias("repaired"), (~scattered & ~sparse).alias("usable"),
        F.when(scattered, "scattered jamo").when(sparse, "too little text").otherwise("").alias("reason"),
    )


def page_chunks(pages: DataFrame, per_chunk: int = PIECES, most: int = MOST_CHARS) -> DataFrame:
    """``(doc_id, chunk, slice, text)``: each document's pages in order, with marks where it has several.

    No row holds more than ``most`` characters, so a document may have any number of pages.
    """
    mark = F.concat(F.lit("===== [p."), c("at").cast("string"), F.lit("] =====\n"))  # fixed value
    text = F.coalesce("text", F.lit(""))
    ended = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("doc_id", "_doc")
    placed = with_position(pages.select("doc_id", "page", "text"), ["doc_id"], "page", "at").join(counts, c("doc_id").eqNullSafe(c("_doc")))
    many = F.concat(F.when(c("at") > 1, F.lit("\n")).otherwise(""), mark, F.when(c("at") < c("n"), ended).otherwise(text))
    # blanks go at both ends of the whole: a mark is at the front of it, so only the last page has some
    last = F.concat(F.rtrim(many, F.lit(WHITESPACE)), F.lit("\n"))
    piece = F.when(c("n") == 1, F.concat(strip(text), F.lit("\n"))).when(c("at") == c("n"), last).otherwise(many)
    return in_chunks(placed.select("doc_id", "at", piece.alias("piece")), ["doc_id"], "at", "piece", "", per_chunk, most)


def assemble_pages(pages: DataFrame, most: int = ONE_STRING) -> DataFrame:
    """``(doc_id, pages, chars, text)``: one text for each document of at most ``most`` characters, null for longer ones."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("doc_id", "_doc")
    whole = one_string(page_chunks(pages), ["doc_id"], most)
    return whole.join(counts, c("doc_id").eqNullSafe(c("_doc"))).select("doc_id", "pages", "chars", "text")


def route(files: DataFrame) -> DataFrame:
    """Method and status of each file from its type, its text layer and what is allowed.

    Expects: name, present, cached, layer_usable, layer_repaired, allow_ocr, no_text.
    A file that waits for OCR is not cached, so it is looked at again later.
    """
    ext = file_ext(c("name"))
    by_ocr = (ext.isin(PDF) & ~c("layer_usable")) | ext.isin(IMAGES)
    method = (
        F.when(~c("present") | ~ext.isin(SUPPORTED), "")
        .when(ext.isin(NATIVE), F.substring(ext, 2, 9))
        .when(ext.isin(PDF) & c("layer_usable"), F.when(c("layer_repaired"), "pdf-layer(NFC)").otherwise("pdf-layer"))
        .when(ext.isin(PDF), F.when(c("allow_ocr"), "ocr").otherwise("pdf-layer(below)"))
        .otherwise(F.when(c("allow_ocr"), "ocr(image)").otherwise("image"))
    )
    status = (
        F.when(~c("present"), ERROR).when(~ext.isin(SUPPORTED), UNSUPPORTED).when(c("cached"), SKIPPED)
        .when(by_ocr & ~c("allow_ocr"), OCR_NEEDED).when(c("no_text"), EMPTY).otherwise(OK)
    )
    return files.withColumns({"ext": ext, "method": method, "status": status}).withColumns({
        "requests": F.when(c("status").isin(OK, EMPTY) & c("method").startswith("ocr"), c("pages")).otherwise(0),
        "to_cache": c("status").isin(OK, EMPTY),
    })


def read_summary(read: DataFrame) -> DataFrame:
    """Counts by status, by method and overall, in one pass."""
    return (
        read.groupingSets([[c("status")], [c("method")], []], "status", "method")
        .agg(
            F.grouping_id().alias("g"), F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.sum("requests").alias("requests"),
            F.count_if(c("requests") > 0).alias("ocr_files"),
        ).select(
            F.when(c("g") == 1, "status").when(c("g") == 2, "method").otherwise("all").alias("what"),
            F.coalesce("status", "method", F.lit("")).alias("value"), "files", "chars", "requests", "ocr_files",
        ).filter((c("what") != "method") | (c("value") != ""))
    )


def problem_list(read: DataFrame) -> DataFrame:
    """Every file with a problem; ``folder`` tells whose it is and ``ord`` gives the order."""
    return read.filter(c("status").isin(PROBLEMS)).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "ord", "status", "name")


def secret_scan(files: DataFrame) -> DataFrame:
    """Files that hold something like a credential; the first pattern names it.

    ``files``: path, text. Forbidden names are reported without reading.
    """
    name, ext = F.lower(base_name(c("path"))), file_ext(base_name(c("path")))
    in_secrets = c("path").contains("/secrets/")
    found = F.coalesce(*[F.when(c("text").rlike(p), F.lit(what)) for p, what in SECRETS])
    forbidden = (name == ".env") | (in_secrets & (ext == ".json"))
    read = ext.isin(SCANNED_TYPES)
    return files.withColumn("finding", F.when(forbidden, "forbidden name").when(read, found)).filter(c("finding").isNotNull())
