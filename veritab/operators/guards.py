"""Checks on a model's answers: what is invented, repeated, missing, unsupported or
borrowed becomes a signal, and a verdict that cannot stand becomes UNDETERMINED.

Keys: ``wb, sheet`` name a worksheet, ``row`` a claim, ``ord`` the order of answers.
Links are a long table (one row per linked file), so no group is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.functions.text import blank_to_empty, short_item, strip
from veritab.operators.first import _hot_keys, _not_hot, keep_first, mark_first, with_position
from veritab.operators.judge import BLANK, BY_MODEL, FAIL, PASS, UNDETERMINED
from veritab.session import materialize, measured

SHEET = ["wb", "sheet"]
ROW = [*SHEET, "row"]
BATCH_ROWS = 8
FEW = 64  # records of one value that a record is compared with

# Words of the answers.
NO_FILE = "없음"
VERDICT_CODES = {"O": PASS, "X": FAIL, "확인 불가": UNDETERMINED, "공란": BLANK}
CONFIDENCE_RANK = {"높음": 3, "보통": 2, "낮음": 1, "못맺음": 0}

c = F.col


def file_tags(files: DataFrame) -> DataFrame:
    """``file_01`` … in the given order, as wide as the number of files needs."""
    sizes = files.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_files"))
    width = F.greatest(F.lit(2), F.length(c("n_files").cast("string")))
    return (
        with_position(files, SHEET, "ord").join(sizes, SHEET)
        .withColumn("tag", F.concat(F.lit("file_"), F.lpad(c("pos").cast("string"), width, F.lit("0"))))
        .drop("pos", "n_files")
    )


def file_refs(tagged: DataFrame) -> DataFrame:
    """What may stand for a file in an answer: its tag, or its exact name."""
    by_tag = tagged.select(*SHEET, c("tag").alias("ref"), "name", F.lit(0).alias("_how"))
    by_name = tagged.select(*SHEET, c("name").alias("ref"), "name", F.lit(1).alias("_how"))
    return keep_first(by_tag.unionByName(by_name), [*SHEET, "ref"], ["_how", "name"]).drop("_how")


# --- rows ---------------------------------------------------------------------------------

def unknown_rows(answers: DataFrame, rows: DataFrame) -> DataFrame:
    return answers.join(rows.select(*ROW), ROW, "left_anti")


def known_rows(answers: DataFrame, rows: DataFrame) -> DataFrame:
    return answers.join(rows.select(*ROW), ROW, "left_semi")


def repeated_rows(known: DataFrame) -> DataFrame:
    return mark_first(known, ROW, ["ord"]).filter("not is_first").drop("is_first")


def first_answers(known: DataFrame) -> DataFrame:
    return keep_first(known, ROW, ["ord"])


def missing_rows(rows: DataFrame, answers: DataFrame) -> DataFrame:
    return rows.select(*ROW).join(answers, ROW, "left_anti")


# --- links --------------------------------------------------------------------------------

def resolve_links(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per cited tag; ``name`` is null for an invented one."""
    cited = answers.select(*ROW, F.posexplode("tags").alias("place", "cited")).withColumn("ref", strip(c("cited")))
    return cited.join(refs, [*SHEET, "ref"], "left").drop("ref")


def invented_tags(resolved: DataFrame) -> DataFrame:
    """Rows that cite unknown files, with all of them in order."""
    bad = resolved.filter(c("name").isNull())
    shown = F.array_sort(F.collect_list(F.struct("place", "cited")))  # as long as one answer's tag list
    return bad.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(shown, lambda x: x["cited"]), ", ").alias("shown"))


def links(resolved: DataFrame) -> DataFrame:
    """Linked files of a row, each once, with the place of its first mention."""
    return resolved.filter(c("name").isNotNull()).groupBy(*ROW, "name").agg(F.min("place").alias("place"))


# --- judgements ---------------------------------------------------------------------------

def unfold(judgements: DataFrame, rules: DataFrame, rule_keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """Judgements on the model's items: codes for verdicts, whole texts, empty ones gone."""
    asked = measured(rules.filter(c("judge") == BY_MODEL).select(*rule_keys, "item_no", "item"))
    code = c("said")
    for word, name in VERDICT_CODES.items():
        code = F.when(c("said") == word, name).otherwise(code)
    source = blank_to_empty(c("provenance"))
    return judgements.filter(blank_to_empty(c("said")) != "").join(asked, [*rule_keys, "item_no"]).select(
        *ROW, "ord", "item_no", "item", code.alias("verdict"),
        F.when(source == NO_FILE, "").otherwise(source).alias("provenance"),
        "rationale", "remark",
    )


def name_provenance(unfolded: DataFrame, refs: DataFrame) -> DataFrame:
    """Provenance as a file name; empty where it names no known file."""
    return (
        unfolded.withColumnRenamed("provenance", "ref").join(refs, [*SHEET, "ref"], "left")
        .withColumn("provenance", F.coalesce("name", F.lit(""))).drop("ref", "name")
    )


def rescue_links(row_links: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the files that only a judgement cites, the rescued ones).

    Own links and cited files are one stream by row, shuffled once: a row's files are those of one answer.
    """
    own = row_links.select(*ROW, "name", "place", F.lit(None).cast(judged.schema["item_no"].dataType).alias("item_no"), F.lit(True).alias("_own"))
    cited = judged.filter(c("provenance") != "").select(
        *ROW, c("provenance").alias("name"), F.lit(None).cast(row_links.schema["place"].dataType).alias("place"), "item_no", F.lit(False).alias("_own")
    )
    both = own.unionByName(cited).repartition(*ROW).groupBy(*ROW, "name").agg(
        F.min("place").alias("place"), F.min("item_no").alias("item_no"), F.bool_or("_own").alias("_own")
    )
    last = F.max("place").over(Window.partitionBy(*ROW))  # behind all own links, however many there are
    place = F.when(c("_own"), c("place")).otherwise(F.coalesce("_last", F.lit(-1)) + 1 + c("item_no"))
    return both.withColumn("_last", last).select(*ROW, "name", place.alias("place")), both.filter(~c("_own")).select(*ROW, "name", "item_no")


def rescue_signals(rescued: DataFrame) -> DataFrame:
    return rescued.groupBy(*ROW).agg(F.min_by("name", "item_no").alias("first_file"), F.count(F.lit(1)).alias("n"))


def with_link_facts(judged: DataFrame, answers: DataFrame, row_links: DataFrame) -> DataFrame:
    """Judgements next to what the downgrade needs: confidence and number of links."""
    counts = row_links.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_links"))
    facts = answers.select(*ROW, "confidence").join(counts, ROW, "left")
    return judged.join(facts, ROW).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def downgrade_reason() -> Column:
    rank = F.coalesce(*[F.when(c("confidence") == w, F.lit(n)) for w, n in CONFIDENCE_RANK.items()], F.lit(0))
    return F.when(
        c("verdict").isin(PASS, FAIL),
        F.when(blank_to_empty(c("rationale")) == "", "no_rationale")
        .when(c("n_links") == 0, "no_link")
        .when((c("verdict") == FAIL) & (rank <= 1), "weak_link"),
    )


def downgrade(facts: DataFrame) -> DataFrame:
    """PASS or FAIL without rationale, without link, or FAIL on a weak link."""
    why = blank_to_empty(c("rationale"))
    lowered = c("reason").isNotNull()
    default = F.concat(short_item(c("item")), F.lit(": not decided"))
    return facts.withColumn("reason", downgrade_reason()).withColumns({
        "was": F.when(lowered, c("verdict")),
        "verdict": F.when(lowered, UNDETERMINED).otherwise(c("verdict")),
        "remark": F.when(lowered, F.coalesce(F.nullif(blank_to_empty(c("remark")), F.lit("")), default)).otherwise(c("remark")),
        "rationale": F.when(lowered, F.concat(F.when(why != "", F.concat(why, F.lit(" · "))).otherwise(""), F.lit("lowered by code"))).otherwise(c("rationale")),
    })


def prefix_provenance(judged: DataFrame) -> DataFrame:
    """``「file」 rationale``; only after the downgrade, which needs the bare rationale."""
    tagged = strip(F.concat(F.lit("「"), c("provenance"), F.lit("」 "), c("rationale")))
    return judged.withColumn(
        "rationale", F.when((c("provenance") != "") & ~c("rationale").startswith("「"), tagged).otherwise(c("rationale"))
    )


# --- across batches -----------------------------------------------------------------------

def _with_supersets(records: DataFrame, at: list[str], few: int) -> DataFrame:
    """``(*at, held, larger_row)``: of each record with values the least ``first_row`` of those that hold all of them and more.

    Values are ordered by how often they occur in a file, rarest first. A record whose rarest value is in at most
    ``few`` records looks at these. The others form a prefix tree, a few levels of values that are
    all frequent; every record walks down the branches that its own values spell, one join a level, and the
    nodes where a record of the tree ends keep the least row that arrives. A record meets at most the
    prefixes that it holds, never the other records of a value.
    """
    held = records.filter("size(held) > 0")
    single = held.select(*at, "held", "first_row", F.explode("held").alias("one"))
    count = single.groupBy(*at, "one").agg(F.count(F.lit(1)).alias("n"))
    ranked = single.join(count, [*at, "one"]).groupBy(*at, "held", "first_row").agg(F.array_sort(F.collect_list(F.struct("n", "one"))).alias("by"))  # as long as a row has columns
    ranked = materialize(ranked)
    light = ranked.filter(c("by")[0]["n"] <= few).select(*at, "held", c("by")[0]["one"].alias("one"))
    larger = single.select(*at, "one", c("held").alias("more"), c("first_row").alias("larger_row"))
    holds = (F.size("more") > F.size("held")) & (F.size(F.array_except("held", "more")) == 0)
    found = light.join(larger, [*at, "one"]).filter(holds).groupBy(*at, "held").agg(F.min("larger_row").alias("larger_row"))

    word = lambda x: x["one"]
    tree = ranked.filter(c("by")[0]["n"] > few).select(*at, "held", F.transform("by", word).alias("path"))
    longest = tree.agg(F.max(F.size("path"))).first()[0] or 0
    spelled = F.transform("by", word)
    walk = ranked.select(*at, "first_row", F.array().cast(ranked.select(spelled.alias("x")).schema["x"].dataType).alias("node"), spelled.alias("left"), F.size("by").alias("size"))
    for level in range(1, longest + 1):
        nodes = tree.filter(F.size("path") >= level).select(*at, F.slice("path", 1, level).alias("node")).distinct()
        steps = walk.select(*at, "first_row", "size", "node", "left", F.posexplode("left").alias("i", "next"))
        steps = steps.select(*at, "first_row", "size", F.concat("node", F.array("next")).alias("node"), F.slice("left", c("i") + 2, F.size("left")).alias("left"))
        walk = materialize(steps.join(nodes, [*at, "node"], "left_semi"))
        ended = tree.filter(F.size("path") == level).select(*at, "held", c("path").alias("node"))
        arrived = walk.filter(c("size") > level).groupBy(*at, "node").agg(F.min("first_row").alias("larger_row"))
        found = found.unionByName(ended.join(arrived, [*at, "node"]).select(*at, "held", "larger_row"))
    return found


def _within_files(using: DataFrame, at: list[str]) -> DataFrame:
    """``(*ROW, larger_row)`` of files of few rows: each row is compared with the others in the file's record."""
    files = using.groupBy(*at).agg(F.collect_list(F.struct("row", "held")).alias("rows"))  # as many as ``few``
    files = files.filter(F.size("rows") > 1)
    more = lambda x: lambda y: (F.size(y["held"]) > F.size(x["held"])) & (F.size(F.array_except(x["held"], y["held"])) == 0)
    least = lambda x: F.array_min(F.transform(F.filter("rows", more(x)), lambda y: y["row"]))
    told = F.transform("rows", lambda x: F.struct(x["row"].alias("row"), least(x).alias("larger_row")))
    return files.select(*SHEET, F.explode(told).alias("x")).select(*SHEET, "x.row", "x.larger_row").filter(c("larger_row").isNotNull())


def borrowed_rows(row_links: DataFrame, claim_values: DataFrame, few: int = FEW) -> DataFrame:
    """Rows whose filled values are all found, with more, in a row that shares a file.

    ``claim_values``: (wb, sheet, row, vals map). Files of at most ``few`` rows are one record each. In the
    others, rows with equal values are one record; which records contain others is a join over their
    values, see ``_with_supersets``. Looking for such files runs a job.
    """
    at = [*SHEET, "name"]
    filled = F.transform(
        F.filter(F.array_sort(F.map_entries("vals")), lambda e: blank_to_empty(e["value"]) != ""),
        lambda e: F.struct(e["key"].alias("k"), strip(e["value"]).alias("v")),
    )
    using = materialize(row_links.select(*ROW, "name").join(claim_values.select(*ROW, filled.alias("held")), ROW))
    hot, most = _hot_keys(using, at, few)
    if not most:
        return _within_files(using, at).groupBy(*ROW).agg(F.min("larger_row").alias("larger_row"))
    many = using.join(hot.select(*at), at, "left_semi")
    records = materialize(many.groupBy(*at, "held").agg(F.min("row").alias("first_row")))
    found = _with_supersets(records, at, few)
    # a row without values is part of every row with some
    empty = records.filter("size(held) > 0").groupBy(*at).agg(F.min("first_row").alias("larger_row")).withColumn("held", F.array().cast(records.schema["held"].dataType))
    told = many.join(found.unionByName(empty), [*at, "held"]).select(*ROW, "larger_row")
    return told.unionByName(_within_files(_not_hot(using, at, hot), at)).groupBy(*ROW).agg(F.min("larger_row").alias("larger_row"))


def lower_borrowed(judged: DataFrame, borrowed: DataFrame) -> DataFrame:
    hit = c("larger_row").isNotNull() & c("verdict").isin(PASS, FAIL)
    remark = F.concat(short_item(c("item")), F.lit(": all values of this row are in row "), c("larger_row").cast("string"))
    return (
        judged.join(borrowed, ROW, "left").withColumn("lowered_for", F.when(hit, c("larger_row")))
        .withColumns({
            "remark": F.when(hit, remark).otherwise(c("remark")),
            "rationale": F.when(hit, F.concat(c("rationale"), F.lit(" · lowered by code (borrowed evidence)"))).otherwise(c("rationale")),
            "verdict": F.when(hit, UNDETERMINED).otherwise(c("verdict")),
        }).drop("larger_row")
    )


def shared_files(row_links: DataFrame, answers: DataFrame) -> DataFrame:
    """Files that several rows of a batch use, one record for each of these rows, with their number."""
    at = row_links.join(answers.select(*ROW, "batch"), ROW)
    keys = [*SHEET, "batch", "name"]
    return at.join(at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"), keys).select(*keys, "n_rows", "row")


def missing_alert(missing: DataFrame) -> DataFrame:
    """One alert for each row that got no answer."""
    return missing.select(*SHEET, "row", F.lit("err").alias("level"))


def unused_files(files: DataFrame, row_links: DataFrame) -> DataFrame:
    return files.select(*SHEET, "name").join(row_links, [*SHEET, "name"], "left_anti")


def blank_batches(answers: DataFrame) -> DataFrame:
    """Batches in which no row links a file or says why not."""
    said = (F.size("tags") > 0) | (blank_to_empty(c("link_reason")) != "")
    return answers.groupBy(*SHEET, "batch").agg(F.bool_or(said).alias("said")).filter("not said").select(*SHEET, "batch")


def row_batches(rows: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Consecutive groups of ``size`` rows per sheet."""
    return with_position(rows, SHEET, "row").withColumn("batch", F.floor((c("pos") - 1) / size)).drop("pos")


def attempt_log(requested: DataFrame, attempts: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """What became of each attempt at a batch: (keys, batch, attempt, missing, blank, finish).

    ``requested``: keys, row, batch. ``attempts``: keys, batch, attempt, row, tags, link_reason, finish, one record for
    each row answered, or one with a null row for an attempt without any.
    """
    at = [*keys, "batch", "attempt"]
    asked = requested.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("asked"))
    known = attempts.join(requested.select(*keys, "batch", "row", F.lit(True).alias("was_asked")), [*keys, "batch", "row"], "left")
    real = c("was_asked").isNotNull()
    said = real & ((F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0) | (blank_to_empty(c("link_reason")) != ""))
    once = known.groupBy(*at, F.when(real, c("row")).alias("row")).agg(F.bool_or(said).alias("said"), F.max("finish").alias("finish"))
    seen = once.groupBy(*at).agg(F.count("row").alias("answered"), F.bool_or("said").alias("said"), F.max("finish").alias("finish"))
    return seen.join(asked, [*keys, "batch"]).select(
        *at, (c("asked") - c("answered")).alias("missing"), ((c("answered") > 0) & ~c("said")).alias("blank"), F.coalesce("finish", F.lit("")).alias("finish")
    )


ANSWERED, BLANK_TO_THE_END, LIMIT, ASK_AGAIN = "answered", "blank to the end", "limit", "ask again"


def attempt_outcomes(log: DataFrame, retries: int = 2, keys: list[str] = SHEET) -> DataFrame:
    """Per batch: which attempt counts, how many there were, and why it stopped.

    An attempt counts when no row is missing and not all are blank. Without one, the last attempt counts: after
    ``retries`` repeats a blank one stands as *blank to the end* and one with missing rows stops at the *limit*;
    before that the batch is to be asked again. Attempts behind the one that counts are left out.
    """
    at = [*keys, "batch"]
    good = (c("missing") == 0) & ~c("blank")
    inside = log.filter(c("attempt") <= retries + 1)
    fold = inside.groupBy(*at).agg(F.min(F.when(good, c("attempt"))).alias("good"), F.max("attempt").alias("last"))
    chosen = fold.withColumn("attempt", F.coalesce("good", "last"))
    facts = chosen.join(inside, [*at, "attempt"])
    reason = (
        F.when(c("good").isNotNull(), ANSWERED).when(c("attempt") <= retries, ASK_AGAIN)
        .when(c("blank") & (c("missing") == 0), BLANK_TO_THE_END).otherwise(LIMIT)
    )
    return facts.select(*at, "attempt", (c("attempt") - 1).alias("repeats"), "missing", "blank", reason.alias("stop"), "finish")


def batches_to_ask(requested: DataFrame, outcomes: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """Batches whose next attempt is due, with its number; each batch by its own count."""
    known = outcomes.select(*keys, "batch", "attempt", "stop")
    return requested.select(*keys, "batch").distinct().join(known, [*keys, "batch"], "left").filter(c("stop").isNull() | (c("stop") == ASK_AGAIN)).select(
        *keys, "batch", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")
    )


def ask_again(requested: DataFrame, answers: DataFrame, attempt: int, limit: int = 2) -> DataFrame:
    """Batches to ask again: some row is missing, or the whole answer is blank."""
    absent = requested.join(answers, ROW, "left_anti").groupBy(*SHEET, "batch").agg(F.count(F.lit(1)).alias("missing"))
    blank = blank_batches(known_rows(answers, requested)).withColumn("blank", F.lit(True))
    return (
        absent.join(blank, [*SHEET, "batch"], "full_outer")
        .select(*SHEET, "batch", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("blank", F.lit(False)).alias("blank"))
        .filter(F.lit(attempt <= limit))
    )


def unlinked_reasons(told: DataFrame, refs: DataFrame) -> DataFrame:
    """Why a file was left unlinked: by name, the first word on each file counts."""
    named = told.join(refs, [*SHEET, "ref"], "left").withColumn("file", F.coalesce("name", "ref"))
    return keep_first(named.select(*SHEET, "file", "batch", "ord", "reason"), [*SHEET, "file"], ["batch", "ord"])


def ownership(row_links: DataFrame, answers: DataFrame, tagged: DataFrame) -> DataFrame:
    """Which rows own a file and from which batch on that is known.

    One row per file and owner, or one row without owner. A file is free in batch ``b``
    when no owner has ``visible_from <= b``; so the state of every batch is given without
    repeating earlier owners for each later batch.
    """
    owners = row_links.join(answers.select(*ROW, "batch"), ROW).select(*SHEET, "name", "row", (c("batch") + 1).alias("visible_from"))
    return tagged.select(*SHEET, "tag", "name").join(owners, [*SHEET, "name"], "left").drop("name")


def answer_summary(rows: DataFrame, row_links: DataFrame, judged: DataFrame) -> DataFrame:
    """Per sheet: rows answered, rows linked, and how often each verdict."""
    answered = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("answered"))
    linked = row_links.select(*ROW).distinct().groupBy(*SHEET).agg(F.count(F.lit(1)).alias("linked"))
    verdicts = judged.groupBy(*SHEET).agg(*[F.count_if(c("verdict") == v).alias(v.lower()) for v in (PASS, FAIL, UNDETERMINED, BLANK)])
    return answered.join(linked, SHEET, "left").join(verdicts, SHEET, "left").na.fill(0)
