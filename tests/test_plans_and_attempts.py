"""Chunks of ordered text, batch budgets, attempts, sinks and the evidence plan on small tables."""

import json

from pyspark.sql import functions as F

from veritab.functions.text import repair_name
from veritab.operators import chunks as C, guards as G, ingest as I, pack as P, report as R
from veritab.plans import evidence, full_check
from veritab.sources import files as S


def test_chunks_hold_any_number_of_pieces(spark):
    rows = [("hot", k, f"name {k}") for k in range(5000)] + [("one", 7, None), (None, 1, "x" * 900), (None, 2, "y")]
    df = spark.createDataFrame(rows, "k string, ord long, t string")
    got = C.in_chunks(df, ["k"], "ord", "t", ", ", per_chunk=16, most=100).collect()
    assert max(len(r.text) for r in got) <= 100
    whole = lambda k: "".join(r.text for r in sorted((r for r in got if r.k == k), key=lambda r: (r.chunk, r.slice)))
    assert whole("hot") == ", ".join(f"name {k}" for k in range(5000)) and whole("one") == "" and whole(None) == "x" * 900 + ", y"
    view = {r.k: (r.chars, r.text) for r in C.one_string(C.in_chunks(df, ["k"], "ord", "t", ", ", per_chunk=16, most=100), ["k"], most=1000).collect()}
    assert view["hot"] == (len(whole("hot")), None) and view[None] == (903, "x" * 900 + ", y") and view["one"] == (0, "")


def test_pages_become_one_text_or_none(spark):
    pages = [(1, 1, "  a "), (2, 1, "b\n"), (2, 5, "  "), (2, 9, None), (3, 2, "long " * 50)]
    got = {r.doc_id: (r.pages, r.text) for r in I.assemble_pages(spark.createDataFrame(pages, "doc_id long, page long, text string"), most=100).collect()}
    mark = lambda n: f"===== [p.{n}] =====\n"
    assert got == {1: (1, "a\n"), 2: (3, mark(1) + "b\n\n" + mark(2) + "  \n\n" + mark(3)), 3: (1, None)}


def test_batches_get_smaller_until_they_fit(spark):
    files = spark.createDataFrame([("s", i, 30000) for i in range(10)], "g string, ord long, len long")
    most = int(P.LIMIT_FLOOR * P.SAFE_SHARE)
    batches = [("s", b, own, 60000, 60000) for b, own in enumerate((0, 20000, 45000, 90000))] + [("none", 0, 100, 50000, 60000)]
    df = spark.createDataFrame(batches, "g string, batch long, chars long, total long, per_file long")
    got = {(r.g, r.batch): r for r in P.fit_batches(files, ["g"], df, lambda x: x, limit=P.LIMIT_FLOOR).collect()}
    for (g, b), r in got.items():
        own, total, rounds = batches[b][2] if g == "s" else 100, 60000 if g == "s" else 50000, 0
        tokens = int((min(total, 300000) * (g == "s") + own) * 0.65)
        while rounds < 4 and tokens > most and (smaller := int(total * most / tokens) - 4000) >= 20000:
            total, rounds = smaller, rounds + 1
            tokens = int((total + own) * 0.65)
        assert (r.total, r.tokens, r.rounds, r.fits) == (total, tokens, rounds, tokens <= most), (g, b)
    assert got["s", 1].rounds and not got["s", 3].fits


def test_each_batch_has_its_own_attempts(spark):
    rows = [("w", "s", b, r) for b in range(5) for r in (2 * b, 2 * b + 1)]
    say = lambda b, a, r, tags, why="", finish="stop": ("w", "s", b, a, r, tags, why, finish)
    tried = [say(0, 1, 0, ["f"]), say(0, 1, 1, [], "no file"), say(0, 2, 0, ["g"])]
    tried += [say(1, a, 2, ["f"], "", "length") for a in (1, 2, 3, 4)]
    tried += [say(2, a, r, []) for a in (1, 2, 3) for r in (4, 5)]
    tried += [say(3, 1, None, None, None, None), say(3, 1, 99, ["f"])]
    log = G.attempt_log(spark.createDataFrame(rows, "wb string, sheet string, batch long, row long"),
                        spark.createDataFrame(tried, "wb string, sheet string, batch long, attempt long, row long, tags array<string>, link_reason string, finish string"))
    out = G.attempt_outcomes(log)
    got = {r.batch: (r.attempt, r.repeats, r.missing, r.blank, r.stop, r.finish) for r in out.collect()}
    assert got == {0: (1, 0, 0, False, G.ANSWERED, "stop"), 1: (3, 2, 1, False, G.LIMIT, "length"), 2: (3, 2, 0, True, G.BLANK_TO_THE_END, "stop"), 3: (1, 0, 2, False, G.ASK_AGAIN, "stop")}
    due = G.batches_to_ask(spark.createDataFrame(rows, "wb string, sheet string, batch long, row long"), out)
    assert {(r.batch, r.attempt) for r in due.collect()} == {(3, 2), (4, 1)}


def test_sinks_may_run_again(spark, tmp_path):
    read = spark.createDataFrame([("a.pdf", "h1", "ocr", 5, "ok"), ("a.pdf", "h1", "ocr", 5, "ok"), ("b.pdf", "h2", "", 0, "error")], "path string, sha256 string, method string, n_chars long, status string")
    for _ in range(3):
        S.append_index(read, f"{tmp_path}/index")
    S.append_index(read.withColumn("sha256", F.lit("h3")), f"{tmp_path}/index")
    assert sorted((r.path, r.sha256) for r in S.read_index(spark, f"{tmp_path}/index").collect()) == [("a.pdf", "h1"), ("a.pdf", "h3")]
    sheets = spark.createDataFrame([("1", "01", 1, "x"), ("1", "2", 2, "y")], "wb string, sheet string, row long, v string")
    S.write_per_sheet(sheets, f"{tmp_path}/sheets")
    for _ in range(2):
        S.write_per_sheet(sheets.filter("sheet = '01'").withColumn("v", F.lit("new")), f"{tmp_path}/sheets")
    assert sorted(map(tuple, S.read_per_sheet(spark, f"{tmp_path}/sheets").select("wb", "sheet", "row", "v").collect())) == [("1", "01", 1, "new"), ("1", "2", 2, "y")]


def test_names_come_back_from_each_wrong_charset(spark):
    from veritab.session import tune

    names = ["보고서 1.pdf".encode().decode(x) for x in ("latin-1", "cp437")] + ["보고.pdf".encode().decode("cp949"), "보고서.pdf", "plain.pdf", "Ã©", None, ""]
    got = [r.r for r in tune(spark).createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(repair_name(F.col("n")).alias("r")).collect()]
    assert got == ["보고서 1.pdf", "보고서 1.pdf", "보고.pdf", "", "", "", None, ""]


def test_manifest_keeps_the_first_spelling_in_order(spark):
    book = {"sheets": [{"sheet": "B", "rows": [{"제출": [{"파일": ["z.pdf", "x\\A.pdf"]}]}, {"키충돌": True, "제출": [{"파일": ["no.pdf"]}]}]},
                       {"sheet": S.ROSTER_SHEET, "rows": [{"제출": [{"파일": ["roster.pdf"]}]}]},
                       {"sheet": "A", "rows": [{"제출": [{"파일": ["X/a.PDF", "dir/"]}, {"파일": ["b.pdf", "", None]}]}]}, {"sheet": "C", "rows": []}]}
    files, counts = S.scan_manifest(spark.createDataFrame([("m", json.dumps(book, ensure_ascii=False))], "wb string, body string"))
    assert [(r.place, r.path) for r in files.orderBy("place").collect()] == [(1, "z.pdf"), (2, "x/A.pdf"), (3, "b.pdf")]
    r = counts.collect()[0]
    assert (r.sheets, r.rows, r.rows_in_collision, r.rows_of_skipped_sheets, r.folders) == (2, 2, 1, 1, 3)


def test_metrics_are_one_aggregation(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    got = R.metrics(R.metric_rows(df, rows=F.lit(1), sum=F.col("v")), df.select(F.lit("kind").alias("metric"), F.lit(2).cast("bigint").alias("value")))
    assert {r.metric: r.value for r in got.collect()} == {"rows": 2, "sum": 5, "kind": 4}


def test_evidence_is_routed_cut_and_packed(spark):
    files = [("w", "s", k, f"{k}{e}", f"/d/{k}{e}", k) for k, e in enumerate((".pdf", ".pdf", ".hwp", ".xyz"))] + [("w", "s", 9, "gone.pdf", "/d/gone.pdf", 99)]
    pages = [(0, 1, "글자 " * 6000), (1, 1, "짧"), (2, 1, "한글 " * 400), (3, 1, "text " * 20)]
    made = evidence.prepare(
        spark.createDataFrame(files, "wb string, sheet string, ord long, name string, path string, doc_id long"), spark.createDataFrame(pages, "doc_id long, page long, text string"),
        spark.createDataFrame([("w", "s", r, f"{r} | x") for r in range(20)], "wb string, sheet string, row long, line string"), per_file=5000,
    )
    assert {(r.name, r.status) for r in made.problems.collect()} == {("1.pdf", I.OCR_NEEDED), ("3.xyz", I.UNSUPPORTED), ("gone.pdf", I.ERROR)}
    assert {r.name for r in made.cuts.collect()} <= {"0.pdf", "2.hwp"} and [r.tag for r in made.segments.orderBy("ord").collect()] == ["file_01", "file_02"]
    assert made.batches.count() == 3 and made.over.count() == 0


def test_each_workbook_has_its_own_rule_book(spark):
    rules = spark.createDataFrame([("w1", "A", 1), ("w2", "A", 2), ("w2", "B", 3)], "wb string, sheet string, item_no long")
    titles = spark.createDataFrame([("w1", 0, "A"), ("w2", 0, "A"), ("w2", 1, "B"), ("w3", 0, "A"), ("w3", 1, "B")], "wb string, ord int, title string")
    got = {(r.wb, r.sheet, r.item_no) for r in full_check.rules_for_sheets(rules, titles).collect()}
    assert got == {("w1", "A", 1), ("w2", "A", 2), ("w2", "B", 3), ("w3", "A", 1)}
    books = spark.createDataFrame([("w1", "w2"), ("w3", "w2")], "wb string, book string")
    assert {(r.wb, r.item_no) for r in full_check.rules_for_sheets(rules, titles, books).collect()} == {("w1", 2), ("w3", 2), ("w3", 3)}
