"""Worksheet rules on small hand-made grids."""

from veritab.operators import grid as H


def test_check_headers_with_one_key_are_one_column(spark):
    """Two headers that differ in blanks only are the same one; the later stands."""
    checks = spark.createDataFrame([("w", "s", 4, "일시 일치 여부"), ("w", "s", 7, "일시일치여부"), ("w", "s", 9, "인원")], "wb string, sheet string, col long, header string")
    items = spark.createDataFrame([("w", "s", 1, "일시 일치"), ("w", "s", 2, "일시 일치여부"), ("w", "s", 3, "없음")], "wb string, sheet string, item_no int, item string")
    assert {r.item_no: r.col for r in H.place_items(items, checks).collect()} == {1: 7, 2: 7, 3: None}


def test_filled_rows_are_claims_or_recorded(spark):
    """After the run of empty rows nothing is a claim, and nothing is lost either."""
    values = spark.createDataFrame([("w", "s", r, "기간", "x", False) for r in (5, 6, 30, 60, 61)], "wb string, sheet string, row long, rep string, text string, inherited boolean")
    heads = spark.createDataFrame([("w", "s", 4)], "wb string, sheet string, head_row long")
    ends = H.end_rows(values, heads)
    assert ends.collect()[0].last_row == 6
    claims = {r.row for r in H.claim_values(values, ends).collect()}
    assert claims == {5, 6}


CELLS = "wb string, sheet string, row long, col long, value string, fill_rgb string, pattern string"
MERGES = "wb string, sheet string, r1 long, r2 long, c1 long, c2 long"


def test_a_merge_to_the_end_of_a_sheet_adds_no_row_below_the_last_filled_one(spark):
    cells = [("w", "s", 1, k, v, "", "") for k, v in ((1, "기업명"), (2, "기간"), (4, "인원"))] + [("w", "s", 3, 1, "가", "", ""), ("w", "s", 7, 4, "5", "", "")]
    merges = [("w", "s", 3, 1 << 20, 1, 3), ("w", "s", 9, 1 << 20, 4, 16384)]
    colmap = [("w", "s", 1, "기업", [1]), ("w", "s", 2, "기간", [2]), ("w", "s", 3, "인원", [4])]
    cells, merges = spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, MERGES)
    colmap = spark.createDataFrame(colmap, "wb string, sheet string, item_no int, rep string, cols array<long>")
    got = {(r.row, r.rep): (r.text, r.inherited) for r in H.read_values(cells, merges, colmap).collect()}
    want = {(r, "기업"): ("가", r != 3) for r in range(3, 8)} | {(r, "기간"): ("가", True) for r in range(3, 8)} | {(7, "인원"): ("5", False)}
    assert got == want


def test_header_cells_find_the_merge_they_lie_in(spark):
    head = [("w", "s", 2, k, v, False) for k, v in ((1, "a"), (2, "b"), (5, "c"), (9, "d"), (12, "e"))]
    merges = [("w", "s", 1, 2, 2, 4), ("w", "s", 2, 2, 9, 16384), ("w", "s", 3, 9, 5, 6), ("w", "s", 2, 5, 5, 5)]
    spans = H._spans_at(spark.createDataFrame(head, "wb string, sheet string, row long, col long, value string, painted boolean"), spark.createDataFrame(merges, MERGES))
    assert {r.value: (r.c1, r.c2) for r in spans.collect()} == {"a": (None, None), "b": (2, 4), "c": (5, 5), "d": (9, 16384), "e": (9, 16384)}


def test_every_candidate_is_named_and_a_late_header_is_found_by_a_deeper_look(spark):
    headers = spark.createDataFrame([("w", "s", k, f"참여{k}", f"참여 {k}", [k]) for k in range(7)], "wb string, sheet string, col long, key string, header string, cols array<long>")
    items = spark.createDataFrame([("w", "s", 1, "i", ["없음", "참여"]), ("w", "s", 2, "j", ["x", "참여3"]), ("w", "s", 3, "k", []), ("w", "t", 4, "l", ["참여"])], "wb string, sheet string, item_no int, item string, names array<string>")
    got = {r.item_no: (r.how, r.found, r.n_found) for r in H.resolve_columns(items, headers).collect()}
    assert got == {1: (H.AMBIGUOUS, " · ".join(f"참여 {k}" for k in range(7)), 7), 2: (H.EXACT, "참여 3", 1), 4: (H.NOT_FOUND, "", 0)}
    cells = spark.createDataFrame([("w", "s", 45, 1, "이름", "", ""), ("w", "s", 46, 1, "값", "", ""), ("w", "t", 2, 1, "머리", "", "")], CELLS)
    assert {(r.sheet, r.head_row) for r in H.header_rows(cells).collect()} == {("s", 1), ("t", 2)}
    assert {(r.sheet, r.head_row) for r in H.header_rows(cells, depth=60).collect()} == {("s", 45), ("t", 2)}
    assert [tuple(r) for r in H.missing_headers(cells).collect()] == [("w", "s", 45)] and H.missing_headers(cells, depth=60).count() == 0
