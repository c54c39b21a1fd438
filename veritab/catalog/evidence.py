"""Queries for evidence files and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritab.catalog.registry import query
from veritab.functions.text import jamo_ratio, natural_key, repair_name, safe_name, squeeze
from veritab.operators import grid as H, ingest as I, pack as P
from veritab.operators.guards import file_tags
from veritab.session import materialize, shared_folder
from veritab.sources import files as S

c = F.col

_EXT = r"lower(regexp_extract({x}, '[^/](\.[^./]+)$', 1))"
ext = lambda x: _EXT.replace("{x}", x)
stem = lambda x: rf"CASE WHEN {ext(x)} <> '' THEN left({x}, len({x}) - len({ext(x)})) ELSE {x} END"
safe = lambda x: rf"left(regexp_replace({x}, '[\\/:*?\x22<>|\r\n\t]+', '_', 'g'), 60)"
trimmed = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
base = lambda x: f"regexp_extract({x}, '([^/]*)$', 1)"
jamo_n = lambda x: rf"len(regexp_extract_all({x}, '[\x{{1100}}-\x{{11ff}}\x{{3130}}-\x{{318f}}]'))"
syl_n = lambda x: rf"len(regexp_extract_all({x}, '[\x{{ac00}}-\x{{d7a3}}]'))"
ratio = lambda j, s: f"(CASE WHEN {j} + {s} > 0 THEN {j} / ({j} + {s}) ELSE 0.0 END)"
squeezed = lambda x: trimmed(rf"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[^\S\n]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_SUPPORTED = "(" + ", ".join(f"'{e}'" for e in I.SUPPORTED) + ")"
_NATIVE = "('.hwp', '.hwpx', '.docx')"
_IMAGES = "(" + ", ".join(f"'{e}'" for e in I.IMAGES) + ")"


@query("s03_file_listing", f"""SELECT ord, path, {ext('name')} AS ext, {ext('name')} IN {_SUPPORTED} AS supported FROM {{files}}
WHERE NOT starts_with(name, '~$') AND NOT starts_with(name, '.')""")
def s03(t):
    return I.list_files(t.files.select("ord", "path"))


# Ten files a manifest, on three sheets of which one is skipped; each row names its file twice, a folder, and one file that all share.
_ENTRIES = """entries AS (SELECT 'M' || ord // 10 AS wb, ord % 3 AS s, ord, path FROM {files} WHERE ord % 3 <> 2 AND ord % 7 <> 0),
named AS (SELECT wb, s, ord, 0 AS e, 0 AS f, path FROM entries UNION ALL SELECT wb, s, ord, 0, 1, upper(path) FROM entries
  UNION ALL SELECT wb, s, ord, 1, 0, CASE WHEN ord % 2 = 0 THEN 'Shared/A.pdf' ELSE 'shared/a.PDF' END FROM entries),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY wb, lower(path) ORDER BY s, ord, e, f) = 1)"""


def manifests(t):
    files = lambda *xs: F.struct(F.array(*xs).alias(S.FILES))
    shared = F.when(c("ord") % 2 == 0, "Shared\\A.pdf").otherwise("shared/a.PDF")
    row = F.struct((c("ord") % 7 == 0).alias(S.COLLISION), F.array(files(c("path"), F.upper("path"), F.lit("묶음/")), files(shared)).alias(S.SUBMITTED))
    in_order = lambda x, field: F.transform(F.array_sort(F.collect_list(x)), lambda y: y[field])
    rows = t.files.select(F.concat(F.lit("M"), F.expr("ord div 10").cast("string")).alias("wb"), (c("ord") % 3).alias("s"), "ord", row.alias("row"))
    sheets = rows.groupBy("wb", "s").agg(in_order(F.struct("ord", "row"), "row").alias("rows"))
    sheet = F.struct(F.when(c("s") == 2, S.ROSTER_SHEET).otherwise(F.concat(F.lit("S"), c("s").cast("string"))).alias("sheet"), "rows")
    books = sheets.groupBy("wb").agg(in_order(F.struct("s", sheet.alias("sheet")), "sheet").alias("sheets"))
    return books.select("wb", F.to_json(F.struct("sheets")).alias("body"))


@query("s04_manifest_scan", f"WITH {_ENTRIES} SELECT wb, cast(row_number() OVER (PARTITION BY wb ORDER BY s, ord, e, f) as int) AS place, path FROM firsts")
def s04(t):
    """The files to open, in order."""
    return S.scan_manifest(manifests(t))[0].drop("key")


@query("s04_manifest_counts", """SELECT 'M' || ord // 10 AS wb, count(DISTINCT CASE WHEN ord % 3 <> 2 THEN ord % 3 END) AS sheets, count(*) FILTER (ord % 3 = 2) AS rows_of_skipped_sheets,
  count(*) FILTER (ord % 3 <> 2 AND ord % 7 <> 0) AS rows, count(*) FILTER (ord % 3 <> 2 AND ord % 7 = 0) AS rows_in_collision,
  count(*) FILTER (ord % 3 <> 2 AND ord % 7 <> 0) AS folders FROM {files} GROUP BY 1""")
def s04_counts(t):
    return S.scan_manifest(manifests(t))[1]


@query("s04_missing_files", f"WITH {_ENTRIES} SELECT wb, cast(place as int) AS place, path FROM (SELECT *, row_number() OVER (PARTITION BY wb ORDER BY s, ord, e, f) AS place FROM firsts) x WHERE path NOT IN (SELECT path FROM {{files}})")
def s04_missing(t):
    return S.missing_files(S.scan_manifest(manifests(t))[0].drop("key"), t.files)


_BOOK = base("concat(path, '_검증본_2단계판정')")
@query("s05_output_names", rf"""SELECT ord, trim(replace(replace({_BOOK}, '_검증본', ''), '_2단계판정', '')) || '_보조_검사결과_' || regexp_replace(name, '[\\/:*?\x22<>|]', '', 'g') AS out FROM {{files}}""")
def s05(t):
    path = F.concat("path", F.lit("_검증본_2단계판정.xlsx"))
    return t.files.select("ord", S.output_name(path, c("name"), "보조_검사결과").alias("out"))


def sink(t, name: str) -> str:
    """A new folder below the session's shared one; it goes when that one is removed."""
    return f"{shared_folder(t.spark)}/sinks/{name}-{uuid.uuid4()}"


@query("s05_sheet_sink", "SELECT wb, sheet, row, CASE WHEN sheet = 'S1' THEN upper(company) ELSE company END AS company FROM {claims}")
def s05_sink(t):
    """All sheets are written, then a later run writes some anew, twice as after a failure; read back."""
    folder, rows = sink(t, "sheets"), t.claims.select("wb", "sheet", "row", "company")
    S.write_per_sheet(rows, folder)
    for _ in range(2):
        S.write_per_sheet(rows.filter("sheet = 'S1'").withColumn("company", F.upper("company")), folder)
    return S.read_per_sheet(t.spark, folder).select("wb", "sheet", "row", "company")


@query("s08_cached_texts", f"""SELECT cast(doc_id as string) AS stem, CASE WHEN doc_id % 4 = 0 THEN cast(doc_id as string) WHEN doc_id % 4 = 1 THEN {base("concat('/a/', name)")} ELSE name END AS name, sha256(text) AS sha
FROM {{docs}} WHERE {trimmed('text')} <> ''""")
def s08(t):
    texts = t.docs.select(c("doc_id").cast("string").alias("stem"), "text")
    metas = t.docs.filter("doc_id % 4 <> 0").select(
        c("doc_id").cast("string").alias("stem"), F.when(c("doc_id") % 4 != 1, c("name")).alias("meta_name"), F.concat(F.lit("/a/"), "name").alias("source_path")
    )
    return S.cached_texts(texts, metas).select("stem", "name", F.sha2("text", 256).alias("sha"))


@query("t01_content_hash", "SELECT doc_id, sha256(text) AS sha FROM {docs}")
def t01(t):
    return t.docs.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t02_content_key", f"SELECT doc_id, substr(sha256(text), 1, 12) || '_' || {safe(stem('name'))} AS key FROM {{docs}}")
def t02(t):
    return t.docs.select("doc_id", I.content_key(c("text"), c("name")).alias("key"))


@query("t03_skip_unchanged", f"""WITH known AS (SELECT sha256(text) AS sha, {safe(stem('name'))} AS st, arg_min(method, ord) AS method, arg_min(chars, ord) AS chars FROM {{read_cache}} GROUP BY ALL)
SELECT d.doc_id, CASE WHEN k.sha IS NOT NULL THEN 'skipped' ELSE 'to read' END AS status, k.method, cast(k.chars as bigint) AS chars
FROM {{docs}} d LEFT JOIN known k ON k.sha = sha256(d.text) AND k.st = {safe(stem('d.name'))}""")
def t03(t):
    identified = lambda df: df.withColumns({"key": I.content_key(c("text"), c("name")), "sha256": F.sha2("text", 256)}).drop("text")
    out = I.skip_unchanged(identified(t.docs.select("doc_id", "text", "name")), identified(t.read_cache))
    return out.select("doc_id", "status", "method", c("chars").cast("bigint").alias("chars"))


@query("t04_jamo_ratio", f"SELECT doc_id, round({ratio(jamo_n('text'), syl_n('text'))}, 6) AS ratio FROM {{docs}}")
def t04(t):
    return t.docs.select("doc_id", F.round(jamo_ratio(c("text")), 6).alias("ratio"))


_JOINED = "string_agg(text, chr(10) ORDER BY page)"
@query("t05_text_layer_quality", f"""WITH j AS (SELECT doc_id, count(*) AS pages, {_JOINED} AS txt, string_agg(nfc_normalize(text), chr(10) ORDER BY page) AS fixed FROM {{doc_pages}} GROUP BY ALL),
r AS (SELECT *, len({trimmed('txt')}) AS chars, round({ratio(jamo_n('txt'), syl_n('txt'))}, 3) AS j1, {ratio(jamo_n('fixed'), syl_n('fixed'))} AS j2 FROM j)
SELECT doc_id, pages, chars, CASE WHEN j1 > 0.1 AND j2 <= 0.1 THEN round(j2, 3) ELSE j1 END AS jamo, j1 > 0.1 AND j2 <= 0.1 AS repaired,
       NOT (j1 > 0.1 AND j2 > 0.1) AND chars >= 40 * pages AS usable,
       CASE WHEN j1 > 0.1 AND j2 > 0.1 THEN 'scattered jamo' WHEN chars < 40 * pages THEN 'too little text' ELSE '' END AS reason FROM r""")
def t05(t):
    return I.text_layer_quality(t.doc_pages)


@query("t06_squeeze", f"SELECT doc_id, sha256({squeezed('text')}) AS sha, len({squeezed('text')}) AS chars FROM {{docs}}")
def t06(t):
    return t.docs.select("doc_id", squeeze(c("text")).alias("s")).select("doc_id", F.sha2("s", 256).alias("sha"), F.length("s").alias("chars"))


@query("t07_safe_name", f"SELECT doc_id, {safe('name')} AS safe FROM {{docs}}")
def t07(t):
    return t.docs.select("doc_id", safe_name(c("name")).alias("safe"))


@query("t08_natural_order", r"""SELECT doc_id, regexp_replace(regexp_replace(name, '([0-9]+)', '00000000000000000000\1', 'g'), '0*([0-9]{20})([^0-9]|$)', '\1\2', 'g') AS key FROM {docs}""")
def t08(t):
    return t.docs.select("doc_id", natural_key(c("name")).alias("key"))


ROUTED = f"""routed AS (SELECT *, {ext('name')} AS x, CASE WHEN NOT present OR {ext('name')} NOT IN {_SUPPORTED} THEN ''
  WHEN {ext('name')} IN {_NATIVE} THEN substr({ext('name')}, 2) WHEN {ext('name')} = '.pdf' AND layer_usable THEN CASE WHEN layer_repaired THEN 'pdf-layer(NFC)' ELSE 'pdf-layer' END
  WHEN {ext('name')} = '.pdf' THEN CASE WHEN allow_ocr THEN 'ocr' ELSE 'pdf-layer(below)' END ELSE CASE WHEN allow_ocr THEN 'ocr(image)' ELSE 'image' END END AS method,
  CASE WHEN NOT present THEN 'error' WHEN {ext('name')} NOT IN {_SUPPORTED} THEN 'unsupported' WHEN cached THEN 'skipped'
  WHEN NOT allow_ocr AND ({ext('name')} IN {_IMAGES} OR ({ext('name')} = '.pdf' AND NOT layer_usable)) THEN 'ocr needed' WHEN no_text THEN 'empty' ELSE 'ok' END AS status FROM {{files}}),
readf AS (SELECT *, CASE WHEN status IN ('ok', 'empty') AND starts_with(method, 'ocr') THEN pages ELSE 0 END AS requests FROM routed)"""


@query("t09_read_routing", f"WITH {ROUTED} SELECT ord, method, status, requests, status IN ('ok', 'empty') AS to_cache FROM readf")
def t09(t):
    return I.route(t.files).select("ord", "method", "status", "requests", "to_cache")


@query("t10_page_assembly", f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM {{doc_pages}}),
a AS (SELECT doc_id, any_value(n) AS pages, {trimmed("string_agg(CASE WHEN n > 1 THEN CASE WHEN i > 1 THEN chr(10) ELSE '' END || '===== [p.' || i || '] =====' || chr(10) ELSE '' END || text || CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END, '' ORDER BY page)")} || chr(10) AS txt FROM n GROUP BY doc_id)
SELECT doc_id, pages, len(txt) AS chars, sha256(txt) AS sha FROM a""")
def t10(t):
    return I.assemble_pages(t.doc_pages).select("doc_id", "pages", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


_HEAD = "CASE WHEN i > 1 THEN chr(10) ELSE '' END || '===== [p.' || i || '] =====' || chr(10)"
@query("t10_page_chunks", rf"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM {{doc_pages}}),
pieces AS (SELECT doc_id, i, CASE WHEN n = 1 THEN {trimmed('text')} || chr(10) WHEN i = n THEN regexp_replace({_HEAD} || text, '\s+$', '') || chr(10)
  ELSE {_HEAD} || text || CASE WHEN suffix(text, chr(10)) THEN '' ELSE chr(10) END END AS piece FROM n),
chunks AS (SELECT doc_id, (i - 1) // 3 AS chunk, string_agg(piece, '' ORDER BY i) AS txt FROM pieces GROUP BY ALL),
slices AS (SELECT *, unnest(range(0, greatest(len(txt) - 1, 0) // 2000 + 1)) AS slice FROM chunks)
SELECT doc_id, chunk, slice, sha256(substr(txt, slice * 2000 + 1, 2000)) AS sha FROM slices""")
def t10_chunks(t):
    """Three pages a chunk and 2,000 characters a row, so that most documents have several of both."""
    return I.page_chunks(t.doc_pages, per_chunk=3, most=2000).select("doc_id", "chunk", "slice", F.sha2("text", 256).alias("sha"))


_SUMS = "count(*) AS files, cast(sum(n_chars) as bigint) AS chars, cast(sum(requests) as bigint) AS requests, count(*) FILTER (requests > 0) AS ocr_files"
@query("t11_read_summary", f"""WITH {ROUTED} SELECT 'status' AS what, status AS value, {_SUMS} FROM readf GROUP BY status
UNION ALL SELECT 'method', method, {_SUMS} FROM readf WHERE method <> '' GROUP BY method UNION ALL SELECT 'all', '', {_SUMS} FROM readf""")
def t11(t):
    return I.read_summary(I.route(t.files))


@query("t12_problem_list", f"""WITH {ROUTED} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, ord, status, name FROM readf
WHERE status IN ('error', 'empty', 'unsupported', 'ocr needed')""")
def t12(t):
    return I.problem_list(I.route(t.files))


@query("t13_name_repair", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '보고 ' || doc_id || '.pdf' WHEN 3 THEN '' ELSE name END AS repaired FROM {docs}""")
def t13(t):
    """Read with each of the wrong charsets, and names that were never garbled."""
    garbled = lambda x, charset: F.decode(F.encode(x, "UTF-8"), charset)
    short = F.concat(F.lit("보고 "), c("doc_id").cast("string"), F.lit(".pdf"))  # its bytes are whole CP949 characters
    name = F.when(c("doc_id") % 4 == 0, garbled(short, "x-windows-949")).when(c("doc_id") % 4 == 1, garbled(c("name"), "IBM437"))
    return t.docs.select("doc_id", repair_name(name.when(c("doc_id") % 4 == 2, garbled(c("name"), "ISO-8859-1")).otherwise(c("name"))).alias("repaired"))


@query("t14_secret_scan", r"""WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 45 = 0 THEN '.env' WHEN doc_id % 46 = 0 THEN 'a.json' ELSE name END AS n, doc_id % 46 = 0 AS sec FROM {docs}),
g AS (SELECT doc_id, CASE WHEN n = '.env' OR sec THEN 'forbidden name' WHEN """ + ext("n") + r""" IN ('.json', '.txt', '.env', '.cfg', '.ini', '.md', '.py', '.yaml', '.yml') THEN
  CASE WHEN regexp_matches(text, 'sk-[A-Za-z0-9_\-]{20,}') THEN 'service key' WHEN regexp_matches(text, 'AIza[0-9A-Za-z_\-]{30,}') THEN 'cloud key'
       WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private key' WHEN regexp_matches(text, '"private_key"\s*:\s*"[^"]{40,}') THEN 'service account key' END END AS finding FROM f)
SELECT doc_id, finding FROM g WHERE finding IS NOT NULL""")
def t14(t):
    name = F.when(c("doc_id") % 45 == 0, F.lit(".env")).when(c("doc_id") % 46 == 0, F.lit("a.json")).otherwise(c("name"))
    folder = F.when(c("doc_id") % 46 == 0, F.lit("/d/secrets/")).otherwise(F.lit("/d/"))
    return I.secret_scan(t.docs.select("doc_id", F.concat(folder, name).alias("path"), "text")).select("doc_id", "finding")


# --- packing --------------------------------------------------------------------------------

SOURCE = ["source"]
TOTAL, PER = 50000, 6000


def lengths(t):
    return t.docs.select("source", "ord", F.length("text").cast("bigint").alias("len"))


def budgets(t, total: int = TOTAL, per: int = PER):
    return t.docs.select("source").distinct().select("source", F.lit(total).cast("bigint").alias("total"), F.lit(per).cast("bigint").alias("per_file"))


def shared(t):
    return P.shares(lengths(t), SOURCE, budgets(t))


# Sequential definition in ranks: sort by (cap, ord), fill until a cap exceeds the even rest.
SHARES = f"""l AS (SELECT source, ord, name, text, len(text) AS len, count(*) OVER (PARTITION BY source) AS n FROM {{docs}}),
caps AS (SELECT *, least(len, greatest({PER}, {TOTAL} // n)) AS cap FROM l),
ranked AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
           sum(cap) OVER (PARTITION BY source) AS want FROM caps WINDOW w AS (PARTITION BY source ORDER BY cap, ord)),
brim AS (SELECT source, min(k) AS ks, arg_min(p, k) AS ps FROM ranked WHERE want > {TOTAL} AND cap > ({TOTAL} - p) // (n - k) GROUP BY source),
shares AS (SELECT r.*, cast(CASE WHEN b.ks IS NULL OR r.k < b.ks THEN r.cap
   ELSE ({TOTAL} - b.ps) // (n - b.ks) + CASE WHEN r.k - b.ks >= (n - b.ks) - ({TOTAL} - b.ps) % (n - b.ks) THEN 1 ELSE 0 END END as bigint) AS share
   FROM ranked r LEFT JOIN brim b USING (source))"""
_TAIL = "cast(floor(share * 0.4) as int)"
_CUT = f"""(CASE WHEN len <= share THEN text WHEN share < 2000 THEN left(text, cast(share as int)) ELSE left(text, cast(share as int) - {_TAIL}) || chr(10) || chr(10) || '…가운데 ' || format('{{:,}}', len - share) || '자 잘림…' || chr(10) || chr(10) || right(text, {_TAIL}) END)"""


@query("p01_fair_shares", f"WITH {SHARES} SELECT source, ord, len, share FROM shares")
def p01(t):
    return shared(t)


@query("p02_head_and_tail", f"WITH {SHARES} SELECT source, ord, len({_CUT}) AS chars, sha256({_CUT}) AS sha FROM shares")
def p02(t):
    cut = t.docs.select("source", "ord", "text").join(shared(t).drop("len"), ["source", "ord"]).withColumn("cut", P.head_and_tail(c("text"), c("share")))
    return cut.select("source", "ord", F.length("cut").alias("chars"), F.sha2("cut", 256).alias("sha"))


@query("p03_cut_log", f"WITH {SHARES} SELECT source, ord, len AS total_chars, share AS kept_chars FROM shares WHERE len > share")
def p03(t):
    return P.cut_log(shared(t))


@query("p04_token_estimate", "SELECT doc_id, cast(floor(len(text) * 0.65) as bigint) AS tokens FROM {docs}")
def p04(t):
    return t.docs.select("doc_id", P.token_estimate(F.length("text")).alias("tokens"))


def _round(i: int) -> str:
    """What each group keeps at the totals of ``s<i>``, and its estimated tokens."""
    return f"""
caps{i} AS (SELECT source, ord, n, total, least(len, greatest(per_file, total // n)) AS cap FROM lens JOIN s{i} USING (source)),
ranked{i} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cap, ord) - 1 AS k, sum(cap) OVER (PARTITION BY source) AS want,
  coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM caps{i}),
brim{i} AS (SELECT source, min(k) AS ks, arg_min(p, k) AS ps FROM ranked{i} WHERE want > total AND cap > (total - p) // (n - k) GROUP BY source),
kept{i} AS (SELECT source, sum(CASE WHEN ks IS NULL OR k < ks THEN cap ELSE 0 END) + max(coalesce(total - ps, 0)) AS kept FROM ranked{i} LEFT JOIN brim{i} USING (source) GROUP BY source),
e{i} AS (SELECT s.*, cast(floor((kept + chars) * 0.65::DOUBLE) AS bigint) AS tokens FROM s{i} s JOIN kept{i} USING (source))"""


def _next(i: int) -> str:
    return f""",
t{i} AS (SELECT *, cast(floor(total * target / greatest(tokens, 1)) AS bigint) - 2000 AS smaller FROM e{i}),
g{i} AS (SELECT *, open AND tokens > target AND smaller < total AND smaller >= 20000 AS go FROM t{i}),
s{i + 1} AS (SELECT source, chars, target, per_file, CASE WHEN go THEN smaller ELSE total END AS total, go AS open FROM g{i}),"""


_FIT = f"""WITH lens AS (SELECT source, ord, len(text) AS len, count(*) OVER (PARTITION BY source) AS n FROM {{docs}}),
others AS (SELECT source, sum(len(name)) AS chars, count(*) AS n FROM {{docs}} GROUP BY source),
goal AS (SELECT *, least({P.FILL_TARGET}, {int(P.LIMIT_FLOOR * P.FILL_SHARE)}) - cast(floor(({P.RESERVE} + {P.RESERVE_PER_FILE} * n) * 0.65::DOUBLE) AS bigint) AS target FROM others),
s0 AS (SELECT source, chars, target, {P.PER_FILE} AS per_file, greatest(0, cast(floor(target / 0.65::DOUBLE) AS bigint)) AS total, true AS open FROM goal),"""


@query("p05_budget_fit", _FIT + "".join(_round(i) + (_next(i) if i < 6 else "") for i in range(7)) + """
SELECT source, total, per_file, tokens, tokens <= target AS fits FROM e6""")
def p05(t):
    """Budgets of all sources at the smallest allowed limit, so that the rounds have work to do."""
    files = materialize(t.docs.select("source", "ord", F.length("text").cast("bigint").alias("len")))
    other = t.docs.groupBy("source").agg(F.sum(F.length("name")).alias("chars"))
    return P.fit_budgets(files, SOURCE, other, materialize, limit=P.LIMIT_FLOOR)


_MOST = int(P.LIMIT_FLOOR * P.SAFE_SHARE)


def _batch_round(i: int) -> str:
    """What open batches keep at the totals of ``b<i>``, their tokens, and the totals of the next round."""
    return f"""
bcaps{i} AS (SELECT source, batch, ord, n, total, least(len, greatest(per_file, total // n)) AS cap FROM lens JOIN b{i} USING (source) WHERE open),
branked{i} AS (SELECT *, row_number() OVER w - 1 AS k, sum(cap) OVER (PARTITION BY source, batch) AS want,
  coalesce(sum(cap) OVER (PARTITION BY source, batch ORDER BY cap, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM bcaps{i} WINDOW w AS (PARTITION BY source, batch ORDER BY cap, ord)),
bbrim{i} AS (SELECT source, batch, min(k) AS ks, arg_min(p, k) AS ps FROM branked{i} WHERE want > total AND cap > (total - p) // (n - k) GROUP BY ALL),
bkept{i} AS (SELECT source, batch, sum(CASE WHEN ks IS NULL OR k < ks THEN cap ELSE 0 END) + max(coalesce(total - ps, 0)) AS kept FROM branked{i} LEFT JOIN bbrim{i} USING (source, batch) GROUP BY source, batch),
bm{i} AS (SELECT b.* EXCLUDE (tokens), CASE WHEN open THEN cast(floor((kept + chars) * 0.65::DOUBLE) AS bigint) ELSE tokens END AS tokens FROM b{i} b LEFT JOIN bkept{i} USING (source, batch)),
bt{i} AS (SELECT *, cast(floor(total * {_MOST} / greatest(tokens, 1)) AS bigint) - 4000 AS smaller FROM bm{i}),
bg{i} AS (SELECT *, open AND tokens > {_MOST} AND smaller >= 20000 AS go FROM bt{i}),
b{i + 1} AS (SELECT source, batch, chars, CASE WHEN go THEN smaller ELSE total END AS total, per_file, rounds + CASE WHEN go THEN 1 ELSE 0 END AS rounds, go AS open, tokens FROM bg{i})"""


@query("p05_batch_fit", _FIT + "".join(_round(i) + (_next(i) if i < 6 else "") for i in range(7)) + """,
b0 AS (SELECT source, batch, chars + batch * 9000 AS chars, total, per_file, 0 AS rounds, true AS open, cast(NULL AS bigint) AS tokens FROM e6, (SELECT unnest(range(0, 8)) AS batch) x),""" + ",".join(_batch_round(i) for i in range(5)) + f"""
SELECT source, batch, b4.total, bm4.tokens, b4.rounds, bm4.tokens <= {_MOST} AS fits FROM b4 JOIN bm4 USING (source, batch)""")
def p05_batches(t):
    """Batches of every source with more and more text of their own, up to four rounds each."""
    files = materialize(t.docs.select("source", "ord", F.length("text").cast("bigint").alias("len")))
    other = t.docs.groupBy("source").agg(F.sum(F.length("name")).alias("chars"))
    totals = P.fit_budgets(files, SOURCE, other, materialize, limit=P.LIMIT_FLOOR)
    batches = totals.join(other, SOURCE).select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("batch"), "chars", "total", "per_file")
    return P.fit_batches(files, SOURCE, batches.withColumn("chars", c("chars") + c("batch") * 9000), materialize, limit=P.LIMIT_FLOOR)


@query("p09_claim_lines", """SELECT k, CASE WHEN len(cast(row as string)) < 4 THEN lpad(cast(row as string), 4, ' ') ELSE cast(row as string) END || ' |  ' ||
  coalesce(nullif(concat_ws('  |  ', CASE WHEN trim(period) <> '' THEN '기간=' || period END, CASE WHEN trim(hours) <> '' THEN '시간=' || hours END, CASE WHEN trim(isbn) <> '' THEN 'ISBN=' || isbn END), ''), '(빈 줄)') AS line FROM {claims}""")
def p09(t):
    values = F.array(*[F.struct(F.lit(k).alias("k"), c(v).alias("v")) for k, v in (("기간", "period"), ("시간", "hours"), ("ISBN", "isbn"))])
    return t.claims.select("k", P.claim_line(c("row"), values).alias("line"))


@query("p10_evidence_payload", f"""WITH {SHARES}, tg AS (SELECT *, 'file_' || lpad(cast(row_number() OVER (PARTITION BY source ORDER BY ord) as string), cast(greatest(2, len(cast(n as string))) as int), '0') AS tag FROM shares),
s AS (SELECT source, ord, tag, concat_ws(chr(10), chr(10) || '【' || tag || '】 ' || name, CASE WHEN len > share THEN '  ※ cut in the middle: ' || format('{{:,}}', len - share) || ' characters' END,
  coalesce(nullif({_CUT}, ''), '(글자를 하나도 뽑지 못한 파일이다)')) AS seg FROM tg)
SELECT source, ord, tag, len(seg) AS chars, sha256(seg) AS sha FROM s""")
def p10(t):
    tagged = file_tags(t.docs.select(F.lit("").alias("wb"), c("source").alias("sheet"), "ord", "name")).select(c("sheet").alias("source"), "ord", "tag")
    docs = t.docs.select("source", "ord", "name", "text").join(tagged, ["source", "ord"])
    return P.segments(docs, shared(t), SOURCE).select("source", "ord", "tag", F.length("segment").alias("chars"), F.sha2("segment", 256).alias("sha"))


@query("p11_roster_line", """WITH p AS (SELECT wb, row, max(value) FILTER (col = 2) AS name, coalesce(max(value) FILTER (col = 3), '') AS category FROM {roster_cells} WHERE row > 1 GROUP BY ALL),
  q AS (SELECT p.wb, name, CASE WHEN h.value = '비고' THEN '' ELSE category END AS category, min(p.row) AS row FROM p JOIN (SELECT wb, value FROM {roster_cells} WHERE row = 1 AND col = 3) h ON h.wb = p.wb
        WHERE len(name) BETWEEN 2 AND 12 AND NOT regexp_full_match(name, '[0-9]+') GROUP BY 1, 2, 3)
SELECT wb, count(*) AS people, string_agg(CASE WHEN category <> '' THEN name || '(' || category || ')' ELSE name END, ' · ' ORDER BY row) AS line FROM q GROUP BY wb""")
def p11(t):
    return P.roster_line(H.read_roster(t.roster_cells), ["wb"])


@query("p11_roster_chunks", """WITH p AS (SELECT wb, row, max(value) FILTER (col = 2) AS name, coalesce(max(value) FILTER (col = 3), '') AS category FROM {roster_cells} WHERE row > 1 GROUP BY ALL),
  q AS (SELECT p.wb, name, CASE WHEN h.value = '비고' THEN '' ELSE category END AS category, min(p.row) AS row FROM p JOIN (SELECT wb, value FROM {roster_cells} WHERE row = 1 AND col = 3) h ON h.wb = p.wb
        WHERE len(name) BETWEEN 2 AND 12 AND NOT regexp_full_match(name, '[0-9]+') GROUP BY 1, 2, 3),
  r AS (SELECT *, (row_number() OVER (PARTITION BY wb ORDER BY row) - 1) // 20 AS chunk, CASE WHEN category <> '' THEN name || '(' || category || ')' ELSE name END AS said FROM q),
  k AS (SELECT wb, chunk, CASE WHEN chunk > 0 THEN ' · ' ELSE '' END || string_agg(said, ' · ' ORDER BY row) AS txt FROM r GROUP BY wb, chunk)
SELECT wb, chunk, slice, substr(txt, slice * 100 + 1, 100) AS text FROM (SELECT *, unnest(range(0, greatest(len(txt) - 1, 0) // 100 + 1)) AS slice FROM k) x""")
def p11_chunks(t):
    return P.roster_chunks(H.read_roster(t.roster_cells), ["wb"], per_chunk=20, most=100)


@query("s10_index_sink", f"""WITH {ROUTED} SELECT r.path, sha256(d.text) AS sha256, r.method, r.n_chars FROM readf r JOIN {{docs}} d ON d.ord = r.ord
WHERE r.status IN ('ok', 'empty', 'skipped') QUALIFY row_number() OVER (PARTITION BY r.path, sha256(d.text) ORDER BY r.method, r.n_chars) = 1""")
def s10_sink(t):
    """A first run over some files, then the whole twice, as after a failure: each file and content is there once."""
    folder, hashes = sink(t, "index"), t.docs.select("ord", F.sha2("text", 256).alias("sha256"))
    read = I.route(t.files).join(hashes, "ord")
    for part in (read.filter("ord % 3 = 0"), read, read):
        S.append_index(part, folder)
    return S.read_index(t.spark, folder).drop("at")


@query("s10_read_index", f"""WITH {ROUTED} SELECT r.path, sha256(d.text) AS sha256, r.method, r.n_chars FROM readf r JOIN {{docs}} d ON d.ord = r.ord
WHERE r.status IN ('ok', 'empty', 'skipped')""")
def s10(t):
    hashes = t.docs.select("ord", F.sha2("text", 256).alias("sha256"))
    return S.index_rows(I.route(t.files).join(hashes, "ord"))
