"""Spreadsheet grids as a long ``cells(source_file, sheet, r, c, v)`` table -> records (CL-25…28).

Workbooks arrive as cells (one row per non-empty cell).  Layout rules become joins on
(sheet, r, c) offsets and pivots with explicit value lists, so a workbook of any size is
parsed by Spark without loading a sheet into one process.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import month_from_name, to_num_commas, utrim, vote_month_token, wb_num, wb_yes

KEYS = ("source_file", "sheet")


def blocks_to_records(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """CL-25: row 0 holds a name in every even column; below it (label, value) pairs in columns
    (c, c+1).  -> one row per (file, sheet, name) with the chosen labels as numeric columns.  Of blocks
    with one name the rightmost stands alone; of rows with one label in a block the lowest counts.

    Cells fold to rows of a block (label from the even column, value from the odd one), rows to one row per
    block, blocks to one per name: three aggregations, each partial before its shuffle, no window."""
    k = list(KEYS)
    even = F.col("c") % 2 == 0
    rows = cells.groupBy(*k, (F.col("c") - F.col("c") % 2).alias("b"), "r").agg(
        F.max(F.when(even, utrim("v"))).alias("label"), F.max(F.when(~even, F.col("v"))).alias("value"))
    blocks = rows.groupBy(*k, "b").agg(
        F.max(F.when(F.col("r") == 0, F.col("label"))).alias("name"),
        F.struct(*[F.max_by("value", F.when((F.col("r") > 0) & (F.col("label") == x), F.col("r"))).alias(f"v{i}")
                   for i, x in enumerate(labels)]).alias("values"))
    named = blocks.where(F.col("name").isNotNull() & ~F.lower("name").isin("", "none", "nan"))
    last = named.groupBy(*k, "name").agg(F.max_by("values", "b").alias("values"))
    return last.select(*k, "name", *[wb_num(F.col(f"values.v{i}")).alias(x) for i, x in enumerate(labels)])


# fixed values: header keywords of the per-caller detail sheets
ACCOUNT_KW = "账号"
RECHARGE_KW = "充值金额"
RELOGIN_KWS = ("七天", "登入")
DATE_KWS = ("拨打日期", "日期")


#: Shares into which the rows of a sheet are dealt, so that a sheet of any length is many tasks.
SHARES = 32


def header_roles(cells: DataFrame, max_header_row: int = 3) -> DataFrame:
    """CL-26: one row per sheet: its header row ``hr`` and the columns of its roles (``c_acc``, ``c_rec``, ``c_rel``,
    ``c_dat``; NULL if absent).  The header is the first of rows 0..max_header_row with a cell that is the account
    word (in a sheet without one, that contains it, e.g. 会员账号); columns are found by substring, the first keyword
    of a role that any cell holds, leftmost among equals.  Only the header rows are read."""
    k, h = list(KEYS), utrim("v")

    def pick(*kws):
        rank = None
        for i, kw in enumerate(kws):
            rank = F.when(h.contains(kw), F.lit(i)) if rank is None else rank.when(h.contains(kw), F.lit(i))
        return F.min_by("c", F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("c"))))

    rows = cells.where(F.col("r") <= max_header_row).groupBy(*k, "r").agg(
        F.bool_or(h == ACCOUNT_KW).alias("exact"), pick(ACCOUNT_KW).alias("c_acc"), pick(RECHARGE_KW).alias("c_rec"),
        pick(*RELOGIN_KWS).alias("c_rel"), pick(*DATE_KWS).alias("c_dat")).where(F.col("c_acc").isNotNull())
    best = rows.groupBy(*k).agg(F.min_by(F.struct(F.col("r").alias("hr"), "c_acc", "c_rec", "c_rel", "c_dat"),
                                         F.struct(~F.col("exact"), F.col("r"))).alias("h"))
    return best.select(*k, "h.*")


def detail_rows(cells: DataFrame, max_header_row: int = 3) -> DataFrame:
    """CL-26: the rows below each sheet's header as (file, sheet, r, account, recharge, relogin, called), rows
    with a blank account skipped.

    A sheet's rows are dealt to ``SHARES`` shares and its one row of roles is copied to each, so a sheet that
    holds a third of all cells is joined and folded by many tasks; the fold uses the join's partitioning."""
    k = [*KEYS, "share"]
    roles = header_roles(cells, max_header_row).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    body = cells.withColumn("share", F.pmod("r", F.lit(SHARES))).join(roles, k).where(F.col("r") > F.col("hr"))
    rows = body.groupBy(*k, "r").agg(*[F.max(F.when(F.col("c") == F.col(c), F.col("v"))).alias(name) for c, name in
                                       (("c_acc", "account"), ("c_rec", "recharge"), ("c_rel", "relogin"), ("c_dat", "called"))])
    return rows.where(F.coalesce(utrim("account"), F.lit("")) != "").drop("share")


def _totals() -> list:
    return [F.sum(wb_num("recharge")).alias("recharge"), F.count_if(wb_yes("relogin")).alias("relogins"),
            F.count(F.lit(1)).alias("rows")]


def detail_totals(cells: DataFrame, max_header_row: int = 3) -> DataFrame:
    """CL-26: per sheet: recharge sum, yes-flag count and row count of its ``detail_rows``."""
    return detail_rows(cells, max_header_row).groupBy(*KEYS).agg(*_totals())


# fixed values: the statistics sheet of a call workbook, its labels and the columns of the call table
STATS_SHEET = "统计结果"
STATS = {"名单数": "名单数", "已播数": "已播数", "接通数": "接通数", "有效通话": "有效通话", "是否申请彩金": "申请彩金"}


def month_of_name(name, year: int | None = None):
    """Month 'YYYY-MM' that a file name tells: '2026…5月', '2026-05' or '2026/5'; else its month number (CL-16) in ``year``."""
    base = F.regexp_extract(name, r"[^/]+$", 0)

    def told(pattern):
        m = F.regexp_extract(base, pattern, 2).try_cast("int")
        return F.when(m.between(1, 12), F.format_string("%s-%02d", F.regexp_extract(base, pattern, 1), m))

    number = month_from_name(base)
    bare = F.when(number.between(1, 12), F.format_string("%d-%02d", F.lit(year).cast("int"), number)) if year else F.lit(None).cast("string")
    return F.coalesce(told(r"(20\d{2})\D{0,3}(\d{1,2})\s*月"), told(r"(20\d{2})[-/](\d{1,2})"), bare)


def call_records(cells: DataFrame, year: int | None = None) -> DataFrame:
    """CL-25 + CL-26 + CL-15: a call workbook -> one row per (source_file, caller) of the call table.

    The callers and their five counts come from the statistics sheet; recharge and re-logins from the caller's own
    sheet (same name, trimmed, in any case; of several the first by name; 0 without one).  ``月份`` is the month that
    most call dates of these sheets name (the smaller on ties), else that of the file name, else NULL."""
    stats = blocks_to_records(cells.where(F.col("sheet") == STATS_SHEET), list(STATS))
    stats = stats.withColumn("fold", F.lower("name")).drop("sheet")
    per_month = detail_rows(cells.where(F.col("sheet") != STATS_SHEET)).groupBy(*KEYS, vote_month_token("called").alias("month")).agg(*_totals())
    per_month = per_month.withColumn("fold", F.lower(utrim("sheet")))
    by_sheet = per_month.groupBy(*KEYS, "fold").agg(F.sum("recharge").alias("recharge"), F.sum("relogins").alias("relogins"))
    totals = by_sheet.groupBy("source_file", "fold").agg(F.min_by(F.struct("sheet", "recharge", "relogins"), "sheet").alias("t"))
    chosen = totals.select("source_file", "fold", "t.*")
    votes = per_month.where(F.col("month").isNotNull()).join(chosen.select("source_file", "sheet"), [*KEYS], "left_semi") \
                     .join(stats.select("source_file", "fold"), ["source_file", "fold"], "left_semi") \
                     .groupBy("source_file", "month").agg(F.sum("rows").alias("n"))
    month = votes.groupBy("source_file").agg(F.min_by("month", F.struct(-F.col("n"), F.col("month"))).alias("voted"))
    out = stats.join(chosen.drop("sheet"), ["source_file", "fold"], "left").join(month, "source_file", "left")
    whole = [F.col(x).cast("long").alias(name) for x, name in STATS.items()]
    return out.select("source_file", F.col("name").alias("专员"), *whole, F.coalesce("relogins", F.lit(0)).alias("七天回登"),
                      F.coalesce("recharge", F.lit(0.0)).alias("召回充值"),
                      F.coalesce("voted", month_of_name(F.col("source_file"), year)).alias("月份"))


# fixed values: positional settlement sheet — marker words on row 7 and the 9 detail columns
MARKERS = ("名称", "总代")
DETAIL_COLS = ("status", "name", "agent", "prior_perf", "month_perf", "total_perf", "treatment", "rate", "commission")
DETAIL_NUMERIC = ("prior_perf", "month_perf", "total_perf", "rate", "commission")


def _marked(cells: DataFrame) -> DataFrame:
    k = list(KEYS)
    m = cells.where(F.col("r") == 7).groupBy(*k).agg(F.collect_set(utrim("v")).alias("m"))
    ok = m.where(F.array_contains("m", MARKERS[0]) & F.array_contains("m", MARKERS[1])).select(*k)
    return cells.join(ok, k, "left_semi")


def settlement_summary(cells: DataFrame) -> DataFrame:
    """CL-27: summary items: labels row 1 / values row 2 (cols 1-6) and labels row 4 / values row 5
    (cols 3-6); only numeric values kept."""
    k = list(KEYS)
    c = _marked(cells)
    lab = c.where(((F.col("r") == 1) & F.col("c").between(1, 6)) | ((F.col("r") == 4) & F.col("c").between(3, 6))) \
           .select(*k, (F.col("r") + 1).alias("r"), "c", utrim("v").alias("item"))
    val = c.where(F.col("r").isin(2, 5)).select(*k, "r", "c", F.col("v").cast("string").try_cast("double").alias("amount"))
    return lab.join(val, [*k, "r", "c"]).where((F.col("item") != "") & F.col("amount").isNotNull()) \
              .select(*k, "item", "amount")


def settlement_detail(cells: DataFrame) -> DataFrame:
    """CL-27: detail rows from row 8 with 9 fixed columns; name, agent and treatment required."""
    k = list(KEYS)
    c = _marked(cells).where((F.col("r") >= 8) & F.col("c").between(0, 8))
    p = c.groupBy(*k, "r").pivot("c", list(range(9))).agg(F.max("v"))
    out = p.select(*k, "r", *[(to_num_commas(F.col(str(i))) if name in DETAIL_NUMERIC else utrim(F.col(str(i)))).alias(name)
                              for i, name in enumerate(DETAIL_COLS)])
    need = [F.coalesce(F.col(x), F.lit("")) != "" for x in ("name", "agent", "treatment")]
    return out.where(need[0] & need[1] & need[2])


# fixed values: words in the name of a workbook's settlement sheet; columns of the two settlement tables
SETTLEMENT_SHEET = "代理(帐|账)"
SETTLEMENT_SUMMARY = {"item": "项目", "amount": "金额"}
SETTLEMENT_DETAIL = {"status": "回款状态", "name": "名称", "agent": "总代账号", "prior_perf": "先前挂账业绩", "month_perf": "本月业绩",
                     "total_perf": "业绩总计", "treatment": "适用待遇", "rate": "比例", "commission": "实际佣金"}


def workbook_kinds(cells: DataFrame) -> DataFrame:
    """CL-03 for workbooks: (source_file, kind, sheet): 'settlement' with the sheet that holds it (its marker words on row
    7; one that is named so first, then by name), 'calls' if there is a statistics sheet, else 'unknown'."""
    v = utrim("v")
    sheets = cells.groupBy(*KEYS).agg(F.bool_or((F.col("r") == 7) & (v == MARKERS[0])).alias("m0"),
                                      F.bool_or((F.col("r") == 7) & (v == MARKERS[1])).alias("m1"))
    marked = F.coalesce(F.col("m0") & F.col("m1"), F.lit(False))
    order = F.struct(~F.col("sheet").rlike(SETTLEMENT_SHEET), F.col("sheet"))
    books = sheets.groupBy("source_file").agg(F.min_by("sheet", F.when(marked, order)).alias("sheet"),
                                              F.bool_or(F.col("sheet") == STATS_SHEET).alias("calls"))
    kind = F.when(F.col("sheet").isNotNull(), "settlement").when(F.col("calls"), "calls").otherwise("unknown")
    return books.select("source_file", kind.alias("kind"), "sheet")


def last_workbook(df: DataFrame) -> DataFrame:
    """Of workbooks that tell the same month the last one by name stands; rows without a month are left out."""
    last = df.groupBy("月份").agg(F.max("source_file").alias("source_file"))
    return df.join(last, ["月份", "source_file"], "left_semi")


def workbook_tables(cells: DataFrame, kinds: DataFrame, year: int | None = None) -> dict[str, DataFrame]:
    """Cells of landed workbooks -> the rows of each table they fill (月份 may be NULL where nothing tells the month)."""
    calls = cells.join(kinds.where(F.col("kind") == "calls").select("source_file"), "source_file", "left_semi")
    settled = cells.join(kinds.where(F.col("kind") == "settlement").select(*KEYS), [*KEYS], "left_semi")
    month = month_of_name(F.col("source_file"), year).alias("月份")

    def named(df, columns):
        return df.select("source_file", *[F.col(c).alias(n) for c, n in columns.items()], month)

    return {"raw_winback": call_records(calls, year),
            "raw_agent_settlement_summary": named(settlement_summary(settled), SETTLEMENT_SUMMARY),
            "raw_agent_settlement_detail": named(settlement_detail(settled), SETTLEMENT_DETAIL)}
