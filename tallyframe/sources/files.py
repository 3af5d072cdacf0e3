"""Landed report files: classification (CL-01…03), reads (IO-01…07) and the batch ingest job (IO-21/22).

Files are classified with Spark expressions over a file listing: the header of every file is
its first line, found without one job per file — the text source reads each split in
order, so ``min_by(value, monotonically_increasing_id())`` over the rows of the split
that starts at offset 0 is the file's first line.  The driver only sees the file -> type
list (bounded by the number of files), then builds ONE lazy plan per report type.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.exprs import LBL_UNKNOWN_ACTIVITY, clean_text, month_key, project_text, to_num, to_num_commas, to_ts, utrim
from ..operators.clean import (SKIP_EXACT, clean_payments, drop_all_zero_rows, drop_total_rows, infer_snapshot_month, modal_month,
                               type_columns, unwrap_all, with_issue_label)
from ..operators import grids as G
from ..operators.dedupe import keep_first, keep_last
from ..operators.quality import check_missing_days, check_row_drop, check_zero_metric, looks_month_aggregated
from ..session import scratch_path
from . import publish as P

# fixed values: report type by file name — (pattern, table), case-insensitive, first match wins
FILE_MAP = (
    (r"business-report", "raw_platform_report"),
    (r"finance-report", "raw_finance_report"),
    (r"game-analysis", "raw_game_analysis"),
    (r"onlineBet-report|onlinebet", "raw_realtime_bet"),
    (r"onlineRecharge|实时存取款|deposit-withdraw", "raw_realtime_deposit_withdraw"),
    (r"^top([\s\-\(.]|$)|top报表", "raw_top_report"),
    (r"会员", "raw_member_report"),
    (r"日期.+一级|推广", "raw_promotion_report"),
    (r"日期.+代理|代理报表", "raw_agent_report"),
    (r"游戏报表.*场馆|游戏报表\(场馆\)", "raw_game_report_venue"),
    (r"游戏报表(?!.*场馆)", "raw_game_report"),
)

# fixed values: payment histories and call records are known by name alone — (pattern, table)
NAME_ONLY = (
    (r"存款管理", "raw_finance_deposit"),
    (r"提款管理", "raw_finance_withdraw"),
    (r"撥打|拨打|電訪|电访", "raw_winback"),
)

# fixed values: report type by header columns — (all of these columns, one of these if any, table), first match wins
HEADER_RULES = (
    (("用户名", "个人输赢"), (), "raw_top_report"),
    (("用户名", "杀数"), (), "raw_top_report"),
    (("会员账号", "注册时间", "是否为代理"), (), "raw_member_report"),
    (("注册数", "公司输赢", "首存人数"), (), "raw_platform_report"),
    (("红利", "返水", "代理佣金"), (), "raw_finance_report"),
    (("线别", "团队名称"), (), "raw_agent_commission_team"),
    (("主线/副线", "团队名称"), (), "raw_agent_commission_team"),
    (("是否在团队",), (), "raw_agent_commission_single"),
    (("满意度评价",), (), "raw_cs_conversations"),
    (("对话内容",), (), "raw_cs_conversations"),
    (("订单号", "红利金额"), (), "raw_bonus_report"),
    (("红利标题", "申请时间"), (), "raw_bonus_report"),
    (("订单号", "订单时间", "订单状态"), (), "raw_finance_deposit"),
    (("订单号", "申请时间", "订单状态"), (), "raw_finance_withdraw"),
    (("代理帐号", "月份"), ("累计挂账额度", "发放佣金"), "raw_agent_settlement_monthly"),
    (("source_file", "sheet", "r", "c", "v"), (), "workbook_cells"),
)

# fixed values: the standard periodic reports; only these lose total rows and all-zero rows
STANDARD_REPORTS = tuple(t for _, t in FILE_MAP)

# write discipline per table: ('dates', date column) | ('snapshot', month column) | ('keys', key)
# | ('months', month column) | ('files', None)
DISCIPLINE = {
    "raw_platform_report": ("dates", "日期"), "raw_finance_report": ("dates", "时间"),
    "raw_game_analysis": ("dates", "日期"), "raw_realtime_bet": ("dates", "时间"),
    "raw_realtime_deposit_withdraw": ("dates", "时间"), "raw_promotion_report": ("dates", "日期"),
    "raw_agent_report": ("dates", "日期"), "raw_game_report_venue": ("dates", "时间"),
    "raw_game_report": ("dates", "时间"), "raw_finance_deposit": ("dates", "订单时间"),
    "raw_finance_withdraw": ("dates", "申请时间"),
    "raw_top_report": ("snapshot", "_snapshot_month"), "raw_member_report": ("snapshot", "_snapshot_month"),
    "raw_bonus_report": ("keys", "订单号"), "raw_cs_conversations": ("files", None),
    "raw_agent_commission_single": ("months", "佣金月份"), "raw_agent_commission_team": ("months", "佣金月份"),
    "raw_agent_settlement_monthly": ("months", "月份"), "raw_winback": ("months", "月份"),
    "raw_agent_settlement_summary": ("months", "月份"), "raw_agent_settlement_detail": ("months", "月份"),
}


def classify_by_name(name: Column) -> Column:
    """CL-01: ordered case-insensitive regex list over the file's base name."""
    base = F.regexp_extract(name, r"[^/]+$", 0)
    e = None
    for pat, table in FILE_MAP + NAME_ONLY:
        cond = base.rlike("(?i)" + pat)
        e = F.when(cond, F.lit(table)) if e is None else e.when(cond, F.lit(table))
    return e


def classify_by_header(header: Column) -> Column:
    """CL-02: ordered column-subset tests over the header array."""
    e = None
    for cols, one_of, table in HEADER_RULES:
        need = F.array(*[F.lit(c) for c in cols])
        cond = F.size(F.array_except(need, header)) == 0
        if one_of:
            cond = cond & F.arrays_overlap(F.array(*[F.lit(c) for c in one_of]), header)
        e = F.when(cond, F.lit(table)) if e is None else e.when(cond, F.lit(table))
    return e


def route(name: Column, header: Column) -> Column:
    """CL-03: name -> header -> 'unknown'."""
    return F.coalesce(classify_by_name(name), classify_by_header(header), F.lit("unknown"))


def file_path(place: str = "_metadata.file_path") -> Column:
    """A row's file as it is named on disk: the metadata spells blanks and some marks as %XX."""
    return F.url_decode(F.replace(F.col(place), F.lit("+"), F.lit("%2B")))


#: A comma outside quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def file_headers(spark: SparkSession, paths: Sequence[str] | str, encoding: str = "UTF-8", nested: bool = False) -> DataFrame:
    """(path, header array) for every text/CSV file, in one distributed pass; with ``nested`` those of all subfolders."""
    t = spark.read.option("encoding", encoding).option("recursiveFileLookup", nested).text(paths if isinstance(paths, str) else list(paths))
    t = t.select(F.col("_metadata.file_path").alias("place"), F.col("_metadata.file_block_start").alias("bs"),
                 "value", F.monotonically_increasing_id().alias("mid"))
    first = t.where(F.col("bs") == 0).groupBy("place").agg(F.min_by("value", "mid").alias("line"))
    first = first.select(file_path("place").alias("path"), "line")  # spelt out once a file, not once a line
    line = F.regexp_replace(F.col("line"), "^﻿", "")
    hdr = F.transform(F.split(line, COMMA), lambda x: utrim(F.regexp_replace(x, r'^="(.*)"$|^"(.*)"$', "$1$2")))
    return first.select("path", hdr.alias("header"))


def classify_files(spark: SparkSession, landing, encoding: str = "UTF-8") -> DataFrame:
    """CL-03 over a landing folder or file list: (path, report_type)."""
    h = file_headers(spark, landing, encoding)
    return h.select("path", "header", route(F.col("path"), F.col("header")).alias("report_type"))


# ---------------------------------------------------------------- reads

#: Only a missing path or a folder without any file means "no table yet"; a table that cannot be read aborts.
NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_raw(spark: SparkSession, name: str, schema: StructType | None = None, root: str | None = None) -> DataFrame:
    """IO-01: catalog table, else Parquet under ``root``, else an empty frame of ``schema``."""
    if spark.catalog.tableExists(name):
        return spark.read.table(name)
    if root:
        path = f"{root.rstrip('/')}/{name}"
        try:
            return spark.read.option("mergeSchema", "true").parquet(path).drop(P.PERIOD)
        except AnalysisException as e:
            if e.getCondition() not in NO_TABLE:
                raise
    return spark.createDataFrame([], schema or StructType([]))


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """IO-02: ad-hoc SQL; types come from the table schemas, so no post-coercion is needed."""
    return spark.sql(sql)


def read_bets(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """IO-03: one bet table partitioned by ``bet_month``; a month filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if months is None else df.where(F.col("bet_month").isin(list(months)))


#: Columns that give a landed row its place: file, first byte of its split, number in the split.
PLACE = ("_source_file", "_split", "_row")


#: Text of a line with more cells than the header (IO-04); null in all other rows.
FAULT = "_fault"


def read_report_csv(spark: SparkSession, paths, encoding: str = "UTF-8", multi_line: bool = False, faults: bool = False) -> DataFrame:
    """IO-04: all-text CSV read of files with ONE header; columns created by trailing commas dropped; ``="…"``
    unwrapped in names and cells; ``PLACE`` columns from the file metadata.

    A line with fewer cells is filled with NULL.  One with more cells that are not blank cannot be told apart into
    columns: it is left out, or, with ``faults``, kept with its text in column ``_fault`` for the caller to put aside.
    ``multi_line`` reads quoted cells with line breaks (such a file is one split)."""
    reader = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("inferSchema", False))
    names = reader.csv(paths).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, FAULT]])
    # without pruning of cells a line of another length is noticed, whichever columns are asked for
    df = reader.option("columnNameOfCorruptRecord", FAULT).option("columnPruning", False).schema(schema).csv(paths)
    cells = F.split(F.col(FAULT), COMMA)
    surplus = F.exists(F.slice(cells, len(names) + 1, F.greatest(F.size(cells), F.lit(1))), lambda c: F.trim(c) != "")
    if names:  # Spark does not read the texts of faulty lines alone, so a data column is always read with them
        surplus = surplus & (F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) >= "")
    df = df.select(*[F.col(f"`{c}`") for c in names if not (c.startswith("_c") and c[2:].isdigit())],
                   F.when(surplus, F.col(FAULT)).alias(FAULT),
                   file_path().alias("_source_file"), F.col("_metadata.file_block_start").alias("_split"),
                   F.monotonically_increasing_id().alias("_row"), F.col("_metadata.file_modification_time").alias("_file_time"))
    return unwrap_all(df) if faults else unwrap_all(df.where(F.col(FAULT).isNull()).drop(FAULT))


def read_grouped(spark: SparkSession, files: Sequence[tuple[str, Sequence[str]]], encoding: str = "UTF-8",
                 multi_line: bool = False, faults: bool = False) -> DataFrame:
    """IO-04 over (path, header) pairs: files are read by header, then united by column name, so a column
    that stands elsewhere in another file is still that column."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in files:
        groups.setdefault(tuple(header), []).append(path)
    out = None
    for paths in groups.values():
        df = read_report_csv(spark, paths, encoding, multi_line, faults)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# fixed values: the summary sheet of multi-sheet workbooks
SUMMARY_SHEET = "总表"


def read_folders(spark: SparkSession, root: str, folder: str, skip: Sequence[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """The CSV files of the subfolders of ``root`` whose path matches ``folder``, read by header and united by column name;
    ``_folder`` is what the expression's group holds.  Quoted cells may have line breaks."""
    heads = file_headers(spark, root, encoding, nested=True)
    name = F.regexp_extract("path", folder, 1)
    landed = [(r["path"], r["header"]) for r in heads.where(~name.isin(list(skip))).collect()]  # one row per file
    if not landed:
        return spark.createDataFrame([], "_source_file string, _folder string")
    df = read_grouped(spark, landed, encoding, multi_line=True).drop("_split", "_row", "_file_time")
    return df.withColumn("_folder", F.regexp_extract("_source_file", folder, 1))


def union_sheets(spark: SparkSession, root: str) -> DataFrame:
    """IO-05: sheets landed as ``sheet=<name>/`` folders -> one frame tagged ``_sheet``, by column name; summary sheet
    and fully empty rows dropped."""
    df = read_folders(spark, root, r"/sheet=([^/]+)/[^/]+$", skip=(SUMMARY_SHEET,)).drop("_source_file")
    df = df.withColumnRenamed("_folder", "_sheet")
    data = [clean_text(F.col(f"`{c}`")) for c in df.columns if c != "_sheet"]
    return df.where(F.coalesce(*data).isNotNull()) if data else df


def read_month_folders(spark: SparkSession, root: str) -> DataFrame:
    """IO-06: CSV files under ``<root>/<YYYYMM or YYYY-MM>/``, by column name, with the month from the folder and
    provenance ``<month>/<file>``."""
    df = read_folders(spark, root, r"/(\d{6}|\d{4}-\d{2})/[^/]+$")
    place = F.concat_ws("/", "_folder", F.regexp_extract("_source_file", r"[^/]+$", 0))
    month = month_key(F.nullif("_folder", F.lit("")))
    return df.withColumns({"_snapshot_month": month, "_source_file": place}).drop("_folder")


def daily_ops(tabs: DataFrame, date_col: str = "日期", tab_ord: str = "tab_ord", row_ord: str = "row_ord") -> DataFrame:
    """IO-07: union of monthly tabs -> rows with a YYYY-MM-DD date, '%' and ',' stripped to numbers,
    last row per date (latest tab, then latest row), sorted by date."""
    df = tabs.where(F.col(date_col).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}"))
    metrics = [c for c in df.columns if c not in (date_col, tab_ord, row_ord, "tab")]
    df = df.select(date_col, tab_ord, row_ord,
                   *[to_num_commas(F.regexp_replace(F.col(f"`{c}`").cast("string"), "%", "")).alias(c) for c in metrics])
    return keep_last(df, [date_col], [tab_ord, row_ord], metrics).orderBy(date_col)


# ---------------------------------------------------------------- batch ingest (IO-21 / IO-22)

@dataclass
class IngestResult:
    """A kind's line of the log: ``rows`` were written (or would be, in a dry run), of ``landed`` cleaned rows; ``faulty``
    lines were put aside; ``warnings`` are the upload checks that failed."""

    report_type: str
    files: int
    rows: int
    status: str
    landed: int = 0
    faulty: int = 0
    warnings: tuple[str, ...] = ()


# fixed values: typed columns of the commission reports
COMMISSION_NUM = ("存款金额", "提款金额", "总输赢", "场馆费", "红利", "代理冲销", "返水", "账户调整", "存款手续费基数",
                  "提款手续费基数", "存款手续费", "提款手续费", "补单输赢", "净输赢", "上月结余", "冲账调整", "冲正后净输赢",
                  "佣金调整", "佣金", "已发放佣金", "剩余佣金", "申请发放佣金", "VIP专享")
COMMISSION_PCT = ("佣金比例", "二次佣金比例")
COMMISSION_INT = ("团队人数", "下级人数", "注册人数", "首存人数", "活跃人数", "新增活跃人数", "有效活跃人数")
COMMISSION_TS = ("成为代理时间", "加入团队时间")
COMMISSION_BOOL = ("是否在团队", "是否取消代理资格", "是否为主线")
# fixed values: numeric columns of the conversation export, text columns of the agent-monthly sheet
CONVERSATION_NUM = ("首次响应", "平均响应", "总时长", "访客消息数", "客服消息数", "撤回消息数", "对话回合数")
AGENT_MONTHLY_TEXT = ("代理名称", "代理帐号", "发展情况", "开户日期", "月份", "来源栏位")
UNHAPPY = ("不满意", "非常不满意")
_OWN = (*PLACE, "_file_time", "_imported_at", "_sheet")


def _texts(df: DataFrame, but: Sequence[str] = (), text: Callable[[Column], Column] = clean_text) -> DataFrame:
    return df.withColumns({c: text(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string" and c not in but and c not in _OWN})


def clean_bonus_report(df: DataFrame) -> DataFrame:
    """CL-21 on a landed bonus report: texts, activity name, month of the application, numbers, and the
    first row of each order in file order."""
    df = _texts(df.withColumnRenamed("流水倍数(倍)", "流水倍数"), text=project_text)
    if "红利标题" in df.columns:
        note = F.col("申请备注") if "申请备注" in df.columns else F.lit(None)
        df = df.withColumn("活动名称", F.coalesce(F.col("红利标题"), note, F.lit(LBL_UNKNOWN_ACTIVITY)))
    if "申请时间" in df.columns:
        df = df.withColumn("_snapshot_month", F.date_format(to_ts("申请时间"), "yyyy-MM"))
    df = df.withColumns({c: to_num_commas(c) for c in ("红利金额", "流水倍数") if c in df.columns})
    return keep_first(df, ["订单号"], PLACE) if "订单号" in df.columns else df


def clean_conversation_report(df: DataFrame) -> DataFrame:
    """CL-22 on a landed conversation export: times, seven numbers, texts, the file's month (its most
    frequent start month, else that of its name) and the issue of unhappy conversations (TX-04)."""
    df = df.withColumns({c: to_ts(c) for c in ("开始时间", "结束时间") if c in df.columns})
    df = df.withColumns({c: to_num(c) for c in CONVERSATION_NUM if c in df.columns})
    df = _texts(df)
    if "开始时间" in df.columns:
        months = modal_month(df, "开始时间", "_source_file", "_source_file").withColumnRenamed("modal_month", "_snapshot_month")
        df = df.join(months, "_source_file", "left")
    need = {"满意度评价": "rating", "对话内容": "content", "评价内容": "review", "服务主题": "topic"}
    staged = df.withColumns({n: F.col(c) if c in df.columns else F.lit(None).cast("string") for c, n in need.items()})
    return with_issue_label(staged, UNHAPPY).withColumnRenamed("issue", "_extracted_issue").drop(*need.values())


def clean_commission_report(df: DataFrame) -> DataFrame:
    """CL-20 on a landed commission report: the fixed column sets typed, the rest text; empty rows dropped."""
    df = df.withColumnRenamed("主线/副线", "线别")
    kinds = {**dict.fromkeys(COMMISSION_NUM, "num"), **dict.fromkeys(COMMISSION_PCT, "pct"), **dict.fromkeys(COMMISSION_INT, "int"),
             **dict.fromkeys(COMMISSION_TS, "ts"), **dict.fromkeys(COMMISSION_BOOL, "bool")}
    data = [c for c in df.columns if c not in _OWN]
    return type_columns(df, {c: kinds.get(c, "text") for c in data}, drop_all_null=data)


def clean_payment_report(df: DataFrame, date_col: str) -> DataFrame:
    """CL-19 / CL-23 on a landed payment history: tabs and header units dropped, texts trimmed, the date required."""
    return clean_payments(df, date_col)


def clean_agent_monthly_report(df: DataFrame) -> DataFrame:
    """CL-24 on a landed agent-monthly sheet: rows with an agent and a month, texts trimmed, the rest numbers."""
    df = df.where(clean_text("代理帐号").isNotNull())
    month = F.coalesce(*[F.date_format(F.try_to_date(utrim("月份"), f), "yyyy-MM") for f in ("yyyy-MM", "yyyy/MM", "yyyyMM")],
                       F.date_format(to_ts("月份"), "yyyy-MM"))
    df = df.withColumn("月份", month).where(F.col("月份").isNotNull())
    return df.select(*[F.col(f"`{c}`") if c in _OWN else (clean_text(F.col(f"`{c}`")) if c in AGENT_MONTHLY_TEXT else to_num_commas(F.col(f"`{c}`"))).alias(c)
                       for c in df.columns])


def clean_report(df: DataFrame, table: str) -> DataFrame:
    """CL-04…06 and the typed cleaning of each kind (CL-20…24).  Total and all-zero rows are dropped from the
    standard periodic reports only: elsewhere a row of blanks and zeros is a record."""
    df = unwrap_all(df)
    if table in STANDARD_REPORTS:
        return drop_all_zero_rows(drop_total_rows(df), skip=(*SKIP_EXACT, *_OWN))
    if table == "raw_bonus_report":
        return clean_bonus_report(df)
    if table == "raw_cs_conversations":
        return clean_conversation_report(df)
    if table in ("raw_agent_commission_single", "raw_agent_commission_team"):
        return clean_commission_report(df)
    if table in ("raw_finance_deposit", "raw_finance_withdraw"):
        return clean_payment_report(df, DISCIPLINE[table][1])
    if table == "raw_agent_settlement_monthly":
        return clean_agent_monthly_report(df)
    return df


def publish_table(spark: SparkSession, table: str, new: DataFrame, root: str, unique: bool = False) -> tuple[str, int | None]:
    """Put ``new`` into the table by its discipline; returns the discipline and, where only some rows may be new
    to the table, how many were (else None: all are written).  ``unique``: the batch has one row a key already.

    Period disciplines read and replace only the batch's months (partitions ``_period``), after the loss
    guard (IO-17) has compared what the batch must not touch, from the period column of the staged copy; keyed and
    per-file tables only append, and keyed ones read only the ranges of keys that the batch has.
    """
    kind, col = DISCIPLINE.get(table, ("files", None))
    P.finish_pending(spark, root, table)
    path = f"{root.rstrip('/')}/{table}"
    if kind in ("keys", "files") or col not in new.columns:
        existing = read_raw(spark, table, new.schema, root)
        own = ("_split", "_row", "_file_time")
        if kind == "keys" and col in new.columns:
            fresh = new if unique else keep_first(new, [col], PLACE)
            if not existing.isEmpty():
                fresh = P.append_new_keys(fresh, P.within_key_runs(existing, fresh, col), col, unique=True)
            return kind, P.append_keyed(fresh.drop(*own), path, col)
        fresh = P.only_new_files(new, existing) if "_source_file" in existing.columns else new
        return kind, P.append_counted(fresh.drop(*own), path)
    if kind == "snapshot" and table == "raw_top_report" and not new.where(F.col(col).isNull()).isEmpty():
        raise ValueError("a TOP report needs its month in the file name")
    text = F.col(col).cast("string")
    key = P.period_of(text) if kind == "dates" else P.period_of(month_key(col))
    periods = [r["p"] for r in new.select(key.alias("p")).distinct().collect()]  # months of the batch
    try:
        existing = spark.read.option("mergeSchema", "true").parquet(path).where(F.col(P.PERIOD).isin(periods)).drop(P.PERIOD)
    except AnalysisException as e:
        if e.getCondition() not in NO_TABLE:
            raise
        existing = spark.createDataFrame([], new.drop("_split", "_row", "_file_time").schema)
    if kind == "dates":
        new = new.drop("_split", "_row", "_file_time")
        combined, touched = P.replace_by_dates(new, existing, col), P.touched_days(new, col)
        guard = F.substring(text, 1, 10)
    elif kind == "snapshot":
        keys = ("会员账号", "代理") if "会员账号" in new.columns else ()  # without an account the month is replaced whole
        merged = P.merge_snapshot(new, existing, col, keys, PLACE)
        combined, touched = merged.drop("_split", "_row", "_file_time"), new.select(month_key(col).alias("k")).distinct()
        guard = month_key(col)
    else:
        combined = P.refresh_months(new.drop("_split", "_row", "_file_time"), existing, col)
        touched, guard = new.select(month_key(col).alias("k")).where("k IS NOT NULL").distinct(), month_key(col)
    if kind == "months" or kind == "dates":  # rows without a period are added to those there are
        touched = touched.unionByName(spark.createDataFrame([(None,), ("",), ("nan",), ("None",)], "k string"))
    before = existing.withColumn("__p", guard)
    P.publish_partitions(combined.withColumn(P.PERIOD, key), root, table,
                         lambda copy: P.assert_untouched(before, copy.withColumn("__p", guard), "__p", touched))
    return kind, None


# fixed values: the key metrics of the periodic reports, by table
ZERO_METRICS = {"raw_platform_report": ("注册数", "公司输赢", "首存人数"), "raw_top_report": ("有效投注额", "个人输赢")}


def upload_checks(spark: SparkSession, table: str, new: DataFrame, root: str | None) -> list[str]:
    """AG-130…133 on a cleaned upload of a table that is replaced by days: what a person should look at before they trust it.
    The batch is compared with the rows that the table holds for the same days."""
    kind, date = DISCIPLINE.get(table, ("files", None))
    if kind != "dates" or date not in new.columns:
        return []
    day = F.substring(F.col(date).cast("string"), 1, 10)
    out = []
    if looks_month_aggregated(new, date).first()["month_aggregated"]:
        out.append("AG-133: dates are whole months")
    gaps = check_missing_days(new.where(day.rlike(r"^\d{4}-\d{2}-\d{2}$")).select(F.try_to_date(day, "yyyy-MM-dd").alias("d")), "d").first()
    if gaps["missing_days"]:
        out.append(f"AG-131: {gaps['missing_days']} days without rows, first {', '.join(gaps['first_missing'])}")
    metric = check_zero_metric(new, ZERO_METRICS.get(table, ())).first()
    if metric["all_zero"]:
        out.append(f"AG-132: {metric['metric']} is zero everywhere")
    if root:
        span = new.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
        months = sorted({p["p"] for p in new.select(P.period_of(day).alias("p")).distinct().collect()})  # calendar-bounded
        try:
            held = spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/{table}").where(F.col(P.PERIOD).isin(months))
        except AnalysisException as e:
            if e.getCondition() not in NO_TABLE:
                raise
            return out
        drop = check_row_drop(new, held.where(day.between(span["lo"], span["hi"]))).first()
        if drop["warn"]:
            out.append(f"AG-130: {drop['new_rows']} rows for days that hold {drop['existing_rows']}")
    return out


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: what follows scans columns instead of working it out again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_aside(faults: DataFrame, root: str, table: str) -> None:
    """IO-04: the lines that could not be read, with their file, under ``_quarantine``; a file's lines once."""
    path = f"{root.rstrip('/')}/_quarantine/{table}"
    try:
        faults = P.only_new_files(faults, faults.sparkSession.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() not in NO_TABLE:
            raise
    P.append_evolving(faults, path)


# fixed values: the year of a call or settlement workbook whose dates and name tell a month but no year
WORKBOOK_YEAR = 2026


def read_cells(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed cell lists -> (cells, lines without a workbook or a place in a sheet)."""
    whole = F.col("source_file").isNotNull() & F.col("r").try_cast("int").isNotNull() & F.col("c").try_cast("int").isNotNull()
    cells = df.where(whole).select("source_file", F.coalesce("sheet", F.lit("")).alias("sheet"), F.col("r").try_cast("int").alias("r"),
                                   F.col("c").try_cast("int").alias("c"), "v")
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in ("source_file", "sheet", "r", "c", "v")])
    return cells, df.where(~whole).select("_source_file", line.alias("line"), F.col("_split").alias("split"), F.col("_row").alias("place"))


def ingest_workbooks(spark: SparkSession, cells: DataFrame, root: str | None, dry_run: bool = False,
                     year: int | None = WORKBOOK_YEAR) -> list[IngestResult]:
    """IO-21 for workbooks as ``cells(source_file, sheet, r, c, v)``: call records and settlements are told apart, parsed
    (CL-25…27) and published by month (IO-14); of workbooks with one month the last by name stands.  A workbook whose
    month nothing tells is not written; both it and an unknown one get a line of the log.  One table's failure does
    not keep the others out: its line says so."""
    base = scratch_path(spark, f"workbooks/{uuid.uuid4().hex}")

    def kept(df: DataFrame, name: str) -> DataFrame:
        return staged(df, f"{base}/{name}")

    # the cell lists are parsed once; header and sheet filters then reach a columnar scan, and each table is built once
    cells = kept(cells, "cells")
    kinds = kept(G.workbook_kinds(cells), "kinds")
    found = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    log = [IngestResult("workbook", found["unknown"], 0, "skipped: unrecognised")] if "unknown" in found else []
    for table, rows in G.workbook_tables(cells, kinds, year).items():
        if ("calls" if table == "raw_winback" else "settlement") not in found:
            continue
        try:
            rows = kept(rows, table)
            dated = rows.where(F.col("月份").isNotNull())
            df = P.stamp(G.last_workbook(dated).withColumnRenamed("source_file", "_source_file"))
            lost = rows.where(F.col("月份").isNull()).agg(F.count_distinct("source_file")).first()[0]
            n, files = df.agg(F.count(F.lit(1)), F.count_distinct("_source_file")).first()
            warnings = (f"no month found for {lost} workbooks",) if lost else ()
            if dry_run or root is None:
                log.append(IngestResult(table, files, n, "dry run", n, 0, warnings))
            elif not n:
                log.append(IngestResult(table, files, 0, "skipped: no rows", 0, 0, warnings))
            else:
                kind, _ = publish_table(spark, table, df, root)
                log.append(IngestResult(table, files, n, f"written ({kind})", n, 0, warnings))
        except Exception as e:  # noqa: BLE001 — reported in the log, and raised by the caller if it repeats failures
            log.append(IngestResult(table, 0, 0, f"failed: {str(e).splitlines()[0][:200]}"))
    P.remove(spark, base)
    return log


def ingest_batch(spark: SparkSession, landing: str, root: str | None, dry_run: bool = False,
                 encoding: str = "UTF-8") -> DataFrame:
    """IO-21 / IO-22: classify every landed file, clean each report type in one plan, then (unless
    ``dry_run``) publish it by its discipline.  One failing report type does not stop the others.
    Returns the log (report_type, files, rows written, status, landed, faulty, warnings)."""
    return ingest_files(spark, landing, root, dry_run, encoding)


def ingest_files(spark: SparkSession, paths, root: str | None, dry_run: bool = False,
                 encoding: str = "UTF-8", raise_failures: bool = False) -> DataFrame:
    """IO-21 over an explicit file list (used by the file-drop stream, ST-01).

    With ``raise_failures`` the job fails, after all other kinds are done, if one kind failed: the caller
    repeats the whole list, which is safe since every discipline takes the same files twice as once.

    The files of a kind are parsed once and cleaned once, into columnar scratch copies that every count, check and
    write scans."""
    files = classify_files(spark, paths, encoding)
    plan: dict[str, list[tuple[str, list[str]]]] = {}
    for r in files.select("path", "report_type", "header").collect():  # one row per file, not per record
        plan.setdefault(r["report_type"], []).append((r["path"], r["header"]))
    log, broken = [], []
    for rtype, landed in sorted(plan.items()):
        if rtype == "unknown":
            log.append(IngestResult(rtype, len(landed), 0, "skipped: unrecognised"))
            continue
        base = scratch_path(spark, f"ingest/{uuid.uuid4().hex}")
        kind = DISCIPLINE.get(rtype, ("files", None))[0]
        try:
            read = staged(read_grouped(spark, landed, encoding, rtype in ("raw_cs_conversations", "workbook_cells"), faults=True), f"{base}/landed")
            faults = read.where(F.col(FAULT).isNotNull()).select("_source_file", F.col(FAULT).alias("line"), F.col("_split").alias("split"),
                                                                 F.col("_row").alias("place"))
            if rtype == "workbook_cells":
                cells, placeless = read_cells(read.where(F.col(FAULT).isNull()))
                faults = faults.unionByName(placeless)
            faulty = faults.count()
            if rtype == "workbook_cells":
                done = ingest_workbooks(spark, cells, root, dry_run)
                if faulty and root and not dry_run:
                    put_aside(faults, root, rtype)
                log += [IngestResult(rtype, len(landed), 0, "read", 0, faulty), *done]
                broken += [(x.report_type, RuntimeError(x.status)) for x in done if x.status.startswith("failed")]
                continue
            df = P.stamp(clean_report(read.where(F.col(FAULT).isNull()).drop(FAULT), rtype))
            if kind == "snapshot" and "_snapshot_month" not in df.columns:
                top = rtype == "raw_top_report"
                df = infer_snapshot_month(df, reg_col="注册时间" if "注册时间" in df.columns else None,
                                          mtime_col=None if top else "_file_time", top_report=top)
            df = staged(df, f"{base}/clean")
            n = df.count()
            warnings = tuple(upload_checks(spark, rtype, df, root))
            if dry_run or root is None:
                log.append(IngestResult(rtype, len(landed), n, "dry run", n, faulty, warnings))
            else:
                kind, fresh = publish_table(spark, rtype, df, root, unique=rtype == "raw_bonus_report")
                if faulty:
                    put_aside(faults, root, rtype)
                status = f"written ({kind})" if fresh is None or fresh == n else f"skipped: already loaded ({kind})" if not fresh else f"written in part ({kind})"
                log.append(IngestResult(rtype, len(landed), n if fresh is None else fresh, status, n, faulty, warnings))
        except Exception as e:  # noqa: BLE001 — one kind's failure does not keep the others out; it is reported below
            log.append(IngestResult(rtype, len(landed), 0, f"failed: {str(e).splitlines()[0][:200]}"))
            broken.append((rtype, e))
        finally:
            P.remove(spark, base)
    if broken and raise_failures:
        raise RuntimeError(f"ingest failed for {', '.join(t for t, _ in broken)}") from broken[0][1]
    return spark.createDataFrame([astuple(x) for x in log], "report_type string, files int, rows long, status string, "
                                 "landed long, faulty long, warnings array<string>")
