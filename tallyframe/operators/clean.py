"""Cleaning and projection operators on landed report frames (CL-04…08, CL-12…24, CL-29).

Bronze report frames arrive all-string; these functions produce typed silver frames with
column expressions only (higher-order array functions for the row-wise rules), so each
stays one narrow projection/filter stage.  Per-file decisions (snapshot month, modal month)
are grouped aggregates over ``source_file`` — never a driver loop with one job per file.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (LBL_UNKNOWN_ACTIVITY, LBL_UNMATCHED, clean_text, col, month_key, pct_to_fraction, project_text,
                               slot_date, slot_hour, slot_label, to_num, to_num_commas, to_ts, unwrap_eq, utrim, yes_no)
from ..functions.text import issue_label
from .dedupe import keep_first, keep_last

# fixed values: words marking a summary row in exported reports
TOTAL_WORDS = ("总计", "合计", "小计")

# fixed values: identity / text columns skipped by the all-zero row test
SKIP_EXACT = (
    "日期", "时间", "代理ID", "代理编号", "代理名称", "代理类型",
    "会员账号", "注册时间", "用户名", "站点名称", "场馆名称",
    "游戏类型", "游戏名称", "注册来源", "注册网址", "区号", "地区名称",
    "用户标签", "会员状态", "用户来源", "是否为代理", "VIP等级",
    "推广渠道", "一级", "二级", "三级", "四级",
    "_snapshot_month", "_snapshot_date", "_imported_at", "_source_file",
)
# fixed values: cell texts counted as a blank (0) by the all-zero row test
BLANK_WORDS = ("", "None", "nan", "null")
# fixed values: a row with unit agents > 0 is never dropped as empty
PRESERVE_COL = "单元代理人数"


def unwrap_all(df: DataFrame) -> DataFrame:
    """CL-04: unwrap ``="…"`` in every string cell and in the column names."""
    out = []
    for c, t in df.dtypes:
        name = re.sub(r'^="(.*)"$', r"\1", c)
        out.append((unwrap_eq(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(name))
    return df.select(*out)


def drop_total_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CL-05: drop rows where any cell, trimmed, is a total word (plain OR of scalar tests: stays in codegen). [UD-01]"""
    cols = list(cols) if cols is not None else [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.trim(F.col(f"`{c}`").cast("string")).isin(*TOTAL_WORDS), F.lit(False))
    return df.where(~hit)


def drop_all_zero_rows(df: DataFrame, skip: Sequence[str] = SKIP_EXACT, preserve: str | None = PRESERVE_COL,
                       literal_nan: bool = False) -> DataFrame:
    """CL-06: drop rows whose checked values are all zero. [UD-01]

    Checked columns = every column not in ``skip``.  Blank/NULL counts as 0, non-numeric
    text is ignored; at least one checked value must exist.  Rows with ``preserve`` > 0 are
    kept.  ``literal_nan=True`` reproduces the source defect where a NULL cell made a row
    "not all zero".  Built from scalar expressions only (no array lambdas) so it stays in
    whole-stage codegen.
    """
    checked = [c for c in df.columns if c not in set(skip)]
    if not checked:
        return df

    def v(c):
        s = F.col(f"`{c}`").cast("string")
        blank = s.isNull() | F.trim(s).isin(*BLANK_WORDS)
        num = F.translate(F.trim(s), ",，", "").try_cast("double")  # non-numeric -> NULL (ignored); NaN stays NaN (not zero)
        if literal_nan:
            return F.when(s.isNull(), F.lit(1.0)).when(blank, F.lit(0.0)).otherwise(num)
        return F.when(blank, F.lit(0.0)).otherwise(num)

    # every value referenced once: greatest() skips NULLs (ignored cells) and orders NaN above all,
    # so "max |v| == 0" <=> at least one checked value and all of them zero
    vals = [F.abs(v(c)) for c in checked]
    mx = F.greatest(*vals) if len(vals) > 1 else vals[0]
    empty = F.coalesce(mx == 0, F.lit(False))
    if preserve and preserve in df.columns:
        keep_anyway = F.coalesce(to_num(F.col(f"`{preserve}`")), F.lit(0.0)) > 0
        empty = empty & ~keep_anyway
    return df.where(~empty)


def coerce_numeric(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """CL-07: every column not declared text -> double (unparsable -> NULL)."""
    keep = set(text_cols)
    return df.select(*[(F.col(f"`{c}`") if c in keep else to_num(F.col(f"`{c}`")).alias(c)) for c in df.columns])


def clean_text_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CL-08 on a set of columns."""
    return df.withColumns({c: clean_text(c) for c in cols if c in df.columns})


def activity_name(title="title", note="note") -> "F.Column":
    """CL-18: bonus title, else application note, else '未知'."""
    return F.coalesce(F.nullif(clean_text(title), F.lit("")), clean_text(note), F.lit(LBL_UNKNOWN_ACTIVITY))


# fixed values: header renames applied to landed reports
RENAMES = {"流水倍数(倍)": "流水倍数", "主线/副线": "线别"}
UNIT_RE = r"[（(\[].*?[）)\]]"


def rename_cols(df: DataFrame, renames: Mapping[str, str] = RENAMES, strip_units: bool = True) -> DataFrame:
    """CL-19: fixed renames, bracketed unit suffixes stripped from headers, tabs removed from cells."""
    out = []
    for c, t in df.dtypes:
        name = renames.get(c, c)
        if strip_units:
            name = re.sub(UNIT_RE, "", name).strip() or name
        e = F.col(f"`{c}`")
        if t == "string":
            e = F.translate(e, "\t", "")
        out.append(e.alias(name))
    return df.select(*out)


def type_columns(df: DataFrame, spec: Mapping[str, str], drop_all_null: Sequence[str] | None = None) -> DataFrame:
    """CL-20: dict-driven typing: 'num' (commas, '-' -> NULL), 'pct', 'int', 'bool', 'ts', 'text'. [UD-07]

    Rows where every ``drop_all_null`` column is NULL after typing are dropped.
    """
    conv = {
        "num": lambda c: to_num_commas(F.when(utrim(c) == "-", F.lit(None)).otherwise(col(c))),
        "pct": pct_to_fraction,
        "int": lambda c: to_num_commas(c).cast("bigint"),
        "bool": yes_no,
        "ts": to_ts,
        "text": clean_text,
    }
    out = [conv[spec[c]](F.col(f"`{c}`")).alias(c) if c in spec else F.col(f"`{c}`") for c in df.columns]
    typed = df.select(*out)
    if drop_all_null:
        present = [c for c in drop_all_null if c in typed.columns]
        if present:
            typed = typed.dropna(how="all", subset=present)
    return typed


def with_snapshot_month(df: DataFrame, month_col: str = "_snapshot_month", date_col: str = "_snapshot_date",
                        out: str = "snapshot_month") -> DataFrame:
    """CL-12: canonical snapshot month from the month text, else the snapshot date."""
    m = month_key(month_col) if month_col in df.columns else None
    d = F.date_format(F.to_date(col(date_col)), "yyyy-MM") if date_col in df.columns else None
    parts = [p for p in (m, d) if p is not None]
    return df.withColumn(out, F.coalesce(*parts) if parts else F.lit(None).cast("string"))


def infer_snapshot_month(df: DataFrame, file_col: str = "_source_file", reg_col: str | None = "registered_at",
                         mtime_col: str | None = None, top_report: bool = False) -> DataFrame:
    """CL-13: per file: month in the name (20YY[-_]?MM; TOP reports: first 6 digits) ->
    month of max(register time) -> month of the file modification time.  Adds
    ``_snapshot_month`` (YYYY-MM) and ``_snapshot_date`` (first of month)."""
    name = F.regexp_extract(col(file_col), r"[^/]+$", 0)
    if top_report:
        pattern = r"(\d{4})(0[1-9]|1[0-2])"
    else:
        pattern = r"(20\d{2})[-_]?(0[1-9]|1[0-2])"
    y, m = (F.regexp_extract(name, pattern, k) for k in (1, 2))
    from_name = F.when(y != "", F.concat(y, F.lit("-"), m))
    aggs = [F.first(from_name).alias("__from_name")]
    if reg_col and reg_col in df.columns:
        aggs.append(F.date_format(F.max(to_ts(col(reg_col))), "yyyy-MM").alias("__from_reg"))
    if mtime_col and mtime_col in df.columns:
        aggs.append(F.date_format(F.max(col(mtime_col)), "yyyy-MM").alias("__from_mtime"))
    per_file = df.groupBy(file_col).agg(*aggs)
    month = F.coalesce(*[F.col(a) for a in ("__from_name", "__from_reg", "__from_mtime") if a in per_file.columns])
    per_file = per_file.select(file_col, month.alias("_snapshot_month"))
    out = df.drop("_snapshot_month", "_snapshot_date").join(per_file, file_col, "left")
    return out.withColumn("_snapshot_date", F.try_to_date(F.concat(F.col("_snapshot_month"), F.lit("-01")), "yyyy-MM-dd"))


def modal_month(df: DataFrame, ts_col: str, group_col: str | None = None, fallback_col: str | None = None) -> DataFrame:
    """CL-14: most frequent month of a timestamp (smallest month on a tie), per group. [UD-04]

    Falls back to a month in ``fallback_col`` (e.g. the file name) when no timestamp parses.
    """
    keys = [group_col] if group_col else []
    m = F.date_format(col(ts_col), "yyyy-MM")
    cnt = df.where(m.isNotNull()).groupBy(*keys, m.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    best = cnt.groupBy(*keys).agg(F.max_by("month", F.struct(F.col("n"), -F.unix_date(F.to_date(F.concat("month", F.lit("-01"))))))
                                   .alias("modal_month"))
    if fallback_col and group_col:
        y, mm = (F.regexp_extract(col(fallback_col), r"(20\d{2})\D?([01]\d)", k) for k in (1, 2))
        fb = df.groupBy(group_col).agg(F.min(F.when(y != "", F.concat(y, F.lit("-"), mm))).alias("__fb"))
        best = fb.join(best, group_col, "left").select(group_col, F.coalesce("modal_month", "__fb").alias("modal_month"))
    return best


def vote_month(df: DataFrame, date_col: str, group_col: str | None = None) -> DataFrame:
    """CL-15: majority month of call dates (YYYY-M, YYYY/M, YYYY年M); smallest month on ties."""
    from ..functions.exprs import vote_month_token
    keys = [group_col] if group_col else []
    tok = vote_month_token(date_col)
    cnt = df.where(tok.isNotNull()).groupBy(*keys, tok.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return cnt.groupBy(*keys).agg(F.min_by("month", F.struct(-F.col("n"), F.col("month"))).alias("month"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """CL-17: keep the first row per key by an explicit order (file, row ordinal, ...)."""
    return keep_first(df, keys, order)


# ---------------------------------------------------------------- composite cleaning pipelines

def clean_bonus(df: DataFrame) -> DataFrame:
    """CL-21: bonus grants: unwrap, trim/blank->NULL text, activity name, numerics, month from apply time,
    dedupe on order number keeping the first by (applied_at, order_no)."""
    text = ["order_no", "account", "vip", "type", "title", "note", "status", "needs_wagering"]
    d = df
    for c in text:
        if c in d.columns:
            d = d.withColumn(c, project_text(unwrap_eq(c)))  # no filter passes the ranking below
    d = d.withColumn("activity", activity_name("title", "note"))
    for c in ("amount", "wager_multiple"):
        if c in d.columns and dict(d.dtypes)[c] == "string":
            d = d.withColumn(c, to_num_commas(c))
    if dict(d.dtypes).get("applied_at") == "string":
        d = d.withColumn("applied_at", to_ts("applied_at"))
    d = d.withColumn("bonus_month", F.date_format("applied_at", "yyyy-MM"))
    order = [c for c in ("applied_at", "account", "amount", "wager_multiple", "status", "needs_wagering", "vip",
                         "type", "title", "note") if c in d.columns]
    return keep_first(d, ["order_no"], order)


# fixed values: rating words of the conversation export
UNHAPPY_RATINGS = ("不满意", "非常不满意")


def clean_conversations(df: DataFrame, unhappy_ratings: Sequence[str] = UNHAPPY_RATINGS) -> DataFrame:
    """CL-22: typed conversations with month and the extracted issue label (TX-04)."""
    d = df
    for c in ("started_at", "ended_at"):
        if dict(d.dtypes).get(c) == "string":
            d = d.withColumn(c, to_ts(c))
    for c in ("first_response_s", "avg_response_s", "duration_s", "turns"):
        if dict(d.dtypes).get(c) == "string":
            d = d.withColumn(c, to_num(c))
    d = d.withColumn("snapshot_month", F.date_format("started_at", "yyyy-MM"))
    return with_issue_label(d, unhappy_ratings)


def with_issue_label(df: DataFrame, unhappy_ratings: Sequence[str] = UNHAPPY_RATINGS) -> DataFrame:
    """TX-04 staged as columns: the de-templated conversation and the two category strings are
    projected once, so the keyword tests never re-run the canned-line filter per keyword."""
    from ..functions.text import blank_to_null, keyword_categories, strip_canned
    d = df.withColumn("__content", blank_to_null("content")).withColumn("__review", blank_to_null("review")) \
          .withColumn("__topic", blank_to_null("topic"))
    d = d.withColumn("__stripped", strip_canned("__content"))
    d = d.withColumn("__rcats", keyword_categories("__review")).withColumn("__ccats", keyword_categories("__stripped"))
    label = (F.when(F.col("__topic").isNotNull(), F.col("__topic"))
             .when(F.col("__review").isNotNull(), F.col("__rcats"))
             .when(F.col("__content").isNotNull() & (F.trim("__stripped") != ""), F.col("__ccats"))
             .otherwise(F.lit(LBL_UNMATCHED)))
    out = d.withColumn("issue", F.when(F.col("rating").isin(*unhappy_ratings), label).otherwise(F.lit("")))
    return out.drop("__content", "__review", "__topic", "__stripped", "__rcats", "__ccats")


def clean_payments(df: DataFrame, date_col: str) -> DataFrame:
    """CL-23: payment orders: tabs/blank stripped, header units removed, date column required."""
    d = rename_cols(df)
    if date_col not in d.columns:
        raise ValueError(f"payment file without {date_col}")
    return d.withColumns({c: clean_text(c) for c, t in d.dtypes if t == "string"})


AGENT_MONTHLY_TEXT = ("month", "agent_name", "agent_account", "development", "opened_on", "source_field")


def clean_agent_monthly(df: DataFrame, text_cols: Sequence[str] = AGENT_MONTHLY_TEXT) -> DataFrame:
    """CL-24: non-blank agent, parseable month -> YYYY-MM, text columns trimmed, the rest numeric."""
    d = df.where(clean_text("agent_account").isNotNull())
    mth = F.coalesce(F.date_format(F.try_to_date(utrim("month"), "yyyy-MM"), "yyyy-MM"),
                     F.date_format(F.try_to_date(utrim("month"), "yyyy/MM"), "yyyy-MM"),
                     F.date_format(to_ts("month"), "yyyy-MM"), month_key("month"))
    d = d.withColumn("month", mth).where(F.col("month").rlike(r"^\d{4}-\d{2}$"))
    return d.select(*[(clean_text(c).alias(c) if c in text_cols else
                       (to_num_commas(c).alias(c) if t == "string" else F.col(c))) for c, t in d.dtypes])


def parse_slot(df: DataFrame, raw: str = "raw_time") -> DataFrame:
    """CL-29: (day, slot, hour) from an hour-slot text."""
    return df.withColumns({"day": slot_date(raw), "slot": slot_label(raw)}).withColumn("hour", slot_hour("slot"))


def with_issue(df: DataFrame) -> DataFrame:
    return clean_conversations(df)


__all__ = [n for n in dir() if not n.startswith("_")] + ["keep_last"]
