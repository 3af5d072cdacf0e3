"""Customer-service analysis (AG-94…100) and conversation text analytics (TX-01…07).

Conversation text is processed row-locally with higher-order SQL functions (split /
regexp_extract_all / filter / transform), so it scales with the number of partitions and
never needs a Python worker.  Keyword heat is a single pass: each row emits the
keywords it contains (``explode`` of a filtered literal array) and one grouped count
follows — not one scan per keyword.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LBL_UNMATCHED, ratio
from ..functions.text import (HEAT_KEYWORDS, ISSUE_CATEGORIES, keyword_categories, keyword_hits, member_text,
                              parse_turns, strip_canned)
from .common import with_share
from .dedupe import latest_per

# fixed values: satisfaction words of the conversation export
NOT_RATED = "未评价"
VERY_HAPPY = "非常满意"
VERY_UNHAPPY = "非常不满意"
UNHAPPY = ("不满意", "非常不满意")
# fixed values: weekday labels, Monday first
WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")


def service_kpis(cs: DataFrame) -> DataFrame:
    """AG-94: conversations, staff, members, mean first response, mean duration, rated count/rate, very unhappy."""
    rated = F.col("rating") != NOT_RATED
    g = cs.agg(F.count(F.lit(1)).alias("conversations"), F.count_distinct("staff").alias("staff"),
               F.count_distinct("account").alias("members"),
               F.coalesce(F.avg("first_response_s"), F.lit(0.0)).alias("avg_first_response_s"),
               F.coalesce(F.avg("duration_s"), F.lit(0.0)).alias("avg_duration_s"),
               F.count_if(rated).alias("rated"), F.count_if(F.col("rating") == VERY_UNHAPPY).alias("very_unhappy"))
    return g.withColumn("rated_pct", F.coalesce(ratio(F.col("rated").cast("double"), "conversations"), F.lit(0.0)) * 100.0)


def satisfaction_dist(cs: DataFrame) -> DataFrame:
    """AG-95: conversations per rating with share %."""
    g = cs.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("conversations"))
    return with_share(g, "conversations", "share_pct", 2)


def staff_ranking(cs: DataFrame) -> DataFrame:
    """AG-96: per staff: volume, mean response / duration / turns (1dp), rated, very happy, very unhappy, [JN-03, UD-03]
    good-rate % = very happy / rated (0 -> 1) (1dp).  Every missing number becomes 0."""
    rated = F.col("rating") != NOT_RATED
    g = cs.where(F.col("staff").isNotNull()).groupBy("staff").agg(
        F.count("conversation_id").alias("volume"),
        F.round(F.coalesce(F.avg("first_response_s"), F.lit(0.0)), 1).alias("avg_first_response_s"),
        F.round(F.coalesce(F.avg("avg_response_s"), F.lit(0.0)), 1).alias("avg_response_s"),
        F.round(F.coalesce(F.avg("duration_s"), F.lit(0.0)), 1).alias("avg_duration_s"),
        F.round(F.coalesce(F.avg("turns"), F.lit(0.0)), 1).alias("avg_turns"),
        F.count_if(rated).alias("rated"),
        F.count_if(rated & (F.col("rating") == VERY_HAPPY)).alias("very_happy"),
        F.count_if(rated & (F.col("rating") == VERY_UNHAPPY)).alias("very_unhappy"))
    good = F.round(ratio(F.col("very_happy").cast("double"), F.col("rated").cast("double"), "one") * 100.0, 1)
    return g.withColumn("good_rate_pct", good).orderBy(F.col("volume").desc(), "staff")


def by_hour(cs: DataFrame) -> DataFrame:
    """AG-97: conversations per hour of day."""
    return cs.where(F.col("started_at").isNotNull()).groupBy(F.hour("started_at").alias("hour")) \
             .agg(F.count(F.lit(1)).alias("conversations"))


def by_weekday(cs: DataFrame) -> DataFrame:
    """AG-97: conversations per weekday, Monday first (weekday 0 = Monday), labelled. [SL-05]"""
    g = cs.where(F.col("started_at").isNotNull()).groupBy(F.weekday("started_at").alias("weekday")) \
          .agg(F.count(F.lit(1)).alias("conversations"))
    labels = F.array(*[F.lit(w) for w in WEEKDAYS])
    return g.withColumn("label", F.element_at(labels, F.col("weekday") + 1)).orderBy("weekday")


def top_topics(cs: DataFrame, k: int = 20) -> DataFrame:
    """AG-98: most frequent service topics."""
    return cs.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("conversations")) \
             .orderBy(F.col("conversations").desc(), "topic").limit(k)


def unhappy_cases(cs: DataFrame, unhappy: Sequence[str] = UNHAPPY) -> DataFrame:
    """AG-99: unhappy conversations newest first."""
    return cs.where(F.col("rating").isin(*unhappy)) \
             .select("conversation_id", "started_at", "account", "staff", "rating", "topic", "review", "issue") \
             .orderBy(F.col("started_at").desc(), "conversation_id")


def label_counts(df: DataFrame, c: str = "issue", exclude: Sequence[str] = (LBL_UNMATCHED, "")) -> DataFrame:
    """TX-07 / AG-99 / SO-08: frequency of labels in comma lists (trimmed, excluded labels dropped)."""
    e = df.select(F.explode(F.split(F.coalesce(F.col(c), F.lit("")), ",")).alias("label"))
    e = e.select(F.trim("label").alias("label")).where(~F.col("label").isin(*exclude))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def conversations_by_vip(cs: DataFrame, member: DataFrame) -> DataFrame:
    """AG-100 / JN-04 / WN-04: conversations by the member's latest VIP (as-of-latest lookup),
    unmatched -> '(未匹配)', with the overall match rate."""
    latest = latest_per(member, "account", ["snapshot_month", "agent"], ["vip"])
    j = cs.select("conversation_id", "account").join(latest, "account", "left")
    g = j.groupBy(F.coalesce(F.col("vip"), F.lit(LBL_UNMATCHED)).alias("vip")).agg(F.count(F.lit(1)).alias("conversations"))
    tot = g.agg(F.sum("conversations").alias("t"),
                F.sum(F.when(F.col("vip") != LBL_UNMATCHED, F.col("conversations"))).alias("m"))
    return g.crossJoin(F.broadcast(tot)).withColumn("match_rate", F.coalesce(ratio(F.col("m").cast("double"), "t"), F.lit(0.0))) \
            .drop("t", "m")


# ---------------------------------------------------------------- text analytics (TX-01…07)

def turns(cs: DataFrame) -> DataFrame:
    """TX-01: one row per parsed turn (conversation_id, pos, speaker, text)."""
    return cs.select("conversation_id", F.posexplode(parse_turns("content")).alias("pos", "turn")) \
             .select("conversation_id", (F.col("pos") + 1).alias("pos"), F.col("turn.speaker").alias("speaker"),
                     F.col("turn.text").alias("text"))


def with_member_text(cs: DataFrame) -> DataFrame:
    """TX-02: member-only text (system and serving-staff turns removed)."""
    return cs.withColumn("member_text", member_text("content", "staff"))


def turns_member_text(conv: DataFrame) -> DataFrame:
    """TX-02 for (conv, turn, role, text) tables: ordered user turns joined with a space."""
    u = conv.where(F.col("role") == "user")
    return u.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                                             lambda x: x["text"]), " ").alias("member_text"))


def with_stripped(cs: DataFrame) -> DataFrame:
    """TX-03: conversation with canned lines removed."""
    return cs.withColumn("stripped", strip_canned("content"))


def with_categories(df: DataFrame, c: str, categories=ISSUE_CATEGORIES, out: str = "categories") -> DataFrame:
    """TX-05: multi-label keyword categories of a text column."""
    return df.withColumn(out, keyword_categories(c, categories))


def keyword_heat(df: DataFrame, c: str = "member_text", keywords: Sequence[str] = HEAT_KEYWORDS,
                 k: int = 25) -> DataFrame:
    """TX-06: conversations whose text contains each keyword (literal, case-insensitive), >0, top-k."""
    e = df.select(F.explode(keyword_hits(c, keywords)).alias("keyword"))
    g = e.groupBy("keyword").agg(F.count(F.lit(1)).alias("conversations"))
    return g.orderBy(F.col("conversations").desc(), "keyword").limit(k)
