"""Projections of the driver's test tables into the engine's input schemas.

These build *stand-in input only*: rows in the daily-metrics schema the
library expects.  They do none of the library's work; every operator then
runs on them through the library code.  The same projections are given as
SQL text (``F1_SQL`` ...) so the DuckDB oracle sees identical input.

F1 ``daily_metrics``  one row per supplier and ship date (from lineitem)
F2 ``daily_dense``    one row per user and day (from events)
F3 ``daily_dirty``    F1 with deterministic damage (nulls, spikes, dups, text dates)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _cnt(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier-days of ``lineitem`` as creator-days."""
    # one shuffle: the days, the running follower count and any later step per
    # creator (weeks, windows) find their rows in one partition
    li = _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("username"), F.to_date("l_shipdate").alias("date"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").repartition("username")
    qty = F.col("l_quantity").cast("long")
    # min over the slot index (its text order equals the index order): keeps the
    # aggregate hash-based instead of a sort-based string min
    slots = F.array(*[F.lit(t) for t in ("08:00", "12:30", "18:30", "21:00")])
    slot_ix = F.pmod(F.col("l_orderkey"), F.lit(4)).cast("int")
    d = li.groupBy("username", "date").agg(
        _cnt(F.col("l_returnflag") == "A").alias("posts"),
        _cnt(F.col("l_returnflag") == "R").alias("reels"),
        _cnt(F.col("l_returnflag") == "N").alias("stories"),
        _cnt(F.col("l_linenumber") == 1).alias("ads_posted"),
        F.min(slot_ix).alias("_slot"),
        F.sum(F.pmod(F.col("l_partkey"), F.lit(18)) + 4).cast("long").alias("hashtags_used"),
        F.sum(F.when(F.col("l_linestatus") == "O", qty).otherwise(0)).cast("long").alias("follows"),
        F.sum(F.when(F.col("l_linestatus") == "F", qty).otherwise(0)).cast("long").alias("unfollows"),
        F.sum(qty * 10).cast("long").alias("post_likes"),
        F.sum("l_linenumber").cast("long").alias("comments"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("long").alias("saves"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("long").alias("shares"),
        F.sum(F.floor("l_extendedprice").cast("long")).cast("long").alias("reach"),
        F.sum(F.floor(F.col("l_extendedprice") / 20).cast("long")).cast("long").alias("profile_visits"),
    )
    d = d.select(*[F.element_at(slots, F.col("_slot") + 1).alias("post_time") if c == "_slot" else F.col(c)
                   for c in d.columns])
    m = (d.withColumn("growth", F.col("follows") - F.col("unfollows"))
          .withColumn("minutes_spent", F.col("posts") * 45 + F.col("reels") * 120 + F.col("stories") * 8))
    from pyspark.sql import Window
    w = Window.partitionBy("username").orderBy("date")
    return m.select(
        "*",
        (F.lit(100000) + F.sum("growth").over(w)).cast("long").alias("followers"),
        ((F.col("post_likes") + F.col("comments") + F.col("saves") + F.col("shares"))
         / F.col("reach").cast("double")).alias("engagement_rate"),
        (F.col("follows") * 60 / F.col("minutes_spent").cast("double")).alias("roi_follows_per_hour"),
        F.when(F.col("posts") > 0, F.col("hashtags_used") / F.col("posts").cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_hashtag_count"),
    )


def daily_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user-days of ``events`` (dense January 2024)."""
    ev = _read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    et = F.col("event_type")
    return ev.groupBy(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.to_date("ts").alias("date"),
    ).agg(
        _cnt(et == "click").alias("posts"),
        _cnt(et == "purchase").alias("reels"),
        _cnt(et == "view").alias("stories"),
        _cnt(et == "signup").alias("follows"),
        _cnt(et == "error").alias("unfollows"),
        F.sum(F.when(et == "signup", 1).when(et == "error", -1).otherwise(0)).cast("long").alias("growth"),
        F.sum(F.floor(F.col("value") * 100).cast("long")).cast("long").alias("reach"),
    )


def daily_dense_with_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("username").orderBy("date")
    return daily_dense(spark, sf_dir).withColumn(
        "followers", (F.lit(1000) + F.sum("growth").over(w)).cast("long"))


def daily_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with deterministic damage keyed by ``(d + k) % p``.

    Adds ``seq`` (0 = original, 1 = later copy of a key) and replaces ``date``
    by its ``dd-MM-yyyy`` text (``'bad'`` for some rows).
    """
    f1 = daily_metrics(spark, sf_dir)
    h = (F.datediff(F.col("date"), F.lit("1995-01-01").cast("date"))
         + F.regexp_extract("username", r"(\d+)$", 1).cast("long"))

    def hit(p):
        return F.pmod(h, F.lit(p)) == 0

    dmg = f1.select(
        "username",
        F.when(hit(53), F.lit("bad")).otherwise(F.date_format("date", "dd-MM-yyyy")).alias("date"),
        F.when(hit(11), F.lit(None).cast("long"))
         .when(hit(89), F.col("followers") + 80000).otherwise(F.col("followers")).alias("followers"),
        F.when(hit(31), F.col("growth") + 50).otherwise(F.col("growth")).alias("growth"),
        "follows", "unfollows",
        F.when(hit(13), F.lit(None).cast("long"))
         .when(hit(101), F.col("posts") + 30).otherwise(F.col("posts")).alias("posts"),
        F.when(hit(37), F.lit(-1).cast("long")).otherwise(F.col("reels")).alias("reels"),
        "stories", "ads_posted",
        F.when(hit(19), F.lit(None).cast("string")).when(hit(23), F.lit("0830"))
         .when(hit(29), F.lit("08:30:00")).otherwise(F.col("post_time")).alias("post_time"),
        "hashtags_used", "avg_hashtag_count",
        F.when(hit(97), F.col("reach") * 1000).otherwise(F.col("reach")).alias("reach"),
        "profile_visits", "post_likes", "comments", "saves", "shares",
        F.when(hit(17), F.lit(None).cast("double"))
         .when(hit(103), F.col("engagement_rate") + 2).otherwise(F.col("engagement_rate")).alias("engagement_rate"),
        "minutes_spent", "roi_follows_per_hour",
        F.lit(0).alias("seq"),
        h.alias("_h"),
    )
    # the copies come from one pass over the damaged rows; a null h has none
    def copies(p, kind):
        return F.when(F.pmod(F.col("_h"), F.lit(p)) == 0, F.array(F.lit(kind))).otherwise(F.array().cast("array<int>"))

    kinds = F.concat(F.array(F.lit(0)), copies(41, 0), copies(43, 1))
    rows = dmg.drop("seq").select("*", F.explode(kinds).alias("seq"))
    return rows.select(*[(F.col("posts") + F.col("seq")).alias(c) if c == "posts" else F.col(c) for c in dmg.columns if c != "_h"])


# ---------------------------------------------------------------------------
# The same projections as SQL text (valid in DuckDB; used by oracle queries)
# ---------------------------------------------------------------------------

F1_SQL = """
SELECT *, CAST(100000 + SUM(growth) OVER (PARTITION BY username ORDER BY date) AS BIGINT) AS followers,
       (post_likes+comments+saves+shares) / CAST(reach AS DOUBLE) AS engagement_rate,
       follows*60 / CAST(minutes_spent AS DOUBLE) AS roi_follows_per_hour,
       CASE WHEN posts>0 THEN hashtags_used/CAST(posts AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS avg_hashtag_count
FROM (SELECT *, follows - unfollows AS growth,
             posts*45 + reels*120 + stories*8 AS minutes_spent FROM (
  SELECT CONCAT('supp_', CAST(l_suppkey AS VARCHAR)) AS username,
         CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS BIGINT) AS posts,
         CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS reels,
         CAST(SUM(CASE WHEN l_returnflag='N' THEN 1 ELSE 0 END) AS BIGINT) AS stories,
         CAST(SUM(CASE WHEN l_linenumber=1 THEN 1 ELSE 0 END) AS BIGINT) AS ads_posted,
         MIN(CASE MOD(l_orderkey,4) WHEN 0 THEN '08:00' WHEN 1 THEN '12:30' WHEN 2 THEN '18:30' ELSE '21:00' END) AS post_time,
         CAST(SUM(MOD(l_partkey,18)+4) AS BIGINT) AS hashtags_used,
         CAST(SUM(CASE WHEN l_linestatus='O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS follows,
         CAST(SUM(CASE WHEN l_linestatus='F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS unfollows,
         CAST(SUM(CAST(l_quantity AS BIGINT)*10) AS BIGINT) AS post_likes,
         CAST(SUM(l_linenumber) AS BIGINT) AS comments,
         CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS BIGINT) AS saves,
         CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS BIGINT) AS shares,
         CAST(SUM(CAST(FLOOR(l_extendedprice) AS BIGINT)) AS BIGINT) AS reach,
         CAST(SUM(CAST(FLOOR(l_extendedprice/20) AS BIGINT)) AS BIGINT) AS profile_visits
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) d) m
"""

F2_SQL = """
SELECT CONCAT('user_', CAST(user_id AS VARCHAR)) AS username, CAST(ts AS DATE) AS date,
       CAST(SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS BIGINT) AS posts,
       CAST(SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS reels,
       CAST(SUM(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS BIGINT) AS stories,
       CAST(SUM(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS BIGINT) AS follows,
       CAST(SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS BIGINT) AS unfollows,
       CAST(SUM(CASE WHEN event_type='signup' THEN 1 WHEN event_type='error' THEN -1 ELSE 0 END) AS BIGINT) AS growth,
       CAST(SUM(CAST(FLOOR(value*100) AS BIGINT)) AS BIGINT) AS reach
FROM events GROUP BY user_id, CAST(ts AS DATE)
"""

F2F_SQL = """
SELECT *, CAST(1000 + SUM(growth) OVER (PARTITION BY username ORDER BY date) AS BIGINT) AS followers
FROM f2
"""

F3_SQL = """
SELECT username,
  CASE WHEN h % 53 = 0 THEN 'bad' ELSE strftime(date, '%d-%m-%Y') END AS date,
  CASE WHEN h % 11 = 0 THEN NULL WHEN h % 89 = 0 THEN followers + 80000 ELSE followers END AS followers,
  CASE WHEN h % 31 = 0 THEN growth + 50 ELSE growth END AS growth,
  follows, unfollows,
  CASE WHEN h % 13 = 0 THEN NULL WHEN h % 101 = 0 THEN posts + 30 ELSE posts END AS posts,
  CASE WHEN h % 37 = 0 THEN CAST(-1 AS BIGINT) ELSE reels END AS reels,
  stories, ads_posted,
  CASE WHEN h % 19 = 0 THEN NULL WHEN h % 23 = 0 THEN '0830' WHEN h % 29 = 0 THEN '08:30:00' ELSE post_time END AS post_time,
  hashtags_used, avg_hashtag_count,
  CASE WHEN h % 97 = 0 THEN reach * 1000 ELSE reach END AS reach,
  profile_visits, post_likes, comments, saves, shares,
  CASE WHEN h % 17 = 0 THEN NULL WHEN h % 103 = 0 THEN engagement_rate + 2 ELSE engagement_rate END AS engagement_rate,
  minutes_spent, roi_follows_per_hour, 0 AS seq, h
FROM (SELECT *, CAST(date - DATE '1995-01-01' AS BIGINT)
               + CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) AS h FROM f1) x
"""

F1_COLUMNS = ["username", "date", "posts", "reels", "stories", "ads_posted", "post_time", "hashtags_used",
              "follows", "unfollows", "post_likes", "comments", "saves", "shares", "reach", "profile_visits",
              "growth", "minutes_spent", "followers", "engagement_rate", "roi_follows_per_hour",
              "avg_hashtag_count"]

F3_COLUMNS = ["username", "date", "followers", "growth", "follows", "unfollows", "posts", "reels",
              "stories", "ads_posted", "post_time", "hashtags_used", "avg_hashtag_count", "reach",
              "profile_visits", "post_likes", "comments", "saves", "shares", "engagement_rate",
              "minutes_spent", "roi_follows_per_hour", "seq"]


def _f3_union_sql() -> str:
    plain = ", ".join(F3_COLUMNS)
    keyd = ", ".join("posts + 1 AS posts" if c == "posts" else "1 AS seq" if c == "seq" else c
                     for c in F3_COLUMNS)
    return (f"SELECT {plain} FROM f3d UNION ALL SELECT {plain} FROM f3d WHERE h % 41 = 0 "
            f"UNION ALL SELECT {keyd} FROM f3d WHERE h % 43 = 0")


F3U_SQL = _f3_union_sql()


def with_ctes(body: str, *names: str) -> str:
    """Prefix an oracle query with the fixture CTEs it needs (in order)."""
    defs = {"f1": F1_SQL, "f2": F2_SQL, "f2f": F2F_SQL, "f3d": F3_SQL, "f3": F3U_SQL}
    deps = {"f2f": ["f2"], "f3d": ["f1"], "f3": ["f1", "f3d"]}
    need = []
    for n in names:
        for dep in deps.get(n, []):
            if dep not in need:
                need.append(dep)
        if n not in need:
            need.append(n)
    parts = [f"{n} AS ({defs[n]})" for n in need]
    return "WITH " + ",\n".join(parts) + "\n" + body
