"""Reusable DuckDB SQL fragments for the oracle side of the query registry.

These restate the operator semantics in plain SQL (window / group-by form),
independent of the Spark implementation, so the comparison is meaningful.
"""

from __future__ import annotations

from ..sources.fixtures import with_ctes

WEEK_START = "CAST({d} - CAST(isodow({d}) - 1 AS INTEGER) AS DATE)"

F1_SUMS = ["posts", "reels", "stories", "ads_posted", "hashtags_used", "minutes_spent",
           "post_likes", "comments", "saves", "shares", "reach", "profile_visits",
           "growth", "follows", "unfollows"]
F1_MEANS = ["engagement_rate", "avg_hashtag_count", "roi_follows_per_hour"]
F2_SUMS = ["posts", "reels", "stories", "reach", "growth", "follows", "unfollows"]


def sdiv(n: str, d: str, default: str = "0.0") -> str:
    return (f"(CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL "
            f"WHEN ({d}) <> 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE {default} END)")


def weekly_ctes(src: str = "f1", sums=None, means=None, followers: bool = True,
                post_time: bool = True, prefix: str = "") -> str:
    """CTEs ``{p}dw`` (daily + week_start), ``{p}wk`` (AG1 + AG2)."""
    sums = F1_SUMS if sums is None else sums
    means = F1_MEANS if means is None else means
    p = prefix
    sum_sql = ",\n  ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {c}" for c in sums)
    mean_sql = "".join(f",\n  AVG({c}) AS {c}" for c in means)
    fol = ",\n  arg_max(followers, date) FILTER (WHERE followers IS NOT NULL) AS followers" if followers else ""
    parts = [
        f"{p}dw AS (SELECT *, {WEEK_START.format(d='date')} AS week_start, "
        f"posts + reels + stories AS _tot FROM {src})",
        f"{p}agg AS (SELECT username, week_start,\n  {sum_sql}{mean_sql}{fol},\n"
        f"  VAR_SAMP(_tot) AS posting_consistency_variance,\n"
        f"  CAST(SUM(CASE WHEN _tot > 0 THEN 1 ELSE 0 END) AS BIGINT) AS posting_consistency_days\n"
        f"  FROM {p}dw GROUP BY username, week_start)",
        f"{p}act AS (SELECT username, week_start, date - LAG(date) OVER (PARTITION BY username, week_start "
        f"ORDER BY date) AS gap FROM {p}dw WHERE _tot > 0)",
        f"{p}gaps AS (SELECT username, week_start, CASE WHEN COUNT(*) > 1 THEN CAST(MAX(gap) AS INTEGER) "
        f"ELSE 7 END AS max_gap_days FROM {p}act GROUP BY username, week_start)",
    ]
    pt_join = ""
    pt_col = ""
    if post_time:
        parts.append(
            f"{p}ptc AS (SELECT username, week_start, post_time, ROW_NUMBER() OVER (PARTITION BY username, "
            f"week_start ORDER BY COUNT(*) DESC, post_time) AS rn FROM {p}dw WHERE post_time IS NOT NULL "
            f"GROUP BY username, week_start, post_time)")
        pt_join = (f" LEFT JOIN (SELECT username, week_start, post_time FROM {p}ptc WHERE rn = 1) pt "
                   f"USING (username, week_start)")
        pt_col = ", pt.post_time"
    parts.append(
        f"{p}wk AS (SELECT a.*{pt_col}, CAST(a.week_start + 6 AS DATE) AS week_end, "
        f"a.posts + a.reels + a.stories AS weekly_posting_frequency, a.growth AS weekly_growth, "
        f"CAST(COALESCE(g.max_gap_days, 7) AS INTEGER) AS max_gap_days, "
        f"a.posting_consistency_days / 7.0 * (1 - LEAST(COALESCE(g.max_gap_days, 7) / 7.0, 1.0)) "
        f"AS posting_regularity_score "
        f"FROM {p}agg a LEFT JOIN {p}gaps g USING (username, week_start){pt_join})")
    return ",\n".join(parts)


def mix_cols(prefix: str = "") -> str:
    """FE1 columns over a frame with posts, reels, stories."""
    tot = "(posts + reels + stories)"
    sp, sr, ss = sdiv("posts", tot), sdiv("reels", tot), sdiv("stories", tot)
    k = f"((CASE WHEN {sp} > 0 THEN 1 ELSE 0 END) + (CASE WHEN {sr} > 0 THEN 1 ELSE 0 END) + (CASE WHEN {ss} > 0 THEN 1 ELSE 0 END))"
    h = " + ".join(f"(CASE WHEN {s} > 0 THEN -{s} * LN({s}) ELSE 0.0 END)" for s in (sp, sr, ss))
    return (f"{tot} AS total_content, {sp} AS share_posts, {sr} AS share_reels, {ss} AS share_stories, "
            f"CASE WHEN {k} <= 1 THEN 0.0 ELSE ({h}) / LN({k}) END AS content_diversity, "
            f"CASE WHEN {sp} >= {sr} AND {sp} >= {ss} THEN 'posts' WHEN {sr} >= {ss} THEN 'reels' "
            f"ELSE 'stories' END AS dominant_content_type, "
            f"CAST({sr} > 0.5 AS INTEGER) AS reels_focused")


def roi_cols() -> str:
    eng = "(post_likes + comments + saves + shares)"
    return (f"{sdiv('follows', 'minutes_spent')} AS follows_per_minute, "
            f"{sdiv(eng, 'minutes_spent')} AS engagement_per_minute, "
            f"{sdiv('follows', 'weekly_posting_frequency')} AS follows_per_post, "
            f"{sdiv(eng, 'weekly_posting_frequency')} AS engagement_per_post, "
            f"{sdiv('reach', 'weekly_posting_frequency')} AS reach_per_post, "
            f"{sdiv('follows', 'reach')} AS reach_efficiency, "
            f"{sdiv('follows', 'profile_visits')} AS profile_visit_conversion")


def weekly_feature_ctes(src: str = "f1") -> str:
    """``wk`` (AG1+AG2) -> ``wm`` (+FE1+FE2) -> ``wf`` (+FE3 roi_score)."""
    return weekly_ctes(src) + ",\n" + (
        f"wm AS (SELECT *, {mix_cols()}, {roi_cols()} FROM wk),\n"
        "wmx AS (SELECT MAX(roi_follows_per_hour) AS m1, MAX(follows_per_post) AS m2, "
        "MAX(reach_efficiency) AS m3 FROM wm),\n"
        "wf AS (SELECT wm.*, COALESCE(0.4 * roi_follows_per_hour / NULLIF(m1, 0) + 0.3 * follows_per_post / "
        "NULLIF(m2, 0) + 0.3 * reach_efficiency / NULLIF(m3, 0), 0.0) AS roi_score FROM wm, wmx)")


def q(body: str, *fixtures: str, extra: str = "", recursive: bool = False) -> str:
    """Full oracle text: fixture CTEs, extra CTEs, then the body."""
    base = with_ctes("", *fixtures).rstrip()
    if recursive:
        base = "WITH RECURSIVE" + base[len("WITH"):]
    if extra:
        base = base + ",\n" + extra
    return base + "\n" + body


def clip_sql(x: str, lo=None, hi=None) -> str:
    """NULL-keeping clip (DuckDB GREATEST/LEAST skip NULLs like Spark's)."""
    e = x
    if hi is not None:
        e = f"LEAST({hi}, {e})"
    if lo is not None:
        e = f"GREATEST({lo}, {e})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {e} END)"
