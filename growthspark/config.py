"""Fixed values of the engine.

Everything in the block marked FIXED VALUES must equal what the reference
library uses (column lists, thresholds, defaults, bounds, weights); it is
stated plainly and in the reference's natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's for the same results)
# ---------------------------------------------------------------------------

# canonical daily schema: counts, rates, text
INT_COLUMNS = [
    "followers", "growth", "follows", "unfollows", "posts", "stories", "reels",
    "ads_posted", "hashtags_used", "reach", "profile_visits", "post_likes",
    "reel_plays", "reel_engagement", "story_reach", "story_engagement",
    "comments", "saves", "shares", "minutes_spent",
]
FLOAT_COLUMNS = [
    "avg_hashtag_count", "engagement_rate", "share_posts", "share_reels",
    "share_stories", "post_consistency_variance_7d", "roi_follows_per_hour",
]
STRING_COLUMNS = ["username", "post_time"]

# raw-data checks
REQUIRED_RAW_COLUMNS = [
    "username", "date", "followers", "growth", "posts", "reels", "stories",
    "engagement_rate", "reach", "post_likes", "comments", "saves", "shares",
]
RAW_TYPE_CHECKS = {
    "followers": "int", "growth": "int", "posts": "int", "reels": "int",
    "stories": "int", "reach": "int", "engagement_rate": "float",
}
NEGATIVE_CHECK_COLUMNS = ["followers", "posts", "reels", "stories", "reach", "post_likes"]
MAX_DATE_GAP_DAYS = 7

DATA_QUALITY_THRESHOLDS = {
    "max_missing_percentage": 0.05,
    "min_data_points": 90,
    "outlier_std_threshold": 3.0,
    "engagement_rate_max": 0.50,
    "followers_growth_max": 10000,
}

# missing-value strategies
FORWARD_FILL_COLUMNS = ["followers"]
ZERO_FILL_COLUMNS = [
    "posts", "stories", "reels", "ads_posted", "hashtags_used",
    "post_likes", "reel_plays", "reel_engagement", "story_reach",
    "story_engagement", "comments", "saves", "shares", "growth",
    "follows", "unfollows", "reach", "profile_visits", "minutes_spent",
]
MEAN_FILL_COLUMNS = [
    "engagement_rate", "avg_hashtag_count", "roi_follows_per_hour",
    "share_posts", "share_reels", "share_stories",
]
MODE_FILL_COLUMNS = ["post_time", "username"]
INTERPOLATE_COLUMNS = ["post_consistency_variance_7d"]

# outliers
OUTLIER_COLUMNS = [
    "followers", "growth", "follows", "unfollows", "reach", "profile_visits",
    "post_likes", "reel_plays", "reel_engagement", "story_reach",
    "story_engagement", "comments", "saves", "shares", "hashtags_used",
    "minutes_spent", "roi_follows_per_hour",
]
NON_NEGATIVE_CAP_COLUMNS = ["followers", "posts", "reels", "stories", "reach", "post_likes"]
LOG_TRANSFORM_COLUMNS = ["followers", "reach", "reel_plays"]

# range repair (column, low, high); None = unbounded
RANGE_CONSTRAINTS = [
    ("engagement_rate", 0.0, 0.5),
    ("share_posts", 0.0, 1.0),
    ("share_reels", 0.0, 1.0),
    ("share_stories", 0.0, 1.0),
    ("avg_hashtag_count", 0.0, 30.0),
    ("roi_follows_per_hour", 0.0, None),
    ("followers", 0, None),
    ("posts", 0, 20),
    ("reels", 0, 10),
    ("stories", 0, 50),
]
SHARE_COLUMNS = ["share_posts", "share_reels", "share_stories"]
SHARE_SUM_TOLERANCE = 0.01
GROWTH_CONSISTENCY_TOLERANCE = 10
RATE_CONSISTENCY_TOLERANCE = 0.1
FOLLOWER_JUMP_LIMIT = 50000
FOLLOWER_JUMP_MAX_CHANGE = 10000
FOLLOWER_JUMP_MAX_FRACTION = 0.1

# specialised cleaning
ENGAGEMENT_CLEAN_COLUMNS = [
    "post_likes", "reel_engagement", "story_engagement",
    "comments", "saves", "shares", "engagement_rate",
]
POSTING_CAPS = [("posts", 10), ("reels", 5), ("stories", 20), ("ads_posted", 5)]
DEFAULT_POST_TIME = "12:00"
CRITICAL_COLUMNS = ["date", "followers", "posts", "engagement_rate"]

# weekly aggregation
WEEKLY_SUM_COLUMNS = [
    "posts", "reels", "stories", "ads_posted", "hashtags_used", "minutes_spent",
    "post_likes", "reel_plays", "reel_engagement", "story_reach", "story_engagement",
    "comments", "saves", "shares", "reach", "profile_visits",
    "growth", "follows", "unfollows",
]
WEEKLY_MEAN_COLUMNS = ["engagement_rate", "avg_hashtag_count", "roi_follows_per_hour"]
CONTENT_TYPES = ["posts", "reels", "stories"]

# daily rolling features: column -> aggregations over 7 rows
DAILY_ROLLING_FEATURES = [
    ("daily_posting_frequency", ["mean", "std", "sum"]),
    ("engagement_rate", ["mean", "std"]),
    ("growth", ["mean", "sum"]),
    ("followers", ["mean"]),
    ("reach", ["sum", "mean"]),
]

# engagement quality weights
ENGAGEMENT_WEIGHTS = [("saves", 3.0), ("shares", 2.5), ("comments", 2.0), ("post_likes", 1.0)]
# audience quality weights: visit conversion, reach to visit, overall conversion
AUDIENCE_WEIGHTS = (0.4, 0.3, 0.3)
# roi score weights: roi per hour, follows per post, reach efficiency
ROI_SCORE_WEIGHTS = (0.4, 0.3, 0.3)
POSTING_TIER_BINS = [0, 3, 7, 14, float("inf")]
POSTING_TIER_LABELS = ["Low", "Medium", "High", "Very High"]
ENGAGEMENT_TIER_BINS = [0, 0.02, 0.05, 0.10, float("inf")]
ENGAGEMENT_TIER_LABELS = ["Low", "Medium", "High", "Exceptional"]

# calendar flags
HOLIDAY_MONTHS = [11, 12, 1]
SUMMER_MONTHS = [6, 7, 8]
BACK_TO_SCHOOL_MONTHS = [8, 9]

# generator-derived daily columns
OPTIMAL_POST_TIMES = ["08:00", "18:30", "21:00"]
MINUTES_PER_CONTENT = [("posts", 45), ("reels", 120), ("stories", 8)]
SATURATION_MIN_CONTENT = 5
SATURATION_MAX_RATE = 0.05

# model
FEATURE_CANDIDATES = [
    "weekly_posting_frequency", "share_posts", "share_reels", "share_stories",
    "engagement_rate", "avg_hashtag_count", "post_consistency_variance_7d",
    "posted_in_optimal_window", "roi_follows_per_hour", "minutes_spent",
    "month", "quarter", "saturation_flag",
]
TARGET_CANDIDATES = ["weekly_growth", "growth"]
MODEL_QUALITY_THRESHOLDS = {
    "min_r2_score": 0.60,
    "max_rmse_ratio": 0.15,
    "min_directional_accuracy": 0.75,
    "max_prediction_interval_width": 1000,
}
CONFIDENCE_LEVEL = 0.95
CV_FOLDS = 5
NONZERO_COEF_TOL = 1e-10
BUSINESS_MEANINGS = {
    "weekly_posting_frequency": "Expected follower growth per additional weekly post",
    "engagement_rate": "Growth impact of higher engagement rates",
    "share_reels": "Effect of having more reels in content mix",
    "share_posts": "Effect of having more posts in content mix",
    "roi_follows_per_hour": "Growth impact of content efficiency",
    "posted_in_optimal_window": "Benefit of posting at optimal times",
    "saturation_flag": "Impact of potential posting saturation",
}
DEFAULT_BUSINESS_MEANING = "Impact on follower growth"
ALPHA_STRENGTHS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]

# KPI buckets
GROWTH_RANGES = [("negative", None, 0), ("low_growth", 0, 100), ("medium_growth", 100, 500),
                 ("high_growth", 500, None)]
POSTING_RANGES = [("low_posting", None, 3), ("medium_posting", 3, 7), ("high_posting", 7, None)]
AGREEMENT_THRESHOLDS = [0, 50, 100, 200, 500, 1000]
GRADE_CUTS = [(0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"), (0.5, "C+"), (0.4, "C")]
GRADE_FLOOR = "D"

# scenario requests: field, default, low, high (None = required / unbounded)
REQUEST_FIELDS = [
    ("weekly_posting_frequency", None, 0.0, 50.0),
    ("share_posts", 0.33, 0.0, 1.0),
    ("share_reels", 0.33, 0.0, 1.0),
    ("share_stories", 0.34, 0.0, 1.0),
    ("engagement_rate", 0.05, 0.0, 1.0),
    ("avg_hashtag_count", 10.0, 0.0, 30.0),
    ("post_consistency_variance_7d", 0.0, 0.0, None),
    ("posted_in_optimal_window", 0, 0, 1),
    ("roi_follows_per_hour", 1.0, 0.0, None),
    ("minutes_spent", 120, 0, 2000),
    ("month", 1, 1, 12),
    ("quarter", 1, 1, 4),
    ("saturation_flag", 0, 0, 1),
]
GROWTH_CATEGORIES = [(1000, "explosive"), (500, "high"), (100, "moderate"), (0, "low")]
GROWTH_CATEGORY_FLOOR = "decline"
DEFAULT_RECOMMENDATION = "Continue current strategy"
# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


# cross-validation report: metrics and limits (fixed values)
CV_METRICS = ("r2", "mse", "mae")
CV_STABLE_BELOW = 0.2      # coefficient of variation of a stable metric
CV_STABLE_SHARE = 0.8      # share of stable metrics of a stable model
CV_TREND_LIMIT = 0.3       # correlation with the fold number that is a trend
CV_FLAT_LIMIT = 0.2        # and below which there is none

# diagnostics: points taken off the health score and advice (fixed values).  Conditions are SQL
# over the columns of one metrics row: r2, assumption_score, outlier_rate, degraded, normal,
# equal_variance, collinear.
HEALTH_PENALTIES = (
    ("r2 < 0.6", "0.2"),
    ("assumption_score < 1", "0.3 * (1 - assumption_score)"),
    ("outlier_rate > 0.1", "0.2 * least(outlier_rate, 0.5)"),
    ("degraded", "0.1"),
)
DIAGNOSTIC_ADVICE = (
    ("r2 < 0.7", "Consider adding more features or feature engineering"),
    ("not normal", "Consider transforming target variable for normality"),
    ("not equal_variance", "Consider using robust regression or weighted least squares"),
    ("collinear", "Remove highly correlated features or use regularization"),
    ("outlier_rate > 0.1", "Investigate and potentially remove outliers"),
    ("degraded", "Model performance is degrading over time - consider retraining"),
)
DIAGNOSTIC_ALL_GOOD = "Model diagnostics look good"

# KPI advice: SQL conditions over the overall-score row, and sentences (fixed values)
KPI_ADVICE = (
    ("r2 < 0.7", "Consider feature engineering to improve R² score"),
    ("mape > 30", "High MAPE indicates need for better feature selection"),
    ("directional_accuracy < 75", "Improve directional accuracy for better decision support"),
    ("not stable", "Model showing instability over time - consider retraining"),
)
KPI_ALL_GOOD = "KPI performance looks good"

# FIXED VALUES: days of the smoothed engagement rate; advice of the model quality verdict
ENGAGEMENT_SMOOTHING_DAYS = 3
LOW_R2_ADVICE = "Consider adding more features or different model type"
LOW_DIRECTION_ADVICE = "Review feature engineering for better trend prediction"
