"""Fixed values of the domain.  Everything here is data, used as parameters by the operators."""

# Competition scope.
LEAGUES = (
    ("National Football League", "NFL", "Football"),
    ("National Basketball Association", "NBA", "Basketball"),
)
KEY = ["league", "season", "season_type"]
REGULAR = 2
SEASON_TYPES = (2, 3)
SEASON_RANGE = (1900, 2200)
MAX_SCOPE_DAYS = 366
STATUSES = ("scheduled", "in_progress", "final", "postponed", "canceled", "suspended", "delayed")
SCORED_STATUSES = ("in_progress", "final", "suspended")

# Raw scoreboard and box-score documents.
MAX_EVENTS = 1000
EXHIBITION_SEASON_TYPE = 1
EXHIBITION_COMPETITION = "ALLSTAR"
REQUIRED_CATEGORIES = {"NFL": ("passing", "rushing", "receiving", "defensive", "kicking", "punting")}
DEFAULT_CATEGORY = {"NBA": "general"}
ZERO_PLACEHOLDERS = ("0", "0-0", "0/0")

# Statistics that add up across games.
ADDITIVE_KEYS = (
    "points", "rebounds", "assists", "turnovers", "steals", "blocks", "offensiveRebounds",
    "defensiveRebounds", "fouls", "plusMinus", "passingYards", "passingTouchdowns", "interceptions",
    "rushingAttempts", "rushingYards", "rushingTouchdowns", "receptions", "receivingYards",
    "receivingTouchdowns", "receivingTargets", "fumbles", "fumblesLost", "fumblesRecovered",
    "totalTackles", "soloTackles", "sacks", "tacklesForLoss", "passesDefended", "QBHits",
    "defensiveTouchdowns", "interceptionYards", "interceptionTouchdowns", "kickReturns",
    "kickReturnYards", "kickReturnTouchdowns", "puntReturns", "puntReturnYards",
    "puntReturnTouchdowns", "totalKickingPoints", "punts", "puntYards", "touchbacks", "puntsInside20",
)
PAIR_KEYS = {
    "fieldGoalsMade-fieldGoalsAttempted": ("fieldGoalsMade", "fieldGoalsAttempted"),
    "threePointFieldGoalsMade-threePointFieldGoalsAttempted": (
        "threePointFieldGoalsMade", "threePointFieldGoalsAttempted"),
    "freeThrowsMade-freeThrowsAttempted": ("freeThrowsMade", "freeThrowsAttempted"),
    "completions/passingAttempts": ("completions", "passingAttempts"),
    "sacks-sackYardsLost": ("sacksTaken", "sackYardsLost"),
    "fieldGoalsMade/fieldGoalAttempts": ("fieldGoalsMade", "fieldGoalAttempts"),
    "extraPointsMade/extraPointAttempts": ("extraPointsMade", "extraPointAttempts"),
}

# A zero row that does not establish an appearance.
UNCERTAIN_KEYS = (
    "fouls", "blocks", "points", "steals", "assists", "rebounds", "plusMinus", "turnovers",
    "defensiveRebounds", "offensiveRebounds", "fieldGoalsMade-fieldGoalsAttempted",
    "freeThrowsMade-freeThrowsAttempted", "threePointFieldGoalsMade-threePointFieldGoalsAttempted",
)
MISSING_VALUES = ("--", "NaN", "Infinity")

# Postponed game -> verified replacement (season, postponed id, final id).
NBA_REPLACEMENTS = (
    (2025, "401705090", "401748704"),
    (2025, "401705098", "401748705"),
    (2025, "401705104", "401748706"),
    (2025, "401705103", "401754705"),
    (2025, "401705183", "401754706"),
    (2026, "401810384", "401850920"),
    (2026, "401810499", "401857824"),
    (2026, "401810506", "401858693"),
    (2026, "401810507", "401858694"),
)

# Modelling protocol.
FEATURES = (
    "win_rate_diff", "points_for_diff", "points_against_diff", "margin_diff",
    "last5_win_rate_diff", "last5_margin_diff", "rest_days_diff",
)
MINIMUM_GAMES = 5
FEATURE_SETS = {
    "strength": FEATURES[:4],
    "recent_form": FEATURES[4:6],
    "rest": FEATURES[6:],
    "strength_recent": FEATURES[:6],
    "strength_rest": FEATURES[:4] + FEATURES[6:],
    "all": FEATURES,
}
CANDIDATES = {"NBA": ("strength", "strength_recent"), "NFL": ("recent_form", "strength_recent")}
BASELINE = "constant_home_rate"
C_GRID = (0.01, 0.1, 1.0, 10.0)
MAX_ITERATIONS = 2000
FEATURE_POLICY = "strictly_prior_utc_dates_v1"
LOG_LOSS_EPSILON = 2.0 ** -52
CONFIDENCE = 0.8
CONFIDENT_ERRORS = 20
CALIBRATION_BINS = 10
REPORT_ID = r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,79}$"

# Paging and forecast limits.
PAGE_DEFAULT, PAGE_MAX, OFFSET_MAX = 25, 100, 1_000_000
RUN_PAGE_DEFAULT, RUN_PAGE_MAX = 50, 200
STALE_MINUTES = 15
LEDGER_HOURS = 72
