"""Fixed values of the domain: seasons, folds, policies, kernels, tolerances."""

from __future__ import annotations

# Season: September to December, 122 days.
SEASON_MONTHS = (9, 12)
SEASON_START_MONTH = 9
SEASON_DAYS = 122
HISTORY_YEARS = (1987, 2025)
HORIZON_DAYS = {24: 1, 48: 2, 72: 3}
SPARSE_POSITIVE_LIMIT = 3

# fold_id, fit end, validation start/end, test start/end.
FOLDS = (
    ("F1", 2013, 2014, 2016, 2017, 2019),
    ("F2", 2016, 2017, 2019, 2020, 2022),
    ("F3", 2019, 2020, 2022, 2023, 2025),
)

# Daily statistic by variable code; anything else is a mean.
SUM_CODES = ("PRECIP_MM", "SUNSHINE_DURATION_MIN", "LEAF_WETNESS_DURATION_S")
MIN_CODES = ("DISCHARGE_MIN_M3_S",)
MAX_CODES = ("DISCHARGE_MAX_M3_S",)
CIRCULAR_CODES = ("WIND_DIR_DEG",)
STATION_POLICY = {
    **dict.fromkeys(SUM_CODES, "SUM"),
    **dict.fromkeys(MIN_CODES, "MIN"),
    **dict.fromkeys(MAX_CODES, "MAX"),
    **dict.fromkeys(CIRCULAR_CODES, "CIRCULAR_MEAN"),
}
CIRCULAR_MIN_STRENGTH = 1e-12

# Cadence inference.
DAY_SECONDS = 86400
MAX_CADENCE_GAP_SECONDS = 6 * 3600
MAX_SAMPLES_PER_DAY = 288
INTERVAL_TOLERANCE = 0.01
DELTA_TOLERANCE = 0.02

# Geometry and the bearing kernel.
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = EARTH_RADIUS_KM * 1000.0
N_SECTORS = 16
SECTOR_STEP_DEG = 22.5
KERNEL_SIGMA_DEG = 22.5
KERNEL_CUTOFF_DEG = 45.0
KERNEL_SCALE_KM = 700.0
KERNEL_MAX_KM = 1600.0

# Kernel sensitivity scenarios: name, sigma, cutoff, scale, max distance.
KERNEL_SCENARIOS = (
    ("BASE", 22.5, 45.0, 700.0, 1600.0),
    ("ANGLE_NARROW", 15.0, 30.0, 700.0, 1600.0),
    ("ANGLE_WIDE", 30.0, 60.0, 700.0, 1600.0),
    ("DIST_SHORT", 22.5, 45.0, 500.0, 1200.0),
    ("DIST_LONG", 22.5, 45.0, 900.0, 2000.0),
    ("SIGMA_NARROW", 15.0, 45.0, 700.0, 1600.0),
    ("SIGMA_WIDE", 30.0, 45.0, 700.0, 1600.0),
    ("SCALE_SHORT", 22.5, 45.0, 500.0, 1600.0),
    ("SCALE_LONG", 22.5, 45.0, 900.0, 1600.0),
)
SUPPORT_CUTOFFS = {"narrow": 30.0, "baseline": 45.0, "wide": 60.0}

# Probability scoring.
PROBABILITY_CLIP = 1e-8
RECALL_TARGET = 0.80
CLIMATOLOGY_SHRINKAGE = (50, 200)
BOOTSTRAP_REPLICATES = 2000
SEED = 20260825
