"""Default parameters of a run."""

# Fixed values.
GRID_RESOLUTION = 4
MIN_LAT, MAX_LAT, MIN_LNG, MAX_LNG = 25.0, 47.0, -87.0, -66.0
MIN_CLUSTERS, MAX_CLUSTERS = 2, 20
LIMIT_RESULTS = 1000
MAX_TAXA = 5000
MIN_PRESENCE = 0.05
OUTPUT_DIR = "output"
