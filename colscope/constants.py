"""Fixed values of the profiling rules.

They decide results, so they are stated here once and never tuned: the same table must give the
same profile whichever entry point is used.
"""

# Markers written into the data.
NULL_TERM = "null"
OTHER_TERM = "others"

# Null policy (share of non-null rows, and the numeric fill).
DROP_BELOW = 0.5
FILL_BELOW = 0.8
FILL_NUMBER = 2809

# Numeric bins of the entropy profile and of the distance step.
ENTROPY_BINS = 20
DISTANCE_BINS = 10

# Terms returned per field, and categories a tree may split on.
TOP_TERMS = 30
MAX_CATEGORIES = 30

# Random forest settings for column importances.
FOREST = {
    "maxBins": 30,
    "subsamplingRate": 0.3,
    "maxDepth": 5,
    "minInfoGain": 0.0,
    "featureSubsetStrategy": "sqrt",
    "minInstancesPerNode": 10,
    "numTrees": 50,
    "seed": 27,
}

# Clustering of mixed rows.
CLUSTERS = 3
CLUSTER_SEED = 2

# Largest number of labels per column that may be held as a driver-side model. Beyond it the
# join-based operators give the same result without a driver-side label list.
MAX_MODEL_LABELS = 100_000

# Most classes of a label that a forest tells apart; rarer ones are folded together by hash.
MAX_CLASSES = 100
