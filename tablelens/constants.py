"""Fixed values that must equal the reference's for results to match.

They are names and words users see in derived columns and options, kept
here together, as plain text, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
# Derived column names.
BIN_COLUMN_PREFIX = "Группа("          # bin column is  Группа(<col>)
CLUSTER_COLUMN = "Кластеры"             # cluster label column
CLUSTER_LABEL_PREFIX = "Кластер "       # label text is  Кластер <i>
PCA_COLUMNS = ("PCA1", "PCA2")

# Text that stands for a missing value when it competes as a value.
EMPTY_SENTINEL = "<EMPTY>"

# A "none" choice in colour / facet pickers.
NONE_CHOICE = "Нет"

# Column-name words that mark an identifier axis as categorical.
CATEGORICAL_NAME_WORDS = ("скважина", "well", "куст")

# Metric names and their aliases (compared after removing whitespace and
# lower-casing).
METRIC_ALIASES = {
    "mean": "mean", "avg": "mean", "average": "mean", "среднее": "mean",
    "median": "median", "медиана": "median",
    "mode": "mode", "мода": "mode",
    "sum": "sum", "сумма": "sum",
    "cumsum": "cumsum", "cumulative": "cumsum",
    "кумулятивнаясумма": "cumsum", "накопительнаясумма": "cumsum",
    "min": "min", "мин": "min",
    "max": "max", "макс": "max",
    "std": "std", "stdev": "std", "sigma": "std", "стандартноеотклонение": "std",
    "count": "count", "количество": "count",
    "nunique": "nunique", "уникальных": "nunique", "числоуникальных": "nunique",
}
NUMERIC_ONLY_METRICS = ("mean", "median", "sum", "min", "max", "std", "cumsum")

# Characters replaced by "_" in export file names (runs collapse to one).
UNSAFE_FILENAME_CHARS = '<>:"/\\|?*'

# Names of the category orders of an axis.
CATEGORY_ORDERS = (
    "trace", "category ascending", "category descending", "total ascending", "total descending",
    "min ascending", "min descending", "max ascending", "max descending", "sum ascending", "sum descending",
    "mean ascending", "mean descending", "geometric mean ascending", "geometric mean descending",
    "median ascending", "median descending",
)

# Workload limits.
MAX_CORR_COLUMNS = 50
KMEANS_STARTS = 10
KMEANS_SEED = 42
PIE_BINS = 10
DEFAULT_TEXT_SUFFIX = "_txt"
# ---------------------------------------------------------------------------
