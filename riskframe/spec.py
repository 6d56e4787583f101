"""Feature registry: which columns play which role, and the fixed clinical values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles, passed to every operator; never mutated."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    label: str = "target"
    id: str = "patientid"

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def with_roles(self, numeric=(), categorical=()) -> "FeatureSpec":
        return replace(
            self,
            numeric=self.numeric + tuple(numeric),
            categorical=self.categorical + tuple(categorical),
        )


# The canonical record, its source names and its documented codes.
NUMERIC_FEATURES = ("age", "restingBP", "serumcholestrol", "maxheartrate", "oldpeak")
CATEGORICAL_FEATURES = (
    "gender",
    "chestpain",
    "fastingbloodsugar",
    "restingrelectro",
    "exerciseangia",
    "slope",
    "noofmajorvessels",
)
CENTRE_FILE_COLUMNS = (
    "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
    "thalach", "exang", "oldpeak", "slope", "ca", "thal", "num",
)
CENTRE_FILES = (
    "processed.cleveland.data",
    "processed.hungarian.data",
    "processed.switzerland.data",
    "processed.va.data",
)
SOURCE_NAMES = {
    "sex": "gender",
    "cp": "chestpain",
    "trestbps": "restingBP",
    "chol": "serumcholestrol",
    "fbs": "fastingbloodsugar",
    "restecg": "restingrelectro",
    "thalach": "maxheartrate",
    "exang": "exerciseangia",
    "ca": "noofmajorvessels",
    "num": "target",
}
GENDER_CODES = {"M": 1, "F": 0, "Male": 1, "Female": 0}
GENDER_TRUE = ("m", "male", "1", "true", "yes")
GENDER_FALSE = ("f", "female", "0", "false", "no")
OFFSET_COLUMNS = ("chestpain", "slope")
CLINICAL_STANDARD = "UCI-1-indexed"
NUMERIC_NAME_HINTS = (
    "age", "restingBP", "restingbp", "resting_blood_pressure", "serumcholestrol", "cholesterol",
    "maxheartrate", "oldpeak", "triglyceride", "fasting", "sugar", "glucose",
)
FALLBACK_SUBSTRINGS = ("age", "bp", "pressure", "rate", "max", "min", "peak", "chol", "sugar")
HARDEN_SUBSTRINGS = ("age", "bp", "press", "rate", "max", "peak", "chol", "sugar")
# (column, smallest, largest, whole numbers only)
RANGE_RULES = (
    ("age", 1, 120, False),
    ("gender", 0, 1, True),
    ("chestpain", 1, 4, True),
    ("restingBP", 30, 300, False),
    ("serumcholestrol", 50, 1000, False),
    ("fastingbloodsugar", 0, 1, True),
    ("restingrelectro", 0, 2, True),
    ("maxheartrate", 30, 300, False),
    ("exerciseangia", 0, 1, True),
    ("oldpeak", 0, 20, False),
    ("slope", 1, 3, True),
    ("noofmajorvessels", 0, 3, True),
)
HIGH_RISK, LOW_RISK = "High risk", "Low risk"
METRIC_KEYS = ("roc_auc", "auc", "roc", "mean_test_roc_auc", "mean_test_score")
CV_METRICS = ("roc_auc", "accuracy", "precision", "recall", "f1")
RANDOM_SEED = 42

HEART_SPEC = FeatureSpec(NUMERIC_FEATURES, CATEGORICAL_FEATURES)

CENTRE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in CENTRE_FILE_COLUMNS])

# A request record: numbers as double, codes as int, gender as text so both spellings arrive intact.
REQUEST_SCHEMA = T.StructType(
    [T.StructField("patientid", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_FEATURES]
    + [T.StructField("gender", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in CATEGORICAL_FEATURES if c != "gender"]
)
