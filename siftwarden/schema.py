"""Schemas and the fixed lookup values of the engine's tables."""

from pyspark.sql import types as T

# Severity weights, confidence factors, category weights.
SEVERITY_WEIGHTS = {"critical": 40, "high": 25, "medium": 10, "low": 3}
CONFIDENCE_FACTORS = {"high": 1.0, "medium": 0.7, "low": 0.4}
CATEGORY_WEIGHTS = {
    "secrets": 1.5,
    "security": 1.4,
    "security-hardening": 1.4,
    "pii": 1.3,
    "web-security": 1.3,
    "ai-safety": 1.3,
    "llm-guardrails": 1.3,
    "devops": 1.2,
    "infrastructure": 1.2,
    "cloud-native": 1.1,
    "supply-chain": 1.4,
    "compliance": 1.2,
    "code-quality": 0.8,
    "performance": 0.6,
    "accessibility": 0.7,
    "git-hygiene": 0.5,
    "ai-detection": 1.0,
    "shift-left": 1.0,
}
UNKNOWN_SEVERITY_WEIGHT = 1
UNKNOWN_CONFIDENCE_FACTOR = 0.5
UNKNOWN_CATEGORY_WEIGHT = 1.0

# Score limits (below) and texts of the risk levels.
RISK_LIMITS = [(20, "low"), (50, "medium"), (100, "high")]
RISK_LEVELS = ["none", "low", "medium", "high", "critical"]

# Entropy classes by upper limit.
ENTROPY_LIMITS = [(2.0, "very_low"), (3.0, "low"), (4.0, "medium"), (5.0, "high")]

# File extension to language.
LANGUAGES = {
    "go": "go", "rs": "rust", "py": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}

RULE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("min_entropy", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("env_var", T.BooleanType()),
    T.StructField("binary", T.BooleanType()),
])

FINDING_COLUMNS = [
    "id", "rule", "category", "severity", "confidence", "line", "start_byte", "end_byte",
    "matched", "matched_len", "description", "reference", "tags", "kind", "fingerprint",
]
