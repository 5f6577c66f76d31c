"""Vocabularies and table schemas of the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ontology's vocabularies.
LAYERS = ("SOURCE", "SEMANTIC", "ARGUMENT", "LEARNING", "CONTEXT")
SOURCE_TYPES = ("PAPER", "SECTION", "PARAGRAPH", "SOURCE_SPAN", "FIGURE", "TABLE", "EQUATION", "REFERENCE")
SEMANTIC_TYPES = (
    "MATHEMATICAL_CONCEPT", "MATHEMATICAL_THEOREM", "MATHEMATICAL_METHOD", "PHYSICAL_LAW", "PHYSICAL_CONCEPT", "PHYSICAL_QUANTITY", "PHENOMENON",
    "CHEMICAL_CONCEPT", "MATERIAL", "THEORY", "MODEL", "DEFINITION", "METHOD", "RELATIONSHIP_ANALYSIS", "ALGORITHM", "PROCESS", "DEVICE", "ARCHITECTURE",
    "EXPERIMENT", "SIMULATION", "DATASET", "PARAMETER", "METRIC", "RESEARCH_PROBLEM", "MOTIVATION", "RESEARCH_GAP",
)
ARGUMENT_TYPES = ("CLAIM", "HYPOTHESIS", "OBSERVATION", "EVIDENCE", "RESULT", "CONCLUSION", "CONTRIBUTION", "INNOVATION", "LIMITATION", "OPEN_QUESTION")
RELATIONS = (
    "CONTAINS", "MENTIONS", "DEFINES", "DESCRIBES", "DERIVES_FROM", "MATHEMATICALLY_DERIVES_FROM", "DEPENDS_ON", "PREREQUISITE_OF", "USES", "APPLIES",
    "IMPLEMENTS", "ASSUMES", "APPROXIMATES", "EXPLAINS", "CAUSES", "AFFECTS", "MEASURES", "MEASURED_BY", "SIMULATES", "SIMULATED_BY", "VALIDATES",
    "VALIDATED_BY", "SUPPORTS", "SUPPORTED_BY", "CONTRADICTS", "COMPARES_WITH", "EXTENDS", "IMPROVES", "MOTIVATES", "ADDRESSES", "SOLVES", "PRODUCES",
    "RESULTS_IN", "CITES", "CITED_BY", "EVIDENCE_FOR", "PART_OF",
)
EPISTEMIC = (
    "PAPER_EXPLICIT", "PAPER_IMPLICIT", "AUTHOR_CLAIM", "OBSERVED_DATA", "REFERENCE_DERIVED", "BACKGROUND_KNOWLEDGE", "AI_INTERPRETATION", "AI_DERIVATION",
    "AI_HYPOTHESIS", "UNVERIFIED", "CONFLICTING", "UNKNOWN", "NOT_SPECIFIED_IN_PAPER",
)
VERIFICATION = ("CANDIDATE", "SUPPORTED", "VERIFIED", "DISPUTED", "REJECTED", "STALE")
JOB = ("UPLOADED", "PARSING", "PARSED", "ENTITY_EXTRACTION", "GRAPH_BUILDING", "READY", "PARTIAL", "FAILED")
SCOPES = ("SOURCE_ATTRIBUTION", "SCIENTIFIC_VALIDITY")
INACTIVE = ("REJECTED", "DISPUTED", "STALE")
REVIEWED = ("VERIFIED", "REJECTED", "DISPUTED")
CLAIM_TYPES = ("CLAIM", "RESULT", "CONCLUSION", "HYPOTHESIS")
TERMINAL_JOBS = ("READY", "PARTIAL", "FAILED")
TERMINAL_TASKS = ("accepted", "rejected", "blocked", "escalated")
VIEWS = {
    "argument": ("PAPER", "CLAIM", "EVIDENCE", "OBSERVATION", "RESULT", "CONCLUSION", "ASSUMPTION", "LIMITATION"),
    "innovation": ("PAPER", "PRIOR_WORK", "RESEARCH_GAP", "METHOD", "CONTRIBUTION", "INNOVATION", "RESULT", "LIMITATION"),
}

ALL_TYPES = (*SOURCE_TYPES, *SEMANTIC_TYPES, *ARGUMENT_TYPES, "FIRST_PRINCIPLE", "PRIOR_WORK", "ASSUMPTION", "APPROXIMATION")
BOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x0", "y0", "x1", "y1")])
NOTE = T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), *(T.StructField(k, T.StringType()) for k in ("raw", "display", "kind")), T.StructField("bbox", BOX), T.StructField("basis", T.StringType())])


def legal_pairs() -> list[tuple[str, str]]:
    """The (type, layer) pairs that a node may have."""
    pairs = [(t, "SOURCE") for t in SOURCE_TYPES] + [(t, "ARGUMENT") for t in ARGUMENT_TYPES] + [(t, "SEMANTIC") for t in SEMANTIC_TYPES]
    pairs += [("FIRST_PRINCIPLE", x) for x in ("LEARNING", "SEMANTIC")] + [("PRIOR_WORK", "CONTEXT")]
    return pairs + [(t, x) for t in ("ASSUMPTION", "APPROXIMATION") for x in ("SEMANTIC", "ARGUMENT")]


def layers(spark: SparkSession) -> DataFrame:
    """legal_pairs as a dimension table of bounded size."""
    return spark.createDataFrame(legal_pairs(), "type string, layer string")


def default_layer(kind: Column) -> Column:
    """The layer that extraction gives a type."""
    return F.when(kind.isin(*SOURCE_TYPES), "SOURCE").when(kind.isin(*ARGUMENT_TYPES), "ARGUMENT").when(kind == "PRIOR_WORK", "CONTEXT").otherwise("SEMANTIC")


def unknown_values(df: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """Rows whose column is not in the vocabulary."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*vocabulary))
