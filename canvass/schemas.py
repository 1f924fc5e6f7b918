"""Record layouts."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

METADATA = StructType([
    StructField("surveyType", StringType()),
    StructField("browser", StringType()),
    StructField("ipAddress", StringType()),
])

STORED_METADATA = StructType(METADATA.fields + [
    StructField("userAgent", StringType()),
    StructField("referer", StringType()),
    StructField("technicalData", MapType(StringType(), StringType())),
])

# One row per submission.
SURVEY = StructType([
    StructField("surveyId", StringType()),
    StructField("userId", StringType()),
    StructField("sessionId", StringType()),
    StructField("answers", MapType(StringType(), StringType())),
    StructField("submittedAt", TimestampType()),
    StructField("metadata", METADATA),
])

STORED_SURVEY = StructType(SURVEY.fields[:5] + [StructField("metadata", STORED_METADATA)])

# The message of the submitting service carries the answers as ``data`` and the
# time as epoch milliseconds; both layouts are read with one schema.
EVENT = StructType(SURVEY.fields + [
    StructField("type", StringType()),
    StructField("timestamp", LongType()),
    StructField("data", MapType(StringType(), StringType())),
])

QUESTION = StructType([
    StructField("position", IntegerType()),
    StructField("id", StringType()),
    StructField("text", StringType()),
    StructField("type", StringType()),
    StructField("options", ArrayType(StringType())),
    StructField("placeholder", StringType()),
    StructField("category", StringType()),
])

ANALYSIS_RUN = StructType([
    StructField("analysisType", StringType()),
    StructField("timestamp", TimestampType()),
    StructField("dataStartTime", TimestampType()),
    StructField("dataEndTime", TimestampType()),
    StructField("results", MapType(StringType(), StringType())),
    StructField("metrics", MapType(StringType(), DoubleType())),
    StructField("parameters", MapType(StringType(), StringType())),
    StructField("sparkJobId", StringType()),
    StructField("sparkApplicationId", StringType()),
    StructField("status", StringType()),
])

# Fixed values.
RUN_STATUS = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")

# Answer keys of the technology survey.
SPRING = "spring_performance"
TECHNOLOGIES = "java_tech_interest"
INTEGRATION = "integration_quality"
ELK = "elk_usefulness"
SUGGESTIONS = "architecture_suggestions"
HOT_ANSWERS = (SPRING, TECHNOLOGIES, INTEGRATION, ELK, SUGGESTIONS)
