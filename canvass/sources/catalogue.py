"""Question catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canvass.schemas import QUESTION

# Fixed values: (id, text, type, options, placeholder, category).
TECHNOLOGY_SURVEY = (
    ("spring_performance", "Jak oceniasz wydajność Spring Boot API?", "rating",
     ["1 - Słabo", "2", "3", "4", "5 - Doskonale"], None, "performance"),
    ("java_tech_interest", "Która technologia Java Cię interesuje?", "multiselect",
     ["Spring Boot", "Apache Spark", "Hibernate", "MongoDB", "Kafka Streams", "Quarkus", "Micronaut"],
     None, "technology"),
    ("integration_quality", "Jak oceniasz integrację z Python/FastAPI?", "rating",
     ["1 - Słaba", "2", "3", "4", "5 - Doskonała"], None, "integration"),
    ("elk_usefulness", "Czy uważasz, że ELK Stack jest przydatny?", "choice",
     ["Tak, zdecydowanie", "Raczej tak", "Nie wiem", "Raczej nie", "Nie"], None, "monitoring"),
    ("architecture_suggestions", "Twoje sugestie dotyczące architektury:", "text",
     None, "Podziel się swoimi pomysłami...", "feedback"),
)

# The questions of the site survey.
SITE_SURVEY = (
    ("1", "Jak oceniasz design strony?", "rating",
     ["1 - Słabo", "2", "3", "4", "5 - Doskonale"], None, None),
    ("2", "Czy informacje były przydatne?", "choice",
     ["Tak", "Raczej tak", "Nie wiem", "Raczej nie", "Nie"], None, None),
    ("3", "Jakie technologie Cię zainteresowały?", "multiselect",
     ["Python", "JavaScript", "React", "Kubernetes", "Docker", "PostgreSQL", "Vault"], None, None),
    ("4", "Czy poleciłbyś tę stronę innym?", "choice",
     ["Zdecydowanie tak", "Prawdopodobnie tak", "Nie wiem", "Raczej nie", "Zdecydowanie nie"], None, None),
    ("5", "Co sądzisz o portfolio?", "text", None, "Podziel się swoją opinią...", None),
)

# Served when the technology survey cannot be reached; its ids match no answer key.
FALLBACK_SURVEY = (
    ("1", "Jak oceniasz wydajność Spring Boot API?", "rating",
     ["1 - Słabo", "2", "3", "4", "5 - Doskonale"], None, None),
    ("2", "Która technologia Java Cię interesuje?", "choice",
     ["Spring Boot", "Apache Spark", "Hibernate", "MongoDB", "Kafka Streams"], None, None),
    ("3", "Jak oceniasz integrację z Python/FastAPI?", "rating",
     ["1 - Słaba", "2", "3", "4", "5 - Doskonała"], None, None),
    ("4", "Czy uważasz, że ELK Stack jest przydatny?", "choice",
     ["Tak, zdecydowanie", "Raczej tak", "Nie wiem", "Raczej nie", "Nie"], None, None),
    ("5", "Twoje sugestie dotyczące architektury:", "text",
     None, "Podziel się swoimi pomysłami...", None),
)


def catalogue(spark: SparkSession, questions=TECHNOLOGY_SURVEY) -> DataFrame:
    rows = [(i, *q) for i, q in enumerate(questions)]
    return spark.createDataFrame(rows, QUESTION)
