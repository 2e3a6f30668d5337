"""Word lists and the country dictionary."""

from __future__ import annotations

from functools import lru_cache

# ---- fixed values -------------------------------------------------------------------
EDUCATION_WORDS = (
    "education", "learning", "teaching", "student", "university", "academic", "classroom",
    "pedagogy", "teacher",
)

ACADEMIC_STOP_WORDS = (
    "study", "research", "paper", "results", "ai", "intelligence", "artificial",
    "author", "authors", "method", "methods", "analysis", "using", "based",
)

# Country -> text variants; the first country in this order wins.
COUNTRIES = {
    "USA": ("usa", "united states", "america", "california", "new york", "harvard", "mit",
            "stanford", "florida", "texas"),
    "China": ("china", "beijing", "shanghai", "tsinghua", "zhejiang", "wuhan"),
    "United Kingdom": ("uk", "united kingdom", "london", "oxford", "cambridge", "manchester",
                       "scotland"),
    "Spain": ("spain", "españa", "madrid", "barcelona", "valencia", "sevilla", "granada"),
    "Colombia": ("colombia", "bogota", "medellin", "cali", "barranquilla", "antioquia",
                 "uniandes"),
    "Mexico": ("mexico", "méxico", "unam", "monterrey", "guadalajara", "puebla"),
    "Brazil": ("brazil", "brasil", "sao paulo", "rio de janeiro", "campinas"),
    "Germany": ("germany", "deutschland", "berlin", "munich", "hamburg", "fraunhofer"),
    "France": ("france", "paris", "lyon", "marseille", "cnrs"),
    "Italy": ("italy", "italia", "roma", "milan", "napoli"),
    "Canada": ("canada", "toronto", "vancouver", "montreal", "mcgill"),
    "Australia": ("australia", "sydney", "melbourne", "queensland"),
}
# -------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def stop_words(language: str) -> tuple[str, ...]:
    """Spark's bundled stop words, lower-cased, as the running session gives them."""
    from pyspark import SparkContext
    from pyspark.ml.feature import StopWordsRemover
    from pyspark.sql import SparkSession

    running = SparkContext._active_spark_context
    session = SparkSession.builder.getOrCreate()
    words = tuple(sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)}))
    if running is None:
        session.stop()
    return words


def cloud_stop_words() -> tuple[str, ...]:
    """English and Spanish stop words together with the academic ones."""
    words = {*stop_words("english"), *stop_words("spanish"), *ACADEMIC_STOP_WORDS}
    return tuple(sorted(words))
