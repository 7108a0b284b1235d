"""Score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the two parts of a search score.
TF_IDF_WEIGHT = 0.7
PAGE_RANK_WEIGHT = 0.3


def idf(n_pages: Column, documents_number: Column) -> Column:
    """Inverse document frequency: natural logarithm, no smoothing."""
    return F.log(n_pages / documents_number)


def text_score(tf_idf: Column) -> Column:
    return TF_IDF_WEIGHT * F.log10(tf_idf + 1)


def rank_score(page_rank: Column) -> Column:
    return PAGE_RANK_WEIGHT * F.log10(page_rank + 1)
