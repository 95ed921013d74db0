"""Static rank of a page, from its images, links, domain, length and URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import length_weight, tld_weight


def image_weight(n: Column) -> Column:
    return F.when(n == 0, 0).when(n <= 5, 2).when(n <= 100, 3).when(n <= 250, 2).otherwise(-1)


def link_weight(n: Column) -> Column:
    return F.when(n == 0, 0).when(n <= 250, 2).otherwise(-1)


def document_weight(n_words: Column) -> Column:
    return F.when(n_words < 64, -2.0).when(n_words < 256, 0.8).when(n_words < 1024, 1.0).when(n_words < 2048, 0.5).otherwise(-1.0)


def static_rank(url: Column, images: Column, links: Column, n_words: Column) -> Column:
    """The truncated sum, 0 at least."""
    total = image_weight(images) + link_weight(links) + tld_weight(url) + document_weight(n_words) + length_weight(url)
    return F.greatest(total.cast("int"), F.lit(0))
