"""Lexical columns of host names: labels, entropy, consonant runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def base_domain(host: Column) -> Column:
    """The last two labels."""
    labels = F.split(host, "[.]")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def subdomain(host: Column) -> Column:
    """All labels before the last two; empty if there are none."""
    labels = F.split(host, "[.]")
    return F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")


def entropy(text: Column) -> Column:
    """Shannon bits a character; 0 for the empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, bits).when(text.isNotNull(), F.lit(0.0))


def longest_label(host: Column) -> Column:
    return F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x)))


def consonant_runs(host: Column) -> Column:
    """Runs of four or more consonants."""
    return F.regexp_count(host, F.lit("[bcdfghjklmnpqrstvwxyz]{4,}"))
