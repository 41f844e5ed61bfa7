"""Hospital systems by name: a prefix tree over the words of all names.

A node of the tree is a prefix of words, its support the facilities below it.
The system of a facility is its deepest node with enough support.  Prefixes
without a word of their own name nobody: a prefix has to hold a word that is
neither generic ("Memorial Hospital") nor part of a dedication at any place
("St. Mary"), so hospitals that only share such words stay apart.

The tree is a table of one row a facility and word; support is a partial
aggregate, so the facilities of one common prefix are combined in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DEDICATION_WORDS, GENERIC_NAME_WORDS


def name_words(name: Column | str) -> Column:
    """Upper-case words (letters, digits, ``&`` and ``'``); of a NULL or blank
    name none."""
    name = F.col(name) if isinstance(name, str) else name
    clean = F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}&']+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def systems_by_name(hospitals: DataFrame, min_support: int = 3) -> DataFrame:
    """(facility_id, facility_name, system): ``system`` is the longest prefix of
    words that at least ``min_support`` facilities share, NULL if there is none."""
    words = hospitals.select("facility_id", "facility_name", name_words("facility_name").alias("_w"))

    def own(word: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get("_w", at - 1))
        return ~word.isin(*GENERIC_NAME_WORDS, *DEDICATION_WORDS) \
            & ~F.coalesce(before.isin(*DEDICATION_WORDS), F.lit(False))

    first = F.array_position(F.transform("_w", own), True).cast("int")  # 0: no word of its own
    lengths = F.when(first > 0, F.sequence(first, F.size("_w")))
    prefix = F.struct(F.col("_n"), F.array_join(F.slice("_w", 1, F.col("_n")), " ").alias("_prefix"))
    tree = words.select("facility_id", "_w", F.explode(lengths).alias("_n")) \
        .select("facility_id", prefix.alias("_p")).select("facility_id", "_p.*")
    shared = tree.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_support")) \
        .filter(F.col("_support") >= min_support)
    deepest = tree.join(shared, "_prefix").groupBy("facility_id") \
        .agg(F.max_by("_prefix", "_n").alias("system"))
    return hospitals.select("facility_id", "facility_name").join(deepest, "facility_id", "left") \
        .orderBy("facility_id")
