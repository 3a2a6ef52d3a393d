"""Records with everything that later steps need of a name and an address, computed once per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def normalise(records: DataFrame, ordinals: bool = False, suffixes: DataFrame | None = None) -> DataFrame:
    """records (entity_id, business_name, business_address, country, ...) plus nclean, core, nskel, aclean, atoks, fcore.

    ``suffixes`` (country, suffixes array): learned legal skeletons, one row per country.
    """
    out = records.withColumns(
        {"ntoks": T.name_tokens(F.col("business_name")), "atoks": T.address_tokens(F.col("business_address"), ordinals)}
    )
    extra = None
    if suffixes is not None:
        out = out.join(suffixes, "country", "left")
        extra = F.coalesce("suffixes", F.array().cast("array<string>"))
    out = out.withColumn("core", T.core_tokens(F.col("ntoks"), extra))
    return out.withColumns(
        {
            "nclean": F.array_join("ntoks", " "),
            "nskel": T.name_skeleton(F.col("core")),
            "aclean": F.array_join("atoks", " "),
            "fcore": T.feature_core(F.col("ntoks")),
        }
    ).drop("ntoks", "suffixes")
