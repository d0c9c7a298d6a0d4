"""Catalogue and crop search, soil compatibility (ops 3.22-3.28, 9.21, 9.24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.jsonx import normalized_array
from furrow.operators.dedup import first_by_key
from furrow.functions.text import any_keyword, contains_ci

DEFAULT_LIMIT = 10


def search_contains(df: DataFrame, cols: Sequence[str], query: str, order: Sequence[str],
                    limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Rows where ``query`` is a case-insensitive substring of any of ``cols``
    (ops 3.22, 3.23); first ``limit`` in ``order`` (op 7.5, ``None`` = all)."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(contains_ci(c, query), F.lit(False))
    out = df.where(cond)
    return out.orderBy(*order).limit(limit) if limit is not None else out


def range_lower_bound(c) -> Column:
    """``"0.70-0.90"`` -> 0.70; ``"1.05"`` -> 1.05; unparsable -> null (op 9.24)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.split(col, "-", 2)[0]).try_cast("double")


def search_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Rows whose range text starts with a number in [lo, hi]; unparsable skipped (op 3.24)."""
    v = range_lower_bound(col)
    return df.where(v.between(F.lit(lo), F.lit(hi)))


def filter_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Catalogue records whose id starts with a country prefix (op 3.25)."""
    return df.where(F.col(col).startswith(prefix))


def keyword_filter(df: DataFrame, fields: Sequence, keywords: Sequence[str], id_col: str | None = None,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Records matching any keyword in any field (op 3.26); with ``id_col`` once
    per id, the smallest by the other columns in order (op 5.12).  ``columns``
    (id included) are what is kept and, per id, shuffled."""
    found = df.where(any_keyword(fields, keywords)).select(*(columns or df.columns))
    return found if id_col is None else first_by_key(found, [id_col], [c for c in found.columns if c != id_col])


# Messages of the soil check.
SOIL_UNKNOWN_PLANT = "Aucune exigence de sol trouvée pour %s."
SOIL_FITS = "Le sol '%s' est compatible avec %s."
SOIL_DOES_NOT_FIT = "Le sol '%s' n'est pas listé comme compatible avec %s. Sols compatibles: %s."
SOIL_NONE = "aucun"


def soil_compatibility(requests: DataFrame, plants: DataFrame, plant_col: str = "nom_du_plante",
                       soil_col: str = "soil_type", soils_col: str = "nature_des_sols",
                       exact_name: bool = True, dim_plant_col: str = "nom_du_plante") -> DataFrame:
    """Is the farmer's soil among the plant's allowed soils? (op 3.28)

    Soil names compare trimmed and lower-cased; an unknown plant gives
    ``compatible = false`` with its own message.  ``exact_name=False`` matches
    plant names case-insensitively (the planting tool's rule, op 3.27).
    Adds ``compatible``, ``allowed_soils`` and ``message``.
    """
    # normalise the allowed soils once per plant (dimension side), not per request
    soils = F.coalesce(F.col(soils_col), F.array().cast("array<string>"))
    dim = plants.select(F.col(dim_plant_col).alias("__plant"),
                        normalized_array(soils).alias("__norm"),
                        F.array_join(soils, ", ").alias("__allowed"))
    if exact_name:
        cond = F.col(plant_col) == F.col("__plant")
    else:
        cond = F.lower(F.col(plant_col)) == F.lower(F.col("__plant"))
    j = requests.join(dim, cond, "left")
    found = F.col("__plant").isNotNull()
    ok = found & F.coalesce(F.array_contains("__norm", F.lower(F.trim(F.col(soil_col)))), F.lit(False))
    allowed = F.col("__allowed")
    msg = (F.when(~found, F.format_string(SOIL_UNKNOWN_PLANT, F.col(plant_col)))
           .when(ok, F.format_string(SOIL_FITS, F.col(soil_col), F.col(plant_col)))
           .otherwise(F.format_string(SOIL_DOES_NOT_FIT, F.col(soil_col), F.col(plant_col),
                                      F.when(allowed == "", F.lit(SOIL_NONE)).otherwise(allowed))))
    # a missing plant or soil leaves no message
    msg = F.when(F.col(plant_col).isNotNull() & (~found | F.col(soil_col).isNotNull()), msg)
    return j.select(*requests.columns, ok.alias("compatible"), allowed.alias("allowed_soils"), msg.alias("message"))
