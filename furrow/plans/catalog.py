"""Catalogue statistics and crop-coefficient search (ops 5.10-5.12, 7.4, 1.13, 6.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.text import decode_entities
from furrow.operators.fill import carry_all_before

TOP_COUNTRIES = 20
TOP_CREATORS = 10


def count_top(df: DataFrame, col: str, k: int | None, count_name: str = "n") -> DataFrame:
    """Records per value, most frequent first, ties by value (ops 5.10, 5.11, 7.4)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name)).orderBy(F.col(count_name).desc(), F.col(col))
    return out.limit(k) if k else out


def catalog_summary(df: DataFrame, country_col: str = "country", creator_col: str = "creator",
                    url_col: str = "download_url") -> DataFrame:
    """One row: total records, records with a download URL, distinct countries and creators."""
    return df.agg(F.count(F.lit(1)).alias("n_records"),
                  F.count_if(F.col(url_col).isNotNull() & (F.col(url_col) != "")).alias("n_with_url"),
                  F.countDistinct(country_col).alias("n_countries"),
                  F.countDistinct(creator_col).alias("n_creators"))


def catalog_report(df: DataFrame, tops: dict[str, int], measures: dict[str, F.Column] | None = None) -> DataFrame:
    """(dim, value, n) in one pass over the records: per column of ``tops`` its
    most frequent values (ties by value) and, as dim ``distinct``, how many it
    has; as dim ``summary`` the records and those that each of ``measures``
    counts.  Grouping sets share the scan and the partial counts; the top values
    are cut in the tasks before they meet."""
    dims, measures = list(tops), {"n_records": F.lit(True), **(measures or {})}
    base = df.select(*[F.col(c).cast("string").alias(c) for c in dims], *[F.coalesce(m, F.lit(False)).cast("long").alias(f"m_{k}") for k, m in measures.items()])
    sets = base.groupingSets([[F.col(c)] for c in dims] + [[]], *dims).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *[F.sum(f"m_{k}").alias(f"m_{k}") for k in measures])
    # a bit per column, the first one highest, is 0 where the set groups by it
    full = (1 << len(dims)) - 1
    gid_of = {c: full - (1 << (len(dims) - 1 - i)) for i, c in enumerate(dims)}
    dim = value = limit = F.lit(None)
    for c, g in gid_of.items():
        dim, value, limit = F.when(F.col("gid") == g, F.lit(c)).otherwise(dim), F.when(F.col("gid") == g, F.col(c)).otherwise(value), F.when(F.col("gid") == g, F.lit(tops[c])).otherwise(limit)
    rows = sets.select("gid", "n", dim.alias("dim"), value.alias("value"), limit.alias("k"), *[f"m_{k}" for k in measures])
    ranked = rows.where(F.col("dim").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.col("n").desc(), F.col("value"))))
    top = ranked.where((F.col("place") <= max(tops.values())) & (F.col("place") <= F.col("k"))).select("dim", "value", "n")
    distinct = rows.where(F.col("dim").isNotNull()).groupBy("dim").agg(F.count("value").alias("n")).select(F.lit("distinct").alias("dim"), F.col("dim").alias("value"), "n")
    pairs = F.array(*[F.struct(F.lit(k).alias("value"), F.coalesce(F.col(f"m_{k}"), F.lit(0)).alias("n")) for k in measures])
    summary = rows.where(F.col("gid") == full).select(F.inline(pairs)).select(F.lit("summary").alias("dim"), "value", "n")
    return top.unionByName(distinct).unionByName(summary)


def country_of(id_col: str = "id") -> F.Column:
    """Country of a catalogue id: its first two characters, ``Unknown`` if it has fewer."""
    return F.when(F.length(id_col) >= 2, F.substring(id_col, 1, 2)).otherwise(F.lit("Unknown"))


# ---------------------------------------------------------------- HTML tables (op 1.13)
_TABLE = r"(?is)<table\b[^>]*>(.*?)(?:</table\s*>|\z)"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<td\b[^>]*>.*?</td\s*>"
_SUP = r"(?is)<sup\b[^>]*>.*?</sup\s*>"
_BOLD = r"(?i)<b(?:\s[^>]*)?>"
_COLSPAN = r"""(?is)^<td\b[^>]*?\bcolspan\s*=\s*["']?([^"'\s>]+)"""
_CATEGORY = r"(?i)^[a-p]\.\s+"
KC_VALUES = ("kc_ini", "kc_mid", "kc_end", "max_height_m")


def _cell_texts(cells: F.Column) -> F.Column:
    """The texts of an array of cells, step by step, so that no step reads a
    result twice; footnotes and references are looked for where there are any."""
    no_sup = F.transform(cells, lambda c: F.when(c.rlike("(?i)<sup"), F.regexp_replace(c, _SUP, "")).otherwise(c))
    bare = F.transform(no_sup, lambda c: F.regexp_replace(c, r"(?s)<[^>]+>", ""))
    decoded = F.transform(bare, lambda c: F.when(F.contains(c, F.lit("&")), decode_entities(c)).otherwise(c))
    blank = F.transform(decoded, lambda c: F.regexp_replace(c, r"[\t\n\x0B\f\r \u00a0]+", " "))
    return F.transform(blank, lambda c: F.trim(c))


def html_table_rows(pages: DataFrame, id_col: str, html_col: str, value_cols: Sequence[str] = KC_VALUES) -> DataFrame:
    """Records of the first HTML table of each page.

    The first row is the header and skipped.  ``<sup>`` footnotes are removed
    and character references decoded before cells are read.

    * Category: bold text in the first or second cell and a first cell that
      starts with ``a.`` .. ``p.`` (either case; a single cell must span columns).  It ends the
      current crop, and is a record itself, with its name as crop, if one of
      its values holds a digit.
    * Variant: empty first cell, ``-`` opens the second.  A record of the
      current crop of its category; without one it is left out.
    * Crop: any other row of two cells or more that has a name in the first or
      else the second cell.  A record if it has a value.

    Values start at the third cell, or at the second if the first has
    ``colspan="2"``; ``value_cols`` names them and missing or empty ones are null.
    Category and crop are carried forward over row order per page.
    Output: page id, row_no, category, crop, variant, the values, and
    ``further`` (the cells behind them, if any).
    """
    table_html = F.regexp_extract(F.col(html_col), _TABLE, 1)
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(table_html, F.lit(_ROW), 1)).alias("row_no", "tr")).where("row_no > 0")
    cells = rows.select(id_col, "row_no", F.regexp_extract_all("tr", F.lit(_CELL), 0).alias("raw")) \
        .select(id_col, "row_no", "raw", _cell_texts(F.col("raw")).alias("cells"), F.size("raw").alias("n"))

    def raw(i: int) -> F.Column:
        return F.coalesce(F.get("raw", F.lit(i)), F.lit(""))

    def text(i: int) -> F.Column:
        return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))

    span = F.regexp_extract(raw(0), _COLSPAN, 1)
    is_cat = text(0).rlike(_CATEGORY) & F.when(F.col("n") == 1, ~span.isin("", "1") & raw(0).rlike(_BOLD)) \
        .otherwise(raw(0).rlike(_BOLD) | raw(1).rlike(_BOLD))
    is_var = (F.col("n") > 1) & (text(0) == "") & text(1).startswith("-")
    name = F.coalesce(F.nullif(text(0), F.lit("")), F.nullif(text(1), F.lit("")))
    kind = F.when(is_cat, "category").when(is_var, "variant").when((F.col("n") > 1) & name.isNotNull(), "crop")
    # rows of no kind carry nothing and leave at the end: a filter here would be
    # pushed below the cells, which would then be read twice
    typed = cells.withColumn("kind", kind)

    first = F.when((F.col("kind") != "variant") & (span == "2"), 1).otherwise(2)
    category = F.when(F.col("kind") == "category", F.regexp_replace(text(0), r"^[a-p]\.\s*", ""))

    def value(i: int) -> F.Column:
        v = F.nullif(F.get("cells", first + i), F.lit(""))
        return F.when((F.col("kind") != "category") | v.rlike("[0-9]"), v)

    further = F.slice("cells", first + len(value_cols) + 1, F.greatest(F.col("n") - first - len(value_cols), F.lit(0)))
    typed = typed.select(
        id_col, "row_no", "kind", category.alias("__cat"),
        # a category ends the crop: an empty name is carried from there
        F.when(F.col("kind") == "category", "").when(F.col("kind") == "crop", name).alias("__crop"),
        F.when(F.col("kind") == "variant", F.regexp_replace(text(1), r"^-\s*", "")).alias("variant"),
        *[value(i).alias(v) for i, v in enumerate(value_cols)], further.alias("further"))
    carried = carry_all_before(typed, [id_col], ["row_no"], {"__cat": "__cat_prev", "__crop": "__crop_prev"})
    crop = F.when(F.col("kind") == "category", F.col("__cat")).when(F.col("kind") == "crop", F.col("__crop")) \
        .otherwise(F.nullif(F.col("__crop_prev"), F.lit("")))
    has_value = F.coalesce(*[F.col(v) for v in value_cols]).isNotNull()
    return (carried.withColumn("crop", crop)
            .where(F.col("kind").isNotNull() & F.col("crop").isNotNull() & ((F.col("kind") == "variant") | has_value))
            .select(id_col, "row_no", F.coalesce("__cat", "__cat_prev").alias("category"), "crop", "variant", *value_cols, "further"))


def kc_values(kc: DataFrame, cols: Sequence[str] = ("kc_ini", "kc_mid", "kc_end")) -> DataFrame:
    """Typed lower bounds of the Kc range texts."""
    from furrow.operators.search import range_lower_bound
    return kc.select("*", *[range_lower_bound(c).alias(f"{c}_lo") for c in cols])
