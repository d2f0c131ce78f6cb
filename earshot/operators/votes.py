"""Votes, themes and macro categories of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.labels import SILENCE, THEME_RULES, UNCLASSIFIED, LabelMap, theme_of, with_catalog


def macro_of(label: Column, theme: Column, labels: LabelMap) -> Column:
    """Override first, then the theme's macro."""
    out = F.lit(UNCLASSIFIED)
    for t, m in labels.theme_to_macro.items():
        out = F.when(theme == t, F.lit(m)).otherwise(out)
    for k, m in labels.overrides.items():
        out = F.when(label == k, F.lit(m)).otherwise(out)
    return F.when(label.isNull() | (label == ""), F.lit(UNCLASSIFIED)).otherwise(out)


def with_themes(chunks: DataFrame, name: str = "top_label", rules=THEME_RULES) -> DataFrame:
    """``chunks`` with the theme of a label column."""
    renamed = theme_of(chunks.withColumn("display_name", F.col(name)), rules)
    return renamed.withColumn("theme", F.when(F.col(name).isNotNull(), F.col("theme"))).drop("display_name")


def with_votes(chunks: DataFrame, labels: LabelMap = LabelMap(), rules=THEME_RULES, catalog: DataFrame | None = None) -> DataFrame:
    """``chunks`` with theme, ``vote`` (null where not eligible), macro and category.

    Themes come from ``catalog`` (display_name, theme) where one is given, by the
    rules otherwise.
    """
    out = with_themes(chunks, rules=rules) if catalog is None else with_catalog(chunks, catalog)
    label = F.col("top_label")
    ok = (
        ~F.col("gated")
        & ~F.coalesce(F.col("clap_status") == "gated", F.lit(False))
        & (F.trim(label) != "")
        & ~label.isin("gated", "n/a", *labels.blacklist)
        & (F.col("top_confidence") >= F.lit(labels.min_confidence))
        & ~F.coalesce(F.col("theme").isin(*labels.blacklist_themes), F.lit(False))
    )
    out = out.withColumn("vote", F.when(ok, label))
    macro = macro_of(F.col("vote"), F.when(F.col("vote").isNotNull(), F.col("theme")), labels)
    out = out.withColumn("macro", macro)
    return out.withColumn("category", F.when(F.col("gated"), F.lit(SILENCE)).otherwise(F.col("macro")))
