"""From stored items to chosen renditions and names, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import formats as fm, playlists as pl, records as rc


def chosen_items(media: DataFrame, formats: DataFrame, archive: DataFrame | None = None, **rules) -> DataFrame:
    """Accepted items with the fields of their chosen rendition (the stored-record path).

    Items are filtered first, so that renditions of rejected ones are dropped before ranking; then
    prepare, select by the default policy, fit the container, and put the pick onto the item.
    """
    items = rc.fill_common(pl.filter_full(media, archive, **rules))
    mine = formats.join(items.select("media_id"), "media_id", "left_semi")
    picks = fm.default_selection(fm.prepare_formats(mine, sizes=formats), items)
    picks = fm.merged_container(picks).withColumn("ext", F.coalesce("container_ext", "ext")).drop("container_ext")
    return fm.apply_selection(items, picks)


def dead_letters(media: DataFrame, formats: DataFrame) -> DataFrame:
    """Items that cannot be processed, with the reason."""
    checked = rc.validate(media, formats)
    return checked.filter(F.col("reason").isNotNull())
