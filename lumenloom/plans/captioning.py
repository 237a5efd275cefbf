"""Images to captions: scores, tags, conflict handling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.tags import stem
from lumenloom.operators.captions import merge_captions, score_items, with_captions, without_caption
from lumenloom.params import CaptionOptions

Scorer = Callable[[DataFrame], DataFrame]


def caption_images(
    images: DataFrame,
    scorer: Scorer,
    tag_dict: DataFrame,
    options: CaptionOptions = CaptionOptions(),
    existing: DataFrame | None = None,
    family: str = "camie",
    skip_captioned: bool = False,
    overwrite: bool = False,
) -> DataFrame:
    """Captions of images (image_id, uri, pixels): (image_id, uri_stem, caption, n_tags, skipped, error).

    Images that already have a caption can be left out before the model sees
    them; otherwise the option's conflict mode resolves old against new.
    """
    keyed = images.withColumn("uri_stem", stem(F.col("uri")))
    if skip_captioned and existing is not None:
        keyed = without_caption(keyed, existing, overwrite)
    scored = scorer(keyed)
    named = scored.join(keyed.select("image_id", "uri_stem"), "image_id")
    good = with_captions(score_items(named.where("error is null"), tag_dict, family), options)
    good = good.select("image_id", "uri_stem", "caption", "n_tags")
    if existing is not None and not skip_captioned:
        good = merge_captions(good, existing, options.conflict_mode).select("image_id", "uri_stem", F.col("merged").alias("caption"), "n_tags", "skipped")
    else:
        good = good.withColumn("skipped", F.lit(False))
    bad = named.where("error is not null").select(
        "image_id", "uri_stem", F.lit(None).cast("string").alias("caption"), F.lit(0).alias("n_tags"), F.lit(False).alias("skipped"), "error"
    )
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
