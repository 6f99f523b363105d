"""Whether a session's presentations say the same of their images in all places where they say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contrasts that a shown image may have.
CONTRASTS = (0.7, 1.0)


def stimulus_semantics(presentations: DataFrame, alignment: DataFrame, *, by: list[str], source: str = "source", image: str = "image_id", contrast: str = "contrast", label: str = "is_image_novel", omitted: str = "omitted", designated: str = "is_designated_novel", exposure: str = "exposure", novel: str = "novel_image", novel_contrast: str = "novel_contrast", aligned: str = "passes") -> DataFrame:
    """A row per session (by, which holds source): counts of what is inconsistent, and passes if nothing is.

    Shown presentations (not omitted) need an image and a contrast that could be read, an allowed contrast, a novelty label that isn't null and agrees with
    the session's designated image, and an exposure; the session one designated image, of full contrast, that is shown. alignment: (source, aligned) by trial;
    a session without trials there has no mismatches. Consistency says nothing of earlier exposure.
    """
    shown = ~F.coalesce(F.col(omitted), F.lit(False))
    count = lambda c: F.count_if(shown & c)
    sessions = presentations.groupBy(*by).agg(
        F.count("*").alias("n_presentations"), F.count_if(shown).alias("n_shown"), count(F.col(image).isNull() | F.col(contrast).isNull()).alias("n_unread_images"), count(~F.coalesce(F.col(contrast).isin(*CONTRASTS), F.lit(False))).alias("n_other_contrasts"),
        count(F.col(label).isNull()).alias("n_missing_labels"), count(F.coalesce(F.col(label) != F.col(designated), F.lit(True))).alias("n_label_mismatches"), count(F.col(exposure).isNull()).alias("n_missing_exposures"),
        F.countDistinct(novel).alias("n_novel_images"), F.countDistinct(novel_contrast).alias("n_novel_contrasts"), F.coalesce(F.every(F.col(novel_contrast) == 1.0), F.lit(True)).alias("novel_is_full"), F.count_if(F.col(designated)).alias("n_designated"),
    )
    trials = alignment.groupBy(source).agg(F.count_if(~F.col(aligned)).alias("n_trial_mismatches"))
    out = sessions.join(trials, source, "left").fillna(0, ["n_trial_mismatches"])
    none = [F.col(c) == 0 for c in ("n_unread_images", "n_other_contrasts", "n_missing_labels", "n_label_mismatches", "n_missing_exposures", "n_trial_mismatches")]
    ok = (F.col("n_novel_images") == 1) & (F.col("n_novel_contrasts") == 1) & F.col("novel_is_full") & (F.col("n_designated") > 0)
    for c in none:
        ok = ok & c
    return out.withColumn("passes", ok)
