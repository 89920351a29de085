"""Columns of the scoring and decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import CONFIG


def fused_score(embedding: Column, hash_score: Column, config=CONFIG) -> Column:
    return config.embedding_weight * embedding + config.hash_weight * hash_score


def keypoint_score(score: Column, similarity: Column, config=CONFIG) -> Column:
    """The score after the keypoint band of a similarity; unchanged where there is none."""
    high, low = config.keypoint_bands
    up = lambda w: F.least(F.lit(1.0), score * (1.0 + w * similarity))
    return F.when(similarity.isNull(), score).when(similarity > high, up(high)).when(similarity > low, up(low)).otherwise(score * config.keypoint_penalty)


def keypoint_boosted(similarity: Column, config=CONFIG) -> Column:
    return F.coalesce(similarity > config.keypoint_bands[1], F.lit(False))


def clarity(s1: Column, s2: Column) -> Column:
    return F.when(s2.isNull(), 1.0).otherwise(s1 - s2)


def ambiguous(s1: Column, s2: Column, s3: Column, config=CONFIG) -> Column:
    return F.when(s2.isNull(), False).when(s3.isNotNull(), s1 - s3 < config.clarity_threshold).otherwise(s1 - s2 < config.clarity_threshold)


def decision(top: Column, is_ambiguous: Column, injected: Column, config=CONFIG) -> Column:
    return (
        F.when(top.isNull(), "no_candidates")
        .when(F.coalesce(injected, F.lit(False)), "ocr_triangulation")
        .when((top >= config.accept_threshold) & is_ambiguous, "ambiguous_high")
        .when(top >= config.accept_threshold, "auto_accept")
        .otherwise("manual_review")
    )


def ocr_gate(top: Column, is_ambiguous: Column, config=CONFIG) -> Column:
    return is_ambiguous | (top < config.accept_threshold)


def boosted(score: Column, weight: float) -> Column:
    return F.least(F.lit(1.0), score + weight)


def _finish_key(raw: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "-_ ", "")


def market_finish(raw: Column) -> Column:
    key = _finish_key(raw)
    return F.when(key.contains("nonfoil") | (key == "nf"), "NF").when(key.contains("etched"), "EF").when(key.contains("foil") | key.contains("surge"), "FO").otherwise("NF")


def sku_fits(sku_finish: Column, raw: Column) -> Column:
    """Whether a SKU's finish is that of a catalogue finish."""
    key, sku = _finish_key(raw), F.upper(F.coalesce(sku_finish, F.lit("")))
    return (key.contains("etched") & sku.contains("ETCHED")) | ((key == "foil") & sku.endswith("FOIL") & ~sku.contains("NON FOIL")) | (key.isin("nonfoil", "nf") & sku.contains("NON FOIL"))


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def variant_type(effects: Column, full_art: Column, promo: Column, promo_types: Column) -> Column:
    has = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(has(effects, "extendedart"), "extended_art")
    for kind in ("showcase", "borderless", "etched"):
        out = out.when(has(effects, kind), kind)
    out = out.when(has(effects, "fullart") | yes(full_art), "full_art")
    for kind in ("serialized", "textured", "stamped"):
        out = out.when(yes(promo) & has(promo_types, kind), kind)
    return out.otherwise("normal")


def regression_status(confidence: Column, before: Column, matched: Column, config=CONFIG) -> Column:
    """PASS, WARN or REGR by confidence; FAIL on another match, NEW without a baseline, NO MATCH without a match."""
    drop = (before > 0) & (before - confidence > config.regression_drop)
    return (
        F.when(matched.isNull(), "NO MATCH")
        .when(before.isNull(), "NEW")
        .when(~matched, "FAIL")
        .when(drop, "REGR")
        .when(confidence >= config.regression_pass, "PASS")
        .otherwise("WARN")
    )
