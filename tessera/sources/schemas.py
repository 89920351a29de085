"""Schemas of the engine's relations and files."""

from pyspark.sql import types as T

_COLUMN = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "v": T.ArrayType(T.FloatType()), "S": T.ArrayType(T.StringType())}


def _of(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _COLUMN[k]) for n, k in (x.split(":") for x in text.split())])


CARDS = _of("id:s scryfall_id:s name:s set_code:s collector_number:s finish:s variant_type:s frame_effects:S image_path:s tcgplayer_id:i tcgplayer_etched_id:i created_at:t")
HASH_VARIANTS = _of("id:i card_id:s variant_type:s phash:s")
EMBEDDINGS = _of("card_id:s embedding:v full_embedding:v collector_embedding:v name_embedding:v weight_full:d weight_collector:d weight_name:d")
BATCHES = _of("id:s user_id:s status:s total_cards:i processed_cards:i set_code:s created_at:t completed_at:t")
_CANDIDATE = _of("card_id:s card_name:s set_code:s collector_number:s finish:s combined_score:d image_path:s")
CANDIDATES = T.ArrayType(_CANDIDATE)
BATCH_RESULTS = T.StructType(
    [
        *_of("id:i batch_id:s image_id:s image_filename:s image_path:s matched_card_id:s confidence:d clarity_score:d is_ambiguous:b").fields,
        T.StructField("candidates", CANDIDATES),
        *_of("detected_finish:s ocr_set_code:s ocr_collector_number:s is_corrected:b corrected_card_id:s correction_reason:s corrected_at:t").fields,
    ]
)
_URIS = T.StructType([T.StructField("large", T.StringType())])
SOURCE_ITEM = T.StructType(
    [
        *_of("id:s name:s set:s collector_number:s lang:s digital:b").fields,
        T.StructField("image_uris", _URIS),
        T.StructField("card_faces", T.ArrayType(T.StructType([T.StructField("image_uris", _URIS)]))),
        *_of("finishes:S frame_effects:S full_art:b promo:b promo_types:S tcgplayer_id:i tcgplayer_etched_id:i").fields,
    ]
)
SKUS = _of("scryfall_id:s mp_product_id:s market_price:d condition_short:s finish:s language:s")
PREDICTIONS = _of("scanned_path:s match_card_id:s matched_card_id:s confidence:s candidates:s processing_time:s")
GOLD = _of("scanned_path:s correct_card_id:s")
