"""Columns that parse and repair text read from images and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of a collector line, in order of trial: (name, pattern). Group 1 is the number, group 2 the set.
RARITY = "[CURMSPTBL]"
COLLECTOR_PATTERNS = [
    ("multiline", rf"(?i)(\d{{2,}}[a-z]?)\s*/\s*\d+\s+{RARITY}\b.*?([A-Z]{{3}})\b"),
    ("with_rarity", rf"(?i)(\d{{2,}}[a-z]?)\s*(?:/\s*\d+)?\s*[•·.*\s]*{RARITY}\s+([A-Z]{{2,5}})\b"),
    ("separator", r"(?i)(\d{2,}[a-z]?)\s*(?:/\s*\d+)?\s*[•·.*]+\s*([A-Z][A-Z0-9]{1,4})\b"),
    ("space", r"(?i)(\d{2,}[a-z]?)\s*(?:/\s*\d+)?\s+([A-Z][A-Z0-9]{1,4})\b"),
]
NUMBER_ONLY = r"(\d+[a-z]?)(?:\s*/\s*\d+)?"
RARITY_AFTER_TOTAL = rf"(?i)/\s*\d+\s+({RARITY})\b"
RARITY_BEFORE_SET = rf"(?i)({RARITY})\s+[A-Z]{{2,5}}\b"

# Fixed table of characters that readers confuse, each with its replacements in order.
CONFUSED = {"0": "ODQ", "O": "0DQ", "D": "O0", "1": "ILl", "I": "1Ll", "L": "1I", "l": "1IL", "5": "S", "S": "5", "8": "B", "B": "8", "G": "6", "6": "G", "Z": "2", "2": "Z"}

# Fixed patterns of file names.
NUMBER_FIRST_NAME = r"(?i)^([A-Z]?-?\d+)_(.+?)_([a-f0-9]{12,})$"
SET_IN_NAME = r"(?i)([A-Z]{2,5})[-_]?(\d+)"

# Fixed characters and names that file systems refuse.
UNSAFE = '/\\"<>:|?*'
RESERVED = r"^(CON|PRN|AUX|NUL|COM\d|LPT\d)$"


def collector_line(text: Column) -> Column:
    """struct(number, set_code, rarity, pattern) of a collector line; nulls where nothing matched."""
    clean = F.upper(F.trim(text))
    found = lambda p, g: F.regexp_extract(clean, p, g)
    info = lambda number, code, rarity, name: F.struct(F.lower(number).alias("number"), code.cast("string").alias("set_code"), F.nullif(rarity, F.lit("")).alias("rarity"), F.lit(name).cast("string").alias("pattern"))
    rarity = {"multiline": found(RARITY_AFTER_TOTAL, 1), "with_rarity": found(RARITY_BEFORE_SET, 1)}
    null = F.lit(None).cast("string")
    out = F.when(clean.rlike(NUMBER_ONLY), info(found(NUMBER_ONLY, 1), null, F.lit(""), "number_only")).otherwise(info(null, null, F.lit(""), None))
    for name, p in reversed(COLLECTOR_PATTERNS):
        out = F.when(clean.rlike(p), info(found(p, 1), F.upper(found(p, 2)), rarity.get(name, F.lit("")), name)).otherwise(out)
    return out


def substitutions(code: Column) -> Column:
    """array<struct(ord, variant)>: the code itself, then each single replacement from left to right."""
    at = F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1)))
    table = F.create_map(*[x for k, v in CONFUSED.items() for x in (F.lit(k), F.lit(v))])

    def of(i: Column) -> Column:
        options = F.split(F.coalesce(F.try_element_at(table, code.substr(i, F.lit(1))), F.lit("")), "")
        return F.transform(F.filter(options, lambda c: c != ""), lambda c: F.concat(code.substr(F.lit(1), i - 1), c, code.substr(i + 1, F.length(code))))

    every = F.concat(F.array(code), F.flatten(F.transform(at, of)))
    return F.transform(every, lambda v, i: F.struct(i.alias("ord"), v.alias("variant")))


def code_tokens(text: Column) -> Column:
    """Upper-case tokens of 2 to 5 letters or digits, in order."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z0-9]{2,5})\b"), F.lit(1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def file_name_parts(path: Column) -> Column:
    """struct(name, set_code, collector_number) of a file name; nulls for parts that it lacks."""
    stem = file_stem(path)
    null = F.lit(None).cast("string")
    spaced = lambda c: F.nullif(F.translate(c, "_-", "  "), F.lit(""))
    pack = lambda name, code, number: F.struct(name.alias("name"), code.alias("set_code"), number.alias("collector_number"))
    before = F.call_function("substring_index", stem, F.regexp_extract(stem, SET_IN_NAME, 0), F.lit(1))
    before = F.regexp_replace(before, r"^[_-]+|[_-]+$", "")
    return (
        F.when(stem.rlike(NUMBER_FIRST_NAME), pack(F.translate(F.regexp_extract(stem, NUMBER_FIRST_NAME, 2), "_", " "), null, F.regexp_extract(stem, NUMBER_FIRST_NAME, 1)))
        .when(stem.rlike(SET_IN_NAME), pack(spaced(before), F.upper(F.regexp_extract(stem, SET_IN_NAME, 1)), F.regexp_extract(stem, SET_IN_NAME, 2)))
        .otherwise(pack(spaced(stem), null, null))
    )


def finish_of_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("nonfoil"), "nonfoil").when(low.contains("etched"), "etched").when(low.contains("foil"), "foil").otherwise("nonfoil")


def card_id(number: Column, name: Column, source_id: Column, stem: Column, finish: Column) -> Column:
    return F.concat_ws("_", F.coalesce(number, F.lit("unknown")), F.translate(name, " ", "_"), F.coalesce(source_id, F.element_at(F.split(stem, "_"), -1)), finish)


def safe_file_name(number: Column, name: Column, source_id: Column) -> Column:
    return F.concat(number, F.lit("_"), F.translate(name, UNSAFE, "_" * len(UNSAFE)), F.lit("_"), F.substring(source_id, 1, 12), F.lit(".jpg"))


def safe_set_folder(code: Column) -> Column:
    up = F.upper(code)
    return F.when(up.rlike(RESERVED), F.concat(up, F.lit("_"))).otherwise(up)


def title_contained(title: Column, name: Column) -> Column:
    """Whether one of the two contains the other; titles under 3 characters match nothing."""
    t, n = F.lower(F.trim(title)), F.lower(name)
    return (F.length(title) >= 3) & (n.contains(t) | t.contains(n))


def first_word(text: Column) -> Column:
    return F.get(F.split(F.trim(F.lower(text)), r"\s+"), F.lit(0))


def public_reference(image_path: Column, source_id: Column, base: str) -> Column:
    """The local file, or else the address built from the id's first characters."""
    built = F.concat(F.lit(base), F.lit("/"), F.substring(source_id, 1, 1), F.lit("/"), F.substring(source_id, 2, 1), F.lit("/"), source_id, F.lit(".jpg"))
    return F.coalesce(image_path, built)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
