"""String expressions: names, templates, caps, number rendering, placement, clean-up."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, all of them data that results are compared with: the placement sentences,
# the flags in their order, and the synonyms of materials.
PLACEMENT = {
    "onCeiling": "typically mounted on a ceiling",
    "onWall": "typically mounted on a wall",
    "onFloor": "typically placed on the floor",
    "onObject": "typically placed on top of other objects",
    "onFloor,onObject": "typically placed on the floor or on other objects",
}
NO_PLACEMENT = "with no typical placement"
FLAGS = ("onCeiling", "onWall", "onFloor", "onObject")
SYNONYMS = {
    "metallic": "metal",
    "metals": "metal",
    "wooden": "wood",
    "plastics": "plastic",
    "fabrics": "fabric",
    "textile": "fabric",
    "glassy": "glass",
    "ceramics": "ceramic",
    "rubbery": "rubber",
    "leathery": "leather",
    "papery": "paper",
    "stones": "stone",
}
# Words that give away that a sentence speaks of coordinates instead of a relation: places
# and turns in numbers, one axis with a value, a distance with its unit, the frame itself.
COORDINATE_WORDS = r"(?i)\b(?:coordinates?|positions?|rotations?|rotated|orientations?|yaw|degrees|[xyz] ?[=:] ?-?[0-9]|[0-9.]+ ?(?:m|cm|metres|meters)\b|world (?:frame|space))"

def contract_id(family: str, version: int, rules: dict) -> str:
    """A name for a set of rules: family, version and 16 digits of the digest of all of them,
    in key order, so that no edit goes unnoticed."""
    text = json.dumps(rules, sort_keys=True, ensure_ascii=False)
    return f"{family}_v{version}@{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def humanise(c: Column) -> Column:
    return F.trim(F.translate(F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", " ")), "_", " "))


def cap(c: Column, n: int) -> Column:
    """At most n characters and a full stop, cut at a word."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*\z", ""), r"[ ,;:]+\z", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit(".")))


def decimal_text(c: Column) -> Column:
    """One decimal, half-even on the exact binary value, without a trailing .0."""
    return F.regexp_replace(F.call_function("format_number", c, F.lit("0.0")), r"[.]0\z", "")


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def placement(flags: dict[str, Column]) -> Column:
    on = F.filter(F.array(*[F.when(flags[f], F.lit(f)) for f in FLAGS]), lambda f: f.isNotNull())
    known = F.try_element_at(_map(PLACEMENT), F.array_join(on, ","))
    phrases = F.transform(on, lambda f: F.element_at(_map(PLACEMENT), f))
    rest = F.transform(F.slice(phrases, 2, 4), lambda p: F.regexp_replace(p, "^[^ ]+ [^ ]+ ", ""))
    joined = F.array_join(F.concat(F.slice(phrases, 1, 1), rest), " or ")
    return F.when(F.size(on) == 0, NO_PLACEMENT).otherwise(F.coalesce(known, joined))


def fold_synonyms(materials: Column) -> Column:
    return F.array_distinct(F.transform(materials, lambda m: F.coalesce(F.try_element_at(_map(SYNONYMS), F.lower(F.trim(m))), F.lower(F.trim(m)))))


def sentence(description: Column, category: Column, materials: Column, width: Column, length: Column, height: Column, place: Column) -> Column:
    """One record as prose; null where materials are empty, which is a violation."""
    d = cap(F.trim(description), 120)
    d = F.when((d == "") | d.endswith("."), d).otherwise(F.concat(d, F.lit(".")))
    kind = capitalise(F.regexp_replace(cap(category, 40), r"[.]+\z", ""))
    size = F.concat(F.lit(", roughly "), decimal_text(width), F.lit(" by "), decimal_text(length), F.lit(" by "), decimal_text(height), F.lit(" centimetres, "))
    whole = F.concat(d, F.lit(" "), kind, F.lit(" made of "), F.array_join(F.slice(materials, 1, 3), ", "), size, place, F.lit("."))
    return F.when(F.size(materials) > 0, whole)


def names_of(objects: list[Column]) -> Column:
    """The words of three letters or more of some descriptions, in lower case."""
    words = [F.regexp_extract_all(F.lower(F.coalesce(o, F.lit(""))), F.lit(r"(\p{L}{3,})"), 1) for o in objects]
    return F.array_distinct(F.concat(*words))


def unwrap(raw: Column, *objects: Column) -> Column:
    """A model's sentence about `objects` without fences, heading, quotes and later lines.

    What stands before a first colon (with a blank after it) is a heading and goes unless it
    names one of the objects: a sentence about them that has a colon does.
    """
    t = F.regexp_replace(F.regexp_replace(raw, "```[a-z]*", ""), r"^\s+", "")
    head = F.regexp_extract(t, r"^([^:\n]*):\s", 1)
    told = F.arrays_overlap(names_of([head]), names_of(list(objects)))
    t = F.when(told, t).otherwise(F.regexp_replace(t, r"^[^:\n]*:\s+", ""))
    line = F.split_part(F.regexp_replace(t, r"^\s+|\s+\z", ""), F.lit("\n"), F.lit(1))
    return F.regexp_replace(line, "^[\"']+|[\"']+\\z", "")


def json_object(raw: Column) -> Column:
    """From the first opening to the last closing brace, else null."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def key_field(key: Column, n: int, sep: str = "|") -> Column:
    """The n-th field of a key, or the whole key if that is missing or empty."""
    return F.coalesce(F.nullif(F.split_part(key, F.lit(sep), F.lit(n)), F.lit("")), key)


def repair_prompt(answer: Column, why: Column, most: int = 300) -> Column:
    """What a model is told of an answer that was refused: why, and how it began."""
    return F.concat(F.lit("The last answer failed: "), why, F.lit(". It began: "), F.substring(answer, 1, most), F.lit(". Answer again."))


def content_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def overridden(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, overridden, digest): settings with those that replace them; a key that the
    base lacks is not added. The digest is that of "key:value"."""
    new = over.select(F.col(key).alias("k_"), F.col(value).alias("v_"), F.lit(True).alias("o_"))
    v = F.coalesce("v_", F.col(value))
    digest = F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), v), 256)
    return base.join(new, F.col(key) == F.col("k_"), "left").select(key, v.alias(value), F.col("o_").isNotNull().alias("overridden"), digest.alias("digest"))
