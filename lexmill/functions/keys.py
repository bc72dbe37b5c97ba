"""Deterministic keys: slugs, version-5 UUIDs and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

YEAR_SUFFIX = r"\s*\(([0-9]{4})\)\s*$"


def uuid5(name: Column, namespace: str) -> Column:
    """Version-5 UUID, computed by native functions only."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    # two top bits of the clock field become binary 10
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def chunk_uuid(content: Column) -> Column:
    """Two hashing steps: the content under the entity space, then the chunk space."""
    inner = uuid5(F.sha1(content), C.ENTITY_NAMESPACE)
    return uuid5(inner, C.CHUNK_NAMESPACE)


def slug(title: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(title, YEAR_SUFFIX, "")))
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_year(title: Column) -> Column:
    return F.regexp_extract(title, YEAR_SUFFIX, 1).try_cast("int")


def entity_id(title: Column, year: Column) -> Column:
    """Slug with the year appended once when it is known."""
    return F.concat_ws("-", slug(title), year.cast("string"))
