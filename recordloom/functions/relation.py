"""Relation URIs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME

# scheme, one or more slashes, record type, slash, record id, nothing after
_URI = "^" + RELATION_SCHEME + r"/+([^/?#]+)/+([^/?#]+)/?$"


def is_relation(c: Column) -> Column:
    return c.startswith(RELATION_SCHEME)


def relation_type(c: Column) -> Column:
    """Target record type of a relation URI; null where the URI is malformed."""
    return F.get(F.regexp_extract_all(c, F.lit(_URI), F.lit(1)), 0)


def relation_id(c: Column) -> Column:
    """Target record id of a relation URI; null where the URI is malformed."""
    return F.get(F.regexp_extract_all(c, F.lit(_URI), F.lit(2)), 0)


def relation_uri(record_type: Column | str, record_id: Column) -> Column:
    kind = F.lit(record_type) if isinstance(record_type, str) else record_type
    return F.concat(F.lit(RELATION_SCHEME + "/"), kind, F.lit("/"), record_id)
