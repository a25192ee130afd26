"""Name-based identifiers in column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID | Column, name: Column) -> Column:
    """The RFC 4122 name-based (SHA-1) identifier of a name within a namespace, itself a UUID or a column of their texts; null for a null name.

    Of the digest's first 16 bytes the version's four bits become 5 and the variant's two bits 10."""
    text = F.lit(namespace.hex) if isinstance(namespace, uuid.UUID) else F.replace(namespace, F.lit("-"), F.lit(""))
    digest = F.sha1(F.concat(F.unhex(text), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = (F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.when(digest.isNotNull(), F.concat_ws("-", *parts))
