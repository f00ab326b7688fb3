"""Stable keys: message ids, thread hashes, hash-derived integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleyspark.functions.text import normalise, strip


def stable_int(*parts) -> Column:
    """First 48 bits of the MD5 of the parts joined by '|'."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Deterministic uniform in [0, 1) with four decimals."""
    return (stable_int(*parts) % F.lit(10000)).cast("double") / F.lit(10000.0)


def split_name(key: Column) -> Column:
    """80/10/10 split by hash of the key."""
    h = stable_int("split", key) % 100
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")


def paired_split_name(pair_index: Column) -> Column:
    """Split by shared line index, so one line never crosses splits."""
    m = pair_index % 10
    return F.when(m == 0, "test").when(m == 1, "val").otherwise("train")


def contact_name(contact: Column, default: str) -> Column:
    stripped = strip(contact)
    return F.coalesce(F.when(stripped != "", stripped), F.lit(default))


def incident_id(contact: Column, text: Column) -> Column:
    chat = contact_name(contact, "Unknown chat")
    return F.sha2(F.concat(chat, F.lit("\n"), F.lower(strip(text))), 256)


def thread_hash(turns: Column) -> Column:
    return F.md5(F.array_join(F.transform(turns, normalise), "\n"))
