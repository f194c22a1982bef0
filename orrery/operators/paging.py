"""Pages of a result: budgets and opaque cursors (K2-K4)."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = 1


def node_budget(tokens: Column) -> Column:
    """How many nodes a budget of tokens shows (K2): a fortieth of it, from 20 to 120."""
    return F.least(F.greatest(F.round(tokens / 40), F.lit(20)), F.lit(120)).cast("int")


def fingerprint(*parts: str) -> str:
    """What a cursor belongs to: 24 hex digits of the snapshot, the query and its filters."""
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def cursor(own: str, offset: int) -> str:
    """An opaque position: base64url, without padding, of version, fingerprint and offset (K3)."""
    body = json.dumps({"v": VERSION, "f": own, "o": offset}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def offset_of(text: str | None, own: str) -> int:
    """The offset of a cursor; 0 for none. A malformed cursor, or one of another snapshot or query, is an error."""
    if text is None:
        return 0
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        version, mark, offset = got["v"], got["f"], got["o"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if version != VERSION or mark != own or not isinstance(offset, int) or offset < 0:
        raise ValueError("the cursor belongs to another result")
    return offset


def page(rows: DataFrame, order: list[Column], own: str, at: str | None, size: int) -> DataFrame:
    """The rows after a cursor, with rank from 1, total and next_cursor (null on the last page).

    Spark's top-n keeps offset + size rows a task; only the total is a full pass.
    """
    offset = offset_of(at, own)
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset(offset).limit(size)  # `size` rows: one small window
    shown = shown.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long") + offset)
    after = F.when(F.col("total") > offset + size, F.lit(cursor(own, offset + size)))
    return shown.crossJoin(F.broadcast(total)).withColumn("next_cursor", after)  # one row
