"""Results as JSON and Markdown, canonical digests, and facts from host text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_json


def as_json(rows: DataFrame) -> DataFrame:
    """(json) of every row, its keys in alphabetical order; nulls are left out, keys of maps are sorted."""
    value = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c) if isinstance(rows.schema[c].dataType, T.MapType) else F.col(c)
    return rows.select(F.to_json(F.struct(*map(value, sorted(rows.columns)))).alias("json"))


def canonical_digest(*fields: str) -> Column:
    """SHA-256 of the compact JSON of the fields, keys sorted at every depth, nulls as null."""
    return F.sha2(F.encode(canonical_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), "utf-8"), 256)


def as_markdown(rows: DataFrame, order: list[str]) -> str:
    """A small result as a Markdown table; it comes to the driver, as a report must."""
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.orderBy(*order).toLocalIterator()])


def id_set_text(ids: Column) -> Column:
    """Ascending distinct numbers as a set like 0-3,7; an empty array gives an empty text."""
    ordered = F.array_sort(F.array_distinct(ids))
    marked = F.transform(ordered, lambda x, i: F.struct((x - i).alias("run"), x.alias("x")))
    runs = F.array_distinct(F.transform(marked, lambda m: m["run"]))

    def show(run: Column) -> Column:
        own = F.transform(F.filter(marked, lambda m: m["run"] == run), lambda m: m["x"])
        low, high = F.array_min(own).cast("string"), F.array_max(own).cast("string")
        return F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high))

    return F.array_join(F.transform(runs, show), ",")


def cpu_model(text: Column) -> Column:
    """The first model name of a cpuinfo text, null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^model name\s*:\s*(.+)$", 1)), F.lit(""))


def memory_bytes(text: Column) -> Column:
    """MemTotal of a meminfo text in bytes, null without it."""
    return F.nullif(F.regexp_extract(text, r"(?m)^MemTotal:\s+(\d+) kB$", 1), F.lit("")).cast("bigint") * 1024
