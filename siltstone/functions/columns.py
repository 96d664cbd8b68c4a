"""Column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_reserved = "CON PRN AUX NUL " + " ".join(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))
RESERVED = tuple(_reserved.split())


def utf8(text: Column) -> Column:
    return F.encode(text.cast("string"), "utf-8")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def padded(size: Column, block: int) -> Column:
    """Bytes of a payload with its 8-byte length, in whole blocks."""
    return ((size + 8 + block - 1) / block).cast("bigint") * block


def pad(content: Column, block: int) -> Column:
    """The content behind its length, 8 big-endian bytes, and zeros up to whole blocks."""
    size = F.octet_length(content).cast("bigint")
    fill = (padded(size, block) - 8 - size).cast("int")
    return F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), content, F.unhex(F.repeat(F.lit("00"), fill)))


def unpad(padded_content: Column, block: int) -> Column:
    """The content of pad(); null where the size isn't one that pad() gives."""
    size, size_all = F.conv(F.hex(F.substring(padded_content, 1, 8)), 16, 10).cast("bigint"), F.octet_length(padded_content)
    return F.when((size_all >= 8) & (size_all == padded(size, block)), F.substring(padded_content, F.lit(9), size.cast("int")))


def varint_length(value: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def human_size(size: Column) -> Column:
    """Bytes as B, or with two decimals (ties to even) in KiB, MiB, GiB, TiB."""
    out = F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", F.bround(size / float(1024**power), 2)))
    return out.otherwise(F.format_string("%.2f TiB", F.bround(size / float(1024**4), 2)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mib_per_second(size: Column, seconds: Column) -> Column:
    return ratio(size / float(1 << 20), seconds)


def portable_path(path: Column) -> Column:
    """Whether a relative path is valid everywhere: no empty, dot or parent component, no backslash, control or reserved
    character, no component that ends in a dot or blank or is a device name, at most 65535 bytes. Null gives null."""
    parts = F.split(path, "/", -1)
    bad = F.exists(
        parts,
        lambda p: (p == "") | p.isin(".", "..") | p.rlike("[ .]$") | p.rlike('[<>:"\\\\|?*\\x00-\\x1f]') | F.upper(F.split_part(p, F.lit("."), F.lit(1))).isin(*RESERVED),
    )
    return (F.octet_length(path) <= 65535) & ~bad


#: First bytes of containers, as hex, and their kinds; SLT0 opens a framed file of this engine.
MAGICS = {"534C5430": "frames", "50415231": "parquet", "4F626A01": "avro", "1F8B": "gzip", "504B0304": "zip", "28B52FFD": "zstd", "FD377A585A00": "xz", "425A68": "bzip2", "377ABCAF271C": "7z"}


def sniff(content: Column) -> Column:
    """The container kind by its first bytes, or unknown; null for null content."""
    out = F.when(content.isNull(), None)
    for magic, kind in MAGICS.items():
        out = out.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, kind)
    return out.otherwise("unknown")


def length_prefixed(*fields: Column) -> Column:
    """The UTF-8 fields, each after its length as four big-endian bytes."""
    return F.concat(*(x for f in fields for x in (F.unhex(F.lpad(F.hex(F.octet_length(f).cast("bigint")), 8, "0")), F.encode(f, "utf-8"))))


def allowance(size: Column) -> Column:
    return F.greatest(F.lit(4096).cast("bigint"), F.ceil(size / 2000).cast("bigint"))


def permission_bits(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o777))
