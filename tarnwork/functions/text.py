"""Column functions on names, ids and loosely typed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_site_id(x: Column) -> Column:
    """Trimmed, without a trailing ".0", digits padded to eight."""
    t = F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")
    return F.when(t.rlike(r"^\d{1,7}$"), F.lpad(t, 8, "0")).otherwise(t)


def safe_token(x: Column) -> Column:
    """For file names: `:`, `/` and space become `-`, other signs go; `unknown` if nothing stays."""
    t = F.regexp_replace(F.regexp_replace(x.cast("string"), "[:/ ]", "-"), r"[^\p{L}\p{N}_.-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"[^\p{L}\p{N}_.-]", "_")


def normal_label(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def plain_path(x: Column) -> Column:
    """A path without the scheme of local files, which Spark's sources write in different ways; other schemes stay."""
    return F.regexp_replace(x, "^file:/+", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def to_double(x: Column) -> Column:
    """A number or null; NaN counts as missing."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def to_time(x: Column) -> Column:
    return x.try_cast("timestamp").cast("timestamp_ntz")


def _first_text(item: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(item, f"$.{k}", "string"), F.lit("")) for k in keys])


def items_of(payload: Column) -> Column:
    """The list of a payload that is a JSON list, or an object with one under items, files or value."""
    v = F.try_parse_json(payload)
    empty = F.lit(None).cast("array<variant>")
    listed = [F.try_variant_get(v, "$", "array<variant>")]
    for k in ("items", "files", "value"):
        a = F.try_variant_get(v, f"$.{k}", "array<variant>")
        listed.append(F.when(F.size(a) > 0, a).otherwise(empty))
    return F.coalesce(*listed, F.array().cast("array<variant>"))


def item_name(item: Column) -> Column:
    """The name of a listed item: itself, or its first usable of five keys."""
    return F.coalesce(F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string")), _first_text(item, ("name", "filename", "fileName", "key", "s3Key")))


def qualifiers(raw: Column, keys: tuple[str, ...] = ("qualifierCode", "value", "qualifierDescription")) -> Column:
    """A comma-joined text of a scalar, or of a list of texts and objects; objects without a usable key are left out."""
    v = F.try_parse_json(raw)
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    names = F.transform(listed, lambda x: F.coalesce(F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")), _first_text(x, keys)))
    return F.when(raw.isNull(), "").otherwise(F.array_join(F.filter(names, lambda x: x.isNotNull()), ","))


def crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))
