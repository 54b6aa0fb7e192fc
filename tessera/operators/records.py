"""JSON records: a canonical form with its checksum, and contracts that a record must keep, each one expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(s: Column) -> Column:
    plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(named.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def _number(x: Column) -> Column:
    """The shortest digits that give a double back: plain from 1e-4 up to 1e16, else with an exponent of two digits or more."""
    own = x.cast("string")
    short = [F.when(F.format_string(f"%.{p}e", x).cast("double") == x, F.format_string(f"%.{p}e", x)) for p in range(16)]
    tiny = (F.abs(x) < 1e-307) & (x != 0)
    s = F.when(tiny, F.coalesce(*short, own)).when(F.length(F.regexp_replace(own, "E.*|[^0-9]", "")) > 15, F.coalesce(*short[14:], own)).otherwise(own)
    sign, whole, rest, power = (F.regexp_extract(s, r"^(-?)([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$", k) for k in (1, 2, 3, 4))
    every = F.concat(whole, rest)
    tail = F.regexp_replace(every, "^0+", "")
    n = F.length(whole) - 1 - (F.length(every) - F.length(tail)) + F.coalesce(power.try_cast("int"), F.lit(0))
    digits = F.regexp_replace(tail, "0+$", "")
    up = F.rpad(digits, F.greatest(n + 1, F.length(digits)), "0")
    plain = F.concat(sign, up.substr(F.lit(1), n + 1), F.lit("."), F.when(F.length(up) > n + 1, up.substr(n + 2, F.length(up))).otherwise("0"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    more = F.when(F.length(digits) > 1, F.concat(F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise("")
    powered = F.concat(sign, F.substring(digits, 1, 1), more, F.lit("e"), F.when(n < 0, "-").otherwise("+"), F.lpad(F.abs(n).cast("string"), F.greatest(F.lit(2), F.length(F.abs(n).cast("string"))), F.lit("0")))
    named = F.when(F.isnan(x), "NaN").when(own.isin("Infinity", "-Infinity"), own).when(x == 0, own)
    return named.when((n >= 0) & (n < 16), plain).when((n < 0) & (n >= -4), small).otherwise(powered)


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON with keys in order at every level and nothing between, whatever the order of the fields: text as it is but for quotes,
    backslashes and control characters, null for null. Structs, arrays, maps with text keys, numbers, booleans, text; dates and the
    rest as text."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("," if i else "{") + '"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '":'), canonical(value[f.name], f.dataType)) for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name))]
        out = F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_text(k.cast("string")), F.lit(":"), canonical(F.element_at(value, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _number(value.cast("double"))
    elif isinstance(kind, T.NumericType):
        out = value.cast("string")
    else:
        out = _text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(out)


def checksums(rows: DataFrame, without: str = "checksum", name: str = "checksum") -> DataFrame:
    """``rows`` with the sha256 of their canonical JSON, the column ``without`` left out."""
    kept = T.StructType([f for f in rows.schema.fields if f.name != without])
    body = canonical(F.struct(*[F.col(f"`{f.name}`") for f in kept.fields]), kept)
    return rows.withColumn(name, F.sha2(F.encode(body, "UTF-8"), 256))


@dataclass(frozen=True)
class Contract:
    """What a JSON object must keep: fields that must be there, fixed values, allowed values, fields that are lists or objects,
    fields that allow no write (an object of which every member is false), and contracts of members and of list items."""

    name: str
    required: tuple[str, ...] = ()
    fixed: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lists: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    locked: tuple[str, ...] = ()
    members: dict[str, Contract] = field(default_factory=dict)
    items: dict[str, Contract] = field(default_factory=dict)


def _by(contract: Contract):
    return lambda x: faults(x, contract)


def faults(record: Column, contract: Contract) -> Column:
    """array<string>: every way in which a record's JSON text breaks its contract; empty if it keeps it."""
    keys = F.json_object_keys(record)
    part = lambda f: F.get_json_object(record, f"$.{f}")
    there = lambda f: F.coalesce(F.array_contains(keys, f), F.lit(False))
    says = lambda test, what: F.when(test, F.lit(f"{contract.name}: {what}"))
    out = [says(keys.isNull(), "is no object")]
    out += [says(keys.isNotNull() & ~there(f), f"{f} is missing") for f in contract.required]
    out += [says(there(f) & ~F.coalesce(part(f) == v, F.lit(False)), f"{f} is not {v}") for f, v in contract.fixed.items()]
    out += [says(there(f) & ~F.coalesce(part(f).isin(list(vs)), F.lit(False)), f"{f} is none of {', '.join(vs)}") for f, vs in contract.allowed.items()]
    out += [says(there(f) & ~F.coalesce(part(f).startswith("["), F.lit(False)), f"{f} is no list") for f in contract.lists]
    out += [says(there(f) & F.json_object_keys(part(f)).isNull(), f"{f} is no object") for f in contract.objects]
    for f in contract.locked:
        open_ = F.coalesce(F.exists(F.map_values(F.from_json(part(f), "map<string, string>")), lambda v: ~F.coalesce(v == "false", F.lit(False))), F.lit(True))
        out.append(says(there(f) & (F.json_object_keys(part(f)).isNull() | open_), f"{f} allows writes"))
    own = F.array_compact(F.array(*out))
    for f, c in contract.members.items():
        own = F.concat(own, F.when(there(f), faults(part(f), c)).otherwise(F.array().cast("array<string>")))
    for f, c in contract.items.items():
        each = F.flatten(F.transform(F.from_json(part(f), "array<string>"), _by(c)))
        own = F.concat(own, F.coalesce(each, F.array().cast("array<string>")))
    return own


# Fields, shapes, spaces and states of picture records.
_REGION = Contract("region", ("region_id", "shape", "bounds", "kind_candidate", "backend_id", "approval_status"), allowed={"shape": ("box", "polygon", "point", "line", "mask_ref")}, objects=("bounds",))
_LOCK = '{"maps": false, "counts": false, "lifetime": false, "lexicon": false}'
AGREEMENTS = ("exact", "near", "missing_visual", "missing_source", "conflict", "unreadable_visual", "source_layout_only", "visual_rescue_candidate")


def region_map(version: str) -> Contract:
    """Regions of a picture in its own pixels or in cells of a grid."""
    return Contract(
        "region map", ("contract_version", "visual_record_id", "region_map_id", "source_hash", "coordinate_space", "regions", "relations", "approval_status", "writes_allowed"), {"contract_version": version},
        {"coordinate_space": ("native_pixels", "grid_cells")}, ("regions", "relations"), locked=("writes_allowed",), items={"regions": _REGION},
    )


def two_sided(version: str) -> Contract:
    """Text of a region as the source has it and as it was seen."""
    side = lambda name, authority: Contract(name, ("text", "authority", "permissions"), {"authority": authority}, objects=("permissions",))
    return Contract(
        "two-sided region", ("schema_version", "bilateral_text_region_id", "page_id", "visual_record_id", "region_id", "source_text", "visual_text", "agreement", "approval_status", "writes_allowed"),
        {"schema_version": version, "approval_status": "candidate"}, objects=("agreement",), locked=("writes_allowed",),
        members={"source_text": side("source side", "source_layout_evidence"), "visual_text": side("visual side", "derived_visual_recognition"), "agreement": Contract("agreement", ("status",), allowed={"status": AGREEMENTS})},
    )


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.encode(F.concat_ws("::", *parts), "UTF-8"), 256), 1, 16))


def empty_region_maps(pictures: DataFrame, version: str) -> DataFrame:
    """Pictures (visual_record_id, source_hash) -> record: the JSON of a map without regions."""
    lock = F.from_json(F.lit(_LOCK), "maps boolean, counts boolean, lifetime boolean, lexicon boolean")
    none = F.array().cast("array<string>")
    row = F.struct(
        F.lit(version).alias("contract_version"), "visual_record_id", _id("region_map_", F.lit(version), F.col("visual_record_id"), F.col("source_hash")).alias("region_map_id"), "source_hash",
        F.lit("native_pixels").alias("coordinate_space"), none.alias("regions"), none.alias("relations"), F.lit("candidate").alias("approval_status"), lock.alias("writes_allowed"),
    )
    return pictures.select("visual_record_id", F.to_json(row).alias("record"))


def two_sided_records(pairs: DataFrame, version: str) -> DataFrame:
    """Pairs (page_id, visual_record_id, region_id, source_text, visual_text, agreement, score) -> record: JSON with both sides,
    each with what it may be used for; the source's text may be quoted, what was seen only compared."""
    lock = F.from_json(F.lit(_LOCK), "maps boolean, counts boolean, lifetime boolean, lexicon boolean")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    side = lambda c, authority, quote: F.struct(text(c).alias("text"), F.lit(authority).alias("authority"), F.struct(F.lit(quote).alias("may_quote"), F.lit(True).alias("may_compare")).alias("permissions"))
    key = _id("btext_", F.lit(version), F.col("page_id"), F.col("visual_record_id"), F.col("region_id"), text("source_text"), text("visual_text"))
    row = F.struct(
        F.lit(version).alias("schema_version"), key.alias("bilateral_text_region_id"), "page_id", "visual_record_id", "region_id", side("source_text", "source_layout_evidence", True).alias("source_text"),
        side("visual_text", "derived_visual_recognition", False).alias("visual_text"), F.struct(F.col("agreement").alias("status"), F.col("score").alias("score")).alias("agreement"), F.lit("candidate").alias("approval_status"), lock.alias("writes_allowed"),
    )
    return pairs.select("region_id", F.to_json(row).alias("record"))
