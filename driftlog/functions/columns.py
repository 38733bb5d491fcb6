"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# The entities and operations a log accepts, and the limits of an envelope.
ENTITIES = ("playlists", "playlist_items", "folders", "likes", "play_events", "queue_state")
OPERATIONS = ("upsert", "delete")
MAX_OP_ID, MAX_ENTITY_ID, MAX_DEPTH, MAX_BYTES = 128, 256, 32, 262_144


def age_days(at: Column, now_ms: int) -> Column:
    """Whole days since ``at``, never negative."""
    return F.greatest(F.lit(0), F.floor((F.lit(now_ms) - at) / DAY_MS)).cast("long")


def json_depth(payload: Column) -> Column:
    """Nesting depth of a JSON text: scalars 0, each object or array one more; brackets inside strings do not count.

    The pattern never goes back, so a string of any length takes no stack.
    """
    bare = F.regexp_replace(payload, r'"(?:[^"\\]++|\\.)*+"', "")
    steps = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")))["most"]


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def blank(text: Column) -> Column:
    """Null, empty or white space of any script only."""
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, OBJECT, ...: the JSON kind of a variant."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def is_object(payload: Column) -> Column:
    """Whether a text is one whole JSON object. The parser overlooks what follows a value, so the text must also stand as the only
    element of an array and as a member of an object."""
    listed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    alone = (kind(F.try_variant_get(listed, "$[0]", "variant")) == "OBJECT") & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"x":'), payload, F.lit("}"))).isNotNull(), F.lit(False))


def found(payload: Column, *spellings: str) -> Column:
    """The value under the first of the spellings that is present, even if its value is null."""
    keys, doc = F.json_object_keys(payload), F.try_parse_json(payload)
    out = F
    for name in spellings:
        out = out.when(F.array_contains(keys, name), F.try_variant_get(doc, f"$.{name}", "variant"))
    return out


def read_string(value: Column) -> Column:
    """Strings as they are and numbers as text; null otherwise."""
    return F.when(kind(value).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "string"))


def read_bool(value: Column) -> Column:
    """true and false, whole numbers other than 0, the words in either case and whole numbers as text; false otherwise."""
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint") != 0)
        .when(kind(value) == "STRING", F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").otherwise(text.try_cast("bigint") != 0)),
        F.lit(False),
    )


def stamp(payload: Column, created_at: Column) -> Column:
    """The payload's updated_at where it is a whole number, else created_at."""
    value = found(payload, "updated_at", "updatedAt")
    return F.coalesce(F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint")), created_at)


def is_deleted(operation: Column, payload: Column) -> Column:
    return (operation == "delete") | read_bool(found(payload, "deleted"))


def playlist_of(entity: Column, entity_id: Column, payload: Column) -> Column:
    """Where an operation is routed: a playlist's own id, or the first spelling of an item's playlist id that is a string."""
    doc = F.try_parse_json(payload)
    text = [F.when(kind(F.try_variant_get(doc, f"$.{name}", "variant")) == "STRING", F.try_variant_get(doc, f"$.{name}", "string")) for name in ("playlist_id", "playlistId")]
    return F.when(entity == "playlists", entity_id).when(entity == "playlist_items", F.coalesce(*text))


HEX = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
GUID_FORMS = rf"^([0-9a-f]{{32}}|{HEX}|\{{{HEX}\}}|\({HEX}\))$"
GUID_PARTS = (8, 4, 4, *[2] * 8)  # digits of the parts of the form {0x..,0x..,0x..,{0x..,...}}
GUID_STRUCT = r"^\{0x([0-9a-f]{1,8}),0x([0-9a-f]{1,4}),0x([0-9a-f]{1,4}),\{" + ",".join([r"0x([0-9a-f]{1,2})"] * 8) + r"\}\}$"


def guid(text: Column) -> Column:
    """A GUID as 32 lower-case hexadecimal digits, from 32 digits, with dashes in their places, in matching braces or parentheses around these, or in hexadecimal parts; white space
    around it is no matter. Null for any other text."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    parts = F.concat(*(F.lpad(F.regexp_extract(bare, GUID_STRUCT, i), n, "0") for i, n in enumerate(GUID_PARTS, 1)))
    return F.when(bare.rlike(GUID_FORMS), F.regexp_replace(bare, "[^0-9a-f]", "")).when(bare.rlike(GUID_STRUCT), parts)


def clamped(value: Column, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def first_fault(max_depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES) -> Column:
    """The first rule an operation breaks, null for a sound one; an operation without any value is no operation."""
    col = F.col
    nothing = F.coalesce(*(col(c).cast("string") for c in ("op_id", "entity", "operation", "entity_id", "payload", "created_at"))).isNull()
    return (
        F.when(nothing, "op")
        .when(blank(col("op_id")) | (utf16_length(col("op_id")) > MAX_OP_ID), "op_id")
        .when(col("entity") == "tracks", "tracks")
        .when(~F.coalesce(col("entity").isin(*ENTITIES), F.lit(False)), "entity")
        .when(~F.coalesce(col("operation").isin(*OPERATIONS), F.lit(False)), "operation")
        .when(blank(col("entity_id")) | (utf16_length(col("entity_id")) > MAX_ENTITY_ID), "entity_id")
        .when(~is_object(col("payload")), "payload")
        .when(json_depth(col("payload")) > max_depth, "depth")
        .when(F.octet_length("payload") > max_bytes, "size")
        .when(F.coalesce(col("created_at"), F.lit(0)) <= 0, "created_at")
    )
