"""Document references: tagged struct on the inside, JSON text at the edge."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of the JSON text. It is read inside an array and inside an object, since a reader
# of a single object would overlook whatever follows it; what follows can close one of the
# two early, but not both.
_WIRE = (
    "array<struct<kind:string,relativePath:string,contentHash:string,displayName:string,"
    "handle:struct<type:string,data:string,uri:string,path:string>>>"
)


def ref_kind(ref: Column) -> Column:
    return ref["kind"]


def is_managed(ref: Column) -> Column:
    """True for a copy the library owns."""
    return ref["kind"] == "managed"


def encode_ref(ref: Column) -> Column:
    """JSON text of a reference; fields that do not belong to its kind are left out."""
    handle = F.struct(
        ref["handle"]["type"].alias("type"),
        F.when(ref["handle"]["type"] == "bookmark", F.base64(ref["handle"]["data"])).alias("data"),
        F.when(ref["handle"]["type"] == "contentUri", ref["handle"]["uri"]).alias("uri"),
        F.when(ref["handle"]["type"] == "path", ref["handle"]["path"]).alias("path"),
    )
    managed = F.to_json(F.struct(
        F.lit("managed").alias("kind"),
        ref["relative_path"].alias("relativePath"),
        ref["content_hash"].alias("contentHash"),
    ))
    external = F.to_json(F.struct(
        F.lit("external").alias("kind"), ref["display_name"].alias("displayName"), handle.alias("handle")
    ))
    return F.when(ref["kind"] == "managed", managed).when(ref["kind"] == "external", external)


def decode_ref(encoded: Column) -> Column:
    """Struct with ``ref`` and ``error``; exactly one of them is set."""
    from shelfmark.functions.text import let

    def checked(raw: Column) -> Column:
        handle = raw["handle"]
        base64_ok = F.try_to_binary(handle["data"], F.lit("base64")).isNotNull()
        error = (
            F.when(encoded.isNull(), F.lit("payload is missing"))
            .when(~F.ltrim(encoded, F.lit(" \t\n\r")).startswith("{") | raw.isNull() | inside.isNull(),
                  F.lit("payload is not an object"))
            .when(not_text, F.lit("field is not text"))
            .when(F.coalesce(raw["kind"], F.lit("")) == "managed", F.when(
                raw["relativePath"].isNull() | raw["contentHash"].isNull(), F.lit("field is missing")))
            .when(F.coalesce(raw["kind"], F.lit("")) != "external", F.concat(
                F.lit("unknown kind: "), F.coalesce(raw["kind"], F.lit("null"))))
            .when(raw["displayName"].isNull() | handle.isNull(), F.lit("field is missing"))
            .when(F.coalesce(handle["type"], F.lit("")) == "bookmark",
                  F.when(~base64_ok, F.lit("bookmark is not base64")))
            .when(F.coalesce(handle["type"], F.lit("")) == "contentUri",
                  F.when(handle["uri"].isNull(), F.lit("field is missing")))
            .when(F.coalesce(handle["type"], F.lit("")) == "path",
                  F.when(handle["path"].isNull(), F.lit("field is missing")))
            .otherwise(F.concat(F.lit("unknown handle type: "), F.coalesce(handle["type"], F.lit("null"))))
        )
        decoded_handle = F.when(raw["kind"] == "external", F.struct(
            handle["type"].alias("type"),
            F.try_to_binary(handle["data"], F.lit("base64")).alias("data"),
            handle["uri"].alias("uri"),
            handle["path"].alias("path"),
        ))
        ref = F.struct(
            raw["kind"].alias("kind"),
            raw["relativePath"].alias("relative_path"),
            raw["contentHash"].alias("content_hash"),
            raw["displayName"].alias("display_name"),
            decoded_handle.alias("handle"),
        )
        return let(error, lambda e: F.struct(F.when(e.isNull(), ref).alias("ref"), e.alias("error")))

    # Numbers, truth values, lists and objects would be read as their JSON text.
    fields = ["$.kind", "$.relativePath", "$.contentHash", "$.displayName", "$.handle.type", "$.handle.data", "$.handle.uri", "$.handle.path"]
    record = F.try_parse_json(encoded)
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(record, p, "variant")), F.lit("VOID")) for p in fields]
    not_text = reduce(lambda a, b: a | b, [~k.isin("STRING", "VOID") for k in kinds])
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    inside = F.from_json(F.concat(F.lit('{"v":'), encoded, F.lit("}")), "struct<v:string>", options)["v"]
    listed = F.from_json(F.concat(F.lit("["), encoded, F.lit("]")), _WIRE, options)
    return let(let(listed, lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))), checked)


def decode_ref_strict(encoded: Column) -> Column:
    """The decoded reference; malformed text fails the query."""
    from shelfmark.functions.text import let

    return let(decode_ref(encoded), lambda d: F.when(
        d["error"].isNotNull(), F.raise_error(F.concat(F.lit("malformed document reference: "), d["error"]))
    ).otherwise(d["ref"]))
