"""Provider records: raw JSON envelopes to flat intake members, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.arrow import stable_digest
from lamella.functions.text import external_key
from lamella.functions.workers import workers_import

#: Schemas, defaults, the status under which a tax article is in force, agencies by number, marks of closed listings, and tag labels.
TAX = "struct<id: string, label: string, column: string, title: string, content: string, url: string, pubName: string, siteName: string, pubDate: string, cwrq: string, xxgk_aging: string, xxgk_description: string>"
AGENCY = "struct<id: string, advertiser: struct<advertiserId: string>, headline: string, description: string, propertyTypes: array<string>, status: string, saleMode: string, channel: string, priceDetails: struct<displayPrice: string>, bedrooms: double, bathrooms: double, carspaces: double, address: struct<suburb: string, stateAbbreviation: string, postcode: string>>"
LISTING = "struct<listingId: string, channel: string, status: struct<label: string, type: string>, title: string, description: string, propertyType: string, price: struct<display: string>, agency: struct<name: string>, address: struct<suburb: string, streetAddress: string, postcode: string, state: string>>"
IN_FORCE = "全文有效"
AGENCIES = {"12106": "McGrath Box Hill", "37576": "Buxton Balwyn Canterbury"}
CLOSED = ("sold", "withdrawn")
TAX_TAGS = (("发布单位", "pubName"), ("成文日期", "cwrq"), ("发布日期", "pubDate"), ("文件时效", "xxgk_aging"))


def text_or_null(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+\z", "")
    return F.when(t != "", t)


def members(envelopes: DataFrame, provider: str) -> DataFrame:
    """(envelope_id, ordinal, record): the records of each envelope (envelope_id, payload).

    Tax articles come as none, one or a list; agency listings as a list; property listings in tiers.
    """
    p = F.col("payload")
    if provider == "tax":
        total = F.get_json_object(p, "$.searchResultAll.searchTotal")
        raw = F.when(F.startswith(total, F.lit("[")), total).when(F.startswith(total, F.lit("{")), F.concat(F.lit("["), total, F.lit("]")))
        records = F.from_json(raw, f"array<{TAX}>")
    elif provider == "agency":
        records = F.from_json(p, f"array<{AGENCY}>")
    elif provider == "listing":
        records = F.flatten(F.transform(F.from_json(p, f"struct<tieredResults: array<struct<results: array<{LISTING}>>>>")["tieredResults"], lambda t: t["results"]))
    else:
        raise ValueError(f"unknown provider: {provider}")
    return envelopes.select("envelope_id", F.posexplode(records).alias("ordinal", "record"))


def _tag(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), value))


def _fields(provider: str) -> dict[str, Column]:
    """What a provider's record says: texts, facets, whether it is active, tags, and the facts its two digests cover."""
    r = lambda c: F.col(f"record.{c}")
    own = lambda c: text_or_null(r(c))
    if provider == "tax":
        return {
            "key": own("id"), "title": own("title"), "body": own("content"), "is_active": F.coalesce(own("xxgk_aging") == IN_FORCE, F.lit(False)),
            "realm": F.lit("tax_china"), "type": F.coalesce(own("label"), F.lit("unknown")), "channel": F.coalesce(own("column"), F.lit("unknown")), "source_name": F.lit("chinatax.gov.cn"), "untitled": F.lit("无标题文件"),
            "tags": F.array(*[_tag(f"{label}: ", own(c)) for label, c in TAX_TAGS]),
            "content": F.struct(own("title").alias("title"), own("content").alias("description"), own("pubName").alias("publisher"), own("pubDate").alias("publish_date")),
            "meta": F.struct(own("xxgk_aging").alias("effective_status"), own("xxgk_description").alias("effective_description")),
        }
    if provider == "agency":
        number, kind = F.coalesce(r("advertiser.advertiserId"), F.lit("0")), F.get(r("propertyTypes"), 0)
        count = lambda c, name: F.when(r(c).isNotNull(), F.concat(r(c).cast("string"), F.lit(f" {name}")))
        return {
            "key": own("id"), "title": own("headline"), "body": own("description"), "is_active": F.lit(True), "realm": F.lit("realestate_on_market"), "type": F.coalesce(r("saleMode"), F.lit("unknown")), "channel": F.coalesce(kind, F.lit("Unknown")),
            "source_name": F.coalesce(*[F.when(number == k, v) for k, v in AGENCIES.items()], F.concat(F.lit("Domain Generic Agency ("), number, F.lit(")"))), "untitled": F.lit("No Title Available"),
            "tags": F.array(own("address.suburb"), own("address.stateAbbreviation"), own("address.postcode"), count("bedrooms", "bedrooms"), count("bathrooms", "bathrooms"), F.when(r("carspaces") > 0, count("carspaces", "carspaces")), kind),
            "content": F.struct(r("headline"), r("description"), F.concat_ws("-", r("bedrooms").cast("string"), r("bathrooms").cast("string")).alias("features")),
            "meta": F.struct(r("priceDetails.displayPrice").alias("price"), F.coalesce(r("status"), F.lit("unknown")).alias("status"), F.coalesce(r("saleMode"), F.lit("unknown")).alias("sale_mode")),
        }
    closed = F.lit(False)
    for mark in CLOSED:
        closed = closed | F.coalesce(F.contains(F.lower(r("channel")), F.lit(mark)), F.lit(False)) | F.coalesce(F.contains(F.lower(r("status.type")), F.lit(mark)), F.lit(False))
    place = F.array_compact(F.array(*[own(f"address.{c}") for c in ("suburb", "streetAddress", "postcode", "state")]))
    return {
        "key": own("listingId"), "title": own("title"), "body": own("description"), "is_active": ~closed, "realm": F.lit("realestate"), "type": F.lit("listing"), "channel": F.coalesce(own("channel"), F.lit("unknown")),
        "source_name": F.coalesce(r("agency.name"), F.lit("Unknown Agency")), "untitled": F.lit("Untitled Property"),
        "tags": F.array(_tag("Price: ", own("price.display")), _tag("Property Type: ", own("propertyType")), F.when(F.size(place) > 0, F.concat(F.lit("Address: "), F.array_join(place, " | ")))),
        "content": F.struct(r("title"), r("description")),
        "meta": F.struct(r("price.display").alias("price"), r("status.label").alias("status")),
    }


def mapped(records: DataFrame, provider: str) -> DataFrame:
    """Flat members: key, title, body, is_active, facets, tags, semantic tuples, clean_text, and separate digests of content and metadata.

    ``clean_text`` is title and body with a blank line between; what is missing is left out. Digests are those of canonical JSON: keys
    sorted, a missing field as null.
    """
    workers_import(records.sparkSession)
    f = _fields(provider)
    facets = ("realm", "type", "channel", "source_name")
    out = records.select("envelope_id", "ordinal", external_key(f["key"]).alias("key"), *[f[c].alias(c) for c in ("title", "body", "is_active", *facets, "untitled")], F.array_compact(f["tags"]).alias("tags"), *[F.to_json(f[c], {"ignoreNullFields": "false"}).alias(f"_{c}") for c in ("content", "meta")])
    tuples = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in facets], F.struct(F.lit("title").alias("name"), F.coalesce("title", "untitled").alias("value")), F.struct(F.lit("tags").alias("name"), F.array_join("tags", "|").alias("value")))
    return out.select(
        "envelope_id", "ordinal", "key", "title", "body", "is_active", F.array_join(F.array(*[F.concat(F.lit(f"{c}="), c) for c in facets]), ";").alias("facets"), "tags", tuples.alias("semantic_tuples"),
        F.concat_ws("\n\n", "title", "body").alias("clean_text"), stable_digest(F.col("_content")).alias("content_digest"), stable_digest(F.col("_meta")).alias("meta_digest"),
    )


def repeated_keys(flat: DataFrame) -> DataFrame:
    """Keys that an envelope holds more than once: an error of the intake."""
    return flat.where("key is not null").groupBy("envelope_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Records that an envelope may hold.
MOST_RECORDS = 10_000


def envelope_states(flat: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """(envelope_id, n, state) of envelopes of records (envelope_id, key): too_many, invalid_record (a key is missing), repeated (keys that differ in case or outer space alone are one), or ok.

    Nothing is cut: an envelope beyond the bound is an error. Records are counted by key before they meet their envelope.
    """
    each = flat.groupBy("envelope_id", external_key(F.col("key")).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    out = each.groupBy("envelope_id").agg(F.sum("_n").alias("n"), F.max(F.when(F.col("_key").isNotNull(), F.col("_n"))).alias("_most"), F.count_if(F.col("_key").isNull()).alias("_bare"))
    return out.select("envelope_id", "n", F.when(F.col("n") > most, "too_many").when(F.col("_bare") > 0, "invalid_record").when(F.col("_most") > 1, "repeated").otherwise("ok").alias("state"))
