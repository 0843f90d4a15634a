"""Provider payloads: nested JSON columns flattened onto fixed contracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provider codes and the states they stand for.
RESULT_STATUS = {"0": "paid", "1032": "cancelled", "1037": "expired"}
STILL_PROCESSING_CODES = ("4999",)
STILL_PROCESSING_TEXT = ("under processing", "being processed", "still processing")
CAPTURE_STATUS = {"COMPLETED": "paid", "DECLINED": "failed", "FAILED": "failed", "VOIDED": "cancelled"}

CALLBACK = ("struct<Body: struct<stkCallback: struct<CheckoutRequestID: string, ResultCode: string, ResultDesc: string, "
            "CallbackMetadata: struct<Item: array<struct<Name: string, Value: string>>>>>>")
CAPTURES = ("struct<status: string, message: string, purchase_units: array<struct<payments: struct<captures: "
            "array<struct<id: string, status: string, amount: struct<value: string, currency_code: string>>>>>>>")
ORDER = ("struct<pnr: string, passengers: array<struct<givenName: string, surname: string>>, segments: array<struct<flightNumber: string, "
         "origin: struct<iata: string, city: string, name: string>, destination: struct<iata: string, city: string, name: string>, "
         "departureUtc: string, cabin: string, fareBrand: string, checkedBaggage: struct<pieces: int, weightKg: int>>>>")
BOARD = ("struct<flight_status: string, departure: struct<airport: string, iata: string, delay: string, gate: string, estimated: string, "
         "scheduled: string>, arrival: struct<airport: string, iata: string>>")
AIRLINE = ("struct<status: string, delayMinutes: string, scheduledDepartureUtc: string, estimatedDepartureUtc: string, "
           "departure: struct<name: string, iata: string, gate: string>, arrival: struct<name: string, iata: string>>")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(p) for pair in table.items() for p in pair])[key]


def result_status(code: Column) -> Column:
    return F.coalesce(_lookup(RESULT_STATUS, F.trim(code)), F.lit("failed"))


def parse_callbacks(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Callback outcome rows; payloads without a checkout id or a code are dropped."""
    call = F.from_json(payload, CALLBACK)["Body"]["stkCallback"]
    rows = df.select(*keep, call.alias("c")).filter(F.col("c.CheckoutRequestID").isNotNull() & F.col("c.ResultCode").isNotNull())
    items = F.coalesce("c.CallbackMetadata.Item", F.array().cast("array<struct<Name:string,Value:string>>"))
    # A repeated name keeps its last value.
    last = F.filter(items, lambda i: i["Name"].isNotNull())

    def value(name: str) -> Column:
        return F.try_element_at(F.filter(last, lambda i: i["Name"] == name), F.lit(-1))["Value"]

    return rows.select(
        *keep, F.col("c.CheckoutRequestID").alias("checkout_id"), result_status(F.col("c.ResultCode")).alias("status"),
        F.col("c.ResultCode").alias("result_code"), F.coalesce("c.ResultDesc", F.lit("")).alias("detail"),
        value("Amount").try_cast("double").alias("amount"), value("MpesaReceiptNumber").alias("receipt"),
        F.nullif(value("PhoneNumber"), F.lit("")).alias("phone_number"))


def interpret_status(code: Column, description: Column) -> Column:
    """Status of a queried payment, NULL while the payer has not finished."""
    text = F.lower(F.coalesce(description, F.lit("")))
    waiting = code.isNull() | F.trim(code).isin(*STILL_PROCESSING_CODES) | text.rlike("|".join(STILL_PROCESSING_TEXT))
    return F.when(~waiting, result_status(code))


def parse_captures(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """First capture of the first unit; an order without one is still pending (NULL)."""
    body = F.from_json(payload, CAPTURES)
    capture = F.get(F.get(F.col("b.purchase_units"), F.lit(0))["payments"]["captures"], F.lit(0))
    rows = df.select(*keep, body.alias("b")).withColumn("capture", capture)
    return rows.select(
        *keep, _lookup(CAPTURE_STATUS, F.col("capture.status")).alias("status"),
        F.coalesce("capture.status", "b.message", "b.status", F.lit("not captured")).alias("detail"),
        F.col("capture.id").alias("receipt"), F.col("capture.amount.value").try_cast("double").alias("amount"),
        F.col("capture.amount.currency_code").alias("currency"))


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _place(name: Column, code: Column) -> Column:
    label, short = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))
    return (F.when((label != "") & (short != ""), F.concat(label, F.lit(" ("), short, F.lit(")")))
            .otherwise(F.coalesce(F.nullif(label, F.lit("")), F.nullif(short, F.lit("")))))


def _contract(source: str, number: Column, origin: Column, destination: Column, status: Column, delay: Column, gate: Column,
              estimated: Column, retrieved: Column) -> list[Column]:
    route = F.when(origin.isNotNull() & destination.isNotNull(), F.concat(origin, F.lit(" -> "), destination))
    return [F.lit(source).alias("source"), F.lit(True).alias("is_live"), F.lit(True).alias("available"), number.alias("flight_number"),
            route.alias("route"), _present(status).alias("status"), delay.try_cast("int").alias("delay_minutes"), _present(gate).alias("gate"),
            _present(estimated).alias("estimated_departure_utc"), retrieved.alias("retrieved_at_utc"), F.lit(None).cast("string").alias("reason")]


def normalise_flights(df: DataFrame, payload: str, number: str, retrieved: str, feed: str) -> DataFrame:
    """A ``board`` or ``airline`` feed on the shared contract; what a feed leaves out stays NULL."""
    rows = df.select(F.col(number).alias("number"), F.col(retrieved).alias("retrieved"),
                     F.from_json(payload, BOARD if feed == "board" else AIRLINE).alias("f"))
    if feed == "board":
        return rows.select(*_contract(
            "board_live", F.col("number"), _place(F.col("f.departure.airport"), F.col("f.departure.iata")),
            _place(F.col("f.arrival.airport"), F.col("f.arrival.iata")), F.col("f.flight_status"), F.col("f.departure.delay"),
            F.col("f.departure.gate"), F.coalesce(_present(F.col("f.departure.estimated")), F.col("f.departure.scheduled")), F.col("retrieved")))
    return rows.select(*_contract(
        "airline_live", F.col("number"), _place(F.col("f.departure.name"), F.col("f.departure.iata")),
        _place(F.col("f.arrival.name"), F.col("f.arrival.iata")), F.lower("f.status"), F.col("f.delayMinutes"), F.col("f.departure.gate"),
        F.coalesce(_present(F.col("f.estimatedDepartureUtc")), F.col("f.scheduledDepartureUtc")), F.col("retrieved")))


def combine_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def flatten_orders(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """One row per segment with the travellers' full names; an order without segments keeps one row."""
    rows = df.select(*keep, F.from_json(payload, ORDER).alias("o"))
    names = F.filter(F.transform("o.passengers", lambda p: F.concat_ws(" ", _present(p["givenName"]), _present(p["surname"]))),
                     lambda n: F.length(n) > 0)
    s = F.col("s")
    return rows.select(*keep, F.col("o.pnr").alias("pnr"), names.alias("passengers"), F.posexplode_outer("o.segments").alias("segment_no", "s")).select(
        *keep, "pnr", "passengers", "segment_no", _present(F.upper(s["flightNumber"])).alias("flight_number"),
        F.coalesce(_present(s["origin"]["city"]), s["origin"]["name"]).alias("origin"), s["origin"]["iata"].alias("origin_code"),
        F.coalesce(_present(s["destination"]["city"]), s["destination"]["name"]).alias("destination"), s["destination"]["iata"].alias("destination_code"),
        s["departureUtc"].alias("departure_utc"), s["cabin"].alias("cabin"), s["fareBrand"].alias("fare_brand"),
        F.when(s["checkedBaggage"].isNotNull(), F.struct(
            s["checkedBaggage"]["pieces"].alias("pieces"), s["checkedBaggage"]["weightKg"].alias("weight_kg"))).alias("checked_baggage"))
