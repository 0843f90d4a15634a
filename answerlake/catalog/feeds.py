"""Sources, provider payloads, fingerprints and place joins."""

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog import search as s
from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.operators import lanes
from answerlake.plans import corpus
from answerlake.session import checkpoint_root
from answerlake.sources import fingerprint, io, payloads


def text(column):
    return F.col(column).cast("string")


def scratch(t, name):
    """A fresh folder in the shared checkpoint area for a query's round trip."""
    import uuid
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- reads and writes

@query("labelled_csv", "S3", f"""SELECT text, CASE quality WHEN 1 THEN 'calm' ELSE 'upset' END AS label, CASE WHEN lang <> 'de' THEN lang ELSE 'en' END AS language, 'real' AS source
FROM documents JOIN labels USING (doc_id) WHERE length({q.strip('text')}) > 0""")
def _(t):
    path = scratch(t, "labelled")
    t.documents.join(t.labels, "doc_id").filter(F.length(F.btrim("text", F.lit(" \t\n\r\f"))) > 0).select(
        "text", F.when(F.col("quality") == 1, "calm").otherwise("upset").alias("label"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("language"), F.lit("real").alias("source"),
    ).write.csv(path, header=True, quote='"', escape='"')
    return io.read_labelled(t.spark, path)


@query("evaluation_set", "S4", """SELECT 'q' || CAST(item_id AS VARCHAR) AS id, text AS query, CAST(item_id % 7 AS VARCHAR) || '|' || CAST(item_id AS VARCHAR) AS topics,
  left(text, 10) AS keywords FROM benchmark""")
def _(t):
    path = scratch(t, "evalset")
    t.benchmark.select(
        F.concat(F.lit("q"), text("item_id")).alias("id"), F.col("text").alias("query"),
        F.array((F.col("item_id") % 7).cast("string"), text("item_id")).alias("expected_topics"),
        F.array(F.left("text", F.lit(10))).alias("expected_keywords")).write.json(path)
    rows = t.spark.read.schema(io.EVAL_SET).json(path)
    return rows.select("id", "query", F.array_join("expected_topics", "|").alias("topics"), F.array_join("expected_keywords", "|").alias("keywords"))


@query("manifest_scan", "S2 P17", """SELECT CAST(doc_id AS VARCHAR) || '.txt' AS file, CASE doc_id % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'published' ELSE 'undeclared' END AS provenance,
  CASE WHEN doc_id % 4 <> 0 THEN 'version 1.' || CAST(doc_id % 4 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 OR doc_id % 5 <= 2 THEN ', ' ELSE '' END ELSE '' END ||
  CASE WHEN doc_id % 3 = 0 THEN 'prototype document, not published policy' WHEN doc_id % 5 = 0 THEN 'effective 9 Oct 2026'
       WHEN doc_id % 5 <= 2 THEN 'as published 23 Sep 2026' ELSE '' END AS edition FROM documents""")
def _(t):
    path = scratch(t, "manifest")
    ident = F.col("doc_id")
    entry = F.struct(
        F.concat(text("doc_id"), F.lit(".txt")).alias("file"),
        F.when(ident % 3 == 0, "synthetic").when(ident % 3 == 1, "published").alias("provenance"),
        F.when(ident % 4 != 0, F.concat(F.lit("1."), (ident % 4).cast("string"))).alias("version"),
        F.when(ident % 5 == 0, "2026-10-09").when(ident % 5 == 1, "soon").alias("effective_from"),
        F.when(ident % 5 <= 2, "2026-09-23").when(ident % 5 == 3, "2026-13-40").alias("retrieved_on"))
    # Manifests are sidecar files: here one per 500 consecutive documents.
    batch = F.floor(F.col("doc_id") / 500)
    t.documents.groupBy(batch.alias("batch")).agg(F.collect_list(entry).alias("documents")).write.option(
        "maxRecordsPerFile", 1).json(path)
    return io.read_manifest(t.spark, path).select("file", "provenance", io.edition_label(
        F.col("version"), F.col("provenance"), F.col("effective_from"), F.col("retrieved_on")).alias("edition"))


@query("index_round_trip", "S5", f"WITH {s.chunks_sql()} SELECT chunk_id, source, section, CAST(length(text) AS INTEGER) AS size FROM chunks")
def _(t):
    path = scratch(t, "index")
    built = s.chunks(t)
    io.write_index(built.filter("doc_id % 2 = 0"), path)
    io.write_index(built.filter("doc_id % 2 = 1"), path, "append")
    return io.read_index(t.spark, path).select("chunk_id", "source", "section", F.length("text").alias("size"))


@query("event_append", "S6", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    path = scratch(t, "events")
    rows = t.events.select("event_id", "user_id", "event_type")
    io.append_events(rows.filter("event_type <> 'error'"), path, "event_type")
    io.append_events(rows.filter("event_type = 'error'"), path, "event_type")
    return t.spark.read.parquet(path).select("event_id", "user_id", F.col("event_type").cast("string").alias("event_type"))


SAFE = "CASE WHEN regexp_matches({0}, '^[=+\\-@\\t\\r]') THEN '''' || {0} ELSE {0} END"


@query("safe_export", "S12", f"""SELECT {SAFE.format('created_at')} AS created_at, {SAFE.format('reference')} AS reference, {SAFE.format('method')} AS method, {SAFE.format('detail')} AS detail
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE o_orderkey % 4 WHEN 0 THEN '=SUM(' WHEN 1 THEN '+1 ' WHEN 2 THEN '-' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS reference,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '@' || o_orderpriority END AS method, o_orderstatus AS detail FROM orders ORDER BY o_orderkey DESC LIMIT 5000)""")
def _(t):
    key = F.col("o_orderkey")
    lead = F.when(key % 4 == 0, "=SUM(").when(key % 4 == 1, "+1 ").when(key % 4 == 2, "-").otherwise("")
    rows = t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.concat(lead, text("o_orderkey")).alias("reference"),
        F.when(key % 5 != 0, F.concat(F.lit("@"), "o_orderpriority")).alias("method"), F.col("o_orderstatus").alias("detail"))
    return io.export_rows(rows, ["created_at", "reference", "method", "detail"], [F.desc("o_orderkey")])


@query("metrics_sink", "S13")
def _(t):
    path = scratch(t, "metrics")
    io.write_metrics(b.scores(t).groupBy("model").agg(F.round(F.avg("groundedness"), 4).alias("groundedness"), F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.json(path)


# ------------------------------------------------------------- provider payloads

@query("parsed_callbacks", "S7", """SELECT o_orderkey, 'CK' || CAST(o_orderkey AS VARCHAR) AS checkout_id, CASE o_orderkey % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'expired' ELSE 'failed' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1032' WHEN 2 THEN '1037' ELSE '2001' END AS result_code, o_orderpriority AS detail,
  CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN 'R' || CAST(o_custkey AS VARCHAR) END AS receipt,
  CASE WHEN o_orderkey % 4 = 0 THEN '2547' || CAST(o_custkey AS VARCHAR) END AS phone_number FROM orders WHERE o_orderkey % 10 <> 9""")
def _(t):
    key = F.col("o_orderkey")
    code = F.when(key % 4 == 0, 0).when(key % 4 == 1, 1032).when(key % 4 == 2, 1037).otherwise(2001)

    def item(name, value):
        return F.struct(F.lit(name).alias("Name"), value.cast("string").alias("Value"))

    items = F.struct(F.array(item("Amount", F.lit(1.0)), item("Amount", F.col("o_totalprice")), item("MpesaReceiptNumber", F.concat(F.lit("R"), text("o_custkey"))),
                             item("PhoneNumber", F.concat(F.lit("2547"), text("o_custkey")))).alias("Item"))
    body = F.struct(F.struct(F.struct(
        F.concat(F.lit("CK"), text("o_orderkey")).alias("CheckoutRequestID"), code.alias("ResultCode"), F.col("o_orderpriority").alias("ResultDesc"),
        F.when(key % 4 == 0, items).alias("CallbackMetadata")).alias("stkCallback")).alias("Body"))
    raw = t.orders.select("o_orderkey", F.when(key % 10 != 9, F.to_json(body)).otherwise('{"Body": {"other": 1}}').alias("payload"))
    return payloads.parse_callbacks(raw, "payload", "o_orderkey")


@query("interpreted_status", "S8", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 0 OR l_returnflag = 'N' THEN NULL
  WHEN l_linenumber % 5 = 1 THEN 'paid' WHEN l_linenumber % 5 = 2 THEN 'cancelled' WHEN l_linenumber % 5 = 3 AND l_linestatus = 'F' THEN 'expired'
  WHEN l_linenumber % 5 = 3 THEN NULL ELSE 'failed' END AS status FROM lineitem""")
def _(t):
    turn = F.col("l_linenumber") % 5
    code = F.when(turn == 1, "0").when(turn == 2, " 1032 ").when(turn == 3, F.when(F.col("l_linestatus") == "F", "1037").otherwise("4999")).when(turn == 4, "17")
    note = F.when(F.col("l_returnflag") == "N", "The transaction is still Under Processing").otherwise("done")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", payloads.interpret_status(code, note).alias("status"))


@query("parsed_captures", "S9", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 < 2 THEN 'paid' WHEN o_orderkey % 6 = 2 THEN 'failed' WHEN o_orderkey % 6 = 3 THEN 'cancelled' END AS status,
  CASE o_orderkey % 6 WHEN 5 THEN 'APPROVED' WHEN 2 THEN 'DECLINED' WHEN 3 THEN 'VOIDED' WHEN 4 THEN 'PENDING' ELSE 'COMPLETED' END AS detail,
  CASE WHEN o_orderkey % 6 <> 5 THEN 'C' || CAST(o_orderkey AS VARCHAR) END AS receipt, CASE WHEN o_orderkey % 6 <> 5 THEN o_totalprice END AS amount,
  CASE WHEN o_orderkey % 6 <> 5 THEN 'USD' END AS currency FROM orders""")
def _(t):
    turn = F.col("o_orderkey") % 6
    state = F.when(turn < 2, "COMPLETED").when(turn == 2, "DECLINED").when(turn == 3, "VOIDED").otherwise("PENDING")
    capture = F.struct(F.concat(F.lit("C"), text("o_orderkey")).alias("id"), state.alias("status"),
                       F.struct(text("o_totalprice").alias("value"), F.lit("USD").alias("currency_code")).alias("amount"))
    done = F.to_json(F.struct(F.lit("COMPLETED").alias("status"), F.array(F.struct(F.struct(F.array(capture).alias("captures")).alias("payments"))).alias("purchase_units")))
    raw = t.orders.select("o_orderkey", F.when(turn == 5, '{"status": "APPROVED", "purchase_units": [{}]}').otherwise(done).alias("payload"))
    return payloads.parse_captures(raw, "payload", "o_orderkey")


FLIGHT_SQL = """SELECT {source} AS source, true AS is_live, true AS available, 'F' || CAST(event_id AS VARCHAR) AS flight_number,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Field ' || CAST(user_id AS VARCHAR) || ' (U' || CAST(user_id % 9 AS VARCHAR) || ') -> ' || CASE WHEN event_id % 3 = 1 THEN 'ZZZ' ELSE 'Port (ZZZ)' END END AS route,
  {status} AS status, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN NULL ELSE CAST(CAST(props->>'k' AS INTEGER) AS INTEGER) END AS delay_minutes,
  CASE WHEN event_id % 4 <> 0 THEN 'G' || CAST(event_id % 4 AS VARCHAR) END AS gate, CASE WHEN event_id % 5 = 0 THEN '2024-01-01T00:00Z' ELSE 'est' END AS estimated_departure_utc,
  strftime(ts, '%Y-%m-%dT%H:%MZ') AS retrieved_at_utc, CAST(NULL AS VARCHAR) AS reason FROM events WHERE {where}"""


@query("normalised_flights", "S10 U6", FLIGHT_SQL.format(source="'board_live'", status="CASE WHEN event_type <> 'click' THEN 'St ' || event_type END", where="event_id % 2 = 0")
       + " UNION ALL " + FLIGHT_SQL.format(source="'airline_live'", status="CASE WHEN event_type <> 'click' THEN 'st ' || event_type END", where="event_id % 2 = 1"))
def _(t):
    ident, user = F.col("event_id"), text("user_id")
    delay = F.when(F.col("event_type") == "view", "soon").when(F.col("event_type") != "error", F.get_json_object("props", "$.k"))
    gate = F.when(ident % 4 != 0, F.concat(F.lit("G"), (ident % 4).cast("string"))).otherwise("")
    field, code = F.concat(F.lit("Field "), user, F.lit(" ")), F.concat(F.lit("U"), (F.col("user_id") % 9).cast("string"))
    away = F.when(ident % 3 == 2, "Port")
    away_code = F.when(ident % 3 != 0, "ZZZ")
    state = F.when(F.col("event_type") != "click", F.concat(F.lit("St "), "event_type")).otherwise("")
    estimated = F.when(ident % 5 != 0, "est")
    planned = F.lit("2024-01-01T00:00Z")
    board = F.to_json(F.struct(state.alias("flight_status"), F.struct(
        field.alias("airport"), code.alias("iata"), delay.alias("delay"), gate.alias("gate"), estimated.alias("estimated"), planned.alias("scheduled")).alias("departure"),
        F.struct(away.alias("airport"), away_code.alias("iata")).alias("arrival")))
    airline = F.to_json(F.struct(state.alias("status"), delay.alias("delayMinutes"), planned.alias("scheduledDepartureUtc"), estimated.alias("estimatedDepartureUtc"),
                                 F.struct(field.alias("name"), code.alias("iata"), gate.alias("gate")).alias("departure"),
                                 F.struct(away.alias("name"), away_code.alias("iata")).alias("arrival")))
    rows = t.events.select("event_id", F.concat(F.lit("F"), text("event_id")).alias("number"),
                           F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("retrieved"), board.alias("board"), airline.alias("airline"))
    return payloads.combine_feeds(
        payloads.normalise_flights(rows.filter("event_id % 2 = 0"), "board", "number", "retrieved", "board"),
        payloads.normalise_flights(rows.filter("event_id % 2 = 1"), "airline", "number", "retrieved", "airline"))


@query("flattened_orders", "S11", """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE unnest([0, 1]) END AS i
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, NULL
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 4 = 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'P' || CAST(l_orderkey AS VARCHAR) AS pnr, 'Ada C' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 THEN '|Solo' ELSE '' END AS passengers,
  CAST(i AS INTEGER) AS segment_no, CASE i WHEN 0 THEN 'KX' || CAST(l_partkey AS VARCHAR) END AS flight_number,
  CASE i WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'City ' || CAST(l_suppkey AS VARCHAR) ELSE 'Name' END WHEN 1 THEN 'Away' END AS origin,
  CASE i WHEN 0 THEN 'S' || CAST(l_suppkey AS VARCHAR) WHEN 1 THEN 'AWY' END AS origin_code, CASE WHEN i = 0 AND l_linenumber % 3 = 0 THEN CAST(l_linenumber AS INTEGER) END AS pieces FROM o""")
def _(t):
    n, part, supplier = F.col("l_linenumber"), text("l_partkey"), text("l_suppkey")

    def place(code, city, name):
        return F.struct(code.alias("iata"), city.alias("city"), name.alias("name"))

    bag = F.when(n % 3 == 0, F.struct(n.alias("pieces"), F.lit(23).alias("weightKg")))
    home = place(F.concat(F.lit("S"), supplier), F.when(n % 2 == 0, F.concat(F.lit("City "), supplier)).otherwise(""), F.lit("Name"))
    away = place(F.lit("AWY"), F.lit("Away"), F.lit("Away field"))
    segments = F.array(
        F.struct(F.concat(F.lit("kx"), part).alias("flightNumber"), home.alias("origin"), away.alias("destination"), bag.alias("checkedBaggage")),
        F.struct(F.lit("").alias("flightNumber"), away.alias("origin"), home.alias("destination"), F.when(F.lit(False), bag).alias("checkedBaggage")))
    travellers = F.array_compact(F.array(
        F.struct(F.lit("Ada").alias("givenName"), F.concat(F.lit("C"), text("o_custkey")).alias("surname")),
        F.when(F.col("o_custkey") % 2 == 0, F.struct(F.lit("").alias("givenName"), F.lit("Solo").alias("surname")))))
    body = F.to_json(F.struct(F.concat(F.lit("P"), text("l_orderkey")).alias("pnr"), travellers.alias("passengers"),
                              F.when(n % 4 != 0, segments).alias("segments")))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    raw = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*keys, body.alias("payload"))
    return payloads.flatten_orders(raw, "payload", *keys).select(
        *keys, "pnr", F.array_join("passengers", "|").alias("passengers"), "segment_no", "flight_number", "origin", "origin_code",
        F.col("checked_baggage.pieces").alias("pieces"))


# ------------------------------------------------------------------ fingerprints

SETTINGS = {"size": 500, "overlap": 50, "encoder": "hashed-64"}
SUMS = ", ".join(f"sum(('0x' || substr(d, {at}, 8))::BIGINT) AS s{at}" for at in range(1, 64, 8))
JOINED = " || '/' || ".join(["CAST(n AS VARCHAR)", *[f"CAST(s{at} AS VARCHAR)" for at in range(1, 64, 8)], "'encoder=hashed-64/overlap=50/size=500'"])


@query("corpus_fingerprint", "S14", f"""SELECT left(sha256({JOINED}), 16) AS fingerprint FROM (SELECT count(*) AS n, {SUMS}
  FROM (SELECT sha256(concat_ws('=', length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, text)) AS d FROM documents))""")
def _(t):
    return fingerprint.corpus_fingerprint(t.documents, SETTINGS)


def versions(t):
    old = t.documents.filter("doc_id % 50 <> 1")
    new = t.documents.filter("doc_id % 50 <> 2").withColumn("text", F.when(F.col("doc_id") % 50 == 3, F.concat("text", F.lit(" New line."))).otherwise(F.col("text")))
    return old, new


@query("changed_documents", "S15", """SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 50 IN (1, 2, 3)""")
def _(t):
    return fingerprint.changed_documents(*versions(t))


@query("refreshed_index", "S15 S5", f"""WITH docs AS (SELECT doc_id, source, CASE WHEN doc_id % 50 = 3 THEN text || ' New line.' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 2),
{s.chunks_sql().replace('FROM documents', 'FROM docs')} SELECT chunk_id, doc_id, section, md5(text) AS body FROM chunks""")
def _(t):
    old, new = versions(t)
    built = corpus.chunk(old, s.HEADING)
    fresh = fingerprint.refresh_index(built, old, new, lambda d: corpus.chunk(d, s.HEADING))
    return fresh.select("chunk_id", "doc_id", "section", F.md5("text").alias("body"))


# ------------------------------------------------------------------------- lanes

LANES = """lanes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey AS origin, c_nationkey AS destination
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""


def lane_rows(t):
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("destination")))


@query("lane_scope", "T32", f"""WITH {LANES} SELECT origin, destination, CASE WHEN origin IN (0, 5, 10) AND destination IN (0, 5, 10) THEN 'domestic' ELSE 'international' END AS scope, count(*) AS n
FROM lanes GROUP BY 1, 2""")
def _(t):
    return lane_rows(t).groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "scope", lanes.scope(F.col("origin"), F.col("destination"), (0, 5, 10)))


@query("lane_fees", "J12", f"""WITH {LANES}, f AS (SELECT l.*, CASE WHEN origin = 5 THEN 'hub' ELSE 'other' END AS row_key, CASE WHEN origin IN (0, 5, 10) AND destination IN (0, 5, 10) THEN 'domestic'
   ELSE (SELECT r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = CASE WHEN destination = 5 THEN origin ELSE destination END) END AS column_key FROM lanes l)
SELECT row_key, column_key, count(*) AS n, any_value(CASE WHEN column_key = 'domestic' THEN 10.0 WHEN column_key <> 'ASIA' THEN length(column_key) * CASE row_key WHEN 'hub' THEN 5.0 ELSE 9.0 END END)::DOUBLE AS amount
FROM f GROUP BY 1, 2""")
def _(t):
    region = F.col("r_name")
    table = t.region.filter(region != "ASIA").select(F.explode(F.array(
        F.struct(F.lit("hub").alias("row_key"), region.alias("column_key"), (F.length(region) * 5.0).alias("amount")),
        F.struct(F.lit("other").alias("row_key"), region.alias("column_key"), (F.length(region) * 9.0).alias("amount")))).alias("c")).select("c.*")
    home = t.region.select(F.explode(F.array(F.struct(F.lit("hub").alias("k")), F.struct(F.lit("other").alias("k")))).alias("c")).select(
        F.col("c.k").alias("row_key"), F.lit("domestic").alias("column_key"), F.lit(10.0).alias("amount")).distinct()
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("region"))
    quoted = lanes.quote_fee(lane_rows(t), table.unionByName(home), places, 5, (0, 5, 10))
    return quoted.groupBy("row_key", "column_key").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("amount"))


@query("place_cover", "J13", """WITH tree AS (SELECT n_name AS place, unnest([n_name, r_name]) AS ancestor FROM nation JOIN region ON r_regionkey = n_regionkey),
asked AS (SELECT o_orderkey AS ident, 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS place FROM orders),
stated AS (SELECT o_orderkey AS ident, CASE WHEN o_orderkey % 2 = 0 THEN 'NATION_' || CAST(o_orderkey % 25 AS VARCHAR) ELSE ['ASIA', 'EUROPE', 'AFRICA'][o_orderkey % 3 + 1] END AS place FROM orders)
SELECT a.ident, a.place, EXISTS (SELECT 1 FROM tree t JOIN stated s ON s.place = t.ancestor AND s.ident = a.ident WHERE t.place = a.place) AS covered FROM asked a""")
def _(t):
    key = F.col("o_orderkey")
    tree = lanes.closure(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("place"), F.lit(None).cast("string").alias("country"), F.col("r_name").alias("region")))
    asked = t.orders.select(key.alias("ident"), F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("place"))
    region = F.element_at(F.array(F.lit("ASIA"), F.lit("EUROPE"), F.lit("AFRICA")), (key % 3 + 1).cast("int"))
    stated = t.orders.select(key.alias("ident"), F.when(key % 2 == 0, F.concat(F.lit("NATION_"), (key % 25).cast("string"))).otherwise(region).alias("place"))
    return lanes.covered(asked, stated, tree)


