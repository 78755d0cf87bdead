"""Registered queries of sources and sinks: tables are landed as documents or files, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import config
from tidemark.sources import parsers, publication, sinks
from tidemark.sources.scratch import scratch_path, shared_dir
from tidemark.plans.catalog import _PRED, _predictions, query, table


@query("s1_verified_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def verified_scan(spark, d):
    path = f"{d}/nation.parquet"
    return sinks.verified_scan(spark, path, sinks.manifest(spark, path))


@query("s2_u1_union_with_lineage", "SELECT 'low' AS model, count(*) AS n, round(sum(o_totalprice * 0.8), 2) AS total, 0::BIGINT AS repeated FROM orders UNION ALL SELECT 'high', count(*), round(sum(o_totalprice * 1.2), 2), 0 FROM orders")
def union_with_lineage(spark, d):
    o, folder = table(spark, d, "orders"), scratch_path(spark, "predictions")
    for name, k in (("low", 0.8), ("high", 1.2)):
        o.select("o_orderkey", F.lit(name).alias("model"), (F.col("o_totalprice") * k).alias("f")).write.parquet(f"{folder}/{name}")
    rows = parsers.with_lineage(spark, [f"{folder}/*/*.parquet"])
    once = rows.groupBy("model", "o_orderkey").agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f"))
    return once.groupBy("model").agg(F.sum("c").alias("n"), F.round(F.sum("f"), 2).alias("total"), F.count_if(F.col("c") > 1).alias("repeated"))


@query("s3_pruned_distinct", "SELECT DISTINCT l_suppkey FROM lineitem")
def pruned_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").distinct()


@query("s4_s5_k4_csv_round_trip", "SELECT o_orderkey, o_totalprice / 3 AS v, o_orderstatus FROM orders")
def csv_round_trip(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 3).alias("v"), "o_orderstatus")
    return sinks.write_csv(rows, scratch_path(spark, "csv"))


_FILED = "f AS (SELECT o_custkey AS cik, o_orderkey, o_orderdate::DATE AS stop, o_orderdate::DATE - 90 AS start, o_totalprice AS val, o_orderdate::DATE + (o_orderkey % 60)::INT - 5 AS filed FROM orders)"


def _facts_documents(spark, d):
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "yyyy-MM-dd")
    o = table(spark, d, "orders")
    obs = F.struct(day(F.lit(-90)).alias("start"), day(F.lit(0)).alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.year("o_orderdate").alias("fy"), F.lit("Q1").alias("fp"), F.lit("10-Q").alias("form"), day((F.col("o_orderkey") % 60).cast("int") - 5).alias("filed"))
    per = o.groupBy("o_custkey").agg(F.collect_list(obs).alias("obs"))
    units = F.struct(F.struct(F.struct(F.col("obs").alias("USD")).alias("units")).alias("Price"))
    return per.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.struct(units.alias("us")).alias("facts"))).alias("body"))


@query("s6_company_facts", f"WITH {_FILED} SELECT cik, 'us' AS namespace, 'Price' AS concept, 'USD' AS unit, start, stop AS \"end\", val, o_orderkey::VARCHAR AS accn, filed FROM f")
def company_facts(spark, d):
    return parsers.company_facts(_facts_documents(spark, d)).select("cik", "namespace", "concept", "unit", "start", "end", "val", "accn", "filed")


@query("s6_rejected_facts", f"WITH {_FILED} SELECT 'FILED_EARLY' AS reason, count(*) AS n FROM f WHERE filed < stop")
def rejected_facts(spark, d):
    return parsers.rejected_facts(parsers.company_facts(_facts_documents(spark, d))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_submissions",
    """WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_custkey AS cik, count(*) FILTER (k <= 5 OR o_custkey % 50 <> 0) AS filings, o_custkey % 50 <> 0 OR count(*) <= 5 AS complete FROM k GROUP BY o_custkey""",
)
def submissions(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    o = table(spark, d, "orders").withColumn("k", k)
    arrays = lambda rows: rows.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("accessionNumber"), F.collect_list("o_orderstatus").alias("form"))
    main, history = arrays(o.filter("k <= 5")), arrays(o.filter("k > 5 and o_custkey % 50 != 0"))
    expected = o.filter("k > 5").select(F.col("o_custkey").alias("cik")).distinct()
    names = {"accessionNumber": "accession", "form": "form"}
    rows = parsers.submissions(main, names).unionByName(parsers.submissions(history, names))
    missing = expected.join(history, "cik", "left_anti").withColumn("missing", F.lit(True))
    return rows.groupBy("cik").agg(F.count(F.lit(1)).alias("filings")).join(missing, "cik", "left").select("cik", "filings", F.col("missing").isNull().alias("complete"))


@query(
    "s8_accession_index",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE lpad(o_custkey::VARCHAR, 10, '0') || '-98-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') END AS accession, CASE WHEN o_orderkey % 9 = 0 THEN 'BAD_ACCESSION' WHEN o_orderkey % 10 = 0 THEN 'NO_FORM' END AS reason FROM orders""",
)
def accession_index(spark, d):
    key = F.col("o_orderkey")
    acc = F.when(key % 9 == 0, "bad").otherwise(F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-98-"), F.lpad((key % 1000000).cast("string"), 6, "0")))
    body = F.to_json(F.struct(acc.alias("accession"), F.when(key % 10 != 0, "10-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.array(F.lit("2.02")).alias("items")))
    return parsers.accession_index(table(spark, d, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "accession", "reason")


@query(
    "s9_curve_csv",
    """SELECT o_orderkey, o_orderdate::DATE AS date, tenor, rate FROM (SELECT o_orderkey, o_orderdate, unnest(['m1', 'y10']) AS tenor, unnest([CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 700 / 100.0)::DOUBLE END, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 900 / 100.0)::DOUBLE END]) AS rate FROM orders) WHERE rate IS NOT NULL""",
)
def curve_csv(spark, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    date = F.when(key % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    cell = lambda n, m: F.coalesce(F.when(key % n != 0, F.format_string("%.2f", F.col("o_custkey") % m / 100.0)), F.lit(""))
    lines = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", date, cell(3, 700), cell(4, 900)).alias("line"))
    wide = lines.select("o_orderkey", F.from_csv("line", "Date string, m1 string, y10 string").alias("c")).select("o_orderkey", "c.*")
    return parsers.curve_points(wide, "Date", ["m1", "y10"], ["o_orderkey"]).withColumn("rate", F.col("rate").cast("double"))


@query(
    "s10_xml_rates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 700 / 100.0)::DOUBLE END AS one_month FROM orders""",
)
def xml_rates(spark, d):
    key = F.col("o_orderkey")
    name = F.when(key % 2 == 0, "BC_1MONTH").otherwise("d1m")
    doctype = F.when(key % 7 == 0, '<!DOCTYPE x [<!ENTITY a "b">]>').otherwise("")
    body = F.concat(doctype, F.lit("<entry><date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</date><"), name, F.lit(">"), F.format_string("%.2f", F.col("o_custkey") % 700 / 100.0), F.lit("</"), name, F.lit("></entry>"))
    return parsers.xml_rates(table(spark, d, "orders").select("o_orderkey", body.alias("body")), {"one_month": ["BC_1MONTH", "d1m"]})


@query(
    "s11_reference_rates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 NOT IN (1, 2, 3) THEN (o_custkey % 500 / 100.0)::DOUBLE END AS rate, CASE o_orderkey % 5 WHEN 1 THEN 'UNKNOWN:extra' WHEN 2 THEN 'RATE_RANGE' WHEN 3 THEN 'MISSING:type' END AS reason FROM orders""",
)
def reference_rates(spark, d):
    kind = F.col("o_orderkey") % 5
    rate = F.when(kind == 2, 900.0).otherwise(F.col("o_custkey") % 500 / 100.0)
    body = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("effectiveDate"), F.when(kind != 3, "SOFR").alias("type"), rate.alias("percentRate"), F.when(kind == 1, 1).alias("extra")))
    return parsers.reference_rates(table(spark, d, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "rate", "reason")


@query(
    "s12_inline_facts",
    """SELECT c_custkey::VARCHAR AS accession, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 2) * 1000 * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'DIMENSIONS' END AS reason FROM customer""",
)
def inline_facts(spark, d):
    key = F.col("c_custkey")
    member = F.when(key % 3 == 0, "<xbrldi:explicitMember>m</xbrldi:explicitMember>").otherwise("")
    context = F.concat(F.lit('<p><xbrli:context id="c"><xbrli:identifier>7</xbrli:identifier>'), member, F.lit("<xbrli:instant>2025-03-31</xbrli:instant></xbrli:context>"))
    sign = F.when(key % 2 == 0, 'sign="-"').otherwise("")
    fact = F.concat(F.lit('<br><ix:nonFraction name="us:Bal" contextRef="c" unitRef="u" scale="3" '), sign, F.lit("> "), F.format_string("%,.2f", "c_acctbal"), F.lit(" </ix:nonFraction>"))
    docs = table(spark, d, "customer").select(key.cast("string").alias("accession"), F.concat(context, fact).alias("payload"), F.lit("7").alias("identifier"))
    return parsers.inline_facts(docs).select("accession", F.round("value", 3).alias("value"), "reason")


@query("s13_partial_lines", "SELECT event_id, value FROM events WHERE event_id % 10 <> 3")
def partial_lines(spark, d):
    line = F.to_json(F.struct("event_id", "value"))
    cut = F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line)
    path = scratch_path(spark, "log")
    sinks.write_lines(table(spark, d, "events").select(cut.alias("line")), path)
    return parsers.json_lines(spark, path, "event_id long, value double")


@query("s17_cached_lags", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lag_1 FROM orders")
def cached_lags(spark, d):
    from pyspark.sql import Window

    lag = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    made = table(spark, d, "orders").select("o_orderkey", lag.alias("lag_1"))
    # the key must name all that the table depends on
    return sinks.cached(made, f"{shared_dir(spark)}/tidemark-cache", f"lag_1:{d}")


@query(
    "k5_ledger_seal",
    """SELECT conv_id, count(*) AS n, sha256(string_agg('{"role":"' || role || '","turn":' || turn || '}', chr(10) ORDER BY turn)) AS seal FROM conversations GROUP BY conv_id""",
)
def ledger_seal(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return sinks.seal(c, ["conv_id"], ["turn"], ["role", "turn"])


@query("k6_k9_published", "SELECT c_custkey, c_acctbal FROM customer")
def published(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    sinks.write_addressed(rows, scratch_path(spark, "addressed"))
    return sinks.published(rows, scratch_path(spark, "staging"), scratch_path(spark, "published"))


@query(
    "k3_published_matrices",
    f"""WITH {_PRED} SELECT o_orderkey, round(max(CASE WHEN m = 'close' THEN f END), 4) AS close, round(max(CASE WHEN m = 'low' THEN f END), 4) AS low, count(DISTINCT m) AS models FROM p GROUP BY o_orderkey""",
)
def published_matrices(spark, d):
    """The long and the wide matrix, published under one manifest, read back and joined."""
    folder = scratch_path(spark, "matrices")
    publication.publish(spark, folder, publication.matrices(_predictions(spark, d).select("o_orderkey", "m", "f"), ["o_orderkey"], "m", "f"))
    t = publication.published_tables(spark, folder)
    models = t["long"].groupBy("o_orderkey").agg(F.count_distinct("m").alias("models"))
    return t["wide"].join(models, "o_orderkey").select("o_orderkey", F.round("close", 4).alias("close"), F.round("low", 4).alias("low"), "models")


@query(
    "q9_event_log",
    """WITH RECURSIVE e AS (SELECT o_orderpriority AS k, '{"n":' || count(*) || '}' AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM orders GROUP BY o_orderpriority),
    c AS (SELECT i, k, p, sha256('|counts|' || i || '|' || k || '|summary|' || p) AS entry FROM e WHERE i = 0 UNION ALL SELECT e.i, e.k, e.p, sha256(c.entry || '|counts|' || e.i || '|' || e.k || '|summary|' || e.p) FROM c JOIN e ON e.i = c.i + 1)
    SELECT i AS sequence, k AS event_key, p AS payload, entry FROM c""",
)
def event_log(spark, d):
    """Counts by priority as events of one log; appending them again changes nothing."""
    log = publication.EventLog(spark, scratch_path(spark, "log"), "counts")
    counts = table(spark, d, "orders").groupBy("o_orderpriority").count().orderBy("o_orderpriority").collect()  # a few priorities
    events = [(r.o_orderpriority, "summary", {"n": r["count"]}) for r in counts]
    for batch in (events[:2], events, events[1:]):
        log.append(batch)
    return log.events().select("sequence", "event_key", "payload", "entry")


@query(
    "k1_k7_written_once",
    "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, 1 AS refused FROM customer GROUP BY c_mktsegment",
)
def written_once(spark, d):
    """Parquet and lines are written once; the second write of either is refused and changes nothing."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path, lines, refused = scratch_path(spark, "once"), scratch_path(spark, "lines"), 0
    text = sinks.canonical_lines(rows, ["c_custkey"])
    for _ in range(2):
        try:
            sinks.write_once(rows, path)
            sinks.write_lines(text, lines)
        except AnalysisException:
            refused += 1
    back = spark.read.schema(rows.schema).json(lines)
    return back.join(spark.read.parquet(path).select("c_custkey"), "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.lit(refused).alias("refused"))


@query(
    "s16_zip_members",
    """SELECT doc_id, member, CASE WHEN member LIKE '..%' THEN 'UNSAFE' ELSE 'OK' END AS status, octet_length(encode(text)) AS size, CASE WHEN member NOT LIKE '..%' THEN sha256(text) END AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 10 = 3 THEN '../text.txt' ELSE 'text.txt' END AS member FROM documents)""",
)
def zip_members(spark, d):
    """Every document as a zip file, read back with the digest of its member; some members have an unsafe name."""

    @F.pandas_udf("binary")
    def packed(member: pd.Series, text: pd.Series) -> pd.Series:
        def one(name: str, value: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(name, value)
            return out.getvalue()

        return pd.Series([one(m, t) for m, t in zip(member, text)])

    member = F.when(F.col("doc_id") % 10 == 3, "../text.txt").otherwise("text.txt")
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), packed(member, F.coalesce("text", F.lit(""))).alias("content"))
    found = parsers.zip_members(files)
    return found.select(F.col("path").cast("long").alias("doc_id"), "member", "status", "size", "sha256")


@query(
    "s15_checked_settings",
    "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 7) AS mean FROM orders WHERE o_totalprice >= 20000 GROUP BY o_custkey HAVING count(*) >= 5",
)
def checked_settings(spark, d):
    """A query whose bounds come from defaults that given settings override, checked before anything runs."""
    settings = config.merged({"orders": {"least_price": 0.0, "least_rows": 1}, "digits": 7}, {"orders": {"least_price": 20000.0, "least_rows": 5}})
    config.checked(settings, {"orders.least_price": (float, 0, None), "orders.least_rows": (int, 1, 1000), "digits": (int, 0, 9)})
    o = table(spark, d, "orders").filter(F.col("o_totalprice") >= settings["orders"]["least_price"])
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), settings["digits"]).alias("mean")).filter(F.col("n") >= settings["orders"]["least_rows"])
