import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import parsers, sinks


def test_company_facts_and_rejections(spark):
    o = lambda **k: {"start": "2025-01-01", "end": "2025-03-31", "val": 1.5, "accn": "a1", "fy": 2025, "fp": "Q1", "form": "10-Q", "filed": "2025-05-01"} | k
    body = {"cik": 7, "facts": {"ns": {"Eps": {"units": {"USD": [o(), o(val=2.5), o(accn="a2", filed="2025-01-05")]}}, "Assets": {"units": {"USD": [o(start=None, val=10.0)]}}}}}
    docs = spark.createDataFrame([(json.dumps(body),), ("not json",), (None,)], "body string")
    rows = parsers.company_facts(docs)
    assert rows.count() == 4
    assert {(r.concept, r.val) for r in rows.collect()} == {("Eps", 1.5), ("Eps", 2.5), ("Assets", 10.0)}
    assert {r.reason for r in parsers.rejected_facts(rows).collect()} == {"CONFLICT", "FILED_EARLY"}


def test_submissions_and_curves(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], ["10-K", "10-Q"]), (2, ["c"], ["x", "y"])], "cik long, acc array<string>, form array<string>")
    assert sorted(map(tuple, parsers.submissions(docs, {"acc": "accession", "form": "form"}).collect())) == [(1, "a", "10-K"), (1, "b", "10-Q")]
    wide = spark.createDataFrame([("01/02/2024", "5.1", ""), ("2024-01-03", "x", "4.0")], "Date string, m1 string, y10 string")
    got = sorted((r.date, r.tenor, float(r.rate)) for r in parsers.curve_points(wide, "Date", ["m1", "y10"]).collect())
    assert got == [(dt.date(2024, 1, 2), "m1", 5.1), (dt.date(2024, 1, 3), "y10", 4.0)]
    j = spark.createDataFrame([('{"a":1}',), ('{"a":1,"z":2}',), ('{"b":1}',), ("[1]",)], "j string")
    assert [r[0] for r in j.select(parsers.known_fields(F.col("j"), ["a", "b"], ["a"])).collect()] == [None, "UNKNOWN:z", "MISSING:a", "NOT_AN_OBJECT"]


def test_inline_facts(spark):
    ctx = lambda i, extra="": f'<xbrli:context id="{i}"><xbrli:identifier>77</xbrli:identifier>{extra}<xbrli:startdate>2025-01-01</xbrli:startdate><xbrli:enddate>2025-03-31</xbrli:enddate></xbrli:context>'
    body = ctx("c") + ctx("d", "<xbrldi:explicitMember>m</xbrldi:explicitMember>")
    fact = lambda c, t, more="": f'<ix:nonFraction name="us:Eps" contextRef="{c}" {more}>{t}</ix:nonFraction>'
    body += fact("c", "732.3", 'unitRef="u" scale="6"') + fact("c", "1,000", 'unitRef="u" sign="-"') + fact("d", "5", 'unitRef="u"') + fact("c", "5") + fact("c", "n/a", 'unitRef="u"') + fact("q", "5", 'unitRef="u"')
    rows = parsers.inline_facts(spark.createDataFrame([("acc", body, "77"), ("b", None, None)], "accession string, payload string, identifier string")).collect()
    assert [r.value for r in rows[:2]] == [732300000.0, -1000.0]
    assert [r.reason for r in rows] == [None, None, "DIMENSIONS", "NO_UNIT", "NOT_NUMERIC", "NO_CONTEXT"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, 0.1), (1, 0.1)], "k long, v double")
    back = sinks.write_verified(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(df, f"{tmp_path}/t")
    assert sinks.content_hash(back).first() == sinks.content_hash(df.repartition(3)).first()
    assert sinks.content_hash(df.distinct()).first() != sinks.content_hash(df).first()
    assert [r.line for r in sinks.canonical_lines(df, ["k"]).collect()][-1] == '{"k":2,"v":null}'


def test_manifests_csv_and_chains(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, None), (3, 1e-300)], "k long, v double")
    path = f"{tmp_path}/p"
    sinks.write_once(df, path)
    known = sinks.manifest(spark, path)
    frozen = spark.createDataFrame(known.collect(), known.schema)
    assert sinks.verified_scan(spark, path, frozen).count() == 3
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="manifest"):
        sinks.verified_scan(spark, path, frozen)
    back = sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="columns"):
        sinks.read_csv(spark, f"{tmp_path}/c", df.select("v", "k").schema)
    assert sinks.write_addressed(df, f"{tmp_path}/a") == sinks.write_addressed(df.repartition(3), f"{tmp_path}/a")
    assert sinks.cached(df, f"{tmp_path}/cache", "x").count() == 3 and sinks.cached(df.limit(0), f"{tmp_path}/cache", "x").count() == 3
    assert sinks.published(df, f"{tmp_path}/s", f"{tmp_path}/pub").count() == 3
    log = spark.createDataFrame([("c", i, p) for i, p in enumerate(["a", None, "b"])], "c string, t int, p string")
    import hashlib

    head, rows = "", []
    for i, p in enumerate(["a", "", "b"]):
        head = hashlib.sha256(f"{head}|{p}".encode()).hexdigest()
        rows.append(("c", i, ["a", None, "b"][i], head))
    assert sinks.chained(log, ["c"], ["t"], "p").first().head == head
    good = spark.createDataFrame(rows, "c string, t int, p string, link string")
    assert sinks.broken_links(good, ["c"], ["t"], "link", "p").count() == 0
    assert sinks.broken_links(good.withColumn("p", F.when(F.col("t") == 1, "x").otherwise(F.col("p"))), ["c"], ["t"], "link", "p").count() == 1


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../out.txt", "no")
        z.writestr("big.txt", "x" * 5000)
    (tmp_path / "b.zip").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    got = {(r.member, r.status): r.sha256 for r in parsers.zip_members(files, most=1000).collect()}
    import hashlib

    assert got == {("ok.txt", "OK"): hashlib.sha256(b"hello").hexdigest(), ("../out.txt", "UNSAFE"): None, ("big.txt", "LARGE"): None, (None, "BROKEN"): None}


def test_zip_members_of_any_size_and_damage(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        z.writestr("long.txt", "x" * 3_000_001)
        z.writestr("hurt.txt", "untouched")
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"untouched", b"UNtouched"))
    got = {r.member: (r.size, r.sha256, r.status) for r in parsers.zip_members(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")).collect()}
    assert got == {"long.txt": (3_000_001, hashlib.sha256(b"x" * 3_000_001).hexdigest(), "OK"), "hurt.txt": (9, None, "DAMAGED")}


def test_config():
    from tidemark import config

    base = {"gate": {"window": 252, "margin": 0.005}, "name": "x"}
    out = config.merged(base, {"gate": {"margin": 0.01}})
    assert out == {"gate": {"window": 252, "margin": 0.01}, "name": "x"} and base["gate"]["margin"] == 0.005
    for bad in ({"gates": {}}, {"gate": {"windo": 1}}, {"gate": 3}):
        with pytest.raises(config.ConfigError):
            config.merged(base, bad)
    rules = {"gate.window": (int, 1, None), "gate.margin": (float, 0, 1), "name": (str, None, None)}
    assert config.checked(out, rules) is out
    for bad in ({"gate": {"window": 0, "margin": 0.1}, "name": "x"}, {"gate": {"window": True, "margin": 0.1}, "name": "x"}, {"gate": {"window": 5}, "name": "x"}):
        with pytest.raises(config.ConfigError):
            config.checked(bad, rules)
