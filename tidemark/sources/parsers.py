"""Landed documents to rows: nested JSON facts, parallel arrays, rate tables, inline facts in HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATION = "start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string"
FACTS = f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<struct<{OBSERVATION}>>>>>>>"


def company_facts(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per observation of nested facts documents: cik, namespace, concept, unit and its fields.

    Bodies that are no such document give no rows; see rejected_facts.
    """
    d = docs.select(F.from_json(body, FACTS).alias("d")).filter("d.facts is not null")
    d = d.select(F.col("d.cik").alias("cik"), F.explode("d.facts").alias("namespace", "concepts"))
    d = d.select("cik", "namespace", F.explode("concepts").alias("concept", "c"))
    d = d.select("cik", "namespace", "concept", F.explode("c.units").alias("unit", "o"))
    d = d.select("cik", "namespace", "concept", "unit", F.explode("o").alias("o"))
    day = lambda c: F.expr(f"try_cast(o.{c} as date)")
    return d.select("cik", "namespace", "concept", "unit", day("start").alias("start"), day("end").alias("end"), "o.val", "o.accn", "o.fy", "o.fp", "o.form", day("filed").alias("filed"))


def rejected_facts(facts: DataFrame) -> DataFrame:
    """Observations that cannot be used, with the reason; repeated identities among them."""
    key = ["cik", "concept", "unit", "start", "end", "accn"]
    twice = facts.groupBy(*key).agg(F.count_distinct("val").alias("n")).filter("n > 1").select(*key, F.lit("CONFLICT").alias("reason"))
    bad = facts.withColumn("reason", F.when(F.col("val").isNull() | F.isnan("val"), "NO_VALUE").when(F.col("end").isNull(), "NO_END").when(F.col("start") > F.col("end"), "BACKWARDS").when(F.col("filed") < F.col("end"), "FILED_EARLY"))
    return bad.filter("reason is not null").select(*key, "reason").unionByName(twice)


def submissions(docs: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Rows of parallel arrays (column of docs -> output name); documents whose arrays differ in length give none."""
    first, *rest = arrays
    same = F.lit(True)
    for c in rest:
        same = same & (F.size(first) == F.size(c))
    z = docs.filter(same).select(*[c for c in docs.columns if c not in arrays], F.explode(F.arrays_zip(*arrays)).alias("z"))
    return z.select(*[c for c in docs.columns if c not in arrays], *[F.col(f"z.{c}").alias(n) for c, n in arrays.items()])


def curve_points(rows: DataFrame, date: str, tenors: list[str], keep: list[str] = ()) -> DataFrame:
    """Wide tenors to (date, tenor, rate): empty cells give no row, dates in either of two formats."""
    day = F.coalesce(F.expr(f"try_to_date({date}, 'MM/dd/yyyy')"), F.expr(f"try_to_date({date}, 'yyyy-MM-dd')"))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tenor"), F.expr(f"try_cast(`{t}` as decimal(38,10))").alias("rate")) for t in tenors]))
    return rows.select(*keep, day.alias("date"), pairs.alias("p")).select(*keep, "date", "p.tenor", "p.rate").filter("rate is not null")


def known_fields(body: Column, allowed: list[str], required: list[str]) -> Column:
    """Why a JSON object is refused: unknown or missing top-level fields; null if it is fine."""
    keys = F.json_object_keys(body)
    unknown = F.array_except(keys, F.array(*map(F.lit, allowed)))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    return F.when(keys.isNull(), "NOT_AN_OBJECT").when(F.size(unknown) > 0, F.concat(F.lit("UNKNOWN:"), F.array_join(unknown, ","))).when(F.size(missing) > 0, F.concat(F.lit("MISSING:"), F.array_join(missing, ",")))


class _Inline(HTMLParser):
    """Facts, contexts and units of one inline document."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.facts, self.contexts, self.open = [], {}, []
        self.context, self.want = None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ix:nonfraction":
            self.open.append({**a, "text": ""})
        elif tag == "xbrli:context":
            self.context = a.get("id")
            self.contexts[self.context] = {"dimensions": False}
        elif tag.startswith("xbrldi:") and self.context:
            self.contexts[self.context]["dimensions"] = True
        elif tag in ("xbrli:startdate", "xbrli:enddate", "xbrli:instant", "xbrli:identifier"):
            self.want = {"xbrli:startdate": "start", "xbrli:enddate": "end", "xbrli:instant": "end", "xbrli:identifier": "identifier"}[tag]

    def handle_data(self, data):
        if self.want and self.context:
            self.contexts[self.context][self.want] = data.strip()
        for f in self.open:
            f["text"] += data

    def handle_endtag(self, tag):
        self.want = None
        if tag == "xbrli:context":
            self.context = None
        elif tag == "ix:nonfraction" and self.open:
            self.facts.append(self.open.pop())


INLINE = "accession string, concept string, context_id string, unit string, value double, start string, end string, status string, reason string"


def inline_facts(docs: DataFrame) -> DataFrame:
    """Facts of inline documents (accession, payload, identifier): scaled and signed values, or why they are quarantined."""

    def parse(frames):
        for pdf in frames:
            rows = []
            for accession, payload, identifier in zip(pdf["accession"], pdf["payload"], pdf["identifier"]):
                p = _Inline()
                p.feed(payload or "")
                for f in p.facts:
                    c = p.contexts.get(f.get("contextref"), {})
                    reason, value = None, None
                    try:
                        value = float(f["text"].strip().replace(",", "")) * 10 ** int(f.get("scale") or 0)
                        value = -value if f.get("sign") == "-" else value
                    except ValueError:
                        reason = "NOT_NUMERIC"
                    if not c:
                        reason = "NO_CONTEXT"
                    elif c["dimensions"]:
                        reason = "DIMENSIONS"
                    elif identifier and c.get("identifier") != identifier:
                        reason = "OTHER_ENTITY"
                    elif not f.get("unitref"):
                        reason = "NO_UNIT"
                    rows.append((accession, f.get("name"), f.get("contextref"), f.get("unitref"), None if reason else value, c.get("start"), c.get("end"), "QUARANTINED" if reason else "OK", reason))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INLINE.split(", ")])

    return docs.select("accession", "payload", "identifier").mapInPandas(parse, INLINE)


ACCESSION = r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$"


def accession_index(docs: DataFrame, body: str = "body") -> DataFrame:
    """accession, form, filed, items and reason (null if the entry can be used) of index metadata."""
    m = F.from_json(body, "accession string, form string, filed string, items array<string>")
    d = docs.select(*[c for c in docs.columns if c != body], m.alias("m"))
    filed = F.expr("try_cast(m.filed as date)")
    reason = F.when(~F.coalesce(F.col("m.accession").rlike(ACCESSION), F.lit(False)), "BAD_ACCESSION").when(F.col("m.form").isNull(), "NO_FORM").when(filed.isNull(), "NO_DATE")
    keep = [c for c in docs.columns if c != body]
    return d.select(*keep, "m.accession", "m.form", filed.alias("filed"), F.size("m.items").alias("items"), reason.alias("reason"))


def xml_rates(docs: DataFrame, fields: dict[str, list[str]], body: str = "body") -> DataFrame:
    """The columns of docs without body, date and one column for each field, which is the first of its
    aliases that is there. Documents that declare a type, or are no XML, give nulls."""
    names = [a for aliases in fields.values() for a in aliases]
    schema = "date string, " + ", ".join(f"{n} string" for n in names)
    safe = F.when(~F.col(body).rlike("<!(DOCTYPE|ENTITY)"), F.col(body))
    d = docs.select(*[c for c in docs.columns if c != body], F.from_xml(safe, schema).alias("x"))
    pick = lambda aliases: F.coalesce(*[F.col(f"x.{a}").try_cast("double") for a in aliases])
    return d.select(*[c for c in docs.columns if c != body], F.expr("try_cast(x.date as date)").alias("date"), *[pick(v).alias(k) for k, v in fields.items()])


def reference_rates(docs: DataFrame, body: str = "body") -> DataFrame:
    """The columns of docs without body, date, kind, rate, volume, revised and reason: null, or why the entry is refused."""
    fields = ["effectiveDate", "type", "percentRate", "volumeInBillions", "revisionIndicator"]
    r = F.from_json(body, "effectiveDate string, type string, percentRate double, volumeInBillions double, revisionIndicator string")
    d = docs.withColumn("r", r).withColumn("_why", known_fields(F.col(body), fields, fields[:3]))
    day = F.expr("try_cast(r.effectiveDate as date)")
    reason = F.coalesce("_why", F.when(day.isNull(), "BAD_DATE").when(F.col("r.percentRate").isNull() | ~F.col("r.percentRate").between(-10, 100), "RATE_RANGE").when(F.col("r.volumeInBillions") < 0, "VOLUME_RANGE").when(~F.coalesce("r.revisionIndicator", F.lit("")).isin("", "R"), "REVISION"))
    keep = [c for c in docs.columns if c != body]
    ok = reason.isNull()
    return d.select(*keep, F.when(ok, day).alias("date"), F.when(ok, F.col("r.type")).alias("kind"), F.when(ok, F.col("r.percentRate")).alias("rate"), F.when(ok, F.col("r.volumeInBillions")).alias("volume"), (F.col("r.revisionIndicator") == "R").alias("revised"), reason.alias("reason"))


def json_lines(spark, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines log; lines that are cut off or broken are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_lineage(spark, paths: list[str]) -> DataFrame:
    """The union of Parquet files of one schema, with the name of the file that each row came from."""
    return spark.read.parquet(*paths).withColumn("file", F.col("_metadata.file_name"))


def zip_members(files: DataFrame, most: int | None = None, piece: int = 1 << 20) -> DataFrame:
    """path, member, size, sha256, status of the members of zip files (path, content binary): UNSAFE names
    (absolute, or leading out of the folder) are not read, nor are members above `most` bytes (LARGE) where
    a bound is given. Members are unpacked `piece` bytes at a time, so their size does not matter; one
    whose bytes do not fit its checksum is DAMAGED."""
    import pyarrow as pa

    schema = "path string, member string, size long, sha256 string, status string"

    def run(batches):
        import hashlib
        import io
        import zipfile
        import zlib

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer())) if content.is_valid else None
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "BROKEN"))
                    continue
                for m in archive.infolist() if archive else []:
                    parts = m.filename.replace("\\", "/").split("/")
                    if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                        rows.append((path, m.filename, m.file_size, None, "UNSAFE"))
                    elif most is not None and m.file_size > most:
                        rows.append((path, m.filename, m.file_size, None, "LARGE"))
                    elif not m.is_dir():
                        digest, size = hashlib.sha256(), 0
                        try:
                            with archive.open(m) as f:
                                while data := f.read(piece):
                                    digest.update(data)
                                    size += len(data)
                            rows.append((path, m.filename, size, digest.hexdigest(), "OK"))
                        except (zipfile.BadZipFile, zlib.error, EOFError):
                            rows.append((path, m.filename, m.file_size, None, "DAMAGED"))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "member", "size", "sha256", "status"])

    return files.select("path", "content").mapInArrow(run, schema)
