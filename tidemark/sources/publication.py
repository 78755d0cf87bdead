"""Several tables that become visible together, and an event log that concurrent writers extend.

Both rest on one step: a small file that is put in place whole, and only if nobody else put it there before.
On a local path that is a hard link of a finished file; elsewhere Hadoop's rename, which HDFS makes atomic and
refuses where the target exists. (Object stores without such a rename are not served.) Tables are written and read by Spark;
the driver handles the manifest and the new lines of the log, a few kilobytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.sinks import content_hash, write_verified

EVENT = "experiment string, sequence bigint, event_key string, event_type string, payload string, previous string, entry string"


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _temporary(spark: SparkSession, path: str, text: str) -> str:
    folder, name = path.rsplit("/", 1)
    tmp = f"{folder}/_{name}.{uuid.uuid4().hex}"
    if local := _local(tmp):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "x", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
    else:
        fs, p = _hadoop(spark, tmp)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
    return tmp


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file in place; False, and nothing changed, if there is one already."""
    tmp = _temporary(spark, path, text)
    if local := _local(path):
        try:
            os.link(_local(tmp), local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(_local(tmp))
    fs, source = _hadoop(spark, tmp)
    done = not fs.exists(_hadoop(spark, path)[1]) and fs.rename(source, _hadoop(spark, path)[1])
    if not done:
        fs.delete(source, False)
    return done


def put_replacing(spark: SparkSession, path: str, text: str, tries: int = 5, pause: float = 0.05) -> None:
    """Put a whole file in place of what is there; a reader sees the old or the new one. Failures of the replacement are tried again."""
    tmp = _temporary(spark, path, text)
    for k in range(tries):
        try:
            if local := _local(path):
                os.replace(_local(tmp), local)
            else:
                jvm = spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_hadoop(spark, path)[1].toUri(), spark._jsc.hadoopConfiguration())
                how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
                context.rename(_hadoop(spark, tmp)[1], _hadoop(spark, path)[1], how)
            return
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole file, None if there is none."""
    try:
        row = spark.read.option("wholetext", True).text(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row.value if row else ""


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> dict:
    """Write all tables, compare each with what is read back, and then put one manifest in place that names them.

    The tables lie below a name of this attempt, so a writer that fails before the manifest leaves nothing
    that a reader would look at, and can run again. The first manifest stays: publishing into a folder that has one is an error."""
    attempt = uuid.uuid4().hex
    entries = {}
    for name, df in sorted(tables.items()):
        path = f"attempt-{attempt}/{name}"
        back = write_verified(df, f"{folder}/{path}")
        h = content_hash(back).first()
        entries[name] = {"path": path, "rows": h.rows, "digest": h.digest, "schema": df.schema.jsonValue()}
    core = {"tables": entries}
    core["sha256"] = hashlib.sha256(canonical(core).encode()).hexdigest()
    if not put_if_absent(spark, f"{folder}/manifest.json", canonical(core)):
        raise FileExistsError(f"{folder} is published already")
    return core


def published_tables(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a published folder; an error if it has no manifest, or if that or (verify) a table is not what was published."""
    text = read_text(spark, f"{folder}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"{folder} is not published")
    core = json.loads(text)
    own = {k: v for k, v in core.items() if k != "sha256"}
    if hashlib.sha256(canonical(own).encode()).hexdigest() != core.get("sha256"):
        raise ValueError(f"the manifest of {folder} was changed")
    out = {}
    for name, e in core["tables"].items():
        df = spark.read.schema(StructType.fromJson(e["schema"])).parquet(f"{folder}/{e['path']}")
        if verify:
            h = content_hash(df).first()
            if (h.rows, h.digest) != (e["rows"], e["digest"]):
                raise ValueError(f"{name} in {folder} is not what was published")
        out[name] = df
    return out


def matrices(predictions: DataFrame, identity: list[str], model: str, value: str) -> dict[str, DataFrame]:
    """{"long", "wide"} of out-of-sample predictions: a row for each identity and model, and a column for each model.

    An identity that a model predicts twice is an error; the models are few, as each is a column."""
    twice = predictions.groupBy(*identity, model).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError("a model predicts an identity more than once")
    names = [r[0] for r in predictions.select(model).distinct().orderBy(model).collect()]
    return {"long": predictions.select(*identity, model, value), "wide": predictions.groupBy(*identity).pivot(model, names).agg(F.first(value))}


class EventLog:
    """An append-only log of one experiment: each entry holds the digest of the one before it.

    A writer reads the head, makes the next entries and puts them in place as the file of their first sequence, only
    if that is still free; if another writer was faster, it starts again from the new head. An event key
    that is there already, with the same type and payload, is not written again; with others it is an error."""

    def __init__(self, spark: SparkSession, folder: str, experiment: str):
        self.spark, self.folder, self.experiment = spark, folder.rstrip("/"), experiment

    def events(self) -> DataFrame:
        """All entries; none where nothing was written yet."""
        try:
            return self.spark.read.schema(EVENT).json(f"{self.folder}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EVENT)

    def append(self, events: list[tuple[str, str, dict]], tries: int = 50) -> int:
        """Append (key, type, payload) together; how many of them were new."""
        wanted = {}
        for key, kind, payload in events:
            if wanted.setdefault(key, (kind, canonical(payload))) != (kind, canonical(payload)):
                raise ValueError(f"event {key} is given twice with different content")
        for _ in range(tries):
            log = self.events()
            head = log.orderBy(F.desc("sequence")).first()
            have = {r.event_key: (r.event_type, r.payload) for r in log.filter(F.col("event_key").isin(list(wanted))).collect()}
            for key, found in have.items():
                if found != wanted[key]:
                    raise ValueError(f"event {key} is in the log with other content")
            new = [k for k in wanted if k not in have]
            if not new:
                return 0
            sequence, previous, lines = (head.sequence + 1 if head else 0), (head.entry if head else ""), []
            first = sequence
            for key in new:
                e = {"experiment": self.experiment, "sequence": sequence, "event_key": key, "event_type": wanted[key][0], "payload": wanted[key][1], "previous": previous}
                previous = e["entry"] = hashlib.sha256("|".join(str(e[k]) for k in ("previous", "experiment", "sequence", "event_key", "event_type", "payload")).encode()).hexdigest()
                lines.append(canonical(e))
                sequence += 1
            if put_if_absent(self.spark, f"{self.folder}/log/{first:020d}.jsonl", "\n".join(lines) + "\n"):
                return len(new)
        raise RuntimeError(f"other writers were faster {tries} times")

    def faults(self) -> DataFrame:
        """Entries that break the chain: a sequence that does not follow, a wrong previous digest or entry, or a repeated key."""
        w = Window.partitionBy("experiment").orderBy("sequence")  # one experiment's log
        want = F.sha2(F.concat_ws("|", "previous", "experiment", "sequence", "event_key", "event_type", "payload"), 256)
        e = self.events()
        bad = (F.col("sequence") != F.row_number().over(w) - 1) | (F.col("previous") != F.coalesce(F.lag("entry").over(w), F.lit(""))) | (F.col("entry") != want)
        return e.withColumn("_bad", bad).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("event_key"))).filter(F.col("_bad").isNull() | F.col("_bad") | (F.col("_n") > 1)).drop("_bad", "_n")
