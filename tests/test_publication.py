import os
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import publication as P


def predictions(spark):
    return spark.createDataFrame([(i, m, float(i * k) if i % 4 else None) for i in range(20) for k, m in enumerate(("low", "mid", "top"))], "id int, m string, f double")


def test_tables_become_visible_together(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    tables = P.matrices(predictions(spark), ["id"], "m", "f")
    seen, plain = [], P.write_verified

    def between(df, path):
        with pytest.raises(FileNotFoundError):
            P.published_tables(spark, folder)
        seen.append(path.rsplit("/", 1)[1])
        if len(seen) == 2:
            raise OSError("the writer fails between both tables")
        return plain(df, path)

    monkeypatch.setattr(P, "write_verified", between)
    with pytest.raises(OSError):
        P.publish(spark, folder, tables)
    assert seen == ["long", "wide"] and os.path.isdir(f"{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        P.published_tables(spark, folder)
    monkeypatch.setattr(P, "write_verified", plain)
    P.publish(spark, folder, tables)
    got = P.published_tables(spark, folder)
    assert got["wide"].columns == ["id", "low", "mid", "top"] and got["wide"].count() == 20 and got["long"].count() == 60
    with pytest.raises(FileExistsError):
        P.publish(spark, folder, tables)
    # a changed table or manifest is found
    got["long"].limit(3).write.mode("append").parquet(got["long"].inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(ValueError, match="long"):
        P.published_tables(spark, folder)
    text = P.read_text(spark, f"{folder}/manifest.json")
    P.put_replacing(spark, f"{folder}/manifest.json", text.replace('"rows":20', '"rows":21'))
    with pytest.raises(ValueError, match="manifest"):
        P.published_tables(spark, folder)


def test_a_model_that_predicts_twice(spark):
    with pytest.raises(ValueError, match="more than once"):
        P.matrices(predictions(spark).unionAll(predictions(spark)), ["id"], "m", "f")


def test_one_of_many_puts_and_replacement_is_tried_again(spark, tmp_path, monkeypatch):
    path, won = f"file://{tmp_path}/x/one", []
    run = [threading.Thread(target=lambda k=k: won.append(k) if P.put_if_absent(spark, path, f"writer {k}") else None) for k in range(12)]
    [t.start() for t in run], [t.join() for t in run]
    assert len(won) == 1 and P.read_text(spark, path) == f"writer {won[0]}"
    plain, failed = os.replace, []

    def flaky(a, b):
        if len(failed) < 2:
            failed.append(b)
            raise PermissionError("busy")
        plain(a, b)

    monkeypatch.setattr(P.os, "replace", flaky)
    P.put_replacing(spark, path, "new", pause=0.001)
    assert P.read_text(spark, path) == "new" and len(failed) == 2
    assert sorted(os.listdir(tmp_path / "x")) == ["one"]
    assert P.read_text(spark, f"file://{tmp_path}/none") is None


def test_two_writers_leave_one_valid_chain(spark, tmp_path):
    folder, errors = f"file://{tmp_path}/log", []

    def work(name):
        try:
            log = P.EventLog(spark, folder, "e")
            for k in range(6):
                assert log.append([(f"{name}-{k}", "step", {"k": k, "by": name}), (f"{name}-{k}b", "step", {})]) == 2
        except Exception as e:  # noqa: BLE001 - a thread's error would be lost
            errors.append(e)

    run = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in run], [t.join() for t in run]
    log = P.EventLog(spark, folder, "e")
    assert not errors and log.faults().count() == 0
    rows = log.events().orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(24)) and all(b.previous == a.entry for a, b in zip(rows, rows[1:]))
    # the same event again is no event; other content under its key is an error
    assert log.append([("a-1", "step", {"by": "a", "k": 1})]) == 0
    with pytest.raises(ValueError, match="other content"):
        log.append([("a-1", "step", {"by": "a", "k": 2})])
    with pytest.raises(ValueError, match="twice"):
        log.append([("z", "step", {"k": 1}), ("z", "step", {"k": 2})])
    # a changed entry breaks its own digest
    name = next(f"{tmp_path}/log/log/{n}" for n in sorted(os.listdir(tmp_path / "log" / "log")) if n.startswith("0"))
    text = open(name).read()
    open(name, "w").write(text.replace("step", "stop", 1))
    assert [r.sequence for r in log.faults().orderBy("sequence").collect()] == [0]
