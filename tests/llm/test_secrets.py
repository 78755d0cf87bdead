import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

from tidemark.llm import secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def spans(text):
    return {(k, s, e, v) for k, s, e, v in secrets.find(text)}


def test_base_rules_by_plain_matching():
    cases = [f'token = "abcdefgh" {KEY} ' + "0a" * 20, "secret: token: abcdefgh", "API_KEY=short pass", "apikey='12345678'", "é" * 5 + "PASSWORD : hunter2.hunter2", "AKIA123 " + "f" * 31, "Token=ſecret", "", None, "deadbeef" * 4 + "g" + "0" * 40]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for t in cases:
        want = {("assign", *m.span()) for m in assign.finditer(t or "") if len(m[2]) >= 8}
        want |= {("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16}
        want |= {("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32}
        assert {s[:3] for s in secrets.find(t) if s[3] == ""} == want


def test_layers_map_back():
    inner = f"key {KEY} end"
    b64 = base64.b64encode(inner.encode()).decode()
    text = "x " + b64 + " y"
    assert ("access", 2, 2 + len(b64), "base64") in spans(text)
    url = "u password%3Dhunter2%2Bhunter2 v"
    assert ("assign", 2, len(url) - 2, "url") in spans(url)
    part = "aaaa%20" + KEY
    assert ("access", 7, 7 + len(KEY), "url") in spans(part) and ("access", 7, 7 + len(KEY), "") in spans(part)
    esc = "q " + "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert ("access", 2, len(esc), "unicode") in spans(esc)
    for pack, name in ((gzip.compress, "gzip"), (zlib.compress, "zlib")):
        z = base64.b64encode(pack(inner.encode())).decode()
        assert any(s[0] == "access" and s[3] == f"base64/{name}" for s in spans("a " + z + " b"))
    deep = urllib.parse.quote(base64.b64encode(b64.encode()).decode(), safe="")
    deep = "".join(f"%{ord(c):02X}" for c in deep)
    assert any(s[0] == "access" and s[3].count("base64") == 2 for s in spans(deep))


def test_key_and_value_in_different_tokens():
    for text, via in (('"password": "\\u0073\\u0033cret9999"', "unicode"), ("token = %61bcdefgh1", "url"), ("\\u0070assword : hunter2hunter2", "unicode")):
        start = text.startswith('"')  # the quotes around do not belong to the span
        assert ("assign", 15 + int(start), 15 + len(text) - int(start), via) in spans("say  " * 3 + text)
    assert any(s[0] == "assign" and s[3].count("/") == 1 for s in spans("\\u0070assword = %61bcdefgh1"))
    # what stands beside a token with escapes is not found again
    assert spans("a%20b " + KEY) == {("access", 6, 6 + len(KEY), "")}


def test_decoded_text_with_odd_characters_and_split_runs():
    plain = f"la cl\u00e9\u00a0: {KEY} fin " * 3
    for odd in ("\u00a0", "\u3000", "\ufeff", "\u200b", "\f", "\x1b", "\0"):
        data = (odd + plain).encode()
        for packed in (data, gzip.compress(data)):
            assert any(s[0] == "access" and s[3] for s in spans(base64.b64encode(packed).decode())), repr(odd)
    b64 = base64.b64encode(f"key {KEY} end".encode()).decode()
    for text in ("id-" + b64, "/v1/" + b64, "key_" + b64, "/api/v1/" + b64 + "/end"):
        assert any(s[0] == "access" and s[3] == "base64" for s in spans(text)), text
    noise = "".join(hashlib.sha256(bytes([k])).hexdigest()[:20].upper() + " " for k in range(40))
    packed = base64.encodebytes(zlib.compress((noise + KEY).encode())).decode()
    assert packed.count("\n") > 3 and any(s[0] == "access" and s[3] == "base64/zlib" for s in spans(packed))
    two = gzip.compress(b"first member ") + gzip.compress(KEY.encode())
    assert any(s[0] == "access" for s in spans(base64.b64encode(two).decode()))
    large = base64.b64encode(gzip.compress(b"a " * 5000 + KEY.encode() + b" b" * 5000)).decode()
    assert {s[0] for s in secrets.find(large, 1000)} >= {"oversize", "access"}


def test_bombs_and_cycles_end():
    bomb = base64.b64encode(gzip.compress(b"a" * (1 << 20))).decode()
    assert any(s[0] == "oversize" for s in secrets.find("b " + bomb, 1000))
    assert secrets.find("%25" * 200 + "41") is not None


def test_query_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"token = abcdefghij {KEY}", 9), (None, None, 8), (2, "", 7), (1, "x", 6)], "doc_id long, text string, spans int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.n_assign): r for r in secrets.op3_query(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    want = f"assign:0:18,access:19:{19 + len(KEY)}"
    assert rows[1, 1].spans == want and rows[1, 1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert rows[None, 0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_deep_escapes_are_linear_and_reach_the_end():
    import time

    value = "hunter2hunter2"
    for nest in (lambda n: "%" + "25" * n + "61", lambda n: "\\" + "u005c" * n + "u0061", lambda n: "%" + "5Cu0025" * n + "61", lambda n: "\\" + "x5C" * n + "x61"):
        for n in (0, 1, 2, 3, 4, 5, 50):
            text = "p" + nest(n) + "ssword=" + value
            found = {(s[1], s[2]) for s in secrets.find(text) if s[0] == "assign" and s[3]}
            assert (0, len(text)) in found, (n, text)
        text = "p" + nest(20_000) + "ssword=" + value
        began = time.time()
        assert any(s[0] == "assign" and (s[1], s[2]) == (0, len(text)) for s in secrets.find(text))
        assert time.time() - began < 5
    text = "".join(f"%{ord(c):02X}" for c in f"password={value} ") * 6000
    began = time.time()
    assert sum(s[0] == "assign" for s in secrets.find(text)) >= 6000
    assert time.time() - began < 15


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, f"a {KEY}", "x", 2), (None, None, "y", 3), (1, f"a {KEY}", "x", 2)], "doc_id long, text string, spans string, start int")
    got = sorted((str(r.doc_id), len(r.spans)) for r in secrets.find_secrets(docs).collect())
    assert got == [("1", 1), ("1", 1), ("None", 0)]
    assert secrets.find_secrets(docs.limit(0)).collect() == []
