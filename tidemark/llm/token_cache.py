"""Token counts by a digest cache.

A document's key is the SHA-256 of its normalised content, and the cache holds
counts by (tokenizer version, key). The version is a digest of the tokenizer
file, the library's name and release and the way content is normalised, so a
changed tokenizer never meets counts of another. A run

1. writes one narrow row a document (key, bytes) and groups the keys,
2. joins the distinct keys to the stored counts,
3. encodes one document of each key that is not stored, and
4. appends those counts to the cache and joins all counts to the documents.

Texts move at most once, one row a document, to meet the rows that are encoded;
they don't move when nothing or little is missing (those row keys are broadcast
up to a checked number). Keys with at least 1/4096 of the rows, so at most 4096
of them, get their counts by broadcast; all others meet in one shuffle.

Normalised content: where the tokenizer drops white space (which is read from
its file), runs of ASCII white space count as one space and those at the ends
as none, as neither changes the tokens; else the text as it is. For such a
tokenizer a text's tokens are also those of its white-space-separated chunks, so
a task encodes each chunk it meets once and texts of any length in pieces.

Defined results: a null text is an empty text with 0 tokens; special strings in
a text are special tokens, as is the library's default; repeated rows come out
as often as they are there; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import SPACE_RUN
from .storage import bounded_batches, shared_dir, small, with_row_key, written

#: Tokens a document may have before it is over the limit.
LIMIT = 2048
PIECE = 1 << 20
_CACHE = "digest binary, n_tokens bigint"
_PROBE = "A b'll 12 ,.\t\n\r\x0b\x0c x-y  é́ 中 z"


def drops_white_space(spec: dict) -> bool:
    """Whether white space of a `tokenizers` file only ends words: it never is in a token nor changes one."""
    import regex

    normal = spec.get("normalizer") or {}
    steps = {n["type"] for n in normal.get("normalizers", [normal] if normal else [])}
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    if not steps <= {"NFC", "Replace", "Lowercase"} or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    replaced = [n for n in normal.get("normalizers", []) if n["type"] == "Replace"]
    if any(n["pattern"] != {"Regex": r"\s+"} or n["content"] != " " for n in replaced):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        return False
    pattern = first["pattern"].get("Regex", "")
    return bool(pattern) and not any(c.isspace() for m in regex.finditer(pattern, _PROBE) for c in m[0])


class Counter:
    """Counts tokens with the library of a tokenizer file: `tokenizers` for .json, `sentencepiece` for .model."""

    def __init__(self, name: str, raw: bytes):
        self.name, self.raw, self.memo, self.held = name, raw, {}, 0
        self.chunked = name.endswith(".json") and drops_white_space(json.loads(raw))
        self._library = None

    def __getstate__(self):
        return {"name": self.name, "raw": self.raw, "chunked": self.chunked, "memo": {}, "held": 0, "_library": None}

    @property
    def version(self) -> str:
        """Digest of all that counts depend on."""
        import sentencepiece
        import tokenizers

        library = f"tokenizers {tokenizers.__version__}" if self.name.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
        return hashlib.sha256(b"\0".join([library.encode(), str(self.chunked).encode(), self.raw])).hexdigest()

    def plain(self, texts: list[str]) -> list[int]:
        """The library's counts of whole strings."""
        if self._library is None:
            if self.name.endswith(".model"):
                import sentencepiece

                self._library = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
            else:
                import tokenizers

                self._library = tokenizers.Tokenizer.from_str(self.raw.decode())
                self._library.no_truncation()
                self._library.no_padding()
        if self.name.endswith(".model"):
            return [len(x) for x in self._library.encode(texts, num_threads=1)]
        return [len(e) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """The library's counts of texts of any length."""
        if not self.chunked:
            return [self.plain([t])[0] for t in texts]
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for piece in pieces(text.encode()):
                held.append((i, piece.split()))
                size += len(piece)
                if size >= PIECE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[bytes]]], out: list[int], most: int = 96 << 20) -> None:
        """Add to out[i] the tokens of the chunks of (i, chunks); each chunk not met before is encoded once."""
        if self.held > most:
            self.memo, self.held = {}, 0
        memo = self.memo
        new = list({w for _, parts in held for w in parts if w not in memo})
        memo.update(zip(new, self.plain([w.decode() for w in new]) if new else []))
        self.held += sum(map(len, new)) + 100 * len(new)
        for i, parts in held:
            out[i] += sum(map(memo.__getitem__, parts))


_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def pieces(raw: bytes, size: int = PIECE):
    """raw in pieces of about `size` bytes that end at white space, or at the next one after that."""
    if len(raw) <= size:
        yield raw
        return
    raw, at = raw.translate(_BLANK), 0
    while at < len(raw):
        end = len(raw) if at + size >= len(raw) else raw.rfind(b" ", at, at + size) + 1 or raw.find(b" ", at + size) + 1 or len(raw)
        yield raw[at:end]
        at = end


def load(spark: SparkSession, path: str) -> Counter:
    """The tokenizer of a file that the driver sees, or of one in a store that Spark reads."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except FileNotFoundError:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return Counter(path.rsplit("/", 1)[-1], raw)


def key_of(text: Column, chunked: bool) -> Column:
    """Digest of the normalised content."""
    text = F.coalesce(text, F.lit(""))
    if chunked:
        text = F.regexp_replace(F.regexp_replace(text, SPACE_RUN, " "), "^ | $", "")
    return F.unhex(F.sha2(text, 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One count for each key of a version; runs that overlapped may have stored a key twice, with the same count."""
    try:
        # of a folder that is there, all batches that any run has ended
        rows = spark.read.schema(_CACHE).option("recursiveFileLookup", True).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode_missing(docs: DataFrame, missing: DataFrame, counter: Counter, path: str) -> None:
    """Write (digest, n_tokens) of the documents whose row keys `missing` names."""
    bounded_batches(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(counter)

    def run(batches):
        for batch in batches:
            counts = value.value.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    # the texts are not sorted: the narrow side is hashed
    few = small(missing.select("rep", "digest"))
    texts = docs.select("_rid", F.coalesce("text", F.lit("")).alias("text")).join(few.hint("shuffle_hash"), F.col("_rid") == F.col("rep"))
    texts.select("digest", "text").mapInArrow(run, _CACHE).write.option("compression", "zstd").parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, cached (its count was stored before this run).

    cache: a folder that all executors see; counts are added to it. Without one,
    a new folder below spark.checkpoint.dir is used, so every key is missing.
    Each run appends a folder of its own, so runs may overlap.
    """
    spark = docs.sparkSession
    counter = load(spark, tokenizer)
    cache = (cache or f"{shared_dir(spark)}/tidemark/counts-{uuid.uuid4().hex}").rstrip("/")
    docs = with_row_key(docs.select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_rid", key_of(F.col("text"), counter.chunked).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = written(rows, "keys")
    keys = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min("_rid").alias("rep"))
    keys = written(keys.join(stored(spark, cache, counter.version), "digest", "left"), "lookup")
    missing = keys.filter("n_tokens is null")
    known = keys.filter("n_tokens is not null").select("digest", "n_rows", "n_tokens", F.lit(True).alias("cached"))
    if missing.limit(1).count():
        batch = f"{cache}/version={counter.version}/batch={uuid.uuid4().hex}"
        _encode_missing(docs, missing, counter, batch)
        new = spark.read.schema(_CACHE).parquet(batch)
        known = known.unionByName(missing.select("digest", "n_rows").join(new, "digest").withColumn("cached", F.lit(False)))
    heavy = F.greatest(F.lit(16), F.lit(rows.count() // 4096 + 1))
    hot = F.broadcast(known.filter(F.col("n_rows") >= heavy))
    rest = known.filter(F.col("n_rows") < heavy)
    out = rows.join(hot, "digest").unionByName(rows.join(F.broadcast(known.filter(F.col("n_rows") >= heavy).select("digest")), "digest", "left_anti").join(rest, "digest"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Counts over all documents with an empty cache, so that every distinct content is encoded."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
