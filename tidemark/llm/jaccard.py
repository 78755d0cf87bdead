"""Exact Jaccard join of five-word shingle sets, with set-relation skipping.

1. One pass over the texts gives each document's set size and set hash; equal
   sets are one set from here on.
2. Candidates. Sort the union of two sets by hash: the shingles that only one
   of them holds (at most a quarter at 0.75) cut the common ones into runs, so
   some runs have three neighbours in both. Triples of neighbours are therefore
   an exact filter, one that shared passages rarely pass, and a prefix of them
   is enough (sets under 15 shingles use single shingles). Prefixes go out
   packed, by bucket, each bucket of a bounded number of entries; inside a
   bucket, sets that share an entry and whose sizes are compatible are chained.
   The chains' connected components hold every link there can be.
3. Each component's sets meet in one task, if they are at most `most_shingles`
   in all, and are joined there: index lists are ordered by set size, so a list
   is entered at the position of the first compatible size; a list whose members
   are all in the current set's class is skipped whole; and where the overlap of
   a highly similar set with a candidate is known, the candidate's answer is
   derived from it (bounds on the overlap) and counted only if the bounds leave
   it open.
4. Larger components are joined across tasks: each entry's list first meets its
   smallest member only, and after their classes are merged only pairs of
   different classes are still verified.

Defined results: null or empty texts have no shingles and link with nothing;
fewer than five words are one shingle; documents without an id form one class
with their equals and get the smallest id there is in it (null if none);
repeated rows link with each other; empty tables give empty results; further
columns are ignored. Shingles are 64-bit hashes; sets of equal hash count as equal.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import connected_components
from .storage import bounded_batches, small, with_row_key, written

N, PERCENT = 5, 75


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


#: Sets of at least TRIPLES shingles have triples of neighbours, sets under SINGLES single shingles;
#: at 0.75 a set under 15 can only link with sets under 20, so any two that may link have one kind in common.
TRIPLES, SINGLES = 15, 20


def common_triples(u: int, percent: int) -> int:
    """The least number of triples of neighbours that two linking sets with a union of u have in common."""
    return u - 3 * (u * (100 - percent) // 100) - 2


def entries(s: np.ndarray, percent: int, prefix: bool) -> np.ndarray:
    """The entries of a sorted set in the index: all of them, or the prefix that a link cannot avoid."""
    n, out = len(s), []
    triples = percent >= 75 and n >= TRIPLES
    if not triples or n < SINGLES:
        out.append(textkit.mix64(s[: n + percent * n // -100 + 1] if prefix else s))
    if triples:
        t = textkit.mix64(textkit.mix64(s[:-2] * np.uint64(3) + s[1:-1]) * np.uint64(5) + s[2:])
        if prefix:
            sure = min(common_triples(u, percent) for u in range(n, 100 * n // percent + 1)) if n < 200 else -(-n * (3 * percent - 200) // 100) - 3
            keep = len(t) - max(sure, 1) + 1
            t = np.partition(t, keep - 1)[:keep] if keep < len(t) else t
        out.append(t)
    return np.concatenate(out) if len(out) > 1 else out[0]


def document_sets(raw: np.ndarray, offsets: np.ndarray, n: int = N):
    """For each document of a slice its sorted distinct shingle hashes."""
    raw = textkit.lower_ascii(raw)
    starts, ends, per = textkit.words(raw, offsets)
    w = textkit.span_hash(raw, starts, ends)
    mult = textkit.powers(n + 1)[1:] | np.uint64(1)
    out_h, out_d = [], []
    doc = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    if len(w) >= n:
        full = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            full += w[k : len(w) - n + 1 + k] * mult[k]
        ok = doc[: len(full)] == doc[n - 1 :]
        out_h.append(textkit.mix64(full[ok]))
        out_d.append(doc[: len(full)][ok])
    for size in range(1, n):  # shorter texts: one shingle of all their words
        at = np.flatnonzero(per == size)
        if len(at):
            h = np.full(len(at), np.uint64(size))
            for k in range(size):
                h += w[first[at] + k] * mult[k]
            out_h.append(textkit.mix64(h))
            out_d.append(at)
    if not out_h:
        return [np.zeros(0, np.uint64)] * len(per)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    parts = np.split(h[order], np.cumsum(np.bincount(d, minlength=len(per)))[:-1])
    return [np.unique(p) for p in parts]


def set_hash(s: np.ndarray) -> int:
    total = np.add.reduce(s * textkit.powers(len(s)), dtype=np.uint64) + np.uint64(len(s))
    return int(textkit.mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _each_set(batches, n: int, extra: int = 0):
    """(leading columns of the row, set) of each document; text is the last column."""
    for batch in batches:
        heads = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        raw, offsets = textkit.columns_bytes(batch.column(batch.num_columns - 1))
        for a, b, r, o in textkit.slices(raw, offsets):
            for k, s in enumerate(document_sets(r, o, n)):
                yield tuple(h[a + k] for h in heads), s


def set_table(texts: DataFrame, n: int) -> DataFrame:
    """(rid, size, sid): each document's set size and set hash, null for no shingles."""

    def run(batches):
        rows = []
        for (rid,), s in _each_set(batches, n):
            rows.append((rid, len(s), set_hash(s) if len(s) else None))
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return texts.select("rid", "text").mapInArrow(run, "rid bigint, size bigint, sid bigint")


def _batch(rows):
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["rid", "size", "sid"])


class Classes:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


_MASK = np.uint64((1 << 40) - 1)


def _pack(sids: list[int], sizes: list[int], prefixes: list[np.ndarray], buckets: int):
    """(bucket, blob) rows: for each set of the block its id, size and shingles in the bucket, 5 bytes each."""
    all_t = np.concatenate(prefixes)
    doc = np.repeat(np.arange(len(sids)), [len(p) for p in prefixes])
    bucket = ((all_t >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    all_t, doc, bucket = all_t[order], doc[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    ids, ns = np.array(sids, np.int64), np.array(sizes, np.int32)
    for b in range(buckets):
        t, d = all_t[cut[b] : cut[b + 1]], doc[cut[b] : cut[b + 1]]
        if len(t):
            who, count = np.unique(d, return_counts=True)
            five = np.ascontiguousarray((t & _MASK).view(np.uint8).reshape(-1, 8)[:, :5])
            head = np.array([len(who), len(t)], np.int64)
            yield b, b"".join((head.tobytes(), ids[who].tobytes(), ns[who].tobytes(), count.astype(np.int32).tobytes(), five.tobytes()))


def _unpack(blob: bytes):
    k, m = np.frombuffer(blob, np.int64, 2)
    at = 16
    ids = np.frombuffer(blob, np.int64, k, at)
    ns = np.frombuffer(blob, np.int32, k, at := at + 8 * k)
    count = np.frombuffer(blob, np.int32, k, at := at + 4 * k)
    five = np.frombuffer(blob, np.uint8, 5 * m, at + 4 * k).reshape(-1, 5)
    t = np.zeros((m, 8), np.uint8)
    t[:, :5] = five
    return ids, ns, count, t.reshape(-1).view(np.uint64)


def candidate_edges(texts: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(a, b): chained pairs of set hashes that share an entry; a bucket's chains as a forest."""

    def pack(batches):
        sids, sizes, prefixes, held, seen = [], [], [], 0, set()

        def out():
            rows = list(_pack(sids, sizes, prefixes, buckets))
            for a in range(0, len(rows), 8):
                part = rows[a : a + 8]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], names=["bucket", "blob"])

        for _, s in _each_set(batches, n):
            if not len(s) or (key := set_hash(s)) in seen:
                continue
            seen.add(key)
            p = entries(s, percent, prefix=True)
            sids.append(key)
            sizes.append(len(s))
            prefixes.append(p)
            held += len(p)
            if held >= 2_000_000:
                yield from out()
                sids, sizes, prefixes, held, seen = [], [], [], 0, set()
        if sids:
            yield from out()

    def chain(batches):
        parts = [_unpack(x.as_py()) for batch in batches for x in batch.column("blob")]
        if not parts:
            return
        ids, ns = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        uniq, place = np.unique(ids, return_inverse=True)
        size = np.zeros(len(uniq), np.int64)
        size[place] = ns
        doc = np.repeat(place, np.concatenate([p[2] for p in parts]))
        t = np.concatenate([p[3] for p in parts])
        order = np.lexsort((size[doc], t))
        t, doc = t[order], doc[order]
        a, b = doc[:-1], doc[1:]
        link = (t[:-1] == t[1:]) & (a != b) & (100 * size[a] >= percent * size[b])
        pairs = np.unique(np.stack([a[link], b[link]], 1), axis=0)
        classes, keep = Classes(len(uniq)), []
        for x, y in pairs.tolist():
            if classes.find(x) != classes.find(y):
                classes.join(x, y)
                keep.append((x, y))
        if keep:
            k = np.array(keep)
            yield pa.RecordBatch.from_arrays([pa.array(uniq[k[:, 0]]), pa.array(uniq[k[:, 1]])], names=["a", "b"])

    packed = texts.select("text").mapInArrow(pack, "bucket bigint, blob binary")
    return packed.groupBy("bucket").applyInArrow(lambda table: pa.Table.from_batches(list(chain(table.to_batches())), schema=_EDGE), "a bigint, b bigint")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def join_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set (ascending in size) the place of its class's first set under exact links."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(m)
    parts = [entries(s, percent, prefix=False) for s in sets]
    doc = np.repeat(np.arange(m, dtype=np.int32), [len(p) for p in parts])
    flat = np.concatenate(parts)
    del parts
    # only entries that two sets share make a list
    run = np.sort(flat)
    again = run[1:] == run[:-1]
    values = run[1:][again & np.append(~again[1:], True)]
    del run, again
    if not len(values):
        return label
    lists = np.minimum(np.searchsorted(values, flat), len(values) - 1).astype(np.int32)
    shared = values[lists] == flat
    doc, lists = doc[shared], lists[shared]
    n_lists = len(values)
    del flat, shared, values
    own = np.searchsorted(doc, np.arange(m + 1))  # lists of each set
    key = lists.astype(np.int64) * m + doc
    key.sort()  # members by list, then by size
    del doc
    first = np.full(n_lists, -1)  # a member of each list; mixed: not all are in its class
    mixed = np.zeros(n_lists, bool)
    known: list[dict[int, int]] = [{} for _ in range(m)]

    def join(x, y):
        a, b = sorted((label[x], label[y]))
        label[label == b] = a

    def answer(x, members, similar, whole):
        """Verify candidates of x, most shared entries first; the most similar set found so far.

        whole: members come from all of x's lists, so that too few of them rule a candidate out.
        """
        nx = int(size[x])
        seen = np.bincount(members, minlength=1)
        candidates = np.flatnonzero(seen)
        if whole and percent >= 75 and nx >= SINGLES:
            ny = size[candidates]
            need = -(-percent * (nx + ny) // (100 + percent))
            fewest = need - 2 * (nx + ny - 2 * need + 1)
            candidates = candidates[(ny < SINGLES) | (seen[candidates] >= fewest)]
        for y in candidates[np.argsort(-seen[candidates], kind="stable")].tolist():
            if label[y] == label[x] or y in known[x]:
                continue
            ny = int(size[y])
            need = least_overlap(nx, ny, percent)
            if similar is not None and (oz := known[similar[0]].get(y)) is not None:
                z, o = similar
                if o + oz - int(size[z]) >= need:
                    join(x, y)
                    continue
                if min(nx, oz + nx - o) < need:
                    continue
            o = known[x][y] = overlap(sets[x], sets[y])
            if o >= need:
                join(x, y)
                if similar is None or o > similar[1]:
                    similar = (y, o)
        return similar

    for x in range(m):
        mine = lists[own[x] : own[x + 1]]
        lo = int(np.searchsorted(size, -(-percent * int(size[x]) // 100)))
        similar = None
        for whole, part in ((False, mine[:4]), (True, mine)):  # a first link lets most lists be skipped
            part = part[first[part] >= 0]
            part = part[mixed[part] | (label[first[part]] != label[x])]
            if len(part) and lo < x:
                a, b = np.searchsorted(key, part.astype(np.int64) * m + lo), np.searchsorted(key, part.astype(np.int64) * m + x)
                n = b - a
                at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
                members = key[at] % m
                members = members[label[members] != label[x]]
                if len(members):
                    similar = answer(x, members, similar, whole)
        fresh = first[mine] < 0
        mixed[mine] |= ~fresh & (label[first[mine]] != label[x])
        first[mine[fresh]] = x
    return label


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _join_components(batches, percent: int):
    """Rows (comp, sid, shingles) sorted by comp -> (a, b) with b the class of a."""
    held, comp = [], None

    def flush():
        held.sort(key=lambda r: (len(r[1]), r[0]))
        label = join_sets([r[1] for r in held], percent)
        mine = [(r[0], held[label[k]][0]) for k, r in enumerate(held)]
        return [x for x in mine if x[0] != x[1]]

    out = []
    for batch in batches:
        for c, sid, blob in zip(*(batch.column(i) for i in range(3))):
            c = c.as_py()
            if c != comp:
                if len(held) > 1:
                    out += flush()
                held, comp = [], c
            held.append((sid.as_py(), np.frombuffer(blob.as_py(), np.uint64)))
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    if len(held) > 1:
        out += flush()
    if out:
        yield _edges(out)


def _edges(pairs):
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def shipped_sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(comp, sid, shingles) for the documents of wanted (rid, comp, sid)."""

    def run(batches):
        rows, held = [], 0
        for (comp, sid), s in _each_set(batches, n):
            rows.append((comp, sid, s.tobytes()))
            held += len(s)
            if held > 500_000:
                yield _sets(rows)
                rows, held = [], 0
        if rows:
            yield _sets(rows)

    return texts.join(small(wanted, 1_000_000), "rid").select("comp", "sid", "text").mapInArrow(run, "comp bigint, sid bigint, shingles binary")


def _sets(rows):
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["comp", "sid", "shingles"])


def join_large(sets: DataFrame, percent: int) -> DataFrame:
    """Exact edges among the sets (sid, shingles) of components too large for one task."""

    def post(batches):
        for batch in batches:
            for sid, blob in zip(batch.column(0), batch.column(1)):
                s = np.frombuffer(blob.as_py(), np.uint64)
                p = entries(s, percent, prefix=True)
                yield pa.RecordBatch.from_pydict({"t": p.view(np.int64), "sid": np.full(len(p), sid.as_py()), "size": np.full(len(p), len(s))})

    lists = written(sets.select("sid", "shingles").mapInArrow(post, "t bigint, sid bigint, size bigint"), "lists")

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))

        def check(batches):
            for batch in batches:
                keep = []
                for a, b, sa, sb in zip(*(batch.column(i) for i in range(4))):
                    x, y = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                    if overlap(x, y) >= least_overlap(len(x), len(y), percent):
                        keep.append((a.as_py(), b.as_py()))
                if keep:
                    yield _edges(keep)

        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")

    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    first = lists.groupBy("t").agg(F.min(F.struct("sid", "size")).alias("z"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    stars = lists.join(first, "t").select(F.col("z.sid").alias("a"), F.col("z.size").alias("na"), F.col("sid").alias("b"), F.col("size").alias("nb"))
    stars = stars.filter((F.col("a") != F.col("b")) & sized).select("a", "b").distinct()
    one = written(verify(stars), "stars")
    labels = connected_components(one).withColumnRenamed("node", "sid")
    named = lists.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = named.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("t")
    named = written(named.join(mixed, "t", "left_semi"), "mixed")
    a = named.select("t", F.col("sid").alias("a"), F.col("size").alias("na"), F.col("component").alias("ca"))
    b = named.select("t", F.col("sid").alias("b"), F.col("size").alias("nb"), F.col("component").alias("cb"))
    pairs = a.join(b, "t").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized).select("a", "b").distinct()
    return one.unionAll(verify(pairs))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, most_shingles: int = 6_000_000, bucket_entries: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, rid."""
    bounded_batches(docs.sparkSession)
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key="rid")
    texts = keyed.select("rid", "text")
    rows = written(set_table(texts, n), "sets")
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_entries))
    coarse = connected_components(candidate_edges(texts, n, percent, buckets)).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    one = rows.filter("sid is not null").groupBy("sid").agg(F.min("rid").alias("rid"), F.first("size").alias("size"))
    wanted = written(one.join(coarse, "sid"), "wanted")
    weight = wanted.groupBy("comp").agg(F.sum("size").alias("w"))
    big = written(weight.filter(F.col("w") > most_shingles).select("comp"), "big")
    any_big = big.limit(1).count() > 0
    near = wanted.select("rid", "comp", "sid")
    shipped = shipped_sets(texts, near.join(big, "comp", "left_anti") if any_big else near, n)
    parts = max(1, math.ceil(total / 20_000_000))
    spark = docs.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = shipped.repartition(parts, "comp").sortWithinPartitions("comp").mapInArrow(lambda it: _join_components(it, percent), "a bigint, b bigint")
    if any_big:
        sets = written(shipped_sets(texts, near.join(big, "comp", "left_semi"), n).select("sid", "shingles"), "large")
        links = links.unionAll(join_large(sets, percent))
        links = connected_components(links).select(F.col("node").alias("a"), F.col("component").alias("b"))
    # b is one class's representative; sets without links stand for themselves
    links = written(links, "links")
    named = rows.join(links.filter("a != b").withColumnRenamed("a", "sid"), "sid", "left").withColumn("g", F.coalesce("b", "sid"))
    ids = keyed.select("rid", "doc_id")
    named = named.select("rid", "size", "g").join(ids, "rid")
    least = named.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "g", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "rid")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one stays for each group of linked documents: the smallest doc_id's."""
    keyed = with_row_key(docs, key="_rid")
    groups = jaccard_components(keyed.select(F.col("_rid").alias("doc_id"), "text"))
    stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_rid"))
    return keyed.join(stay.hint("shuffle_hash"), "_rid", "left_semi").select(*docs.columns)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
