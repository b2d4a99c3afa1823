"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles, equal sets become one representative, and a
representative gets a signature of `COORDINATES` min-hashes. In each run a set
chooses a random few of its signature's tokens, 1 / (threshold x COORDINATES)
each, so that two sets at the threshold share about one choice; sets with the
same choice meet in a bucket. A bucket of more than `LARGE` sets is split again
by further choices, at most `DEPTH` levels deep. Buckets compare signatures by
brute force, those of more than `SMALL` sets in pairs of blocks, none left out.
With q(0) = 1 and q(d) = 1 - exp(-q(d - 1)) a pair at the threshold meets in a
run with probability q(DEPTH) at least; runs are repeated until the chance that
it has met reaches `RECALL`. More levels part larger corpora's buckets further,
at the price of more runs.

What met, at a lower signature agreement than the threshold's (`SLACK`
deviations), forms provisional clusters. Within a cluster every pair's exact
Jaccard similarity decides, again in pairs of blocks; no pair is ever a row.

Defined results: null text counts as empty; texts without words have no links
and a class of their own; texts of fewer words than a shingle are one shingle;
equal sets (copies) are one class and count as one text; rows with a null id
are left out; repeated rows give one row each; an id with several texts is in
the class of each of them, row by row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import release, slices
from folioflow.llm._tables import components, discard, splittable, written

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
DEPTH = 2
LARGE = 1024
SMALL = 512
RECALL = 0.999
SLACK = 3.8
BLOCK = 96
AT_ONCE = 400_000  # shingles of a group of sets in memory as arrays
_U = np.uint64


def meeting(depth: int) -> float:
    """Least chance that a pair at the threshold meets in a run of this depth."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(depth)))


def least_agreement(threshold: float = THRESHOLD) -> int:
    """Coordinates that must agree for a provisional link."""
    return math.floor(COORDINATES * threshold - SLACK * math.sqrt(COORDINATES * threshold * (1 - threshold)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, known: dict) -> np.ndarray:
    """The set of a text's word shingles as ascending 64-bit hashes."""
    words = (text or "").lower().split()
    h = np.array([known[w] for w in words], np.uint64)
    n = min(SHINGLE, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, _U(n))
        for i in range(n):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


_A = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)).astype(np.uint32)[:, None] | np.uint32(1)
_B = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0xAF251AF3B0F025B5)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(items: np.ndarray) -> np.ndarray:
    """Min-hashes of a set, 32 bits each."""
    h = (items >> _U(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):  # long texts by parts
        x = h[None, i : i + 4096] * _A
        x ^= x >> np.uint32(15)
        x *= _B
        x ^= x >> np.uint32(13)
        out = np.minimum(out, x.min(1))
    return out


def _chosen(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each path and each coordinate's token: which are chosen, and the paths that they lead to."""
    j = np.arange(COORDINATES, dtype=np.uint64) * _U(0x2545F4914F6CDD1D)
    h = _mix(_mix(paths[:, None] ^ j) + tokens.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    row, at = np.nonzero(h < _U(int(2**64 / (threshold * COORDINATES))))
    return row, _mix(h[row, at] ^ _U(0x632BE59BD9B4E019))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_id", pa.binary()), ("sig", pa.binary()), ("paths", pa.list_(pa.int64()))])
_ROWS = "path long, rep long, sig binary"
_ROWS_PA = pa.schema([("path", pa.int64()), ("rep", pa.int64()), ("sig", pa.binary())])


def sign(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Per row: `doc_id`, `text_key`, its set's identity, byte signature, and the first level's chosen paths. Wordless texts have nulls."""
    seeds = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

    def work(batches):
        known = _Words()
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets, sigs, paths = [], [], []
                for text in batch.column(2).to_pylist():
                    items = shingles(text, known)
                    if not len(items):
                        sets.append(None), sigs.append(None), paths.append(None)
                        continue
                    sets.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    full = signature(items)
                    sigs.append(full.astype(np.uint8).tobytes())
                    paths.append(_chosen(seeds, np.broadcast_to(full, (runs, COORDINATES)), threshold)[1].view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, type=f.type) for x, f in zip((sets, sigs, paths), list(_SIGNED)[2:], strict=True))], schema=_SIGNED)

    return docs.select("doc_id", "text_key", "text").mapInArrow(work, "doc_id long, text_key long, set_id binary, sig binary, paths array<long>")


def _deeper(rows: DataFrame, threshold: float) -> DataFrame:
    """The next level's rows of the sets of large buckets."""

    def work(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                tokens = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                at, new = _chosen(b.column(0).to_numpy().view(np.uint64), tokens, threshold)
                index = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), b.column(1).take(index), b.column(2).take(index)], schema=_ROWS_PA)

    return rows.select("path", "rep", "sig").mapInArrow(work, _ROWS)


def _in_blocks(rows: DataFrame, key: str, size: int, *carry: str) -> DataFrame:
    """Rows of a key that has `n` members, dealt to pairs of blocks `i` <= `j` of about `size` members; `own` is the row's block.

    Every two members of a key share a pair of blocks, and only one pair unless they share a block.
    """
    blocks = F.ceil(F.col("n") / F.lit(size)).cast("int")
    # by the member alone: in all keys that hold the same members the same ones meet, and agree on their root
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = rows.select(key, "rep", *carry, blocks.alias("__k"), own.alias("own"))
    dealt = dealt.select(key, "rep", *carry, "own", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__o"))
    return dealt.select(key, F.least("own", "__o").alias("i"), F.greatest("own", "__o").alias("j"), "own", "rep", *carry)


def _groups(batches, keys: int):
    """Whole groups of rows with equal first `keys` columns from sorted Arrow batches."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if t.num_rows > 1 else np.zeros(0, int)
        if len(cut):
            yield t.slice(0, int(cut[-1])), np.r_[0, cut]
            rest = t.slice(int(cut[-1]))
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])
    release()


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _provisional(rows: DataFrame, agree: int) -> DataFrame:
    """Edges (`u` > `v`) that span what agrees within each bucket.

    A block's own group gives every member's edge to the smallest of its part;
    a pair of blocks gives only edges between such smallest ones.
    """

    def parts(ids: np.ndarray, sigs: np.ndarray) -> np.ndarray:
        """For each row the place of the smallest id that agreement leads to."""
        left = np.argsort(ids, kind="stable")
        root = np.empty(len(ids), int)
        while len(left):
            first, frontier, left = left[0], left[:1], left[1:]
            root[first] = first
            while len(frontier) and len(left):
                found = np.zeros(len(left), bool)
                for f in frontier:
                    found |= (sigs[left] == sigs[f]).sum(1) >= agree
                    if found.all():
                        break
                frontier, left = left[found], left[~found]
                root[frontier] = first
        return root

    def spans(ids: np.ndarray, sigs: np.ndarray, own: np.ndarray, one: bool) -> np.ndarray:
        root = parts(ids, sigs)
        if one:
            return np.stack([ids, ids[root]], 1)
        firsts = np.concatenate([at[np.unique(parts(ids[at], sigs[at]))] for at in (np.flatnonzero(own == b) for b in np.unique(own))])
        return np.stack([ids[firsts], ids[root[firsts]]], 1)

    def work(batches):
        for t, cut in _groups(batches, 3):
            ids, own = t.column("rep").to_numpy(), t.column("own").to_numpy()
            one = t.column("i").to_numpy() == t.column("j").to_numpy()
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            starts, sizes = cut[:-1], np.diff(cut)
            few = (sizes <= 8) & one[starts]
            out = [np.zeros((0, 2), np.int64)]
            for n in np.unique(sizes[few]).tolist():  # small groups of one size together
                at = starts[few & (sizes == n)]
                for a in range(n):
                    for b in range(a + 1, n):
                        x, y = at + a, at + b
                        ok = (sigs[x] == sigs[y]).sum(1) >= agree
                        out.append(np.stack([np.maximum(ids[x], ids[y])[ok], np.minimum(ids[x], ids[y])[ok]], 1))
            for a, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                out.append(spans(ids[a : a + n], sigs[a : a + n], own[a : a + n], bool(one[a])))
            e = np.concatenate(out)
            e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=_EDGE)

    dealt = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return dealt.select("path", "i", "j", "own", "rep", "sig").mapInArrow(work, "u long, v long")


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """Of each group of sets: a set's exact links in it and the root of its links."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def linked(own: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], same: bool):
        sizes = np.array([len(s) for s in sets], np.float32)
        both = np.zeros((len(sets), len(sets)), np.float32)
        # by ranges of the hashes, so that memory is bounded for sets of any length
        ranges = max(1, -(-int(sizes.sum()) // AT_ONCE))
        edges = [np.searchsorted(s, np.array([k * (2**64 // ranges) for k in range(1, ranges)], np.uint64)) for s in sets]
        edges = [np.r_[0, e, len(s)] for e, s in zip(edges, sets, strict=True)]
        for k in range(ranges):
            part_sets = [s[e[k] : e[k + 1]] for s, e in zip(sets, edges, strict=True)]
            items, owner = np.concatenate(part_sets), np.repeat(np.arange(len(sets)), [len(s) for s in part_sets])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            new = np.ones(len(items), bool)
            new[1:] = items[1:] != items[:-1]
            number = np.cumsum(new) - 1
            shared = np.bincount(number) > 1  # what only one set holds links nothing
            column = np.cumsum(shared) - 1
            keep = shared[number]
            owner, number = owner[keep], column[number[keep]]
            for at in range(0, int(shared.sum()), 4096):
                lo, hi = np.searchsorted(number, (at, at + 4096))
                part = np.zeros((len(sets), 4096), np.float32)
                part[owner[lo:hi], number[lo:hi] - at] = 1
                both += part @ part.T
        union = sizes[:, None] + sizes[None, :] - both
        link = both >= threshold * union - 1e-4
        link &= ids[:, None] != ids[None, :]
        if not same:
            link &= own[:, None] != own[None, :]
        root = np.arange(len(sets))
        rank = np.argsort(np.argsort(ids))
        while True:  # least rank among neighbours until nothing changes
            low = np.where(link, rank[None, :], len(sets)).min(1, initial=len(sets))
            better = np.minimum(rank, low)
            if (better == rank).all():
                break
            rank = better
        root = np.sort(ids)[rank]
        return root, link.sum(1)

    def work(batches):
        for t, cut in _groups(batches, 3):
            ids, own, i, j = (t.column(c).to_numpy() for c in ("rep", "own", "i", "j"))
            loads = t.column("items")
            for a, b in zip(cut[:-1].tolist(), [*cut[1:].tolist(), t.num_rows] if cut[-1] != t.num_rows else cut[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                root, links = linked(own[a:b], ids[a:b], [np.frombuffer(x.as_buffer(), np.uint64) for x in loads.slice(a, b - a)], i[a] == j[a])
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], schema=schema)

    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    return dealt.select("cluster", "i", "j", "own", "rep", "items").mapInArrow(work, "rep long, root long, links long")


def _sets(texts: DataFrame) -> DataFrame:
    """`rep`, `cluster`, `n` and the shingle set of each text."""

    def work(batches):
        known = _Words()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t, known).tobytes() for t in b.column(3).to_pylist()], type=pa.binary())], names=["rep", "cluster", "n", "items"])

    return texts.select("rep", "cluster", "n", "text").mapInArrow(work, "rep long, cluster long, n long, items binary")


def text_key(text: str):
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """Per row: `doc_id`, `class_id` (the smallest id that links lead to) and `n_links` (different texts that it is linked with)."""
    return joined_rows(df, key, text, threshold, recall, depth).select("doc_id", "class_id", "n_links")


def joined_rows(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """What `jaccard_join` gives, with each row's `text_key` and its class's number `class_set` (null without words)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    signed = written(sign(docs, threshold, runs_needed(recall, depth)))

    # copies are aggregated on both sides of the shuffle, so a hot set is one row per task
    reps = signed.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key", "sig", "paths")).alias("r"))
    # a number of its own for each set: one id may have several sets
    reps = written(reps.select("set_id", F.monotonically_increasing_id().alias("rep"), F.col("r.doc_id").alias("first"), F.col("r.text_key").alias("text_key"), F.col("r.sig").alias("sig"), F.col("r.paths").alias("paths")))

    level, parts, done = reps.select(F.explode("paths").alias("path"), "rep", "sig"), [], []
    for step in range(1, depth + 1):
        met = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(splittable("path").alias("__k"), "n")
        rows = written(level.withColumn("__k", splittable("path")).join(met, "__k").select("path", "rep", "sig", "n"))
        done.append(rows)
        last = step == depth
        parts.append(_in_blocks(rows if last else rows.where(F.col("n") <= LARGE), "path", SMALL, "sig"))
        if not last:
            level = written(_deeper(rows.where(F.col("n") > LARGE), threshold))
            done.append(level)
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    clusters = components(_provisional(together, least_agreement(threshold)).distinct())
    discard(*done)

    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).select(splittable("root").alias("__k"), "n")
    members = written(clusters.withColumn("__k", splittable("root")).join(sizes, "__k").select(F.col("id").alias("rep"), F.col("root").alias("cluster"), "n"))
    discard(clusters)
    # one text per set: repeated rows must not count twice
    firsts = reps.select("rep", F.col("first").alias("doc_id"), "text_key")
    held = docs.join(members.join(firsts, "rep"), ["doc_id", "text_key"]).groupBy("rep", "cluster", "n").agg(F.min("text").alias("text"))
    found = written(_exact(_in_blocks(_sets(held), "cluster", BLOCK, "items"), threshold))
    discard(members)

    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    rooted = written(classes.withColumnRenamed("id", "rep").join(firsts, "rep").select("rep", "root", "doc_id"))
    discard(classes)
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")).select(splittable("root").alias("__k"), "class_id")
    linked = rooted.withColumn("__k", splittable("root")).join(smallest, "__k").join(links, "rep").select("rep", "root", "class_id", "n_links")
    of = reps.select("set_id", "rep", "first").join(linked, "rep", "left")
    out = signed.select("doc_id", "text_key", "set_id").join(of, "set_id", "left")
    return out.select("doc_id", "text_key", F.coalesce("root", "rep").alias("class_set"), F.coalesce("class_id", "first", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) ELSE [array_to_string(ws, ' ')] END) AS g FROM w WHERE len(ws) > 0),
d AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS sid, count(*) AS n FROM s GROUP BY doc_id),
reps AS (SELECT sid, min(doc_id) AS rep, any_value(n) AS n FROM d GROUP BY sid),
r AS (SELECT s.doc_id AS rep, s.g, reps.n FROM s JOIN reps ON s.doc_id = reps.rep),
pairs AS (SELECT a.rep AS x, b.rep AS y FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
links AS (SELECT x AS u, y AS v FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT u, u AS v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT documents.doc_id, coalesce(root, reps.rep, documents.doc_id) AS class_id, coalesce(degrees.n, 0) AS n_links
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id LEFT JOIN reps ON d.sid = reps.sid LEFT JOIN roots ON reps.rep = roots.u LEFT JOIN degrees ON reps.rep = degrees.u
"""
