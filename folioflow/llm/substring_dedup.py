"""Removal of repeated word windows, with a count-min prefilter.

Every task codes its documents into chunks of about `CHUNK_BYTES` of text: the
distinct words, and each document's words as numbers. Texts are read and split
into words once, and never shuffled; the steps below read the coded table.

1. The count-min sketch has two rows of counters (0, 1, "2 or more") for each
   segment of the range of window hashes. A chunk counts its windows in a sketch
   of its own, sends each segment the counters that are not zero, and a segment
   adds the chunks' counters up. It answers each chunk with one bit per counter
   sent: estimated to be repeated, or not. Counters are shared by chance, so
   counts are overestimates and no repeated window is lost.
2. A window that both rows estimate to be repeated goes, once per chunk, with 128
   hash bits and the smallest id that holds it, to its segment, which groups such
   windows exactly and answers with the smallest id of all chunks.
3. Each chunk marks the windows that a smaller id holds and drops their words.

A segment has `SEGMENT_WINDOWS` windows as expected, but never so few that a
message would hold under `PER_MESSAGE` of a chunk's windows: messages are at most
one per `PER_MESSAGE` windows, whatever the size of the corpus, and beyond about
a hundred billion bytes segments grow instead (larger chunks keep them small). A
window that a third of all documents share is one entry per chunk. Nothing goes
to the driver but two sums.

Defined results: null text has no words; texts of fewer words than a window
keep them all; of repeated rows with one id none removes the other's words; a
null id removes nothing and loses nothing. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import slices
from folioflow.llm._tables import written

WINDOW = 13
CHUNK_BYTES = 8 << 20
SEGMENT_WINDOWS = 1 << 20
PER_MESSAGE = 64
LOAD = 8  # counters of a row for each window expected in a segment
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Vocabulary(dict):
    """word -> number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    return h * np.uint64(0x81DADEF4BC2DD44D) ^ (h >> np.uint64(33))


def _rolled(h: np.ndarray, m: np.uint64, n: int) -> np.ndarray:
    """Polynomial hash of the n values from each position on (shorter at the end: left out)."""
    out, at = None, 0
    power, span, block = m, 1, h
    # binary decomposition of n, from its lowest bit: the blocks stand one behind the other
    while n:
        if n & 1:
            keep = len(h) - at - span + 1
            if keep <= 0:
                return h[:0]
            part = block[at : at + keep]
            out = part if out is None else out[:keep] * power + part
            at += span
        n >>= 1
        if n:
            block = block[:-span] * power + block[span:] if len(block) > span else block[:0]
            power, span = power * power, span * 2
    return out


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, so that compression sees the zeros."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


_CODEC = pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


CODED = "chunk long, windows long, ids binary, known binary, sizes binary, numbers binary, words binary, lengths binary"


def code(ids: list, texts: list, window: int) -> dict:
    """A chunk: ids (and which are not null), words per document, words as numbers, the distinct words and their lengths."""
    vocabulary, sizes, numbers = _Vocabulary(), [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        sizes.append(len(words))
        numbers.append(np.fromiter([vocabulary[w] for w in words], np.uint32, len(words)))
    n, all_numbers = np.array(sizes, np.int64), np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
    # frequent words get small numbers, which take less room
    common = np.argsort(-np.bincount(all_numbers, minlength=len(vocabulary)), kind="stable")
    rank, words = np.empty(len(common), np.int64), list(vocabulary)
    rank[common] = np.arange(len(common))
    words = [words[i] for i in common.tolist()]
    return {
        "windows": int(np.maximum(n - window + 1, 0).sum()), "ids": np.array([d or 0 for d in ids], np.int64).tobytes(), "known": np.array([d is not None for d in ids], bool).tobytes(), "sizes": _planes(n),
        "numbers": _packed(_planes(rank[all_numbers])), "words": _packed(b"".join(words)), "lengths": _packed(_planes(np.array([len(w) for w in words], np.int64))),
    }


class Chunk:
    """A coded chunk's documents and windows. A window's hash, document and first word stand at one index."""

    def __init__(self, row: dict, window: int = WINDOW):
        self.ids, self.known, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), _from_planes(row["sizes"])
        self.numbers, self.window, words = _from_planes(_unpacked(row["numbers"])), window, _unpacked(row["words"])
        ends = np.cumsum(_from_planes(_unpacked(row["lengths"]))).tolist()
        self.words = [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        valid = np.where(self.known, np.maximum(self.sizes - window + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(self.ids)), valid)
        self.first = np.arange(len(self.doc)) - np.repeat(np.cumsum(valid) - valid, valid) + self.starts[self.doc]

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in self.words]), np.uint64).reshape(-1, 2)

    def hashes(self, k: int, of: np.ndarray | None = None) -> np.ndarray:
        """The k-th 64-bit hash of each window, or of some."""
        first = self.first if of is None else self.first[of]
        if not len(first):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mix(_rolled(self.word_hashes[self.numbers, k], (_M1, _M2)[k], self.window)[first])

    def results(self, flagged: np.ndarray, keep_text: bool) -> dict:
        """Per document: number of words, number removed, kept words' hash."""
        step = np.zeros(len(self.numbers) + 1, np.int64)
        np.add.at(step, self.first[flagged], 1)
        np.add.at(step, self.first[flagged] + self.window, -1)
        keep = np.cumsum(step[:-1]) == 0
        before = np.r_[0, np.cumsum(keep)]
        kept = before[self.starts + self.sizes] - before[self.starts]
        sha, texts, words = [], [], self.words
        for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            left = b" ".join([words[i] for i in self.numbers[a : a + n][keep[a : a + n]].tolist()])
            sha.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "surrogatepass") if keep_text else None)
        ids = [d if k else None for d, k in zip(self.ids.tolist(), self.known.tolist(), strict=True)]
        return {"doc_id": ids, "n_words": self.sizes, "n_removed": self.sizes - kept, "kept_sha256": sha, "kept": texts}


class Sketch:
    """The range of window hashes in `segments` parts, each with two rows of `width` counters (a power of two)."""

    def __init__(self, segments: int, width: int):
        self.segments, self.width = segments, width

    def segment(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.segments)).astype(np.int64)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """Each window's counter in a row, numbered through all segments."""
        low = (h * np.uint64(0xD6E8FEB86659FD93 if row else 1)) >> np.uint64(20 if row else 0)
        return self.segment(h) * self.width + (low & np.uint64(self.width - 1)).astype(np.int64)


def counted(cells: np.ndarray):
    """The counters that are not zero, in order, whether each is 2 or more, and each window's index among them."""
    order = np.argsort(cells, kind="stable")
    c = cells[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    index = np.empty(len(c), np.int64)
    index[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return c[at], np.diff(at, append=len(c)) > 1, index


MESSAGE = "chunk long, kind int, seg int, payload binary"
TO_SEGMENT = "seg int, chunk long, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in text.split(", "))])


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    arrow = _schema(schema)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _by_segment(cells: np.ndarray, width: int):
    """(segment, from, to) of the segments that have counters."""
    if not len(cells):
        return
    seg = cells // width
    cut = np.flatnonzero(np.diff(seg)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(seg)], strict=True):
        yield int(seg[a]), a, b


def _counters(cells: np.ndarray, many: np.ndarray) -> bytes:
    """Counters of one segment's row: differences of their places, and a bit each for "2 or more"."""
    return np.uint32(len(cells)).tobytes() + _planes(np.diff(cells, prepend=0)) + np.packbits(many).tobytes()


def _read_counters(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    n = int.from_bytes(data[at : at + 4], "little")
    end = at + 4 + 4 * n
    stop = end + -(-n // 8)
    return np.cumsum(_from_planes(data[at + 4 : end])), np.unpackbits(np.frombuffer(data[end:stop], np.uint8), count=n), stop


def _bits(marks: np.ndarray) -> bytes:
    return np.packbits(marks).tobytes()


def _distinct(h1: np.ndarray, h2: np.ndarray, d: np.ndarray):
    """The distinct pairs of hashes in order, the smallest id of each, and each one's index."""
    order = np.lexsort((d, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(new) - 1
    return a[new], b[new], d[order][new], index


def coded(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """The documents (`doc_id`, `text`) in coded chunks; a longer document is a chunk of its own."""
    schema = _schema(CODED)

    def work(batches):
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            row = {"chunk": (part << 32) + n} | code(ids, texts, window)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in slices(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t or "") + 16
                if size >= chunk_bytes:
                    yield out()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield out()

    return docs.mapInArrow(work, CODED)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_removed`, `kept_sha256` and the `kept` words (null unless `keep_text`)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = written(coded(docs, window, chunk_bytes))
    n_chunks, n_windows = chunks.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    segments = max(1, min(-(-n_windows // SEGMENT_WINDOWS), n_windows // (PER_MESSAGE * max(1, n_chunks))))
    sketch = Sketch(segments, 1 << max(4, (LOAD * -(-n_windows // segments) - 1).bit_length()))
    width = sketch.width

    def count(batches):
        """Each chunk's own sketch, by segment."""
        for batch in batches:
            for i in range(batch.num_rows):  # one chunk at a time in memory
                (row,) = batch.slice(i, 1).to_pylist()
                h = Chunk(row, window).hashes(0)
                loads: dict[int, list[bytes]] = {}
                for k in (0, 1):
                    cells, many, _ = counted(sketch.cells(h, k))
                    for s, a, b in _by_segment(cells, width):
                        loads.setdefault(s, []).append(_counters(cells[a:b] - s * width, many[a:b]))
                yield from _rows([(s, row["chunk"], _packed(b"".join(x))) for s, x in loads.items()], TO_SEGMENT).to_batches(1024)

    def merge(table: pa.Table) -> pa.Table:
        """The segment's counters are sums of the chunks'; each chunk learns which of its own came to 2 or more."""
        loads = table.column("payload").to_pylist()
        answers, ends = [b""] * len(loads), [0] * len(loads)
        for _ in (0, 1):
            counters, sent = np.zeros(width, np.uint8), []
            for i, p in enumerate(loads):
                cells, many, ends[i] = _read_counters(_unpacked(p), ends[i])
                counters[cells] = np.minimum(counters[cells] + 1 + many, 2)  # a chunk's cells are distinct
                sent.append(cells)
            answers = [x + _bits(counters[c] > 1) for x, c in zip(answers, sent, strict=True)]
        return _rows([(c, 1, s, x) for c, s, x in zip(table.column("chunk").to_pylist(), table.column("seg").to_pylist(), answers, strict=True)], MESSAGE)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """To each segment the windows estimated to be repeated; to the chunk itself, as kind 2, where they stand."""
        if not len(left):
            return _rows([], MESSAGE)
        (row,) = left.to_pylist()
        c, bits = Chunk(row, window), dict(zip(right.column("seg").to_pylist(), right.column("payload").to_pylist(), strict=True))
        h = c.hashes(0)
        repeated, at = np.ones(len(h), bool), dict.fromkeys(bits, 0)
        for k in (0, 1):
            cells, _, index = counted(sketch.cells(h, k))
            marks = np.zeros(len(cells), bool)
            for s, a, b in _by_segment(cells, width):
                n = -(-(b - a) // 8)
                marks[a:b] = np.unpackbits(np.frombuffer(bits[s][at[s] : at[s] + n], np.uint8), count=b - a)
                at[s] += n
            repeated &= marks[index]
        of = np.flatnonzero(repeated)
        a, b, low, index = _distinct(h[of], c.hashes(1, of), c.ids[c.doc[of]])
        seg = sketch.segment(a)
        order = np.argsort(seg, kind="stable")
        a, b, low, seg = a[order], b[order], low[order], seg[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = [(row["chunk"], 1, s, a[i:j].tobytes() + b[i:j].tobytes() + low[i:j].tobytes()) for s, i, j in _by_segment(seg, 1)]
        return _rows([*rows, (row["chunk"], 2, -1, _planes(of) + _planes(place[index]))], MESSAGE)

    def group(table: pa.Table) -> pa.Table:
        """The smallest id of each window of the segment, exactly."""
        loads = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in table.column("payload").to_pylist()]
        a, b, d = (np.concatenate([x[k] for x in loads]) for k in range(3))
        _, _, low, index = _distinct(a, b, d.view(np.int64))
        answers = np.split(low[index], np.cumsum([x.shape[1] for x in loads])[:-1])
        return _rows([(c, 1, s, x.tobytes()) for c, s, x in zip(table.column("chunk").to_pylist(), table.column("seg").to_pylist(), answers, strict=True)], MESSAGE)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _rows([], RESULT)
        c = Chunk(left.to_pylist()[0], window)
        mail = sorted(zip(*(right.column(n).to_pylist() for n in ("kind", "seg", "payload")), strict=True), key=lambda m: m[:2])
        places = [p for kind, _, p in mail if kind == 2]
        flagged = np.zeros(0, np.int64)
        if places and places[0]:
            of, index = _from_planes(places[0][: len(places[0]) // 2]), _from_planes(places[0][len(places[0]) // 2 :])
            low = np.concatenate([np.frombuffer(p, np.int64) for kind, _, p in mail if kind == 1])
            flagged = of[low[index] < c.ids[c.doc[of]]]
        arrow = _schema(RESULT)
        out = c.results(flagged, keep_text)
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    table = chunks.drop("windows")
    by_chunk = lambda mail: table.groupBy("chunk").cogroup(mail.groupBy("chunk"))
    bits = table.mapInArrow(count, TO_SEGMENT).groupBy("seg").applyInArrow(merge, MESSAGE)
    # computed for the segments and again for the chunks, from the same shuffles: their table would take as much room as the shuffle of the chunks
    found = by_chunk(bits).applyInArrow(candidates, MESSAGE)
    least = found.where("kind = 1").select("seg", "chunk", "payload").groupBy("seg").applyInArrow(group, MESSAGE)
    return by_chunk(found.where("kind = 2").unionByName(least)).applyInArrow(finish, RESULT)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT k.doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN m ON k.g = m.g WHERE low < k.doc_id) GROUP BY doc_id),
p AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN ws ELSE list_filter(ws, lambda v, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM p
"""
