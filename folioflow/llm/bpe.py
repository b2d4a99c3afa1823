"""BPE encoding by tree concatenation, and decoding.

A text longer than `piece` characters is halved until its pieces are short, the
pieces of a whole batch are encoded together, and the halves' ids are joined
bottom-up: windows around each join are encoded again, and grown, until they
agree with both sides. A window begins and ends at a space, where this
tokenizer's words can't cross, so agreement on both sides is exact. A run
without spaces is one word to the merges; it is halved too, as a fragment of
the byte alphabet, and its windows begin and end between two ids. There the
join is exact because ids are a valid encoding if and only if each neighbouring
pair is one, and every pair of the result occurs in a valid encoding.

Texts of more than `LONG` characters are dealt: their leaves, stretches of text or
fragments of a run without spaces, are rows that all tasks encode in parallel, and
one task per text then joins them upward. Equal long texts are encoded once.

Where no window short of both whole sides agrees, both sides are encoded again
as one. The joins hold for files of the `FORM` below, whose words can't cross
spaces; others are refused. Defined results: null text counts as empty; an empty text has no ids
and decodes to an empty string; special-token strings in a text become their
ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from copy import copy
from functools import cached_property
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import map_columns, slices

PIECE = 4096
WINDOW = 48
KEPT_WORDS = 600_000  # of a task's memory of encoded words, some 150 MB; emptied when full
KEPT_LENGTH = 48
LONG = 1 << 18
LEAF = 1 << 16  # characters of a long text that one row holds
PLAIN = "\u0130"  # letters below it are lowered one by one and have no combining forms
SIGNS = ".,;:!?&%$#*|)\""
PARTING = "<|endoftext|>"  # a special token; its id parts words that are encoded together
# The parts of a tokenizer file that the joins and the learned words rely on.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "decoder": None,
}


def tokenizer_json(path: str | None = None) -> str:
    """A tokenizer file's text; read on the driver only."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def check_form(source: str) -> None:
    """Raise where a tokenizer file is not of the form that the joins hold for."""
    found = json.loads(source)
    model = found["model"]
    bad = [k for k, v in FORM.items() if found.get(k) != v] + [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
    if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
        bad.append("model")
    if not any(t["content"] == PARTING for t in found["added_tokens"]):
        bad.append("added_tokens")
    if bad:
        raise ValueError(f"tree concatenation doesn't hold for this tokenizer's {', '.join(bad)}")


class TreeEncoder:
    """Encodes texts as the library's tokenizer does, in pieces."""

    def __init__(self, source: str, piece: int = PIECE, window: int = WINDOW, kept: int = KEPT_WORDS):
        # tasks are the parallelism: the library's threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_form(source)
        self.source = source
        self.library = Tokenizer.from_str(source)
        self.library.no_padding()
        self.library.no_truncation()
        self.suffix = json.loads(source)["model"].get("end_of_word_suffix") or ""
        self.piece, self.window, self.kept, self.known = piece, window, kept, {}
        self.parting = PARTING
        self.parting_id = self.library.token_to_id(self.parting)
        self.unsplit = re.compile(rf"\S{{{piece},}}")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokens = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.numbers = list(range(len(self.tokens)))
        self.widths = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.tokens]

    @cached_property
    def fragments(self):
        """Two tokenizers of single words: for what ends inside a word, and for what ends it. Made when a long run needs them."""
        from tokenizers import Tokenizer, models

        model = json.loads(self.source)["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return Tokenizer(models.BPE(vocab, merges)), Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix or None))

    @property
    def middle(self):
        return self.fragments[0]

    @property
    def last(self):
        return self.fragments[1]

    def _library(self, texts: list[str]) -> list[list[int]]:
        """Each text as the library encodes it; what stands between spaces is looked up where this worker has met it."""
        known = self.known
        if len(known) > self.kept:
            known.clear()
        rows = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = {w for row in rows for w in row if w not in known}
        long = {w for w in fresh if len(w) > KEPT_LENGTH}
        self._learn(fresh - long)
        if not long:
            return [list(chain.from_iterable([known[w] for w in row])) for row in rows]
        once = dict(zip(long, (e.ids for e in self.library.encode_batch_fast(list(long), add_special_tokens=False)), strict=True))
        return [list(chain.from_iterable([once[w] if w in once else known[w] for w in row])) for row in rows]

    def _learn(self, fresh: set[str]) -> None:
        """Encode words that stand between spaces and remember them.

        A word of plain Latin letters has the ids of its lower-case stem and then
        those of its closing signs: this tokenizer lowers case, and a change from
        a letter or digit to these signs parts its words.
        """
        known, parted, stems = self.known, [], set()
        numbers = self.numbers  # one object per id, however many words have it
        for w in fresh:
            folded = w.lower()
            if not w or max(w) >= PLAIN or max(folded) >= PLAIN:
                stems.add(w)
                continue
            stem = folded.rstrip(SIGNS)
            if stem and stem[-1].isalnum():
                parted.append((w, stem, folded[len(stem) :]))
            else:
                parted.append((w, folded, ""))
        stems.update(x for _, stem, tail in parted for x in (stem, tail))
        need = [x for x in stems if x not in known]
        odd = [x for x in need if "<" in x]
        even = [x for x in need if "<" not in x]
        for e, x in zip(self.library.encode_batch_fast(odd, add_special_tokens=False), odd, strict=True):
            known[x] = tuple([numbers[i] for i in e.ids])
        # many words a call, parted by a special token's id, which none of them can give
        packs = [even[i : i + 64] for i in range(0, len(even), 64)]
        for k in range(0, len(packs), 16):  # the library's encodings are large, so few at a time
            some = packs[k : k + 16]
            for e, pack in zip(self.library.encode_batch_fast([self.parting.join(p) for p in some], add_special_tokens=False), some, strict=True):
                ids, at = [*e.ids, self.parting_id], 0
                for x in pack:
                    end = ids.index(self.parting_id, at)
                    known[x] = tuple([numbers[i] for i in ids[at:end]])
                    at = end + 1
        for w, stem, tail in parted:
            known[w] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> list[list[int]]:
        # a long run without spaces, in a text without special tokens, has no pieces here
        spans = [[] if len(t) > self.piece and self.unsplit.search(t) and not any(s in t for s in self.special) else self._halves(0, len(t)) for t in texts]
        flat = iter(self._library([t[a:b] for t, cut in zip(texts, spans, strict=True) for a, b in cut]))
        out = []
        for t, cut in zip(texts, spans, strict=True):
            if not cut:
                out.append(self._mixed(t))
            else:
                out.append(self._tree(t, [(a, b, next(flat)) for a, b in cut]))
        return out

    def _halves(self, a: int, b: int, size: int | None = None) -> list[tuple[int, int]]:
        if b - a <= (size or self.piece):
            return [(a, b)]
        mid = (a + b) // 2
        return self._halves(a, mid, size) + self._halves(mid, b, size)

    def leaves(self, t: str, size: int = LEAF) -> list[tuple[int, int, str]]:
        """A text's leaves in order: (part, kind, characters).

        Kind 0 is a stretch of text; 1 a fragment within a word of the byte
        alphabet and 2 one that ends it; 3 short words of that alphabet, on lines.
        """
        out, part, at = [], 0, 0

        def stretch(a: int, b: int) -> None:
            nonlocal part
            out.extend((part, 0, t[x:y]) for x, y in self._halves(a, b, size))
            part += 1

        if not any(s in t for s in self.special):
            for m in self.unsplit.finditer(t):
                if m.start() > at:
                    stretch(at, m.start())
                at, short = m.end(), []
                # whole run at once: NFC and lower case look at neighbouring characters
                for word, _ in [*self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(m[0])), (None, None)]:
                    if short and (word is None or len(word) > self.piece or len(short) >= size):
                        out.append((part, 3, "\n".join(short)))
                        part, short = part + 1, []
                    if word is not None and len(word) > self.piece:
                        cut = self._halves(0, len(word))
                        out += [(part, 1 + (b == len(word)), word[a:b]) for a, b in cut]
                        part += 1
                    elif word is not None:
                        short.append(word)
        if at < len(t) or not out:
            stretch(at, len(t))
        return out

    def leaf_ids(self, kind: int, chars: str) -> list[int]:
        if kind == 0:
            return self.encode([chars])[0]
        if kind == 3:
            return list(chain.from_iterable(e.ids for e in self.last.encode_batch(chars.split("\n"))))
        return (self.middle if kind == 1 else self.last).encode(chars).ids

    def joined(self, leaves: list[tuple[int, int, str, list[int]]]) -> list[int]:
        """The ids of a text from its leaves in order: (part, kind, characters, ids)."""
        out = []
        for _, group in groupby(leaves, key=lambda leaf: leaf[0]):
            some = list(group)
            ends = list(accumulate(len(chars) for *_, chars, _ in some))
            parts = [(b - len(chars), b, ids) for b, (*_, chars, ids) in zip(ends, some, strict=True)]
            whole = "".join(chars for *_, chars, _ in some)
            out += self._tree(whole, parts) if some[0][1] == 0 else self._fragment_tree(whole, parts)
        return out

    def _tree(self, t: str, parts: list[tuple[int, int, list[int]]]) -> list[int]:
        while len(parts) > 1:
            joined = [(x[0], y[1], self._join(t, x, y)) for x, y in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + (parts[-1:] if len(parts) % 2 else [])
        return parts[0][2]

    def _join(self, t: str, x: tuple, y: tuple) -> list[int]:
        (lo, mid, left), (_, hi, right), w = x, y, self.window
        while True:
            a, b = t.rfind(" ", lo, max(lo, mid - w)), t.find(" ", min(hi, mid + w), hi)
            a, b = lo if a < 0 else a, hi if b < 0 else b
            if a == lo and b == hi:
                return self._library([t[lo:hi]])[0]
            el, er, both = self._library([t[a:mid], t[mid:b], t[a:b]])
            if left[len(left) - len(el) :] == el and right[: len(er)] == er and (a == lo or both[:1] == el[:1]) and (b == hi or both[-1:] == er[-1:]):
                return left[: len(left) - len(el)] + both + right[len(er) :]
            w *= 4

    def _mixed(self, t: str) -> list[int]:
        """A text with long runs without spaces: the runs go through the fragment tree, the rest as usual."""
        out, at = [], 0
        for m in self.unsplit.finditer(t):
            out += self.encode([t[at : m.start()]])[0]
            # whole run at once: NFC and lower case look at neighbouring characters
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(m[0]))
            for word, _ in words:
                out += self._word(word)
            at = m.end()
        return out + self.encode([t[at:]])[0]

    def _word(self, s: str) -> list[int]:
        """The ids of one word of the byte alphabet."""
        if len(s) <= self.piece:
            return self.last.encode(s).ids
        cut = self._halves(0, len(s))
        ids = [e.ids for e in self.middle.encode_batch([s[a:b] for a, b in cut[:-1]])] + [self.last.encode(s[slice(*cut[-1])]).ids]
        return self._fragment_tree(s, [(a, b, i) for (a, b), i in zip(cut, ids, strict=True)])

    def _fragment_tree(self, s: str, parts: list[tuple[int, int, list[int]]]) -> list[int]:
        while len(parts) > 1:
            joined = [(x[0], y[1], self._join_fragments(s, x, y)) for x, y in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + (parts[-1:] if len(parts) % 2 else [])
        return parts[0][2]

    def _join_fragments(self, s: str, x: tuple, y: tuple) -> list[int]:
        (lo, mid, left), (_, hi, right), w = x, y, self.window
        end = self.last if hi == len(s) else self.middle
        while True:
            a = b = mid
            i, j = len(left), 0
            while i > 0 and mid - a < w:
                i -= 1
                a -= self.widths[left[i]]
            while j < len(right) and b - mid < w:
                b += self.widths[right[j]]
                j += 1
            if i == 0 and j == len(right):
                return end.encode(s[lo:hi]).ids
            both = (end if j == len(right) else self.middle).encode(s[a:b]).ids
            if (i == 0 or both[0] == left[i]) and (j == len(right) or both[-1] == right[j - 1]):
                return left[:i] + both + right[j:]
            w *= 2

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without skipping special tokens: this tokenizer has no decoder, so tokens joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


_ENCODERS: dict[str, TreeEncoder] = {}  # one per worker process, kept between its tasks


def _encoder(df: DataFrame, path: str | None, kept: int = KEPT_WORDS):
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json(path))  # one tokenizer file: its size doesn't depend on the corpus

    def build() -> TreeEncoder:
        if shared.value not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[shared.value] = TreeEncoder(shared.value)
        own = copy(_ENCODERS[shared.value])
        own.kept, own.known = kept, {}  # ends with the task
        return own

    return build


def _encoded_long(texts: DataFrame, build) -> DataFrame:
    """`h` and `ids` of long texts (`h`, `text`): leaves are encoded by all tasks, and joined by one task per text."""

    def cut(batches):
        e = build()
        for b in slices(batches):
            for h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, (part, kind, chars) in enumerate(e.leaves(t)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((h, pa.string()), (i, pa.int32()), (part, pa.int32()), (kind, pa.int32()), (chars, pa.string()))], names=["h", "leaf", "part", "kind", "chars"])

    def work():
        e = build()
        return lambda h, leaf, part, kind, chars: [h, leaf, part, kind, chars, [e.leaf_ids(k, c) for k, c in zip(kind, chars, strict=True)]]

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("leaf", "part", "kind", "chars", "ids")), strict=True), key=lambda r: r[0])
        return pa.table([pa.array([t.column("h")[0].as_py()], pa.string()), pa.array([build().joined([r[1:] for r in rows])], pa.list_(pa.int32()))], names=["h", "ids"])

    schema = "h string, leaf int, part int, kind int, chars string"
    # a fixed number of partitions: adaptive execution would put leaves together by size, but their work is what is dealt
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(cut, schema).repartition(n, "h", "leaf")
    return map_columns(dealt, work, f"{schema}, ids array<int>").groupBy("h").applyInArrow(join, "h string, ids array<int>")


def _by_length(df: DataFrame, build, short, long, long_chars: int) -> DataFrame:
    """`short` of the rows (`key`, `text`) up to `long_chars` characters, and of the others their `key` with `long` of their text's `h` and `ids`."""
    many = F.coalesce(F.length("text") > long_chars, F.lit(False))
    whole = df.where(many).withColumn("h", F.sha2("text", 256))
    made = long(_encoded_long(whole.select("h", "text").dropDuplicates(["h"]), build))
    at = splittable_text("h").alias("__k")
    return short(df.where(~many)).unionByName(whole.select("key", at).join(made.select(at, *[c for c in made.columns if c != "h"]), "__k").drop("__k"))


def splittable_text(column: str):
    """A join key that nothing is dealt by yet, so that adaptive execution may split a hot one."""
    return F.concat(F.col(column), F.lit("-"))


def encode(df: DataFrame, key: str, text: str, tokenizer: str | None = None, long_chars: int = LONG) -> DataFrame:
    """`key` and `ids` array<int> of every whole text."""
    build = _encoder(df, tokenizer)

    def make():
        e = build()
        return lambda keys, texts: [keys, e.encode([t or "" for t in texts])]

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return _by_length(rows, build, lambda d: map_columns(d, make, f"key {kind}, ids array<int>"), lambda made: made, long_chars).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, tokenizer: str | None = None) -> DataFrame:
    """`key` and the decoded `text`; null ids count as none."""
    build = _encoder(df, tokenizer)

    def make():
        e = build()
        return lambda keys, rows: [keys, [e.decode(r or []) for r in rows]]

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df.select(F.col(key).alias("key"), F.col(ids)), make, f"key {kind}, text string").withColumnRenamed("key", key)


def digest(docs: DataFrame, tokenizer: str | None = None, kept: int = KEPT_WORDS, long_chars: int = LONG) -> DataFrame:
    """Encode and decode every document and return counts and hashes; ids of all but long texts stay in the task that made them."""
    build = _encoder(docs, tokenizer, kept)

    def told(e: TreeEncoder, decimal: list[str], ids: list[int]) -> tuple:
        written = " ".join([decimal[i] for i in ids])
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    def make():
        e = build()
        decimal = [str(i) for i in range(len(e.tokens))]

        def work(keys, texts):
            out = []
            for i in range(0, len(keys), 64):  # a few texts' words and ids at a time in memory
                out += [(k, *told(e, decimal, ids)) for k, ids in zip(keys[i : i + 64], e.encode([t or "" for t in texts[i : i + 64]]), strict=True)]
            return [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(4)]

        return work

    def of_ids():
        e = build()
        decimal = [str(i) for i in range(len(e.tokens))]
        return lambda hs, rows: [hs, *([list(c) for c in zip(*(told(e, decimal, ids) for ids in rows), strict=True)] or [[] for _ in range(3)])]

    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _by_length(rows, build, lambda d: map_columns(d, make, f"key long, {columns}"), lambda made: map_columns(made, of_ids, f"h string, {columns}"), long_chars).withColumnRenamed("key", "doc_id")


def op5_bpe_tree(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
