"""BPE encoding and decoding with a tokenizers file.

Every text is a tree: it is halved until its parts have LEAF characters at most (a shorter text is one part). Parts are
rows of their own, encoded in parallel; then neighbours are joined pairwise up the tree. At each join a window around the
cut is encoded again and grown until it agrees with both sides: two consecutive tokens with equal ids and spans on the
left and on the right. A BPE encoding is valid exactly if its neighbouring tokens are, so agreement makes the joined
encoding that of the whole text.

That holds for normalised text, and NFC orders and composes marks across any edge that stands among them. So texts are cut,
windows begin and end, and encodings agree only before characters that NFC neither moves nor joins to what stands before
them (`opens`); there the normalised text is that of both sides in a row. A text without such a place is one part.

Parts are encoded by pieces where the tokenizer's file says that no token crosses white space: a part is cut at ASCII
white space (and between an ASCII letter and a following full stop or comma, where the pre-tokenizer always cuts),
distinct pieces are encoded once and kept in a bounded table, and ids are gathered with numpy. Other tokenizers encode
their parts whole.

Defined results: null counts as empty (no ids, empty decoded text); repeated rows repeat; null doc_ids stay; an empty
table gives an empty result; other columns are ignored, and `apply` returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words

LEAF, EDGE, EDGE_CHARS, FIRST_WINDOW = 32_768, 256, 600, 32
PIECES, SLICE, JOINED, AT_ONCE = 1_000_000, 6_000_000, 256, 250_000
#: The normalizer and pre-tokenizer of tokenizers with word ends, of which each token ends within a word.
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Pieces of these letters alone are one word each, before and after NFC and lower case.
LETTERS = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$"
_encoders: dict[str, Encoder] = {}

#: The vowels and tails of Hangul, which compose with the character before them.
JAMO = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that compose with one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset([*(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"), *map(chr, JAMO)])


@functools.lru_cache(maxsize=65_536)
def opens(c: str) -> bool:
    """Whether NFC neither moves this character nor joins it to what stands before it."""
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _joining()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """One tokenizer and its table of encoded pieces (PIECES at most, then it starts anew)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        n = self.model.get_vocab_size(with_added_tokens=True)
        names = [self.model.id_to_token(i) or "" for i in range(n)]
        self.tokens = [t.encode() for t in names]
        self.ends = np.array([t.endswith(WORD_END) for t in names])
        spec = json.loads(self.model.to_str())
        normalizers = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pattern = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_pieces = normalizers == WORD_NORMALIZER and pattern == WORD_PATTERN and spec["model"].get("end_of_word_suffix") == WORD_END and not spec["post_processor"]
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. AT_ONCE characters or so are encoded together."""
        flats, sizes, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(texts):
            j, left = i, AT_ONCE
            while j < len(texts) and (j == i or left > 0):
                left -= len(texts[j]) + 16
                j += 1
            encoded = [e.ids for e in self.model.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
            flats.append(np.fromiter((t for e in encoded for t in e), np.uint32, int(sizes[-1].sum())))
            i = j
        return np.concatenate(flats), np.concatenate(sizes)

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of one word each: many are encoded as one text, and word ends tell them apart."""
        if not pieces:
            return self._whole([])
        flat = self._whole([" ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])[0]
        ends = np.flatnonzero(self.ends[flat]) + 1
        return (flat, np.diff(ends, prepend=0)) if len(ends) == len(pieces) else self._whole(pieces)

    def _add(self, pieces: pa.Array) -> None:
        letters = pc.match_substring_regex(pieces, LETTERS)
        for some, encoded in ((pieces.filter(letters), self._words), (pieces.filter(pc.invert(letters)), self._whole)):
            flat, size = encoded(some.to_pylist())
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.known, self.size, self.ids = pa.concat_arrays([self.known, some]), np.concatenate([self.size, size]), np.concatenate([self.ids, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and for each text the number of ids before it (one entry more than texts)."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if not self.by_pieces:
            flat, size = self._whole(texts.to_pylist())
            return flat, np.concatenate([[0], np.cumsum(size)])
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, "([A-Za-z])([.,])", r"\1 \2"))
        of = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        # the tokenizer composes before it lowers case: only pieces in which nothing composes are lowered here
        plain = pc.and_not(pc.string_is_ascii(distinct), pc.match_substring(distinct, "<|"))
        distinct = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        found = pc.index_in(distinct, value_set=self.known)
        new = pc.unique(distinct.filter(pc.is_null(found)))
        if len(self.known) + len(new) > PIECES:
            self.clear()
            found, new = pa.nulls(len(distinct), pa.int32()), pc.unique(distinct)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            n, unknown = len(self.known), pc.is_null(found)
            self._add(new)
            at[unknown.to_numpy(zero_copy_only=False)] = n + pc.index_in(distinct.filter(unknown), value_set=self.known.slice(n)).to_numpy(zero_copy_only=False)
        at = at[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        size = self.size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[at] - before[:-1], size)
        place += np.arange(before[-1])
        flat = self.ids.take(place)
        return flat, before[of]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and (start, end) in characters of one text."""
        e = self.model.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)

    def decode(self, ids: np.ndarray) -> bytes:
        """What decode(ids, skip_special_tokens=False) gives, in UTF-8. Without a decoder that is the tokens with a space between."""
        if self.model.decoder is not None:
            return self.model.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Part:
    """An encoded stretch of a text, from character begin to end. Spans are held for the EDGE tokens at either end."""

    def __init__(self, begin: int, end: int, ids: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.begin, self.end, self.ids, self.head, self.tail = begin, end, ids, head, tail

    @classmethod
    def of(cls, model: Encoder, text: str, begin: int, end: int, ids: np.ndarray | None = None) -> Part:
        """The stretch encoded; ids are its tokens, if they are known."""
        part = text[begin:end]
        # white space splits the encoding: spans are only needed near the ends, the rest is encoded by pieces
        front, back = part.find(" ", EDGE_CHARS), part.rfind(" ", 0, max(0, len(part) - EDGE_CHARS))
        if model.by_pieces and 0 < front < back:
            head, tail = model.spans(part[:front])[1], model.spans(part[back:])[1] + back
            ids = model.encode(pa.array([part]))[0] if ids is None else ids
        else:
            ids, head = model.spans(part)
            tail = head
        return cls(begin, end, ids, head[:EDGE] + begin, tail[max(0, len(tail) - EDGE) :] + begin)


def _agree(text: str, a_ids, a_at, b_ids, b_at, last: bool) -> tuple[int, int] | None:
    """Indexes (i, j) of the first (or last) two consecutive tokens that are equal in both, the second of which begins
    where normalised text does."""
    where = {(int(t), int(s), int(e)): i for i, (t, (s, e)) in enumerate(zip(a_ids, a_at, strict=True))}
    turn = range(len(b_ids) - 2, -1, -1) if last else range(len(b_ids) - 1)
    for j in turn:
        i = where.get((int(b_ids[j]), int(b_at[j][0]), int(b_at[j][1])))
        if i is not None and i + 1 < len(a_ids) and a_ids[i + 1] == b_ids[j + 1] and (a_at[i + 1] == b_at[j + 1]).all() and a_at[i][1] <= a_at[i + 1][0] and opens(text[a_at[i + 1][0]]):
            return i, j
    return None


def join(model: Encoder, text: str, left: Part, right: Part) -> Part:
    """The encoding of both stretches as one; the text may be cut between them (see opens)."""
    if not len(left.ids) or not len(right.ids):
        return Part.of(model, text, left.begin, right.end)
    cut, reach = left.end, FIRST_WINDOW
    nl, nr = len(left.tail), len(right.head)
    l_ids, r_ids = left.ids[len(left.ids) - nl :], right.ids[:nr]
    whole = lambda at: left.begin < at < right.end and opens(text[at])
    begins, ends = ([int(x) for x in at if whole(int(x))] for at in (left.tail[:, 0], right.head[:, 1]))
    while True:
        begin, end = max(left.begin, cut - reach), min(right.end, cut + reach)
        if begin > left.begin:
            begin = max((x for x in begins if x <= begin), default=-1)
        if end < right.end:
            end = min((x for x in ends if x >= end), default=-1)
        if begin < 0 or end < 0:
            return Part.of(model, text, left.begin, right.end)  # beyond the held spans: encode the whole
        ids, at = model.spans(text[begin:end])
        at = at + begin
        at_left = (0, 0) if begin == left.begin else _agree(text, l_ids, left.tail, ids, at, last=False)
        at_right = (0, 0) if end == right.end else _agree(text, ids, at, r_ids, right.head, last=True)
        if at_left and at_right:
            i, j = at_left if begin > left.begin else (0, 0)
            kept_left = len(left.ids) - nl + i if begin > left.begin else 0
            p, q = at_right if end < right.end else (len(ids), nr)
            if p >= j:
                tail_ids = right.ids[q:] if end < right.end else right.ids[:0]
                merged = np.concatenate([left.ids[:kept_left], ids[j:p], tail_ids])
                head = np.concatenate([left.head[:kept_left], at[j:p]])[:EDGE] if kept_left < len(left.head) else left.head
                n_tail = len(tail_ids)
                if n_tail >= len(right.tail):
                    tail = right.tail
                else:
                    tail = np.concatenate([at[j:p], right.tail[len(right.tail) - n_tail :]])[-EDGE:]
                if len(head) < min(EDGE, len(merged)) and kept_left < len(left.head):
                    head = np.concatenate([head, right.head[q : q + EDGE - len(head)]])[:EDGE] if end < right.end else head
                if len(tail) < min(EDGE, len(merged)) and n_tail < len(right.tail):
                    tail = np.concatenate([left.tail[: nl - (len(left.ids) - kept_left)], tail])[-EDGE:]
                return Part(left.begin, right.end, merged, head, tail)
        if begin == left.begin and end == right.end:
            return Part(left.begin, right.end, ids, at[:EDGE], at[max(0, len(at) - EDGE) :])
        reach *= 4


def tree(model: Encoder, text: str, parts: list[Part]) -> Part:
    """Joins neighbours pairwise until one part is left."""
    while len(parts) > 1:
        parts = [join(model, text, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Bounds of the parts of a text: halves of halves of leaf characters at most, each moved on to the next place at which
    the text may be cut (see opens)."""
    n, k = len(text), 1
    while n > k * leaf:
        k *= 2
    found = [next((at for at in range(n * i // k, n) if opens(text[at])), n) for i in range(1, k)]
    return sorted({0, *found, n})


def _ids_column(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary())


def _single(path: str):
    """Texts of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for rows, _, _ in words.slices(batches, limit=SLICE):
            flat, before = model.encode(rows.column(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), _ids_column([flat[a:b] for a, b in zip(before[:-1], before[1:], strict=True)])], ["doc_id", "ids"])

    return run


def _leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for b, _, _ in words.slices(batches, limit=SLICE):
            flat, before = model.encode(b.column(3))
            texts = b.column(3).to_pylist()
            parts = [Part.of(model, t, 0, len(t), flat[x:y]) for t, x, y in zip(texts, before[:-1], before[1:], strict=True)]
            raw = [pa.array([getattr(p, n).tobytes() for p in parts], pa.binary()) for n in ("ids", "head", "tail")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), *raw], ["row", "doc_id", "i", "text", "ids", "head", "tail"])

    return run


def _joined(path: str):
    def run(rows: pa.Table) -> pa.RecordBatch:
        model = encoder(path)
        rows = rows.sort_by("i")
        texts, at, parts = rows["text"].to_pylist(), 0, []
        for text, *raw in zip(texts, *(rows[c].to_pylist() for c in ("ids", "head", "tail")), strict=True):
            head, tail = (np.frombuffer(x, np.int64).reshape(-1, 2) + at for x in raw[1:])
            parts.append(Part(at, at + len(text), np.frombuffer(raw[0], np.uint32), head, tail))
            at += len(text)
        ids = tree(model, "".join(texts), parts).ids
        return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"].to_pylist()[:1], pa.int64()), _ids_column([ids])], ["doc_id", "ids"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            row, doc, text = (b.column(c)[r].as_py() for c in range(3))
            at = cuts(text)
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])], ["row", "doc_id", "i", "text"])


Batches = Iterator[pa.RecordBatch]


def _encoded(docs: DataFrame, path: str, finish: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """finish, which gives rows of schema, over (doc_id, ids) of every whole text; it runs in the tasks that encode."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    single = docs.filter(F.length("text") <= LEAF).mapInArrow(lambda batches: finish(_single(path)(batches)), schema)
    long = docs.filter(F.length("text") > LEAF).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    leaves = long.mapInArrow(_cut, "row bigint, doc_id bigint, i int, text string").repartition("row", "i").mapInArrow(_leaves(path), "row bigint, doc_id bigint, i int, text string, ids binary, head binary, tail binary")
    join = _joined(path)
    return single.unionByName(leaves.groupBy("row").applyInArrow(lambda rows: pa.Table.from_batches(finish(iter([join(rows)]))), schema))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""
    return _encoded(docs, path or default_path(), lambda batches: batches, "doc_id bigint, ids binary")


def _digest(path: str):
    def run(batches: Batches) -> Batches:
        model = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                raw = x.as_py()
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, and its ids decoded again."""
    path = path or default_path()
    return _encoded(docs, path, _digest(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if not x.is_valid else model.decode(np.frombuffer(x.as_py(), "<u4")).decode() for x in b.column(1)], pa.string())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text of encoded(doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), "doc_id bigint, decoded string")


def apply(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of every text."""
    return encode(docs, path).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")
