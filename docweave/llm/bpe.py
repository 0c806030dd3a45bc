"""Byte-level BPE: encoding of whole texts, long ones by tree concatenation, and decoding.

A position between a character and a following blank is one across which no token reaches, so texts are cut there and the
pieces looked up in a table of known ones; the library encodes the others. A text too long for that is cut into leaves of equal length, between
any two characters wherever that is, which tasks encode apart and a tree joins, halves first: the words around a join are formed
again over a growing window until the window's outer words are those of both sides; a word that runs through the join is encoded from its halves, whose tokens
are merged again over a growing window until its outer tokens are those of both sides. A sequence of BPE tokens is the
encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes, so agreement at both ends of the
window makes the whole exact. A piece without a sure position that is longer than a leaf goes the same way, whatever its text's length.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows are encoded each; columns
besides the text pass through unchanged, but for ones named as an output, which are replaced; an empty table gives an empty
result. Strings of special tokens in a text become those tokens, as is the library's default.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import text_groups

#: Bytes from which a text is encoded in leaves by several tasks, and of one leaf. Entries of a generation of known pieces, and the characters of the longest one there.
LONG_BYTES, LEAF_CHARS, KNOWN, KNOWN_CHARS = 1 << 16, 1 << 14, 100_000, 64
#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20
#: Where a blank follows white space and stands before more of it, a cut before the blank could change the words.
UNSURE = re.compile(r"[\s᠎] (?:[\s᠎]|\Z)")
#: A stop behind such letters is a word of its own, and so are the letters.
STOPS, LETTERS_TO = ",.;:!?", "\u024f"
SURE = re.compile(r"(?<=[^\s᠎])(?= )")
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def byte_alphabet() -> list[str]:
    """The characters by which byte-level vocabularies write the bytes 0 to 255: printable ones themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Known:
    """The ids of pieces met of late, in two generations of at most KNOWN: when the newer one is full, the older one goes."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def put(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.new) >= KNOWN:
            self.old, self.new = self.new, {}
        self.new[piece] = ids


class Codec:
    """The tokenizer in a file of the tokenizers library, byte-level without a prefix space."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.leaf_chars = Tokenizer.from_file(path), leaf_chars
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(self.tokenizer.to_str())
        pre = conf["pre_tokenizer"] or {}
        if conf["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError(f"{path} isn't a byte-level tokenizer without normalizer and prefix space")
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.known, self.after = Known(), Known()  # after: of pieces that follow a blank, which their keys leave out
        self.letters = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}

    @cached_property
    def table(self) -> list[bytes]:
        """The bytes of each id."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = token.encode() if token in self.special else bytes(self.bytes_of[c] for c in token)
        return out

    @cached_property
    def stops(self) -> dict[str, tuple[int, ...]]:
        return {c: tuple(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in STOPS}

    @cached_property
    def numbers(self) -> list[int]:
        """The ids, so that known pieces share them."""
        return list(range(len(self.table)))

    @cached_property
    def numerals(self) -> list[str]:
        return [str(i) for i in range(len(self.table))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode(errors="replace")

    def ids_text(self, ids: list[int]) -> str:
        return ",".join(map(self.numerals.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        if UNSURE.search(text):
            return list(chain.from_iterable(self._pieces(self.known, SURE.split(text))))
        first, *rest = text.split(" ")
        return list(chain(*self._pieces(self.known, [first]), *self._pieces(self.after, rest, " ")))

    def _pieces(self, known: Known, keys: list[str], before: str = "") -> list[tuple[int, ...]]:
        """The ids of each piece, from the table or by the library."""
        got = list(map(known.new.get, keys))
        if None not in got:
            return got
        missing = {k for k, ids in zip(keys, got, strict=True) if ids is None}
        stems = {k: k[:-1] for k in missing if k[-1:] in STOPS and k[:-1].isalpha() and max(k) <= LETTERS_TO}
        found: dict[str, tuple[int, ...]] = {}
        rest = []
        for k in {stems.get(k, k) for k in missing}:
            ids = known.new.get(k) or known.old.get(k)
            if ids is None:
                rest.append(k)
            else:
                found[k] = ids
        short = [k for k in rest if len(k) < self.leaf_chars]
        encoded = self.tokenizer.encode_batch_fast([before + k for k in short], add_special_tokens=False)
        found.update(zip(short, (tuple(map(self.numbers.__getitem__, e.ids)) for e in encoded), strict=True))
        found.update((k, tuple(self._whole(before + k))) for k in rest if k not in found)
        for k, ids in found.items():
            if len(k) <= KNOWN_CHARS:
                known.put(k, ids)
        found.update((k, found[stem] + self.stops[k[-1]]) for k, stem in stems.items())
        return [found[k] if ids is None else ids for k, ids in zip(keys, got, strict=True)]

    def _whole(self, piece: str) -> list[int]:
        """A piece between sure positions: by the library, or in a tree if long."""
        if len(piece) <= self.leaf_chars:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self.joined([(x, glued, *self.leaf(x)) for x, glued in self.cuts(piece)])

    def cuts(self, text: str) -> list[tuple[str, bool]]:
        """Leaves of about leaf_chars characters, and whether each must be joined to the one before it.

        Special strings are leaves, and what stands between two of them is encoded by itself, as the library does.
        """
        out: list[tuple[str, bool]] = []
        found = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        for part in found:
            at, glued = 0, False
            while at < len(part) and part in self.special:
                out.append((part, False))
                at = len(part)
            while at < len(part):
                end = min(at + self.leaf_chars, len(part))
                out.append((part[at:end], glued))
                at, glued = end, True
        return out

    def leaf(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a leaf by itself, and how many each of its words has."""
        if text in self.special:
            return [self.special[text]], [1]
        ids = [self._word(w) for w in self.words(text)]
        return list(chain.from_iterable(ids)), [len(x) for x in ids]

    def words(self, text: str) -> list[str]:
        """The library's words of a text, in the byte alphabet."""
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, word: str) -> list[int]:
        """The ids of a word in the byte alphabet; of a long one from its halves."""
        if len(word) <= self.leaf_chars:
            return [t.id for t in self.tokenizer.model.tokenize(word)]
        half = len(word) // 2
        return self.join_tokens(self._word(word[:half]), self._word(word[half:]))

    def joined(self, leaves: list[tuple[str, bool, list[int], list[int]]]) -> list[int]:
        """The ids of (text, glued, ids, tokens of each word) leaves in order."""
        out: list[int] = []
        run: list[Words] = []
        for text, glued, ids, sizes in [*leaves, ("", False, [], [])]:
            if not glued and run:
                out += chain.from_iterable(self.tree(run).ids) if len(run) > 1 else run[0].flat
                run = []
            run.append(Words(text, ids, sizes))
        return out

    def tree(self, run: list[Words]) -> Words:
        """Leaves joined two by two, halves first."""
        if len(run) == 1:
            return run[0].split(self)
        half = len(run) // 2
        return self.join(self.tree(run[:half]), self.tree(run[half:]))

    def join(self, a: Words, b: Words) -> Words:
        """The encoding of two neighbouring texts' concatenation, from those of both."""
        k = 1
        while True:
            left, right = a.words[-k:], b.words[:k]
            words = self.words(bytes(self.bytes_of[c] for c in chain(*left, *right)).decode())
            if (k >= len(a.words) or words[0] == left[0]) and (k >= len(b.words) or words[-1] == right[-1]):
                break
            k *= 2
        had = dict(zip(left + right, a.ids[-k:] + b.ids[:k], strict=True))
        through = left[-1] + right[0] if left and right else ""
        ids = [had[w] if w in had else self.join_tokens(a.ids[-1], b.ids[0]) if w == through else self._word(w) for w in words]
        out = Words("", [], [])
        out.words, out.ids = a.words[:-k] + words + b.words[k:], a.ids[:-k] + ids + b.ids[k:]
        return out

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of one word from those of its two sides."""
        k = 4
        while True:
            left, right = a[-k:], b[:k]
            window = [t.id for t in self.tokenizer.model.tokenize("".join(self.letters[x] for x in b"".join(self.table[i] for i in left + right)))]
            if (k >= len(a) or window[0] == left[0]) and (k >= len(b) or window[-1] == right[-1]):
                return a[:-k] + window + b[k:]
            k *= 2


class Words:
    """A text by words: each in the byte alphabet, with its ids. Leaves are split into words only where a join needs them."""

    def __init__(self, text: str, flat: list[int], sizes: list[int]):
        self.text, self.flat, self.sizes = text, flat, sizes
        self.words: list[str] = []
        self.ids: list[list[int]] = []

    def split(self, codec: Codec) -> Words:
        self.words, at = codec.words(self.text), 0
        for n in self.sizes:
            self.ids.append(self.flat[at : at + n])
            at += n
        return self


@lru_cache(2)
def codec_at(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    """A worker's codec, which keeps its table of known pieces from task to task."""
    return Codec(path, leaf_chars)


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",), text_col: str = "text", long_bytes: int = LONG_BYTES, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs without text_col and with the outputs asked for: ids, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded, decoded_sha256.

    Texts over long_bytes are encoded in leaves by as many tasks as there are leaves and joined by one task a document, whose ids
    have to stand in one row anyway; the others stay where they were read.
    """
    rest = [c for c in docs.columns if c != text_col and c not in outputs]
    fed = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").alias(text_col))
    made = T.StructType([*(fed.schema[c] for c in rest), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    size = F.coalesce(F.octet_length(text_col), F.lit(0))

    def short(batches):
        codec = codec_at(path, leaf_chars)
        for b in batches:
            texts = chain.from_iterable(text_groups(b.column(b.num_columns - 1), BATCH_BYTES))
            yield answered(codec, b, range(b.num_columns - 1), map(codec.encode, texts), made, outputs)

    def cut(batches):
        import pyarrow as pa

        codec = codec_at(path, leaf_chars)
        for b in batches:
            for row, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                pieces = codec.cuts(text)
                yield pa.RecordBatch.from_pydict({"_row": pa.array([row.as_py()] * len(pieces), pa.string()), "_leaf": pa.array(range(len(pieces)), pa.int32()), "_glued": [g for _, g in pieces], "_text": pa.array([p for p, _ in pieces], pa.string())})

    def leaves(batches):
        import pyarrow as pa

        codec = codec_at(path, leaf_chars)
        for b in batches:
            done = [codec.leaf(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i for i, _ in done], pa.list_(pa.int32())), pa.array([n for _, n in done], pa.list_(pa.int32()))], names=[*b.schema.names, "_ids", "_sizes"])

    def merge(key, group):
        import pyarrow as pa

        codec = codec_at(path, leaf_chars)
        group = group.sort_by("_leaf")
        ids = codec.joined(list(zip(*(group.column(c).to_pylist() for c in ("_text", "_glued", "_ids", "_sizes")), strict=True)))
        one = answered(codec, None, (), [ids], T.StructType(made.fields[len(rest) :]), outputs)
        return pa.table({"_row": pa.array([key[0].as_py()], pa.string()), **{o: one.column(o) for o in outputs}})

    if not rest:
        raise ValueError("docs need a column besides the text")
    # Long rows are known by all that they hold; what is alike is encoded once.
    far = fed.filter(size > long_bytes).withColumn("_row", F.sha2(text_col, 256))
    cuts = far.select("_row", text_col).dropDuplicates(["_row"]).mapInArrow(cut, "_row string, _leaf int, _glued boolean, _text string")
    done = cuts.repartition("_row", "_leaf").mapInArrow(leaves, "_row string, _leaf int, _glued boolean, _text string, _ids array<int>, _sizes array<int>")
    whole = done.groupBy("_row").applyInArrow(merge, T.StructType([T.StructField("_row", T.StringType()), *made.fields[len(rest) :]]))
    long = far.select("_row", *(F.col(f"`{c}`") for c in rest)).join(whole, "_row").select(*(F.col(f"`{c}`") for c in made.names))
    return fed.filter(size <= long_bytes).mapInArrow(short, made).unionByName(long)


def answered(codec: Codec, batch, keep, found, schema: T.StructType, outputs: tuple[str, ...]):
    """An Arrow batch of the kept columns and the outputs, from the ids of each row; only outputs asked for are held."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    got: dict[str, list] = {o: [] for o in outputs}
    for ids in found:
        decoded = codec.decode(ids) if {"decoded", "decoded_sha256"} & got.keys() else ""
        for o, values in got.items():
            values.append(ids if o == "ids" else len(ids) if o == "n_tokens" else decoded if o == "decoded" else hashlib.sha256((decoded if o == "decoded_sha256" else codec.ids_text(ids)).encode()).hexdigest())
    arrays = [pa.array(v, to_arrow_type(OUTPUTS[o])) for o, v in got.items()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=schema.names)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the text of ids_col; null ids give an empty text, and bytes that are not UTF-8 the replacement character."""
    rest = [c for c in rows.columns if c != to]
    fed = rows.select(*(F.col(f"`{c}`") for c in rest))

    def run(batches: Iterator):
        import pyarrow as pa

        codec = codec_at(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())], names=[*rest, to])

    return fed.mapInArrow(run, T.StructType([*fed.schema.fields, T.StructField(to, T.StringType())]))
