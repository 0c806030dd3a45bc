"""Token counts: texts go through a public tokenizer in Arrow batches and only lengths come back.

A text is cut where no token can reach across, the lengths of what lies between are looked up, and what has not been seen
before is encoded by the library in batches of about equal bytes. A library file (.json) whose pre-tokenizer drops white
space can be cut at every blank, which also cuts long texts into pieces that need no memory to speak of; a piece of over LONG_PIECE bytes without a
blank is cut at its digits too, and is encoded whole where it has none, as is every text for a .model file, whose pieces may span words.

Defined results: a null or empty text has no tokens; repeated rows are counted each; other columns pass through unchanged,
but for ones named as an output, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import text_groups

#: Entries of a worker's table of known pieces (it takes no more when full), bytes of the longest piece put there, and the bytes of one batch for the library.
KNOWN, KNOWN_BYTES, BATCH_BYTES = 700_000, 32, 1 << 20
#: Bytes of the texts that are looked up together.
GROUP_BYTES = 1 << 22

#: A longer piece is cut at digits too: each is a word of its own, so that no token reaches across either of its sides.
LONG_PIECE, DIGITS = 1 << 16, re.compile(rb"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def by_bytes(pieces: list[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Batches of at most `limit` bytes, or of one piece; sorted by length, so that batches hold like pieces."""
    batch: list[bytes] = []
    held = 0
    for p in sorted(pieces, key=len):
        if batch and held + len(p) > limit:
            yield batch
            batch, held = [], 0
        batch.append(p)
        held += len(p)
    if batch:
        yield batch


def library_lengths(path: str) -> tuple[Callable[[list[bytes]], list[int]], bool, bool, bool]:
    """The tokenizer at path as a function from pieces to lengths, whether it may be fed pieces between blanks, whether it lower-cases, and whether each digit is a word."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda xs: [len(i) for i in piece.encode([x.decode() for x in xs], num_threads=1)]), False, False, False
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    conf = json.loads(tokenizer.to_str())
    steps = (conf["pre_tokenizer"] or {}).get("pretokenizers", [])
    # Matches are kept and the rest removed, and no match holds white space.
    words = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and r"[^\s" in s["pattern"].get("Regex", "") for s in steps)
    # Special strings are looked for before the text is lower-cased, so they must be without capitals.
    lower = any(s["type"] == "Lowercase" for s in (conf["normalizer"] or {}).get("normalizers", [])) and all(t["content"] == t["content"].lower() for t in conf["added_tokens"])
    special = [t["content"].encode() for t in conf["added_tokens"]]
    digits = words and any(r"[\p{L}]+|[\p{N}]|" in s["pattern"].get("Regex", "") for s in steps if s["type"] == "Split") and not any(48 <= c <= 57 for t in special for c in t)

    def lengths(xs: list[bytes]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast([x.decode() for x in xs], add_special_tokens=False)]

    return lengths, words, lower and not any(any(65 <= c <= 90 for c in s) for s in special), digits


class Lengths:
    """Counts tokens of texts, keeping the lengths of pieces it has met."""

    def __init__(self, path: str):
        self.lengths, self.words, self.lower, self.digits = library_lengths(path)
        self.known: dict[bytes, int] = {}
        self.stop = dict(zip((b",", b"."), self.lengths([b",", b"."]), strict=True)) if self.words else {}

    def of(self, texts: list[str | None]) -> list[int]:
        if not self.words:
            got: dict[bytes, int] = {}
            raw = [(t or "").encode() for t in texts]
            for batch in by_bytes(list(set(raw))):
                got.update(zip(batch, self.lengths(batch), strict=True))
            return [got[r] for r in raw]
        out: list[int] = []
        missed: list[list[bytes]] = []
        known = self.known
        for t in texts:
            # A text with special strings keeps its capitals, lest it seem to hold more of them.
            pieces = [] if not t else t.encode().lower().split() if self.lower and "<|" not in t else t.encode().split()
            if self.digits and len(t or "") > LONG_PIECE and max(map(len, pieces), default=0) > LONG_PIECE:
                pieces = [x for p in pieces for x in (DIGITS.split(p) if len(p) > LONG_PIECE else (p,))]
            n = list(map(known.get, pieces))
            if None in n:
                rest = [p for p, k in zip(pieces, n, strict=True) if k is None]
                missed.append(rest)
                out.append(-1)
                n = [k for k in n if k is not None]
                missed[-1].append(sum(n))  # what is known of it, at the end
            else:
                out.append(sum(n))
        if missed:
            found = self._learn({p for rest in missed for p in rest[:-1]})
            done = iter(missed)
            out = [k if k >= 0 else (rest := next(done))[-1] + sum(map(found.__getitem__, rest[:-1])) for k in out]
        return out

    def _learn(self, pieces: set[bytes]) -> dict[bytes, int]:
        """The lengths of pieces that aren't known. A stop at the end of letters is a word of its own, and so are the letters."""
        found: dict[bytes, int] = {}
        stems = {p: p[:-1] for p in pieces if p[-1:] in self.stop and p[:-1].isalpha()}
        new = {stems.get(p, p) for p in pieces}
        for p in new:
            if (n := self.known.get(p)) is not None:
                found[p] = n
        for batch in by_bytes([p for p in new if p not in found]):
            for p, n in zip(batch, self.lengths(batch), strict=True):
                found[p] = n
                if len(p) <= KNOWN_BYTES and len(self.known) < KNOWN:
                    self.known[p] = n
        for p, stem in stems.items():
            found[p] = found[stem] + self.stop[p[-1:]]
            if len(self.known) < KNOWN // 2:
                self.known[p] = found[p]
        return found


@lru_cache(2)
def lengths_at(path: str) -> Lengths:
    """A worker's counter, which keeps its table of known pieces from task to task."""
    return Lengths(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs without text_col, and with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    made = {"n_bytes", "n_tokens", "over_limit"}
    rest = [c for c in docs.columns if c != text_col and c not in made]
    fed = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").alias(text_col))
    schema = T.StructType([*(fed.schema[c] for c in rest), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = lengths_at(path)
        for b in batches:
            text = b.column(b.num_columns - 1)
            n = pa.array([k for group in text_groups(text, GROUP_BYTES) for k in lengths.of(group)], pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, n, pc.greater(n, limit)], names=[*rest, "n_bytes", "n_tokens", "over_limit"])

    return fed.mapInArrow(run, schema)
