"""Packing by power-of-two decomposition.

A document of ``n`` tokens is cut along the binary digits of ``n``: as many pieces of ``longest``
tokens as fit, then one piece for each set bit of the rest, longest first. Every piece is a
sequence of its own whose length is a power of two, so no sequence crosses documents, nothing is padded, and
sequences of one length form a bucket from which batches of equal shape are drawn. One Arrow
pass over the texts, no shuffle: however hot a source or long a text, its pieces stay where they are read.

``sequence_id`` holds the bucket in its top bits and a number unique in the run below.

Tokens: the text is normalised and split as the tokenizer file says, and each distinct word goes
through the tokenizer once for as long as it is remembered. That holds for texts of characters on which all Unicode
versions agree (``Words.odd``); any other text, and one that holds the string of a special token,
goes through the tokenizer whole. So does every text where the file normalises or splits in any other way than ``WORDWISE``.

Edge cases: a null or empty text has the end token alone, a piece of one token; very long texts give
many pieces; repeated rows each give their pieces; an empty table gives none; only ``keep`` columns are carried.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small_batches, spare, table

LONGEST = 4096
#: Buckets have four bits of ``sequence_id``.
LIMIT = 1 << 15
END = 2
#: How a tokenizer file normalises, splits and models where ``Words`` may do it word by word.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
#: Words remembered in each of two generations, and bits by which a word's first occurrence is noted.
_REMEMBERED = 300_000
_SEEN_BITS = 1 << 22
_OUT_BYTES = 4_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Words:
    """Token ids of texts by a tokenizer whose words are encoded one by one."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        self.wordwise = all(told[k] == v for k, v in WORDWISE.items() if k != "model") and all(told["model"].get(k) == v for k, v in WORDWISE["model"].items())
        self.model = self.tok.model
        self.special = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen, self.noted = bytearray(_SEEN_BITS >> 3), 0
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        #: What the file's split pattern says, for the characters that ``odd`` leaves.
        self.split = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        #: Any character outside a set whose classes, case and normal form no library or Unicode version disputes.
        self.odd = regex.compile("[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]|[\xb2\xb3\xb9\xbc\xbd\xbe]").search
        #: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in own]
        self.letters = {x: x for x in own} | {x: 256 + i for i, x in enumerate(rest)}

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.model.tokenize(word)])

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        low = text.lower()
        if not self.wordwise or self.odd(text) or any(t in low for t in self.special):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, fresh = self.known.get, self._fresh
        return b"".join([get(w) or fresh(w) for w in self.split(low)])

    def _fresh(self, word: str) -> bytes:
        """Ids of a word that this generation doesn't hold. Most words of a corpus occur once, so only the second occurrence is remembered."""
        ids = self.older.get(word)
        if ids is None:
            ids = self._word(word)
            at = hash(word) & (_SEEN_BITS - 1)
            if not self.seen[at >> 3] >> (at & 7) & 1:
                if self.noted > _SEEN_BITS // 3:
                    self.seen, self.noted = bytearray(_SEEN_BITS >> 3), 0
                self.seen[at >> 3] |= 1 << (at & 7)
                self.noted += 1
                return ids
        if len(self.known) >= _REMEMBERED:  # what is still in use moves over from the older generation
            self.older, self.known = self.known, {}
        self.known[word] = ids
        return ids


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def lengths(n: int, longest: int = LONGEST) -> Iterator[int]:
    """Powers of two that add up to ``n``, longest first."""
    yield from itertools.repeat(longest, n // longest)
    rest = n % longest
    for bit in range(longest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield 1 << bit


def pack(docs: DataFrame, tokenizer: str | None = None, keep: list[str] | None = None, longest: int = LONGEST) -> DataFrame:
    """A row for each piece: ``keep`` columns, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``bucket`` (the exponent of its length), ``sequence_id`` and ``offset``."""
    if longest & (longest - 1) or not 1 <= longest <= LIMIT:
        raise ValueError(f"the longest sequence must be a power of two up to {LIMIT}")
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    made = {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "bucket": "int"}
    carried = kept(docs, keep, [*made, "sequence_id", "offset"])
    schema = docs.select(*carried, *[F.lit(None).cast(t).alias(c) for c, t in made.items()]).schema
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists of words come and go by the million and hold no cycles, which the collector would look for again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            yield from cut(batches)
        finally:
            if on:
                gc.enable()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0

            def flush(b=b, rows=rows) -> pa.RecordBatch:
                at = pa.array(rows[0], pa.int64())
                cols = [pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.int32())]
                out = pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:-1]], *cols], [*b.schema.names[:-1], *made])
                for r in rows:
                    r.clear()
                return out

            for i, text in enumerate(x.as_py() for x in b.column(b.num_columns - 1)):
                ids = words.ids(text) + end
                n, start = len(ids) // 4, 0
                for k in lengths(n, longest):
                    for r, v in zip(rows, (i, start, k, ids[4 * start : 4 * (start + k)], n, k.bit_length() - 1), strict=True):
                        r.append(v)
                    start += k
                    size += 4 * k + 40
                    if size >= _OUT_BYTES:
                        size = 0
                        yield flush()
            if rows[0]:
                yield flush()

    pieces = docs.select(*carried, docs["text"].alias(spare(docs, "__text"))).mapInArrow(run, schema)
    number = F.shiftleft(F.col("bucket").cast("long"), 59).bitwiseOR(F.monotonically_increasing_id())
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
