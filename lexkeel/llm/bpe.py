"""Byte-level BPE encoding and decoding with overlapping chunks.

``encode`` cuts every text longer than ``chunk`` code points into chunks that overlap by
``overlap``; chunks pre-tokenise in parallel, each from its own start. The pattern
scans forward without looking back, so once two neighbouring scans share a token start
they agree from there on: that first shared start is where the pieces are
stitched. Seams are found on the starts alone, so texts move by chunk, never by document. Pieces then encode in parallel and
their ids are joined in order. Where two neighbours share no start (one token longer
than the overlap) these two are encoded as one piece, so the result is exact for every text and the others of its seams stay.
A text of one chunk is its own piece and needs no shuffle.

``decode`` concatenates the raw bytes of the ids.

Ids are kept as little-endian unsigned 32-bit integers in a binary column.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; repeated rows each give a row; an empty table gives an empty result; only the
columns named in ``keep`` are carried, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, materialize, small_batches, spare, table

CHUNK, OVERLAP = 32_768, 1_024
_U32 = np.dtype("<u4")


@lru_cache(maxsize=2)
def encoding(ranks_path: str):
    """The tiktoken encoding of a rank file and the public pattern; one per worker."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=1 << 16)
def settled(c: str) -> bool:
    """Whether all libraries agree on a character's class: it was a letter, number, sign or space in Unicode 3.2 as it is now. Of controls, only ASCII's are."""
    kind = unicodedata.category(c)[0]
    return c < "\x80" or (kind != "C" and kind == unicodedata.ucd_3_2_0.category(c)[0])


def token_starts(text: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk that what follows the chunk can't change.

    A token depends on at most three characters from its start and one behind its end,
    so starts near the end of a chunk that isn't the text's last are left out. Only
    starts between settled characters count, whatever their script, and none behind white space or an apostrophe:
    at the end of a piece ``\\s+(?!\\S)`` would take a whole run of spaces, in the text it leaves its last character.
    """
    limit = len(text) if last else len(text) - 4
    return [p for m in _pattern().finditer(text) if 0 < (p := m.start()) <= limit and text[p - 1] != "'" and not text[p - 1].isspace() and settled(text[p - 1]) and settled(text[p])]


_ROWS = 256
Batches = Iterator[pa.RecordBatch]


def _columns(of: Callable[[list], dict[str, pa.Array]], rows: int = _ROWS) -> Callable[[Batches], Batches]:
    """A batch function that replaces the last column by those that ``of`` makes of its values, a bounded number of rows at a time."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), rows):
                b = whole.slice(at, rows)
                made = of(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made.values()], [*b.schema.names[:-1], *made])

    return run


def encoder(ranks_path: str) -> Callable[[Batches], Batches]:
    """Texts to ``ids``."""
    one = lambda t: np.asarray(encoding(ranks_path).encode_ordinary(t), _U32).tobytes() if t else b""
    return _columns(lambda texts: {"ids": pa.array(map(one, texts), pa.binary())})


def decoder(ranks_path: str) -> Callable[[Batches], Batches]:
    """``ids`` to their raw ``bytes``."""
    one = lambda x: encoding(ranks_path).decode_bytes(np.frombuffer(x, _U32).tolist()) if x else b""
    return _columns(lambda ids: {"bytes": pa.array(map(one, ids), pa.binary())})


def _scanned(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks of texts (``row``, ``key``, ``text``) with the token starts in the overlaps at their two ends; ``row`` stays with the first."""
    n = F.ceil(F.length("text") / chunk).cast("int")
    chunks = long.select("row", "key", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    chunks = chunks.select(F.when(F.col("k") == 0, F.col("row")).alias("row"), "key", "n", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))

    def scan(batches: Batches) -> Batches:
        for b in batches:
            head, tail = [], []
            for k, n, t in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), b.column("text").to_pylist(), strict=True):
                starts = token_starts(t, k == n - 1)
                head.append([k * chunk + p for p in starts if p < overlap])
                tail.append([k * chunk + p for p in starts if p >= chunk])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, ints), pa.array(tail, ints)], [*b.schema.names, "head", "tail"])

    made = chunks.repartition("key", "k").mapInArrow(scan, chunks.withColumns({"head": F.array(F.lit(0)), "tail": F.array(F.lit(0))}).schema)
    return materialize(made, "bpe-chunks")


def _seams(scanned: DataFrame) -> DataFrame:
    """For each chunk its piece, ``from`` to ``to`` (null: the chunk's own border), the number ``run`` of the run that it belongs to and that run's ``size``."""
    ordered = Window.partitionBy("key").orderBy("k")
    to = F.array_min(F.array_intersect("tail", F.lead("head").over(ordered)))
    found = scanned.select("key", "k", "head", "tail").withColumn("to", to).select("key", "k", "to")
    found = found.withColumn("from", F.lag("to").over(ordered)).withColumn("run", F.count("from").over(ordered))
    return found.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key", "run")))


def stitching(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row: ``texts`` of several chunks, their ``chunks``, and the ``seams`` and ``borders_without`` one."""
    text = F.coalesce(docs["text"], F.lit(""))
    long = docs.where(F.length(text) > chunk + overlap).select(F.lit(None).cast("int").alias("row"), F.monotonically_increasing_id().alias("key"), text.alias("text"))
    found = _seams(_scanned(long, chunk, overlap))
    return found.agg(F.countDistinct("key").alias("texts"), F.count(F.lit(1)).alias("chunks"), F.count("from").alias("seams"), F.count_if((F.col("k") > 0) & F.col("from").isNull()).alias("borders_without"))


def encode(docs: DataFrame, ranks_path: str | None = None, keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, then: Callable[[Batches], Batches] | None = None, made: str = "ids binary") -> DataFrame:
    """``keep`` columns of ``docs`` (by default all that have other names) plus ``ids`` binary.

    ``then``, a batch function that replaces ``ids`` by the columns ``made``, runs in the encoding worker itself
    wherever a text's ids are whole there.
    """
    small_batches(docs.sparkSession)
    ranks_path = ranks_path or default_ranks()
    carried = kept(docs, keep, ["ids"])
    schema = docs.select(*carried, *[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in made.split(", "))]).schema
    ids_of, last = encoder(ranks_path), then or (lambda batches: batches)
    text = F.coalesce(docs["text"], F.lit(""))
    short = docs.where(F.length(text) <= chunk + overlap).select(*carried, text.alias(spare(docs, "__text")))
    done = short.mapInArrow(lambda batches: last(ids_of(batches)), schema)

    long = docs.where(F.length(text) > chunk + overlap).select(F.struct(*carried).alias("row"), F.monotonically_increasing_id().alias("key"), text.alias("text"))
    scanned = _scanned(long, chunk, overlap)
    begin = F.coalesce("from", F.col("k") * chunk)
    end = F.coalesce("to", F.when(F.col("k") == F.col("n") - 1, 2**31 - 1).otherwise((F.col("k") + 1) * chunk))
    cut = F.substring("text", begin - F.col("k") * chunk + 1, end - begin)
    pieces = scanned.drop("head", "tail").join(_seams(scanned), ["key", "k"]).select("key", "run", "k", "size", "row", cut.alias("text"))
    in_order = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c.alias("v")))), lambda x: x["v"]), "")
    some = F.first("row", ignorenulls=True).alias("row")
    single = pieces.where("size = 1").select("key", "run", "row", "text")
    merged = pieces.where("size > 1").groupBy("key", "run").agg(some, in_order(F.col("text"), "k").alias("text"))
    encoded = single.unionByName(merged).mapInArrow(ids_of, single.select("key", "run", "row", F.lit(b"").alias("ids")).schema)
    # concat has no form for an array of binaries, so hexadecimal digits are joined and turned back.
    whole = encoded.groupBy("key").agg(some, F.unhex(in_order(F.hex("ids"), "run")).alias("ids")).select("row.*", "ids")
    return done.unionByName(whole.mapInArrow(then, schema) if then else whole)


def decode(encoded: DataFrame, ranks_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``encoded`` (by default all that have other names, ``ids`` included) plus ``bytes`` binary."""
    small_batches(encoded.sparkSession)
    ranks_path = ranks_path or default_ranks()
    carried = kept(encoded, keep, ["bytes"])

    return encoded.select(*carried, F.col("ids").alias(spare(encoded, "__ids"))).mapInArrow(decoder(ranks_path), encoded.select(*carried, F.lit(b"").alias("bytes")).schema)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(ranks_path: str) -> Callable[[Batches], Batches]:
    """``ids`` to their number, the SHA-256 of their decimal forms joined by spaces, and that of the bytes that they decode to."""
    names: list[str] = []

    def of(rows: list) -> dict[str, pa.Array]:
        if not names:
            names.extend(map(str, range(encoding(ranks_path).n_vocab)))
        n, texts, raw = [], [], []
        for x in rows:
            ids = np.frombuffer(x or b"", _U32).tolist()
            n.append(len(ids))
            texts.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            raw.append(hashlib.sha256(encoding(ranks_path).decode_bytes(ids)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(texts, pa.string()), "decoded_sha256": pa.array(raw, pa.string())}

    return _columns(of)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"], then=digests(default_ranks()), made=DIGEST)
