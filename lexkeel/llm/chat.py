"""Chat formatting as a prefix tree.

Conversations that share their initial turns are merged: the turns form a prefix tree, walked depth first, and every
node's text is emitted once into a stream. A unit (here a code point) has its offset in the stream, a position id (its
place in its own conversation) and the intervals of the stream that it may attend to: its
ancestors' and the part of its own node before it.

How it is done without gathering a tree: a turn's node is the hash of the path to it, conversations are
sorted by their paths (a range partitioning with the conversation's id as last key, so even identical
conversations spread), and a conversation emits just the turns beyond the longest prefix that it shares with
its predecessor. That order is the depth-first order. Of each range partition, its last path and its length cross over to the next ones.

Template: ``<turn role>``, newline, text, ``</turn>``, newline. Inside roles and texts a backslash goes before
every backslash and angle bracket, so no text holds a marker, and ``parse`` restores it exactly.
The loss mask covers the text of assistant turns.

Edge cases: a null text or role counts as empty; turns are sorted by number (null first), then role and text; repeated
rows are turns of their own; rows with a null id form one conversation; an empty table gives an empty stream; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    head = f"<turn {escape(role)}>\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts; anything but whole turns is an error."""
    at, out = 0, []
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream's nodes and the turns of each conversation.

    Nodes: ``node``, ``start`` and ``end`` (offsets in the stream), ``position`` (the position id of its first unit), ``text`` (formatted), ``loss_start``
    and ``loss_end`` (the masked part, equal if none). Turns: ``conv_id``, ``depth``, ``node``.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = "conv_id long, path array<binary>, texts array<string>, lens array<long>, loss array<struct<a:long,b:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(at, 512)
                path, texts, lens, loss = [], [], [], []
                for turns in b.column("turns").to_pylist():
                    key, p, t, s = b"", [], [], []
                    for x in turns:
                        text, a, z = format_turn(x["role"], x["text"])
                        key = hashlib.blake2b(key + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        p.append(key)
                        t.append(text)
                        s.append({"a": a, "b": z if x["role"] == "assistant" else a})
                    path.append(p)
                    texts.append(t)
                    lens.append([len(x) for x in t])
                    loss.append(s)
                kinds = (pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(v, k) for v, k in zip((path, texts, lens, loss), kinds, strict=True)]], ["conv_id", "path", "texts", "lens", "loss"])

    spark = conversations.sparkSession
    formatted = materialize(gathered.mapInArrow(run, kind), "chat-formatted")
    # Texts stay behind: only paths and lengths are sorted and numbered.
    ranged = formatted.select("conv_id", "path", "lens").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = materialize(ranged.withColumns({"part": F.spark_partition_id(), "ord": F.monotonically_increasing_id()}), "chat-ordered")

    # A row for each partition: what the next one must know.
    last = ordered.groupBy("part").agg(F.max_by("path", "ord").alias("last"))
    before = last.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("ord")
    seen = ordered.join(F.broadcast(before), "part").withColumn("prev", F.coalesce(F.lag("path").over(inside), "before", F.array().cast("array<binary>")))
    differ = F.array_position(F.zip_with("path", "prev", lambda a, b: F.coalesce(a != b, F.lit(True))), True)
    shared = F.when(differ == 0, F.size("path")).otherwise((differ - 1).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    emitted = seen.withColumn("shared", shared).withColumn("held", total(F.slice("lens", F.lit(1), F.col("shared")))).withColumn("new", total("lens") - F.col("held"))
    emitted = materialize(emitted.drop("prev", "before"), "chat-emitted")
    sizes = emitted.groupBy("part").agg(F.sum("new").alias("size"))
    base = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    start = F.col("base") + F.sum("new").over(inside) - F.col("new")
    placed = emitted.join(F.broadcast(base), "part").withColumn("start", start)
    placed = placed.where(F.size("path") > F.col("shared")).select("conv_id", "path", "lens", "shared", "held", "start")
    said = formatted.select(F.col("conv_id").alias("own_id"), "texts", "loss")
    placed = placed.join(said, F.col("conv_id").eqNullSafe(F.col("own_id")))
    turn = F.explode(F.arrays_zip("path", "texts", "lens", "loss", F.transform("path", lambda _, i: i + 1).alias("depth")))
    nodes = placed.select("shared", "held", "start", "lens", turn.alias("x")).where("x.depth > shared")
    position = total(F.slice("lens", F.lit(1), F.col("x.depth") - 1))
    nodes = nodes.withColumn("position", position).withColumn("start", F.col("start") + F.col("position") - F.col("held"))
    at = F.col("start")
    nodes = nodes.select(F.col("x.path").alias("node"), at.alias("start"), (at + F.col("x.lens")).alias("end"), "position", F.col("x.texts").alias("text"), (at + F.col("x.loss.a")).alias("loss_start"), (at + F.col("x.loss.b")).alias("loss_end"))
    turns = emitted.select("conv_id", F.posexplode("path").alias("depth", "node"))
    return materialize(nodes, "chat-stream"), turns


#: Copies of a node that many conversations share.
SALTS = 32


def attention(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Each conversation's intervals of the stream, from its root on: ``conv_id``, ``intervals`` (``start``, ``end``, ``loss_start``, ``loss_end``) and ``texts`` in the same order.

    The last interval is the leaf's, those before it are its ancestors', which is all that the leaf attends to. Nodes that over a thousandth of all turns share
    (fewer than a thousand) stand ``SALTS`` times, and their conversations are dealt over those.
    """
    total = turns.count()
    crowded = turns.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 1000 > total).select("node", F.lit(True).alias("crowded"))
    crowded = F.broadcast(materialize(crowded, "chat-crowded"))
    dealt = turns.join(crowded, "node", "left").withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("crowded")
    copies = F.when(F.col("crowded"), F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).otherwise(F.array(F.lit(0).cast("long")))
    told = nodes.join(crowded, "node", "left").withColumn("salt", F.explode(copies)).drop("crowded")
    found = dealt.join(told, ["node", "salt"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "end", "position", "loss_start", "loss_end", "text"))).alias("n"))
    return found.select("conv_id", F.transform("n", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["position"].alias("position"), x["loss_start"].alias("loss_start"), x["loss_end"].alias("loss_end"))).alias("intervals"), F.transform("n", lambda x: x["text"]).alias("texts"))


def read_back(attended: DataFrame) -> DataFrame:
    """What the stream holds for each conversation: ``conv_id``, ``formatted``, ``turns`` (role, text) and ``loss_text`` (unescaped text under the mask)."""
    kind = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(at, 512)
                formatted, turns, loss = [], [], []
                for texts, spans in zip(b.column("texts").to_pylist(), b.column("intervals").to_pylist(), strict=True):
                    for t, s in zip(texts, spans, strict=True):
                        if len(t) != s["end"] - s["start"]:
                            raise ValueError("an interval doesn't fit its text")
                    formatted.append("".join(texts))
                    turns.append([{"role": r, "text": t} for r, t in parse(formatted[-1])])
                    loss.append("".join(unescape(t[s["loss_start"] - s["start"] : s["loss_end"] - s["start"]]) for t, s in zip(texts, spans, strict=True)))
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(formatted, pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(loss, pa.string())], ["conv_id", "formatted", "turns", "loss_text"])

    return attended.mapInArrow(run, kind)


#: The contract's own conversation, whose texts look like control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    back = read_back(attention(*tree(rows.unionByName(own))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || role || '>' || chr(10) || text || '</turn>' || chr(10)) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
