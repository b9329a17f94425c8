"""Chat formatting into a prefix tree.

Conversations that begin with the same turns share those nodes. The tree is emitted depth first: sorted by their
paths of chained turn hashes, conversations come in depth-first order, and each emits only the nodes that none
before it has. A node's tokens stand once in the stream; with them come their position ids (as if the ancestors
stood right before) and the intervals of the stream that they attend to besides their own node.

The template marks a turn ``<turn ROLE>TEXT</turn>`` and a line feed; in role and text, a backslash and the angle
brackets get a backslash before them, so no text can imitate a mark and every text comes back as it was.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready
from provenia.llm.packing import byte_bpe

_MARKED = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>([^\\<>]*(?:\\.[^\\<>]*)*)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """A turn before, in and after its text."""
    return f"<turn {escape(role)}>", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns; raises if anything else stands between them."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def conversations_by_path(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, path): turns in order of (turn, role, text); path: 16 bytes for each, chained."""
    ready(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        import xxhash

        for batch in batches:
            paths = []
            for turns in batch.column(1):
                path, last = [], b""
                for t in turns.as_py():
                    role = t["role"].encode("utf-8", "replace")
                    last = xxhash.xxh3_128_digest(last + len(role).to_bytes(4, "big") + role + t["text"].encode("utf-8", "replace"))
                    path.append(last)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.binary())], names=["conv_id", "turns", "path"])

    return lists.mapInArrow(run, "conv_id long, turns array<struct<turn: long, role: string, text: string>>, path binary")


def steps(paths: DataFrame, *names: str) -> DataFrame:
    """(names, depth, node): the nodes along each path."""
    depth = F.explode(F.sequence(F.lit(0), (F.octet_length("path") / 16 - 1).cast("int")))
    return paths.select(*names, "path", depth.alias("depth")).select(*names, "depth", F.substring("path", F.col("depth") * 16 + 1, F.lit(16)).alias("node"))


def prefix_tree(convs: DataFrame, ranks_path: str) -> DataFrame:
    """The emitted nodes, one row each.

    node, tree (its root), depth, role, start, end (place in the stream), position (of its first token), ancestors
    (intervals [start, end) of the stream, neighbours merged), ids, loss_from, loss_to (the tokens of an assistant's
    text; else 0 and 0).
    """
    ready(convs.sparkSession)
    paths = convs.groupBy("path").agg(F.any_value("turns").alias("turns"))
    # sorted once and written: the rank of a path never changes afterwards
    ranked = cut(paths.orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    along = steps(ranked.select("rank", "path"), "rank")
    owners = along.groupBy("node").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"))
    # a path owns the last of its nodes, from the first that no earlier path has
    first = owners.groupBy("rank").agg(F.min("depth").alias("first"))

    def emit(batches):
        encode = byte_bpe(ranks_path, {})
        kinds = [("rank", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("tree", pa.binary()), ("role", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("size", pa.int64())]
        for batch in batches:
            rows = []
            for rank, path, turns, begin in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for depth in range(begin, len(turns)):
                    role = turns[depth]["role"]
                    before, text, after = map(encode, parts_of(role, turns[depth]["text"]))
                    loss = (len(before), len(before) + len(text)) if role == "assistant" else (0, 0)
                    ids = before + text + after
                    rows.append((rank, depth, path[16 * depth : 16 * depth + 16], path[:16], role, ids, *loss, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    nodes = cut(ranked.join(first, "rank").select("rank", "path", "turns", "first").mapInArrow(emit, "rank long, depth int, node binary, tree binary, role string, ids array<int>, loss_from int, loss_to int, size long"))
    # Running totals: within the parts of the sorted table, and over the parts (as many rows as it has partitions).
    part = F.shiftright("rank", 33)
    totals = nodes.groupBy(part.alias("part")).agg(F.sum("size").alias("total"))
    over = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = nodes.select("node", "rank", "depth", "size", part.alias("part")).withColumn("inner", inner).join(F.broadcast(over), "part")
    placed = cut(placed.select("node", "rank", "depth", "size", (F.col("base") + F.col("inner")).alias("start")))
    lines = along.join(placed.select("node", "start", "size"), "node").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "size"))).alias("line"))

    def attend(batches):
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for rank, begin, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                position, seen = 0, []
                for step in line:
                    if step["depth"] >= begin:
                        for column, value in zip(out, (rank, step["depth"], position, [dict(x) for x in seen])):
                            column.append(value)
                    if seen and seen[-1]["end"] == step["start"]:
                        seen[-1]["end"] += step["size"]
                    else:
                        seen.append({"start": step["start"], "end": step["start"] + step["size"]})
                    position += step["size"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), spans))], names=["rank", "depth", "position", "ancestors"])

    seen = lines.join(first, "rank").select("rank", "first", "line").mapInArrow(attend, "rank long, depth int, position long, ancestors array<struct<start: long, end: long>>")
    out = nodes.join(placed.select("rank", "depth", "start"), ["rank", "depth"]).join(seen, ["rank", "depth"])
    return out.select("node", "tree", "depth", "role", "start", (F.col("start") + F.col("size")).alias("end"), "position", "ancestors", "ids", "loss_from", "loss_to")


def read_back(convs: DataFrame, nodes: DataFrame, ranks_path: str) -> DataFrame:
    """Per conversation, from the ids of its nodes: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ready(convs.sparkSession)
    own = steps(convs.select("conv_id", "path"), "conv_id").join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    lists = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_from", "loss_to"))).alias("nodes"))

    def run(batches):
        decode = byte_bpe(ranks_path, {}).decode
        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        for batch in batches:
            rows = []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = line.as_py()
                formatted = "".join(decode(x["ids"]) for x in line)
                turns = parse(formatted)
                loss = "".join(unescape(decode(x["ids"][x["loss_from"] : x["loss_to"]])) for x in line)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv_id, len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return lists.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(turns: DataFrame, ranks_path: str) -> DataFrame:
    """Formats all conversations into one prefix tree and reads them back.

    Null role or text: empty. Turns are ordered by (turn, role, text), null turns first; repeated rows are turns of
    their own. Rows with a null conv_id are one conversation. Empty input: no rows. Other columns aren't read.
    """
    convs = cut(conversations_by_path(turns))
    return read_back(convs, prefix_tree(convs.select("path", "turns"), ranks_path), ranks_path)
