"""Conversations as prefix trees of formatted turns, so that turns which conversations share at their start are emitted once.

A node of the forest is a sequence of turns that some conversation begins with; its owner is the least conversation that
begins so. The nodes that one conversation owns are its turns from some turn on: a chain, which leaves the chain of another
owner after the turns they share. Depth-first order with the least owner first visits a chain as a whole, then the chains
that leave it, deepest first. So a tree's tokens are its chains one after another, and a chain's tokens attend to one
interval of each chain on the way to the root.

No group is gathered. Turns are numbered, and the turns so far hashed, by ``running`` (ranges with a carried value); owners are
a minimum for each node, and map-side aggregation keeps one copy of a shared turn for each task; the way to the root is
found by doubling pointers from chain to chain, and a chain's first token by a running sum in depth-first order.

The template. A turn of a user is ``[INST]text[/INST]``, of an assistant ``<s>text</s>``, of a system ``[SYS]text[/SYS]``, of
any other role ``[ROLE]role[/ROLE]text</s>``. These marks have ids of their own, above the vocabulary. A mark within a text or
role gets a backslash after its first character (one more, if it has some there already), which reading takes out
again; so no text can hold a mark.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.packing import ChunkIds, tokenizer_files
from modsplit_spark.operators.ranks import running
from modsplit_spark.sources.workspace import materialize, materialize_observed

#: Marks of the template, and what the vocabulary itself reads as a mark.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
RESERVED = (*MARKS, "<|endoftext|>")
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
LEARNT = "assistant"
#: Ids of the vocabulary end before this; the marks follow. All fit in 16 bits.
VOCABULARY = 50_257
#: Null conversation ids are one conversation, after all others.
NO_ID = 10**19

_TAILS = "|".join(re.escape(m[1:]) for m in RESERVED)
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_MARK = re.compile("|".join(map(re.escape, MARKS)))


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def format_turn(role: str, text: str) -> list[str]:
    """The turn's parts: marks, and escaped texts between them. The text is the last but one."""
    opening, closing = TURNS.get(role, ("", "</s>"))
    head = [opening] if opening else ["[ROLE]", escape(role), "[/ROLE]"]
    return [*head, escape(text), closing]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    roles = {opening: role for role, (opening, _) in TURNS.items()}
    while at < len(formatted):
        opening = _MARK.match(formatted, at)
        if opening is None:
            raise ValueError(f"no mark at {at}")
        start, role = opening.end(), roles.get(opening[0])
        if role is None:
            end = formatted.index("[/ROLE]", start)
            role, start = unescape(formatted[start:end]), end + len("[/ROLE]")
        closing = _MARK.search(formatted, start)
        turns.append((role, unescape(formatted[start : closing.start()])))
        at = closing.end()
    return turns


@lru_cache(maxsize=2)
def _ids(files: tuple[str, str, str]) -> ChunkIds:
    return ChunkIds(*files)


@lru_cache(maxsize=2)
def _bytes_of(files: tuple[str, str, str]) -> list[bytes]:
    """Bytes of every id."""
    fast = _ids(files).fast
    known = [fast.decode_single_token_bytes(i) for i in range(fast.n_vocab)]
    return [*known, *[b""] * (VOCABULARY - len(known)), *(m.encode() for m in MARKS)]


def decode(ids: bytes, files: tuple[str, str, str] | None = None) -> str:
    table = _bytes_of(files or tokenizer_files())
    return b"".join([table[i] for i in np.frombuffer(ids, "<u2").tolist()]).decode()


def _encode(batches, files):
    table = _ids(files)
    mark = {m: (VOCABULARY + i).to_bytes(2, "little") for i, m in enumerate(MARKS)}
    for batch in parts(batches):
        ids, counts, begins, ends = [], [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            coded = [mark.get(x) if x in mark else np.frombuffer(table.encode(x), "<u4").astype("<u2").tobytes() for x in format_turn(role, text)]
            before = sum(map(len, coded[:-2])) // 2
            learnt = len(coded[-2]) // 2 if role == LEARNT else 0
            ids.append(b"".join(coded))
            counts.append(len(ids[-1]) // 2)
            begins.append(before if role == LEARNT else 0)
            ends.append(begins[-1] + learnt)
        kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (counts, begins, ends))], [str(i) for i in range(len(kept) + 4)])


@dataclass
class Forest:
    """``pieces``: one row a node, ``(tree, start, position, n_tokens, ids, loss_from, loss_to, attends)``. A tree's tokens are its pieces by
    ``start``, ids as little-endian 16-bit numbers; the piece's token i has position id ``position + i`` and attends to the
    intervals ``attends`` of the tree's tokens and to its own piece up to itself. Tokens from ``loss_from`` to before ``loss_to`` are learnt.

    ``turns``: one row a turn of a conversation, ``(conv_id, ordinal, tree, start)``: the piece that holds it.
    """

    pieces: DataFrame
    turns: DataFrame


def _conversation(conv_id: str) -> Column:
    return F.coalesce(F.col(conv_id).cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))


def build(conversations: DataFrame, files: tuple[str, str, str] | None = None) -> Forest:
    """The forest of ``conversations`` (conv_id, turn, role, text).

    Turns go by ``turn``, nulls first, ties by role and text. Null texts and roles are empty; null conv_ids are one
    conversation. Repeated rows are turns of their own. Texts of any length are whole pieces; a conversation of any number of
    turns is spread over tasks. Two sequences of turns are the same node if two 64-bit hashes and their lengths agree. An empty table gives an empty forest. Other
    columns are not read.
    """
    files = files or tokenizer_files()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(_conversation("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(5), "text", "role")})
    longs = [T.StructField(c, T.LongType()) for c in ("n_tokens", "loss_from", "loss_to")]
    coded = materialize(rows.mapInArrow(partial(_encode, files=files), T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("ids", T.BinaryType()), *longs])), "turns")
    placed = running(coded, ["conv"], ["turn", "role", "h1", "h2"], "ordinal", {"upto": F.col("n_tokens")}, {"p1": F.col("h1"), "p2": F.col("h2")})

    node = ["ordinal", "p1", "p2"]
    same = ("upto", "n_tokens", "ids", "loss_from", "loss_to")
    nodes = materialize(placed.groupBy(*node).agg(F.min("conv").alias("owner"), *(F.first(c).alias(c) for c in same)), "nodes")
    owned = materialize(placed.select("conv", "n_tokens", *node).join(nodes.select(*node, "owner"), node).select("conv", "ordinal", "n_tokens", "owner"), "owned")
    own = F.col("owner") == F.col("conv")
    none = F.lit(0).cast("long")
    # The owner of a later turn is never less than that of an earlier one, so the greatest of the shared is the last.
    chains = owned.groupBy("conv").agg(
        F.max(F.when(~own, F.col("owner"))).alias("up"), F.coalesce(F.max(F.when(~own, F.col("ordinal"))), none).alias("shared"),
        F.coalesce(F.sum(F.when(~own, F.col("n_tokens"))), none).alias("position"), F.coalesce(F.sum(F.when(own, F.col("n_tokens"))), none).alias("n_tokens"),
    )
    chains = materialize(chains.where("n_tokens > 0"), "chains")
    paths = _paths(chains)
    ordered = running(paths, ["tree"], ["path"], "place", {"upto": F.col("n_tokens")}).select("conv", "tree", "path", "position", (F.col("upto") - F.col("n_tokens")).alias("start"))
    ordered = materialize(ordered, "ordered")
    starts = ordered.join(_intervals(ordered), "conv", "left").select(F.col("conv").alias("owner"), "tree", "start", F.col("position").alias("from"), "above")

    interval = "array<struct<start:long,end:long>>"
    at = F.col("start") + F.col("upto") - F.col("n_tokens") - F.col("from")
    before = F.when(at > F.col("start"), F.array(F.struct(F.col("start"), at.alias("end")))).otherwise(F.array().cast(interval))
    attends = F.concat(F.coalesce("above", F.array().cast(interval)), before)
    pieces = nodes.join(starts, "owner").select("owner", "ordinal", "tree", at.alias("start"), (F.col("upto") - F.col("n_tokens")).alias("position"), "n_tokens", "ids", "loss_from", "loss_to", attends.alias("attends"))
    pieces = materialize(pieces, "pieces")
    place = pieces.select("owner", "ordinal", "tree", "start")
    turns = owned.select("conv", "ordinal", "owner").join(place, ["owner", "ordinal"])
    conv_id = F.when(F.col("conv") != F.lit(str(NO_ID)).cast("decimal(20,0)"), F.col("conv")).cast(conversations.schema["conv_id"].dataType)
    return Forest(pieces.drop("owner", "ordinal"), turns.select(conv_id.alias("conv_id"), "ordinal", "tree", "start"))


def _paths(chains: DataFrame) -> DataFrame:
    """``chains`` with the way from the tree's root to the chain: an array of (how deep it leaves the chain before, negated; its owner).

    Pointers double, so there are as many rounds as the depth of the chains has binary digits."""
    step = F.struct((-F.col("shared")).alias("deep"), F.col("conv").alias("chain"))
    now, seen = materialize_observed(chains.select("conv", "up", "position", "n_tokens", F.array(step).alias("path")), "paths", F.count("up").alias("open"))
    while seen["open"]:
        above = now.select(F.col("conv").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        further = now.where("up is not null").join(above, "up").select("conv", F.col("next").alias("up"), "position", "n_tokens", F.concat("head", "path").alias("path"))
        now, seen = materialize_observed(now.where("up is null").unionByName(further), "paths", F.count("up").alias("open"))
    return now.select("conv", "position", "n_tokens", "path", F.get("path", F.lit(0))["chain"].alias("tree"))


def _intervals(ordered: DataFrame) -> DataFrame:
    """``(conv, above)``: for each chain under another the intervals of tokens above it, from the root on."""
    steps = ordered.where(F.size("path") > 1).select("conv", F.posexplode("path").alias("i", "step")).select("conv", "i", F.col("step.chain").alias("chain"))
    placed = steps.join(ordered.select(F.col("conv").alias("chain"), "start", "position"), "chain")
    row = F.array_sort(F.collect_list(F.struct("i", "start", "position")))
    lists = placed.groupBy("conv").agg(row.alias("steps"))
    # A chain is seen as far as the next one leaves it.
    span = lambda a, b: F.struct(a["start"].alias("start"), (a["start"] + b["position"] - a["position"]).alias("end"))
    n = F.size("steps")
    return lists.select("conv", F.zip_with(F.slice("steps", F.lit(1), n - 1), F.slice("steps", F.lit(2), n - 1), span).alias("above"))


def _digests(batches, files):
    """One row a conversation from its pieces in order; hashes are fed piece by piece."""
    key, state = None, None

    def out():
        return pa.RecordBatch.from_arrays(
            [key, *(pa.array([x], kind) for x, kind in ((state[0], pa.int64()), (state[1].hexdigest(), pa.string()), (state[2], pa.int64()), (state[3].hexdigest(), pa.string()), (state[4], pa.int64())))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    for batch in parts(batches):
        convs = batch.column("conv_id")
        for i, (ids, begin, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "loss_from", "loss_to")), strict=True)):
            conv = convs.slice(i, 1)
            if key is None or not conv.equals(key):
                if key is not None:
                    yield out()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = decode(ids, files)
            for role, text in read_turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            learnt = unescape(decode(ids[2 * begin : 2 * end], files))
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(formatted)
    if key is not None:
        yield out()


def read_back(forest: Forest, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, decoded from the forest's tokens.

    A digest is of one whole conversation, so its pieces go by one task, in order and one at a time."""
    fields = [forest.turns.schema["conv_id"], *(T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))]
    read = forest.turns.join(forest.pieces.select("tree", "start", "ids", "loss_from", "loss_to"), ["tree", "start"]).select("conv_id", "ordinal", "ids", "loss_from", "loss_to")
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    return ordered.mapInArrow(partial(_digests, files=files or tokenizer_files()), T.StructType(fields))
