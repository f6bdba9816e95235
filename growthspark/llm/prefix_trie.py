"""Conversation prefix trie (operator 13).

A turn is known by an id of fixed width, a conversation by the ids of its turns
one after another.  Burst trie: suffixes lie in containers under trie heads, at
first all under the root.  A container whose suffixes hold too many turns is
burst: each suffix gives up its next turn ids, which become heads, and moves to
the container below them; the number given up doubles with each round.  The
containers left are dealt to shards, sorted, and swept: neighbours share the
nodes of their common prefix, so a stack of open nodes yields each node once,
with all that its subtree adds up to.  Heads collect from the containers below.

Conversations are cut into pages of at most ``PAGE`` turns, so no row grows
with a conversation.  The pages form levels; a page's trie hangs from the node
its predecessor ends at, so levels are swept from the deepest up.  A page under
a node that one conversation alone passes is a chain and needs no sweep.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from growthspark.llm.common import stage

UNIT = 24             # bytes of a turn id: 16 of its digest, 8 of the length of its text
PAGE = 4096           # turns per page of a conversation
CONTAINER = 1 << 14   # turns of a container that bursts beyond them
FIRST = 9             # the head of a conversation that comes from its base has fewer turns
STEP = 5              # conversations that share a base
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
HEAD_PATH = "array<struct<key: binary, bytes: long>>"


def turn_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos from 1, unit) in order of turn, nulls first, then turn id; thin rows without texts.

    Rows are ranged over all partitions, so one long conversation may span
    many; a partition adds the count of its conversation's earlier ones.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    size = F.octet_length(role).cast("string")
    digest = F.unhex(F.sha2(F.concat(size, F.lit(":"), role, text), 256)).substr(1, 16)
    unit = F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    turns = stage(conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), unit.alias("unit"))
                  .where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    ranged = stage(turns.repartitionByRange("conv_id", "turn", "unit", "row").withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # a partition goes on with one conversation at most, so there are no more such rows than partitions
    spans = parts.withColumn("earlier", earlier).where("earlier > 0").select("conv_id", "part", "earlier")
    inside = F.row_number().over(W.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first("turn"), "unit"))
    return (ranged.withColumn("inside", inside).join(F.broadcast(spans), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("pos"), "unit"))


def rebuild(rows: DataFrame, page: int) -> DataFrame:
    """Pages (conv_id, page, blob, total) of all rebuilt conversations.

    The last page of a conversation is shorter than ``page`` turns, if need be empty.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % FIRST
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % STEP).alias("base"))
    convs = stage(convs, "convs")
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage(convs.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
        .withColumn("total", F.col("taken") + F.col("own")), "rebuilt")
    own = (rows.join(convs.where("own > 0").select("conv_id", "h", "taken", "total"), "conv_id").where("pos > h")
           .select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "unit"))
    first = rows.where(F.col("pos") < FIRST).select(F.col("conv_id").alias("base"), "pos", "unit")
    taken = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "total", "pos", "unit")
    blob = F.expr("listagg(unit) WITHIN GROUP (ORDER BY pos)")
    full = own.unionByName(taken).groupBy("conv_id", "total", F.expr(f"(pos - 1) div {page}").alias("page")).agg(blob.alias("blob"))
    last = convs.where(F.col("total") % page == 0).select("conv_id", "total", F.expr(f"total div {page}").alias("page"), F.lit(b"").alias("blob"))
    return full.unionByName(last).select("conv_id", "page", "blob", "total")


def _key(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:16]


def _page_heads(batches):
    """Keys of the node above each page, from the digests of the pages before it."""
    for batch in batches:
        out = []
        for conv, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = ROOT
            for d in digests:
                out.append((conv, d["page"], key))
                key = _key(key, d["digest"])
        conv, page, head = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(page, pa.int64()), pa.array(head, pa.binary())], names=["conv_id", "page", "head"])


def with_heads(pages: DataFrame, page: int) -> DataFrame:
    """Adds head (key of the node above) and end_key (of the node the page ends at)."""
    digest = F.unhex(F.sha2("blob", 256))
    one = pages.where(F.col("total") < page).withColumn("head", F.lit(ROOT))
    many = pages.where(F.col("total") >= page)
    lists = many.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page", digest.alias("digest")))))  # 40 bytes a page
    heads = lists.mapInArrow(_page_heads, "conv_id long, page long, head binary")
    end = F.unhex(F.sha2(F.concat("head", digest), 256)).substr(1, 16)
    return one.unionByName(many.join(heads, ["conv_id", "page"])).withColumn("end_key", end)


def _ends(batches):
    """SHA-256 of the ids that end at each key; rows come sorted by key and id, across batches."""
    key, state, first = None, None, None
    for batch in batches:
        done = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                state.update(b",%d" % conv)
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(b"%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["end_key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["end_key", "ends"])


def burst(suffixes: DataFrame, limit: int) -> DataFrame:
    """Adds key, at and path: container, turns given up, and heads from the page's down to the container's.

    Ends when no container of two suffixes or more holds over ``limit`` turns.
    """
    size = F.floor(F.length("blob") / UNIT)
    first = F.array(F.struct(F.col("head").alias("key"), F.lit(0).cast("long").alias("bytes"))).cast(HEAD_PATH)
    state = stage(suffixes.withColumn("key", F.col("head")).withColumn("at", F.lit(0)).withColumn("path", first), "suffixes")
    stride = 1

    def step(batches):
        for batch in batches:
            key, at, path = (batch.column(c).to_pylist() for c in ("key", "at", "path"))
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                for _ in range(min(stride, len(blob) // UNIT - at[i])):
                    unit = blob[at[i] * UNIT:(at[i] + 1) * UNIT]
                    key[i] = _key(key[i], unit)
                    path[i].append({"key": key[i], "bytes": int.from_bytes(unit[16:], "big")})
                    at[i] += 1
            new = {"key": pa.array(key, pa.binary()), "at": pa.array(at, pa.int32()), "path": pa.array(path, batch.schema.field("path").type)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    while True:
        weight = (size - F.col("at")).cast("long")
        large = state.groupBy("key").agg(F.sum(weight).alias("turns"), F.count(F.lit(1)).alias("n")).where((F.col("turns") > limit) & (F.col("n") > 1))
        large = stage(large.select("key"), "large")
        if large.isEmpty():
            return state
        # one row per ``limit`` turns at most: with the broadcast a key that all rows share is no skewed join
        large = F.broadcast(large.withColumn("large", F.lit(True)))
        marked = state.join(large, "key", "left").select(*state.columns, "large")
        moved = marked.where("large").drop("large").mapInArrow(step, state.schema)
        state = stage(marked.where("large is null").drop("large").unionByName(moved), "suffixes")
        stride *= 2


class Sweep:
    """Open nodes of one container; rows come in order of their suffixes."""

    def __init__(self, top: int):
        self.top = top  # depth of the head
        self.before = b""
        self.done: list[list] = []   # conv_id, depth, place of the parent, n, children, leaves, saved, ends
        self.stack = [self.node(0)]

    def node(self, size: int) -> list:
        return [None, 0, 0, 0, 0, None, size, []]  # least id, n, children, leaves, saved, ends, bytes, places of the children

    def close(self) -> None:
        conv, n, children, leaves, saved, ends, size, below = self.stack.pop()
        place = len(self.done)
        for b in below:
            self.done[b][2] = conv
        leaves, saved = leaves if children else 1, saved + (n - 1) * size
        self.done.append([conv, self.top + len(self.stack), None, n, children, leaves, saved, ends])
        up = self.stack[-1]
        up[0] = conv if up[0] is None else min(up[0], conv)
        up[1] += n
        up[2] += 1
        up[3] += leaves
        up[4] += saved
        up[7].append(place)

    def add(self, rest: bytes, conv: int, n: int, ends, children: int, leaves: int, saved: int) -> None:
        same, least = 0, min(len(rest), len(self.before))
        while same < least and rest[same:same + UNIT] == self.before[same:same + UNIT]:
            same += UNIT
        while len(self.stack) - 1 > same // UNIT:
            self.close()
        for k in range(same, len(rest), UNIT):
            self.stack.append(self.node(int.from_bytes(rest[k + 16:k + UNIT], "big")))
        self.before, end = rest, self.stack[-1]
        end[0] = conv if end[0] is None else min(end[0], conv)
        end[1] += n
        end[2] += children
        end[3] += leaves
        end[4] += saved
        end[5] = ends if end[5] is None else end[5]

    def finish(self) -> list:
        while len(self.stack) > 1:
            self.close()
        head = self.stack[0]
        for b in head[7]:
            self.done[b][2] = head[0]
        return head


def _sweep(schema: pa.Schema):
    """Nodes of each container below its head, and the head's sums; rows come sorted by container and suffix."""

    def run(batches):
        key = path = sweep = None
        out: list[tuple] = []

        def flush():
            conv, n, children, leaves, saved, ends, _, _ = sweep.finish()
            out.extend((*d, None, None) for d in sweep.done)
            out.append((conv, sweep.top, None, n, children, leaves, saved, ends, key, path))

        def table():
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return got

        names = ("key", "rest", "conv_id", "n", "ends", "children", "leaves", "saved")
        for batch in batches:
            top, paths = batch.column("top").to_pylist(), batch.column("path")
            for i, (k, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if k != key:
                    if sweep:
                        flush()
                    key, path, sweep = k, paths[i].as_py(), Sweep(top[i])
                sweep.add(*row)
            if out:
                yield table()
        if sweep:
            flush()
            yield table()

    return run


def level_nodes(suffixes: DataFrame, level: int, page: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the heads of a level, with the heads made by bursting; and the sums of the pages' own heads."""
    spark = suffixes.sparkSession
    state = burst(suffixes, limit).withColumn("rest", F.expr(f"substring(blob, at * {UNIT} + 1)")).withColumn("top", F.col("at").cast("long") + level * page)
    out = f"{NODE}, key binary, path {HEAD_PATH}"
    kinds = spark.createDataFrame([], out).schema
    arrow = pa.schema([pa.field(f.name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.list_(
        pa.struct([("key", pa.binary()), ("bytes", pa.int64())])))) for f in kinds])
    ordered = (state.select("key", "rest", "conv_id", "n", "ends", "children", "leaves", "saved", "top", "path")
               .repartition("key").sortWithinPartitions("key", "rest"))
    swept = stage(ordered.mapInArrow(_sweep(arrow), out), "swept")
    nodes = swept.where("key is null").select(*[c.split()[0] for c in NODE.split(", ")])
    totals = swept.where("key is not null")
    step = F.posexplode("path").alias("i", "step")
    own = lambda c: F.when(F.col("step.key") == F.col("key"), F.col(c))
    above = totals.select("*", step)
    heads = above.groupBy(F.col("step.key").alias("head")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.coalesce(F.sum(own("n_children")), F.lit(0)).alias("swept"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max(own("ends_sha256")).alias("ends_sha256"),
        F.max("i").alias("i"), F.max("step.bytes").alias("bytes"), F.first(F.expr("slice(path, 1, i + 1)")).alias("path"))
    heads = stage(heads.withColumn("parent", F.expr("if(i > 0, path[i - 1].key, null)")), "heads")
    children = heads.where("i > 0").groupBy(F.col("parent").alias("head")).agg(F.count(F.lit(1)).alias("k"))
    full = heads.join(children, "head", "left").withColumn("n_children", F.col("swept") + F.coalesce("k", F.lit(0)))
    # a childless head is a leaf; of a page's head the level above (or, at the root, no text) counts the bytes
    full = stage(full.withColumn("leaf", ((F.col("n_children") == 0) & ((F.col("i") > 0) | F.lit(level == 0))).cast("long"))
                 .withColumn("own", F.when(F.col("i") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)), "full_heads")
    given = (full.where("leaf > 0 or own > 0").select("leaf", "own", F.explode("path").alias("a"))
             .groupBy(F.col("a.key").alias("head")).agg(F.sum("leaf").alias("more_leaves"), F.sum("own").alias("more_saved")))
    up = full.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    done = full.join(given, "head", "left").join(up, "parent", "left").select(
        "head", "i", "conv_id", (F.col("i") + level * page).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), "ends_sha256")
    done = stage(done, "level_heads")
    tops = done.where("i = 0")
    inner = done.where("i > 0") if level else done
    return nodes.unionByName(inner.select(nodes.columns)), tops


def _chains(page: int):
    """Nodes of pages that one conversation alone passes."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, number, blob, total in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "page", "blob", "total"))):
                for d in range(number * page + 1, number * page + len(blob) // UNIT + 1):
                    end = d == total
                    out.append((conv, d, conv, 1, 0 if end else 1, 1, 0, hashlib.sha256(b"%d" % conv).hexdigest() if end else None))
            if out:
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in NODE.split(", ")])

    return run


def prefix_trie(conversations: DataFrame, page: int = PAGE, limit: int = CONTAINER, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All nodes of the trie of rebuilt conversations, the textless root included.

    A conversation c is rebuilt from the first h turns of its base c - c % 5 (the
    remainder has c's sign) and its own after its first h; h is the CRC-32 of
    c in decimal, modulo 9.  Turns with the same number stand by turn id, those
    without one come first; repeated rows are turns of their own.  Null role
    or text is empty; rows without conv_id belong to no conversation.  Turn ids
    are 128 bits of a SHA-256 of role and text with the text's length.  Extra
    columns are ignored; an empty table has no trie and gives no rows.
    """
    rows = stage(turn_rows(conversations, id_col, turn_col, role_col, text_col), "numbered")
    pages = stage(with_heads(stage(rebuild(rows, page), "pages"), page), "headed")
    passing = pages.where("page > 0").groupBy("page", "head").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("solo"))
    passing = stage(passing, "passing")
    levels = (passing.where("n > 1").agg(F.max("page")).first()[0] or 0) + 1
    alone = passing.where("n = 1").select("page", "head", F.lit(True).alias("alone"))
    marked = pages.where("page > 0").join(alone, ["page", "head"], "left")
    chains = marked.where("alone").select("conv_id", "page", "blob", "total").mapInArrow(_chains(page), NODE)
    shared = marked.where("alone is null").drop("alone")
    ending = pages.where(F.col("total") < (F.col("page") + 1) * page).select("end_key", "conv_id")
    ends = stage(ending.repartition("end_key").sortWithinPartitions("end_key", "conv_id").mapInArrow(_ends, "end_key binary, ends string"), "ends")
    # what a lone page hands to the node above: a chain, or nothing if the conversation ends there
    lone = marked.where("alone").join(ends, "end_key", "left").select(
        "page", "head", (F.length("blob") > 0).cast("long").alias("children"), F.when(F.length("blob") == 0, F.col("ends")).alias("below"))
    lone = lone.select("page", F.col("head").alias("end_key"), "children", F.col("children").alias("leaves"), F.lit(0).cast("long").alias("saved"), "below")
    nodes, tops = chains, None
    for level in reversed(range(levels)):
        sums = lone.where(F.col("page") == level + 1).drop("page")
        if tops is not None:
            sums = sums.unionByName(tops.select(
                F.col("head").alias("end_key"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("below")))
        texts = ((shared if level else pages).where(F.col("page") == level).groupBy("head", "end_key", "blob")
                 .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        suffixes = texts.join(ends, "end_key", "left").join(sums, "end_key", "left").select(
            "head", "blob", "conv_id", "n", F.coalesce("ends", "below").alias("ends"), zero("children"), zero("leaves"), zero("saved"))
        found, tops = level_nodes(suffixes, level, page, limit)
        nodes = nodes.unionByName(found)
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
