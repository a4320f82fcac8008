"""The trie of conversation beginnings, with totals over subtrees by centroid decomposition.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. A conversation's path is
its running sums of turn hashes, salted with the position, in four 32-bit lanes: one scan, no growing strings. The smallest
member owns a node, so a node is (owner, depth), and each conversation's path names the owner at every depth.

Totals over subtrees do not climb the trie level by level. Every node weighs the turns that lie on it, so a component's top
knows its weight, the nodes of more than half of it form a path from the top down, and the lowest of those is the centroid.
A round splits every component at its centroid: the totals of the centroid's own side of the component are added to the nodes
on the path from it to the top, whose weight drops by the same side; its children's subtrees and the rest go on as components
of at most half the weight. After a logarithmic number of rounds, however deep the trie is, each node has its subtree's total.
Rounds run as joins while a component is larger than a task should hold; smaller components are finished, by the same rounds,
in numpy, many to a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.text import arrow_schema
from folioscope.session import cut_lineage

#: Weight of a component that one task finishes.
IN_TASK = 16_384
#: Turns of one conversation that are numbered or summed together.
SLICE = 4_096
#: Members of a node whose digest is fed at once.
MEMBERS = 4_096
LANES = ["s0", "s1", "s2", "s3"]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ... by turn, null first, then role, then text), two hashes of (role, text) and the text's length.

    Rows are dealt by range, so one conversation with a third of all turns is numbered in many tasks; what stands before a
    task's first turn is added from the counts of the tasks before it. Turns without a conversation id belong to none.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    keys = ["conv_id", "turn", "role", "text"]
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*keys, "any").sortWithinPartitions(*keys)
    schema = "part int, conv_id bigint, i bigint, h0 bigint, h1 bigint, chars bigint"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            new = np.append(conv[0] != last, conv[1:] != conv[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            i = np.where(begin < 0, np.arange(len(conv)) + seen, np.arange(len(conv)) - begin)
            last, seen = conv[-1], int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(i, pa.int64()),
                                              *(batch.column(c) for c in ("h0", "h1", "chars"))], schema=to)

    hashed = dealt.select(F.spark_partition_id().alias("part"), "conv_id", F.xxhash64("role", "text").alias("h0"),
                          F.xxhash64("text", F.lit(1), "role").alias("h1"), F.char_length("text").cast("bigint").alias("chars"))
    local = cut_lineage(hashed.mapInArrow(run, schema))
    counts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    several = counts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).filter(F.size("parts") > 1)
    before = several.select("conv_id", F.posexplode("parts").alias("k", "p"), "parts").select(
        F.col("conv_id").alias("conv"), F.col("p.part").alias("at"),
        F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("before"))
    return local.join(before, (F.col("conv_id") == F.col("conv")) & (F.col("part") == F.col("at")), "left").select(
        "conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("pos"), "h0", "h1", "chars")


def shared_openings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of ``numbered`` with the first h turns of each conversation c replaced by those of conversation c - c % 100,
    and the ids of all conversations, those left without turns too.

    h is the checksum of c modulo 6. A conversation keeps its own turns after its first h.
    """
    c = F.col("conv_id")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = sizes.select("conv_id", "n", (c - c % 100).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 6).alias("h"))
    bases = sizes.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = cut_lineage(plan.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))
    heads = rows.filter("conv_id % 100 = 0 and pos < 5").withColumnRenamed("conv_id", "base")
    opened = plan.filter("m > 0").join(heads, "base").filter("pos < h").select("conv_id", "pos", "h0", "h1", "chars")
    own = rows.join(plan, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "h0", "h1", "chars")
    return own.unionByName(opened), plan.select("conv_id")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, len, key and up (hashes of the first depth turns, and of one fewer), chars; depth 0 for each of ``convs``.

    Running sums go over slices of a conversation, then over the slices' totals.
    """
    salted = turns.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "chars", F.expr(f"pos div {SLICE}").alias("slice"),
        F.xxhash64("pos", "h0", "h1").alias("a"), F.xxhash64("h1", "pos", "h0").alias("b"))
    low = F.lit(0xFFFFFFFF)
    lanes = [F.col("a").bitwiseAND(low), F.shiftrightunsigned("a", 32), F.col("b").bitwiseAND(low), F.shiftrightunsigned("b", 32)]
    own = salted.select("conv_id", "depth", "chars", "slice", *(x.alias(f"t{i}") for i, x in enumerate(lanes)))
    w = Window.partitionBy("conv_id", "slice").orderBy("depth")
    running = own.select("*", *(F.sum(f"t{i}").over(w).alias(f"r{i}") for i in range(4)))
    slices = own.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(4)))
    lengths = slices.groupBy("conv_id").agg(F.sum("n").alias("len"), F.max("slice").alias("last"))
    earlier = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumnsRenamed({"conv_id": "conv", "slice": "at"}).join(
        lengths.filter("last > 0").select(F.col("conv_id").alias("conv")), "conv", "left_semi").select(
        "conv", "at", *(F.sum(f"t{i}").over(earlier).alias(f"o{i}") for i in range(4)))
    summed = running.join(offsets, (F.col("conv_id") == F.col("conv")) & (F.col("slice") == F.col("at")), "left").join(
        lengths.select("conv_id", "len"), "conv_id").select(
        "conv_id", "depth", "len", "chars", *((F.col(f"r{i}") + F.coalesce(f"o{i}", F.lit(0))).alias(f"s{i}") for i in range(4)),
        *(f"t{i}" for i in range(4)))

    def key(depth: Column, lanes: list[Column]) -> Column:
        return F.struct(F.xxhash64(depth, *lanes).alias("x"), F.xxhash64(*reversed(lanes), depth, F.lit(1)).alias("y"))

    steps = summed.select("conv_id", "depth", "len", "chars", key(F.col("depth"), [F.col(c) for c in LANES]).alias("key"))
    roots = convs.join(lengths.select("conv_id", "len"), "conv_id", "left").select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.coalesce("len", F.lit(0)).alias("len"), F.lit(0).cast("bigint").alias("chars"),
        F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")).alias("key"))
    return steps.unionByName(roots)


def member_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ids of the conversations that end at a node, ascending, joined by commas.

    Sorted by range; ids become text in parts of up to ``MEMBERS``. Parts meet by node in order and are fed to the digest as
    they come, so a node with a third of all conversations is a short stream of parts, never a group in memory.
    """
    ids = ends.select(F.col("key.x").alias("x"), F.col("key.y").alias("y"), "conv_id").repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    part_schema, schema = "x bigint, y bigint, least bigint, ids string", "x bigint, y bigint, ends_sha256 string"
    part_to, to = arrow_schema(part_schema), arrow_schema(schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "conv_id"))
            new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))).tolist() if len(x) else []
            cuts = sorted({*new, *range(0, len(x), MEMBERS)})
            texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(x)])]
            yield pa.RecordBatch.from_arrays([pa.array(v[cuts], pa.int64()) for v in (x, y, c)] + [pa.array(texts, part_to.field("ids").type)], schema=part_to)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "ids"))):
                if (x, y) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), to)], schema=to)
                out = []
        if at is not None:
            out.append((*at, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), to)], schema=to)

    parts = ids.mapInArrow(joined, part_schema)
    return parts.repartition("x", "y").sortWithinPartitions("x", "y", "least").mapInArrow(digested, schema).select(
        F.struct("x", "y").alias("key"), "ends_sha256")


def split_rounds(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of ``values`` over subtrees of many components; ``top`` and ``parent`` are places, a top is its own parent.

    ``weight`` is that of a node's side of its component; it falls strictly from a node to its children.
    """
    n = len(top)
    total, alive = values.copy(), np.arange(n)
    top, weight = top.copy(), weight.copy()
    while len(alive):
        heavy = alive[2 * weight[alive] > weight[top[alive]]]  # of each component a path from the top down
        lowest = heavy[np.lexsort((depth[heavy], top[heavy]))]
        lowest = lowest[np.append(top[lowest][1:] != top[lowest][:-1], True)]
        centre = np.full(n, -1)
        centre[top[lowest]] = lowest
        # Where each node comes to rest on the way up: the centroid's child above it, or the component's top.
        rest = np.arange(n)
        own = centre[top[alive]]
        rest[alive] = np.where((parent[alive] == own) | (alive == own) | (alive == top[alive]), alive, parent[alive])
        while True:
            on = rest[rest[alive]]
            if (on == rest[alive]).all():
                break
            rest[alive] = on
        side = (rest[alive] == own) | (parent[rest[alive]] == own)
        on_side = alive[side & (alive != own)]
        sums = np.zeros((n, values.shape[1]), values.dtype)
        np.add.at(sums, top[on_side], values[on_side])
        sums[top[lowest]] += values[lowest]
        total[lowest] += sums[top[lowest]] - values[lowest]
        above = heavy[heavy != centre[top[heavy]]]
        total[above] += sums[top[above]]
        weight[above] -= weight[centre[top[above]]]
        top[alive] = np.where(side, rest[alive], top[alive])
        alive = alive[alive != own]
    return total


def subtree_totals(nodes: DataFrame, owners: DataFrame, columns: list[str], in_task: int = IN_TASK) -> DataFrame:
    """conv_id, depth and the totals of ``columns`` over each node's subtree.

    ``nodes``: conv_id (owner), depth, up (owner of the parent), weight, columns; one tree with its top at depth 0.
    ``owners``: conv_id, depth, owner, next: the owners of a conversation's path at a depth and at the next one.
    """
    spark = nodes.sparkSession
    at = owners.select(F.col("conv_id").alias("of"), F.col("depth").alias("cut"), "owner", "next")
    top = F.struct(F.min(F.when(F.col("depth") == 0, F.col("conv_id"))).alias("c"), F.lit(0).cast("bigint").alias("d"))
    active = nodes.join(F.broadcast(nodes.agg(top.alias("comp"))), F.lit(True)).withColumns({f"t_{c}": F.col(c) for c in columns})
    active = cut_lineage(active)
    settled = []
    while True:
        sizes = active.groupBy("comp").agg(F.max("weight").alias("all")).filter(F.col("all") > in_task)
        sizes = cut_lineage(sizes)
        if sizes.isEmpty():
            break
        large = active.join(sizes, "comp")
        heavy = large.filter(2 * F.col("weight") > F.col("all"))
        centres = heavy.groupBy("comp").agg(F.max_by(F.struct("conv_id", "weight", "depth"), "depth").alias("m")).select(
            "comp", F.col("m.conv_id").alias("mc"), F.col("m.depth").alias("md"), F.col("m.weight").alias("mw"))
        large = large.join(cut_lineage(centres), "comp")
        under = F.coalesce((F.col("owner") == F.col("mc")) & (F.col("depth") >= F.col("md")), F.lit(False))
        sided = cut_lineage(large.join(at, (F.col("conv_id") == F.col("of")) & (F.col("md") == F.col("cut")), "left").withColumn("side", under).drop("of", "cut"))
        sums = cut_lineage(sided.filter("side").groupBy("comp").agg(*(F.sum(c).alias(f"side_{c}") for c in columns)))
        sided = sided.join(sums, "comp")
        is_centre = F.col("side") & (F.col("depth") == F.col("md"))
        above = ~F.col("side") & (2 * F.col("weight") > F.col("all"))
        settled.append(cut_lineage(sided.filter(is_centre).select(
            "conv_id", "depth", *((F.col(f"t_{c}") - F.col(c) + F.col(f"side_{c}")).alias(c) for c in columns))))
        rest = sided.filter(~is_centre).select(
            "conv_id", "depth", "up", F.when(above, F.col("weight") - F.col("mw")).otherwise(F.col("weight")).alias("weight"), *columns,
            F.when(F.col("side"), F.struct(F.col("next").alias("c"), (F.col("md") + 1).alias("d"))).otherwise(F.col("comp")).alias("comp"),
            *(F.when(above, F.col(f"t_{c}") + F.col(f"side_{c}")).otherwise(F.col(f"t_{c}")).alias(f"t_{c}") for c in columns))
        small = active.join(sizes, "comp", "left_anti").select(rest.columns)
        active = cut_lineage(rest.unionByName(small))

    schema = "conv_id bigint, depth bigint, " + ", ".join(f"{c} bigint" for c in columns)
    to = arrow_schema(schema)

    def finish(table: pa.Table) -> pa.Table:
        def get(c: str) -> np.ndarray:
            return table.column(c).fill_null(0).to_numpy()

        conv, depth, up, cc, cd = get("conv_id"), get("depth"), get("up"), get("cc"), get("cd")
        order = np.lexsort((depth, conv))
        place = {k: int(i) for i, k in zip(order, zip(conv[order].tolist(), depth[order].tolist()))}
        top = np.array([place[k] for k in zip(cc.tolist(), cd.tolist())])
        parent = np.array([place.get((u, d - 1), -1) for u, d in zip(up.tolist(), depth.tolist())])
        parent = np.where(top == np.arange(len(top)), np.arange(len(top)), parent)
        own = np.stack([get(c) for c in columns], 1)
        done = split_rounds(top, parent, depth, get("weight"), own) + np.stack([get(f"t_{c}") for c in columns], 1) - own
        return pa.table([pa.array(conv), pa.array(depth), *(pa.array(done[:, i]) for i in range(len(columns)))], schema=to)

    groups = max(spark.sparkContext.defaultParallelism, -(-active.count() // in_task))
    small = active.select("conv_id", "depth", "up", "weight", *columns, *(f"t_{c}" for c in columns), F.col("comp.c").alias("cc"), F.col("comp.d").alias("cd"),
                          F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("group"))
    done = small.groupBy("group").applyInArrow(finish, schema)
    for part in settled:
        done = done.unionByName(part)
    return done


def conversation_trie(turns: DataFrame, shared: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``shared``, conversations first get the openings of ``shared_openings``. Turns are ordered by turn, null first, then
    by role and text, so ties and repeated rows have one order; null roles and texts are empty; rows without conversation id
    are in no conversation. Very long texts only pass through a hash; a conversation of any length is numbered and summed in
    slices. A table without conversations gives no node, not even the root. Extra columns are left out, whatever their names.
    """
    rows = numbered(turns)
    if shared:
        rows = cut_lineage(rows)
        rows, convs = shared_openings(rows)
    else:
        convs = rows.select("conv_id").distinct()
    steps = cut_lineage(paths(cut_lineage(rows), cut_lineage(convs)))
    nodes = cut_lineage(steps.groupBy("depth", "key").agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight")))
    named = steps.filter("depth > 0").join(nodes.select("depth", "key", "owner"), ["depth", "key"]).select("conv_id", "depth", "owner")
    root = nodes.filter("depth = 0").select("owner")
    named = cut_lineage(named.unionByName(steps.filter("depth = 0").select("conv_id", "depth").join(F.broadcast(root), F.lit(True))))
    # Only paths of conversations that own nodes are asked for, each at one depth and the next.
    following = named.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("next"))
    owners = cut_lineage(named.join(following, ["conv_id", "depth"], "left"))
    above = owners.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"))
    full = nodes.join(above, ["owner", "depth"], "left")
    children = full.filter("depth > 0").groupBy("up", "depth").agg(F.count("*").alias("n_children")).select(
        F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth"), "n_children")
    full = full.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = cut_lineage(full.select(
        F.col("owner").alias("conv_id"), "depth", "up", "n_convs", "n_children", "weight", "key",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    totals = subtree_totals(full.select("conv_id", "depth", "up", "weight", "n_leaves", "saved_tokens"), owners, ["n_leaves", "saved_tokens"], in_task)
    ends = member_digests(steps.filter("len = depth").select("key", "conv_id"))
    return full.drop("n_leaves", "saved_tokens").join(totals, ["conv_id", "depth"]).join(ends, "key", "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
