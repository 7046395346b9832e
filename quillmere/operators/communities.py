"""Communities by modularity (Louvain), on DataFrames.

All nodes decide at once, from the communities' totals before a sweep, so a sweep is a few aggregations and not a loop
over nodes. To keep neighbours from swapping for ever, a sweep moves only one half of the nodes, dealt anew each time
by a hash; the others are asked again. A level ends when no node wants to move, when its modularity has stopped
rising, or after MAX_SWEEPS; it returns the best labelling that it has met. Ties go to the smallest label; the result
does not depend on the order of rows. Each level runs on the graph of the communities before it, with the weight
inside a community as a loop.

Nodes are numbered in their order once a level, and arcs are written once a level, bucketed by the end that tells its
label, so they are not moved to meet the labels. What they tell is summed by the other end and label before it
is moved to the other end. A sweep is one job; the modularity of the labelling before it is a sum that it makes by the way.

A level of nodes whose labels and strengths may be sent to all tasks (a checked size) moves nothing else: its arcs are packed
once into blocks of whole nodes, each about ARCS arcs, and a sweep is a scan of them. Both ways give the same labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import BROADCAST_BYTES, bucketed, cut, discard
from .graph import edge_weights

MAX_SWEEPS, MAX_LEVELS, MIN_SIZE = 100, 3, 2
#: Modularity is worked out after so many sweeps; a level ends after so many looks without so much of a rise.
LOOK, PATIENCE, RISE = 4, 1, 1e-4
#: Arcs of a block, and the bytes of a node's label and strength; nodes are packed if these may be sent.
ARCS, SENT = 250_000, 12


def modularity(edges: DataFrame, labels: DataFrame, total: float) -> float:
    """Of a labelling (node, label) of weighted pairs (a, b, weight); total is their summed weight."""
    if not total:
        return 0.0
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = edges.join(la, "a").join(lb, "b")
    inside = both.where("la = lb").agg(F.sum("weight")).first()[0] or 0.0
    ends = both.select(F.explode(F.array("la", "lb")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("k"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - squares / (4 * total * total)


def _asked(arcs: DataFrame, state: DataFrame, total: float, sweep: int) -> DataFrame:
    """The state (id, node, label, k) after a sweep; also `wish`, whether the node wanted to move, and of the labelling
    before it `inside`, the node's weight to others of its community, and `tot`, the community's total."""
    told = state.join(state.groupBy("label").agg(F.sum("k").alias("tot")), "label")
    met = arcs.join(told.select(F.col("id").alias("other"), "label", "tot"), "other").groupBy("id", "label", "tot").agg(F.sum("weight").alias("inside"))
    own = told.select("id", "node", "k", F.col("label").alias("own"), F.col("tot").alias("own_tot"))
    share = F.col("k") / (2 * total)
    gain = F.round(F.col("inside") - F.col("tot") * share, 9)
    # The highest gain elsewhere, of the smallest label; and what the node has inside its own community.
    away = F.min(F.when(F.col("label") != F.col("own"), F.struct((F.lit(0.0) - gain).alias("loss"), "label"))).alias("away")
    inside = F.sum(F.when(F.col("label") == F.col("own"), F.col("inside")).otherwise(0.0)).alias("inside")
    offers = met.join(own, "id").groupBy("id", "node", "k", "own", "own_tot").agg(away, inside)
    stay = F.round(F.col("inside") - (F.col("own_tot") - F.col("k")) * share, 9)
    offers = offers.withColumn("wish", F.coalesce(-F.col("away.loss") > stay, F.lit(False)))
    moves = F.col("wish") & (F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(2)) == 0)
    return offers.select("id", "node", F.when(moves, F.col("away.label")).otherwise(F.col("own")).alias("label"), "k", "wish", "inside", F.col("own_tot").alias("tot"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits as F.round does: half up, of the shortest decimal."""
    whole_ones = ~(np.abs(x) < 1 << 53)  # and what is no number
    size = np.abs(np.where(whole_ones, 0.0, x)) * 1e9
    low = np.floor(size)
    part = size - low
    out = np.where(whole_ones, x, np.copysign(low + (part >= 0.5), x) / 1e9)
    for i in np.flatnonzero(~whole_ones & ((np.abs(part - 0.5) <= 1e-6 + size * 4e-16) | (size >= 1 << 52))).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


_NUMBERS, _PACKED = {"rows": "<i4", "others": "<i4", "weights": "<f8"}, "block int, labels binary, k binary"


def _packed(arcs: DataFrame, every: DataFrame, blocks: int) -> DataFrame:
    """Per block, the one of every `blocks`-th node: block, labels (the nodes' own numbers), k, the names `nodes`, and the arcs,
    by node and with its place in the block, as rows, others, weights."""

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        named = table.filter(pa.compute.is_null(table.column("other"))).sort_by("id")
        met = table.filter(pa.compute.is_valid(table.column("other"))).sort_by([("id", "ascending"), ("other", "ascending")])
        columns = {"rows": (met.column("id").to_numpy() - block) // blocks, "others": met.column("other").to_numpy(), "weights": met.column("weight").to_numpy()}
        packed = {"block": block, "labels": named.column("id").to_numpy().astype("<i4").tobytes(), "k": named.column("k").to_numpy().astype("<f8").tobytes(), "nodes": named.column("node").to_pylist()}
        kinds = [("block", pa.int32()), ("labels", pa.binary()), ("k", pa.binary()), ("nodes", pa.list_(pa.string())), *((c, pa.binary()) for c in _NUMBERS)]
        return pa.Table.from_pylist([packed | {c: v.astype(_NUMBERS[c]).tobytes() for c, v in columns.items()}], pa.schema(kinds))

    block = F.pmod("id", F.lit(blocks)).cast("int").alias("block")
    null = lambda kind: F.lit(None).cast(kind)
    rows = every.select(block, "id", "node", "k", null("long").alias("other"), null("double").alias("weight")).unionByName(arcs.select(block, "id", null("string").alias("node"), null("double").alias("k"), "other", "weight"))
    return rows.repartition(blocks, "block").groupBy("block").applyInArrow(pack, f"{_PACKED}, nodes array<string>, rows binary, others binary, weights binary")


def _decided(packed: DataFrame, state: DataFrame, total: float, sweep: int, blocks: int) -> DataFrame:
    """_asked() over packed arcs: the state (block, labels, k) after a sweep, and for each block wish, inside and squares."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = tots = None
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                numbers = lambda name, kind: np.frombuffer(get[name].as_buffer(), kind)  # noqa: B023, E731
                if labels is None:
                    held = get["held"].values
                    parts = [(b, *(np.frombuffer(held.field(c)[i].as_buffer(), kind) for c, kind in (("labels", "<i4"), ("k", "<f8")))) for i, b in enumerate(held.field("block").to_pylist())]
                    labels, ks = np.zeros(sum(len(p[1]) for p in parts), "<i4"), np.zeros(sum(len(p[1]) for p in parts))
                    for b, own, k in parts:
                        labels[b::blocks], ks[b::blocks] = own, k
                    tots = np.bincount(labels, ks, len(labels))
                at, weights, k = numbers("rows", "<i4"), numbers("weights", "<f8"), numbers("k", "<f8")
                own = labels[get["block"].as_py() :: blocks]
                share = k / (2 * total)
                met = labels[numbers("others", "<i4")]
                order = np.argsort(at.astype(np.int64) * len(labels) + met, kind="stable")
                at, met = at[order], met[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(met) != 0)])) if len(at) else np.zeros(0, int)
                told = np.add.reduceat(weights[order], first) if len(at) else np.zeros(0)
                at, met = at[first], met[first]
                mine = met == own[at]
                inside, wish, new = np.zeros(len(own)), np.zeros(len(own), bool), own.copy()
                inside[at[mine]] = told[mine]
                stay = _rounded(inside - (tots[own] - k) * share)
                at, met, told = at[~mine], met[~mine], told[~mine]
                if len(at):
                    gain = _rounded(told - tots[met] * share[at])
                    nodes, begin, size = np.unique(at, return_index=True, return_counts=True)
                    best = np.maximum.reduceat(gain, begin)
                    # Labels ascend: the first of the highest gain is the smallest.
                    hit = np.flatnonzero(gain == np.repeat(best, size))
                    hit = hit[np.unique(at[hit], return_index=True)[1]]
                    wish[nodes] = best > stay[nodes]
                    moves = wish[nodes] & np.asarray(get["deal"].values)[nodes]
                    new[nodes[moves]] = met[hit[moves]]
                out = {"block": get["block"].as_py(), "labels": new.tobytes(), "k": k.tobytes(), "wish": int(wish.sum()), "inside": float(inside.sum()), "squares": float((k * tots[own]).sum())}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("block", pa.int32()), ("labels", pa.binary()), ("k", pa.binary()), ("wish", pa.int64()), ("inside", pa.float64()), ("squares", pa.float64())]))

    told = state.coalesce(1).agg(F.collect_list(F.struct("block", "labels", "k")).alias("held"))
    deal = F.transform("nodes", lambda x: F.pmod(F.xxhash64(x, F.lit(sweep)), F.lit(2)) == 0).alias("deal")
    asked = packed.select("block", "k", "rows", "others", "weights", deal).crossJoin(F.broadcast(told))
    return asked.mapInArrow(decide, f"{_PACKED}, wish long, inside double, squares double")


def _unpacked(state: DataFrame, blocks: int) -> DataFrame:
    """id, label of a packed state."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, labels in zip(batch.column("block").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                own = np.frombuffer(labels, "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)) * blocks + block), pa.array(own)], names=["id", "label"])

    return state.select("block", "labels").mapInArrow(rows, "id long, label long")


def _numbered(nodes: DataFrame) -> DataFrame:
    """node and id: numbers from 0 in the nodes' order, without gaps."""
    placed = cut(nodes.orderBy("node").select("node", F.monotonically_increasing_id().alias("id")), "ids")
    part = F.shiftright("id", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each task
    firsts = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    base = placed.sparkSession.createDataFrame([(r["part"], f) for r, f in zip(sizes, firsts, strict=False)], "part long, base long")
    return cut(placed.join(F.broadcast(base), part == F.col("part")).select("node", (F.col("id") - F.shiftleft(F.col("part"), 33) + F.col("base")).alias("id")), "ids")


def _settled(start: DataFrame, swept: Callable[[DataFrame, int], tuple[DataFrame, float, int]], sweeps: int) -> DataFrame:
    """The best state met by sweeps from the first; a sweep gives the state after it, the modularity before it, and how many
    nodes wanted to move."""
    state, best, best_q, looked, stale = start, start, None, None, 0
    for sweep in range(sweeps + 1):
        # The last one only tells the modularity of what the others have reached.
        after, q, wished = swept(state, sweep)
        if best_q is None or q > best_q:
            if best is not start and best is not state:
                discard(best)
            best, best_q = state, q
        elif state is not best:
            discard(state)
        if not wished or sweep == sweeps:
            break
        if sweep % LOOK == 0:
            stale = stale + 1 if looked is not None and best_q <= looked + RISE else 0
            looked = best_q
            if stale >= PATIENCE:
                break
        state = after
    return best


def louvain_level(edges: DataFrame, nodes: DataFrame, sweeps: int = MAX_SWEEPS) -> DataFrame:
    """node, label of one level, the label being the smallest node of its community; edges (a, b, weight) with a <= b,
    nodes (node). Without weight all stay alone."""
    spark = edges.sparkSession
    total, count = edges.agg(F.sum("weight"), F.count("*")).first()
    if (total or 0.0) <= 0:
        return cut(nodes.select("node", F.col("node").alias("label")), "labels")
    ids = _numbered(nodes)
    end = lambda name: ids.select(F.col("node").alias(name), F.col("id").alias(f"i{name}"))
    pairs = cut(edges.join(end("a"), "a").join(end("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "weight"), "pairs")
    ends = F.array(F.struct(F.col("a").alias("other"), F.col("b").alias("id")), F.struct(F.col("b").alias("other"), F.col("a").alias("id")))
    arcs = pairs.where("a <> b").select(F.explode(ends).alias("e"), "weight").select("e.other", "e.id", "weight")
    strength = pairs.select(F.explode(F.array("a", "b")).alias("id"), "weight", (F.col("a") != F.col("b")).alias("met")).groupBy("id").agg(F.sum("weight").alias("k"), F.max("met").alias("met"))
    every = cut(ids.join(strength, "id").select("id", "node", F.col("id").alias("label"), "k", "met"), "state")
    loops = pairs.where("a = b").agg(F.sum("weight")).first()[0] or 0.0
    known = ids.limit(BROADCAST_BYTES // SENT + 1).count()
    if known <= BROADCAST_BYTES // SENT:
        blocks = -(-max(2 * count, known) // ARCS)
        full = ids.join(every.select("id", "k"), "id", "left").select("id", "node", F.coalesce("k", F.lit(0.0)).alias("k"))
        packed = cut(_packed(arcs, full, blocks), "packed")

        def swept(state: DataFrame, sweep: int) -> tuple[DataFrame, float, int]:
            seen = Observation()
            after = cut(_decided(packed, state, total, sweep, blocks).observe(seen, *(F.sum(c).alias(c) for c in ("wish", "inside", "squares"))).select("block", "labels", "k"), "state")
            found = seen.get
            return after, (found["inside"] / 2 + loops) / total - found["squares"] / (4 * total * total), found["wish"]

        best = _settled(packed.select("block", "labels", "k"), swept, sweeps)
        rows = _unpacked(best, blocks).join(every.select("id", "node"), "id").select("node", "label")
        return rows.join(rows.groupBy("label").agg(F.min("node").alias("name")), "label").select("node", F.col("name").alias("label"))

    arcs = bucketed(spark, arcs, ["other"], "arcs")
    # Nodes without arcs have no other community to go to.
    start, alone = every.where("met").select("id", "node", "label", "k"), every.where("not met").select("id", "node", "label", "k")
    lone = alone.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0

    def swept(state: DataFrame, sweep: int) -> tuple[DataFrame, float, int]:
        seen = Observation()
        sums = F.count(F.when(F.col("wish"), 1)).alias("wish"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("tot")).alias("squares")
        after = cut(_asked(arcs, state, total, sweep).observe(seen, *sums).select("id", "node", "label", "k"), "state")
        found = seen.get
        return after, ((found["inside"] or 0.0) / 2 + loops) / total - ((found["squares"] or 0.0) + lone) / (4 * total * total), found["wish"]

    best = _settled(start, swept, sweeps)
    rows = best.unionByName(alone)
    return rows.join(rows.groupBy("label").agg(F.min("node").alias("name")), "label").select("node", F.col("name").alias("label"))


def louvain(relationships: DataFrame, max_levels: int = MAX_LEVELS, sweeps: int = MAX_SWEEPS) -> DataFrame:
    """entity_id, level, label for every level from the finest (0); label is the smallest entity of the
    community. A level that merges nothing is not told."""
    edges = cut(edge_weights(relationships).where("a is not null and b is not null"), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    inside, found, count = None, None, -1
    for level in range(max_levels):
        labels = cut(louvain_level(edges, nodes, sweeps), "level")
        now = labels.select("label").distinct().count()
        if level and now == count:
            break
        count = now
        inside = labels.select(F.col("node").alias("entity_id"), "label") if inside is None else inside.join(labels.withColumnRenamed("label", "__up"), F.col("label") == F.col("node")).select("entity_id", F.col("__up").alias("label"))
        inside = cut(inside, "inside")
        rows = inside.select("entity_id", F.lit(level).alias("level"), "label")
        found = rows if found is None else found.unionByName(rows)
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = cut(edges.join(la, "a").join(lb, "b").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("weight").alias("weight")), "edges")
        nodes = labels.select(F.col("label").alias("node")).distinct()
    return found


def community_tables(assigned: DataFrame, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """communities (id, level, parent_id, rank = size) and members, of at least min_size entities. The parent is
    the community of the next coarser level that holds the same entities."""
    id_ = lambda level, label: F.concat_ws("-", F.lit("c"), level.cast("string"), label)
    sized = assigned.groupBy("level", "label").agg(F.count("*").alias("size"), F.min("entity_id").alias("one")).where(F.col("size") >= min_size)
    above = assigned.select((F.col("level") - 1).alias("level"), F.col("entity_id").alias("one"), F.col("label").alias("parent"))
    kept = sized.select((F.col("level") - 1).alias("level"), F.col("label").alias("parent"), F.lit(True).alias("there"))
    rows = sized.join(above, ["level", "one"], "left").join(kept, ["level", "parent"], "left")
    communities = rows.select(id_(F.col("level"), F.col("label")).alias("id"), "level", F.when(F.col("there"), id_(F.col("level") + 1, F.col("parent"))).alias("parent_id"), F.col("size").cast("int").alias("rank"))
    members = assigned.join(sized.select("level", "label"), ["level", "label"], "left_semi").select(id_(F.col("level"), F.col("label")).alias("community_id"), "entity_id")
    return communities, members


def community_texts(members: DataFrame, entities: DataFrame, relationships: DataFrame, entity_chars: int = 3000, edge_chars: int = 2000) -> DataFrame:
    """community_id, entity_text, edge_text: descriptions of members (`- name (type): description`) and of the
    relationships among them, joined by lines in id order. Rows longer than the texts can hold are left out
    before they are gathered, so a large community is not collected whole."""
    from pyspark.sql import Window

    def gathered(rows: DataFrame, limit: int) -> DataFrame:
        order = Window.partitionBy("community_id").orderBy("id")
        before = F.coalesce(F.sum(F.char_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = rows.withColumn("at", before).where(F.col("at") < limit)
        return some.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("text")).withColumn("text", F.left("text", F.lit(limit)))

    line = F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit("")))
    one = members.select("community_id", F.col("entity_id").alias("id")).join(entities.select("id", line.alias("line")), "id")
    ends = members.select("community_id", F.col("entity_id").alias("source_id")).join(relationships.where("coalesce(description, '') <> ''"), "source_id").join(members.select("community_id", F.col("entity_id").alias("target_id")), ["community_id", "target_id"])
    two = ends.select("community_id", "id", F.concat(F.lit("- "), "description").alias("line"))
    return gathered(one, entity_chars).withColumnRenamed("text", "entity_text").join(gathered(two, edge_chars).withColumnRenamed("text", "edge_text"), "community_id", "left")
