"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Items are spread by hash into blocks of about BLOCK items. Each block is solved by several islands, each a Spark group
with its own seed: the islands' populations start from best-fit packings in different orders; crossover injects a few
well-filled containers of one parent into another, dissolves the containers that held the same items, exchanges the
displaced items into better fillings and best-fits the rest. After each round the elites of an island migrate to the
next one of the same block. The best packing of a block counts. Then each block's emptiest containers are opened again,
as far as they are filled less than FULL and hold up to half of the block's items, and their items are packed in the
next level, with the same algorithm, until one block is left: so a block's remainder isn't lost room, and all levels
together are at most twice the work of the first.

A block is given up to evolution only while it uses more containers than its sum of sizes, or its items above half a
container, need at least.

Only an item larger than the capacity is divided: into full containers and one remainder, which is an item like any
other. Every item is placed, also one of size 0; a null size counts as 0, a negative one is an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import shared_path, ship, written

CAPACITY = 8_192
BLOCK = 2_000
ISLANDS = 2
ROUNDS = 4
GENERATIONS = 40
POPULATION = 6
ELITES = 2
TRIED = 24  #: displaced items that are tried in exchanges, with their pairs
FULL = 0.985
TASK_GROUPS = 16

_STATE = "block bigint, island int, ids array<bigint>, pieces array<int>, sizes array<int>, elites array<array<int>>, used int, score double, least int, children int"


def best_fit(sizes: np.ndarray, items: np.ndarray, assign: np.ndarray, room: list[tuple[int, int]], capacity: int, opened: int) -> int:
    """Put items, in the order given, each into the fullest container that takes it; room: sorted (room, container).
    Returns the number of containers opened so far."""
    for k, s in zip(items.tolist(), sizes[items].tolist(), strict=True):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, c = room.pop(at)
        else:
            left, c = capacity, opened
            opened += 1
        assign[k] = c
        insort(room, (left - s, c))
    return opened


def score(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """(containers used, mean squared filling): fewer containers win, then the more uneven filling."""
    fill = np.bincount(assign, weights=sizes)
    return len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def exchange(sizes: list[int], bins: list[list[int]], rooms: list[int], displaced: list[int], rng: np.random.Generator) -> list[int]:
    """Fill containers better by exchange: for each container in random order, none, one or two of its items go out and
    one or two displaced ones of a larger sum, that still fits, come in; the best such exchange is made. Returns what is
    displaced in the end: as many or fewer items, of a smaller sum. bins and rooms are changed."""
    tried, rest = displaced[:TRIED], displaced[TRIED:]

    def sums():
        one = [(sizes[k], (k,)) for k in tried]
        two = [(sizes[k] + sizes[m], (k, m)) for i, k in enumerate(tried) for m in tried[:i]]
        both = sorted(one + two)
        return [x[0] for x in both], both

    values, choices = sums()
    for c in rng.permutation(len(bins)).tolist():
        if not tried:
            break
        room, have = rooms[c], bins[c]
        if room <= 0 or not have:
            continue
        some = have if len(have) <= 6 else [have[i] for i in rng.choice(len(have), 6, replace=False).tolist()]
        gain, best = 0, None
        for out in [(), *((k,) for k in some), *((k, m) for i, k in enumerate(some) for m in some[:i])]:
            s = sum(sizes[k] for k in out)
            at = bisect_right(values, s + room) - 1
            if at >= 0 and values[at] - s > gain:
                gain, best = values[at] - s, (out, choices[at][1])
        if best:
            out, come = best
            bins[c] = [k for k in have if k not in out] + list(come)
            rooms[c] = room - gain
            tried = [k for k in tried if k not in come] + list(out)
            values, choices = sums()
    return tried + rest


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with a few of the best of b's containers injected: the containers of a that held the same items are
    dissolved, and so are a few of its emptiest ones; what they displace is exchanged into better fillings, and the
    rest put in by best fit."""
    fill = np.bincount(b, weights=sizes)
    tried = rng.choice(len(fill), size=min(len(fill), 12), replace=False)
    take = tried[np.argsort(-fill[tried], kind="stable")][: int(rng.integers(1, 5))]
    injected = np.isin(b, take)
    own = np.bincount(a, weights=sizes)
    worst = np.argsort(own + rng.random(len(own)) * capacity * 0.2, kind="stable")[: int(rng.integers(1, 4))]
    broken = np.union1d(np.unique(a[injected]), worst)
    free = np.isin(a, broken) & ~injected
    label = np.where(injected, len(own) + np.searchsorted(np.sort(take), b), a)
    kept = np.flatnonzero(~free)
    names, at = np.unique(label[kept], return_inverse=True)
    order = np.argsort(at, kind="stable")
    bins = [x.tolist() for x in np.split(kept[order], np.cumsum(np.bincount(at, minlength=len(names)))[:-1])] if len(kept) else []
    plain = sizes.tolist()
    rooms = [capacity - sum(plain[k] for k in x) for x in bins]
    left = np.array(exchange(plain, bins, rooms, rng.permutation(np.flatnonzero(free)).tolist(), rng), np.int64)
    child = np.empty(len(sizes), np.int64)
    for c, x in enumerate(bins):
        child[x] = c
    best_fit(sizes, left[np.argsort(-sizes[left], kind="stable")], child, sorted((r, c) for c, r in enumerate(rooms)), capacity, len(bins))
    return _compact(child)


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer: two items above half a container never share one."""
    return max(1, -(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))


def evolve(
    sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, seed: int, made: list[int] | None = None
) -> list[np.ndarray]:
    """The population after some generations, best first. Ends early once the least possible number is reached. made
    gets the number of containers of each child."""
    rng = np.random.default_rng(seed)
    least = least_containers(sizes, capacity)
    while len(population) < POPULATION:
        order = np.argsort(-sizes * (1 + 0.15 * (len(population) > 0) * rng.random(len(sizes))), kind="stable")
        assign = np.empty(len(sizes), np.int64)
        best_fit(sizes, order, assign, [], capacity, 0)
        population.append(_compact(assign))
        if population[-1].max(initial=0) + 1 <= least and len(population) >= ELITES:
            break
    rank = lambda x: (-score(sizes, x, capacity)[0], score(sizes, x, capacity)[1])
    ranked = sorted(((rank(x), i, x) for i, x in enumerate(population)), key=lambda t: (t[0], -t[1]), reverse=True)
    for g in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[i][2], ranked[j][2], sizes, capacity, rng)
        mark = rank(child)
        if made is not None:
            made.append(-mark[0])
        if any(mark == r for r, _, _ in ranked):
            continue  # as good as one that is there, so most likely its copy: copies would fill the population
        ranked.append((mark, POPULATION + g, child))
        ranked.sort(key=lambda t: (t[0], -t[1]), reverse=True)
        ranked = ranked[:POPULATION]
    return [x for _, _, x in ranked]


def _pack_blocks(items: DataFrame, capacity: int, blocks: int, base: str, report: list[dict]) -> DataFrame:
    """items: item bigint, piece int, size int. Returns these with block and bin: the best island's packing of each
    block. report gets a row for each round."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        block, island = int(pdf["block"].iat[0]), int(pdf["island"].iat[0])
        sizes = pdf["size"].to_numpy(np.int64)
        return _row(block, island, pdf["item"].to_numpy(), pdf["piece"].to_numpy(), sizes, [], 1 + block * 1009 + island)

    def _row(block, island, ids, pieces, sizes, start, seed):
        made: list[int] = []
        population = evolve(sizes, start, capacity, GENERATIONS, seed, made)
        used, s = score(sizes, population[0], capacity)
        return pd.DataFrame(
            {
                "block": [block], "island": [island], "ids": [ids], "pieces": [pieces], "sizes": [sizes.astype(np.int32)],
                "elites": [[x.astype(np.int32) for x in population[:ELITES]]], "used": [used], "score": [s],
                "least": [least_containers(sizes, capacity)], "children": [len(made)],
            }
        )

    def migrated(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                start = [np.asarray(x, np.int64) for x in (*r.elites, *r.guests)]
                rows.append(_row(r.block, r.island, np.asarray(r.ids), np.asarray(r.pieces), sizes, start, 7 + r.block * 1013 + r.island))
            if rows:
                yield pd.concat(rows)

    # A group costs time far beyond its few bytes, so the number of tasks is set by groups and not left to the size of
    # their data: at most TASK_GROUPS groups a task.
    spark = items.sparkSession
    tasks = max(min(blocks * ISLANDS, spark.sparkContext.defaultParallelism), -(-blocks * ISLANDS // TASK_GROUPS))
    each = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    spread = each.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).repartition(tasks, "block", "island")
    state = written(spread.groupBy("block", "island").applyInPandas(found, _STATE), f"{base}/round=0")
    for r in range(ROUNDS):
        each_block = state.groupBy("block").agg(F.min("used").alias("used"), F.first("least").alias("least"), F.sum("children").alias("children"))
        seen = each_block.agg(F.count(F.lit(1)), F.sum("used"), F.sum("least"), F.count_if(F.col("used") > F.col("least")), F.sum("children")).first()
        report.append(dict(zip(("round", "blocks", "used", "least", "open_blocks", "children"), (r, *seen), strict=True)))
        if r == ROUNDS - 1 or not seen[3]:
            break  # evolution has nothing left to do in any block, or has had its rounds
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elites").alias("guests"))
        state = written(
            state.join(guests, ["block", "island"]).repartition(tasks, "block", "island").mapInPandas(migrated, _STATE), f"{base}/round={r + 1}"
        )
    best = state.groupBy("block").agg(
        F.max_by(F.struct("ids", "pieces", "sizes", F.col("elites")[0].alias("bins")), F.struct(-F.col("used"), "score", -F.col("island"))).alias("b")
    )
    return best.select("block", F.explode(F.arrays_zip("b.ids", "b.pieces", "b.sizes", "b.bins")).alias("x")).select(
        F.col("x.ids").alias("item"), F.col("x.pieces").alias("piece"), F.col("x.sizes").alias("size"), "block", F.col("x.bins").alias("bin")
    )


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(id, piece, first, size, container) for each piece of each item; sizes has one row an item, with a unique
    whole-numbered id.

    piece counts from 0, first is where the piece starts in the item. Only items larger than capacity have more than
    one piece. container is a name; the sizes of its pieces sum to capacity at most.
    """
    return packed(sizes, id_col, size_col, capacity, block)[0]


def packed(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n", capacity: int = CAPACITY, block: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """The result of pack, and a report of the evolution: for each level and round the blocks, the containers they use
    and need at least, the blocks that use more than that, and the children made."""
    report: list[dict] = []
    spark = sizes.sparkSession
    ship(spark)
    base = shared_path(spark, "packing")
    n = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint")
    all_ = written(sizes.select(F.col(f"`{id_col}`").cast("bigint").alias("item"), n.alias("n")), f"{base}/items")
    if all_.filter("n < 0").limit(1).count():
        raise ValueError("a size is negative")
    whole = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0).cast("int")
    full = all_.filter(F.col("n") > capacity).select(
        "item", F.posexplode(F.sequence(F.lit(1), whole)).alias("piece", "_"), F.lit(capacity).alias("size")
    )
    parts = [
        full.select("item", "piece", "size", F.concat(F.lit("d"), "item", F.lit("-"), "piece").alias("container"))
    ]
    # What is left to place: whole items, and the remainder of a divided one unless it is empty.
    left = all_.select("item", (F.col("n") - whole * capacity).cast("int").alias("size"), whole.alias("piece")).filter(
        (F.col("size") > 0) | (F.col("piece") == 0)
    )
    todo = left.select("item", "piece", "size")
    level = 0
    while count := todo.count():
        blocks = max(1, -(-count // block))
        rounds: list[dict] = []
        best = _pack_blocks(todo, capacity, blocks, f"{base}/level={level}", rounds)
        report += [{"level": level} | r for r in rounds]
        best = best.withColumn("fill", F.sum("size").over(Window.partitionBy("block", "bin")))
        # Within a block, at most some thousand rows: items in containers from the emptiest up, and how many so far.
        rising = Window.partitionBy("block").orderBy("fill", "bin")
        best = best.withColumn("upto", F.count(F.lit(1)).over(rising)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("block")))
        again = (F.col("fill") < FULL * capacity) & (F.col("upto") * 2 <= F.col("all"))
        best = written(best.withColumn("again", again if blocks > 1 else F.lit(False)), f"{base}/packed={level}")
        done = best.filter(~F.col("again"))
        parts.append(done.select("item", "piece", "size", F.concat(F.lit(f"c{level}-"), "block", F.lit("-"), "bin").alias("container")))
        todo = best.filter("again").select("item", "piece", "size")
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        F.col("item").alias(id_col), "piece", (F.col("piece").cast("bigint") * capacity).alias("first"), "size", "container"
    ), report
