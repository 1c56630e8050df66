"""Connected components, and components of links that hide in buckets of candidates.

``connected_components`` has each task find the components of its own links, which leaves a row for each id, and one task
those of all rows, as they stream in. Beyond FOREST_ROWS of them it alternates large-star and small-star over the rows until
they stay as they are. Minima are summed up before the shuffle; a node with very many neighbours is joined by Spark's
skewed-join handling.
``merged_components`` adds links to components that are known, beyond FOREST_ROWS by their least members alone.

``bucket_components`` gets buckets (key, id) whose members may be linked and a function that verifies pairs. It finds the
components of all links inside buckets without making all pairs of a bucket: links between members that are connected
already can't change a component, so

1. in each star round, one member of each bucket meets all members of other components: first the hub, which meets most
   documents in all, then another one of the bucket's largest component;
2. buckets whose members are in one component are done. In what remains, members outside the bucket's largest component
   meet all members of other components in blocks, which test pairs on the members' payloads before any is made a row.
   Blocks bound what a task holds, whatever the size of the bucket.
So the result is the same as with all pairs of each bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shortest_paths import _least_reachable
from .common import gathered, in_batches, materialize, narrow, release, stored

STAR_ROUNDS = 2
#: Members, and bytes of payloads, of a block.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
#: Pairs that are compared at a time, if blocks are smaller than that.
PAIRS = 1 << 19
#: Rows that one task makes components of (some 100 bytes each), and rows that it takes in at a time.
FOREST_ROWS, FOREST_CHUNK = 8_000_000, 1 << 20


def _minima(edges: DataFrame) -> DataFrame:
    """edges: (u, v). (u, m): the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _minima(down)
    linked = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(mins.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _forest(edges: DataFrame, roots: bool = False) -> DataFrame:
    """(u, v) of the ids u of the edges (u, v) in each partition, v being the least id reachable over them; without those that
    are least themselves, unless roots."""

    def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*held))
        known, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = known[_least_reachable(place[: len(u)], place[len(u) :], len(known))]
        return known, root

    def forest(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(np.asarray(x) for x in batch.columns))
            n += batch.num_rows
            if n >= FOREST_CHUNK:
                known, root = joined(held)
                held, n = [(known[root < known], root[root < known])], 0
        if held:
            known, root = joined(held)
            which = slice(None) if roots else root < known
            yield pa.RecordBatch.from_arrays([pa.array(known[which]), pa.array(root[which])], ["u", "v"])

    return edges.mapInArrow(forest, "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b). (id, component) of all ids in links; component is the least id reachable."""
    edges = stored(_forest(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v")), "edges")
    if edges.count() <= FOREST_ROWS:
        return _forest(edges.coalesce(1), roots=True).select(F.col("u").alias("id"), F.col("v").alias("component"))
    last = None
    while (now := _sign(edges)) != last:
        last, before = now, edges
        edges = stored(small_star(large_star(gathered(edges))), "edges")
        release(before)
    edges = gathered(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged_components(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after links (a, b) join known components; links and known are materialized."""
    if known is None:
        return connected_components(links)
    if links.count() + known.count() <= FOREST_ROWS:
        return connected_components(links.select("a", "b").unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    links, known = gathered(links), gathered(known)
    held = narrow(known)
    told = links.join(held.select(F.col("id").alias("a"), F.col("component").alias("p")), "a", "left").join(held.select(F.col("id").alias("b"), F.col("component").alias("q")), "b", "left")
    told = gathered(stored(told.select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q")), "roots"))
    roots = stored(connected_components(told.select(F.col("p").alias("a"), F.col("q").alias("b"))), "joined")
    ends = told.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("p").alias("root")), F.struct(F.col("b").alias("id"), F.col("q").alias("root")))).alias("e")).select("e.*")
    # A link's ends come with one root whatever link names them, so equal rows are the same id.
    ids = known.select("id", F.col("component").alias("root")).unionByName(ends).distinct()
    now = narrow(roots.select(F.col("id").alias("root"), "component"))
    return ids.join(now, "root", "left").select("id", F.coalesce("component", "root").alias("component"))


def _with_component(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """members (id, ...) with comp; an id without links is its own component."""
    if components is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(narrow(components), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that have several components, with main, the component that most members are in, and bucket_size."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    several = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("bucket_size"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main")).filter("comps > 1")
    return members.join(several.drop("comps"), "key")


def _blocks(members: DataFrame, payloads: DataFrame, match: Callable) -> DataFrame:
    """Pairs (a, b) of different components of a bucket that match finds. payloads: materialized (id, payload).

    A task gets many blocks, one after another, and compares small ones together. Members are dealt out by their numbers;
    payloads, which may be whole texts, join them last.
    """
    side = F.when(F.col("comp") == F.col("main"), F.lit(0)).otherwise(F.lit(1))
    sized = members.select("key", "id", "comp", side.alias("side"), "bucket_size").join(payloads.select("id", F.length("payload").alias("length")), "id")
    sized = gathered(stored(sized, "sized"))
    n = F.greatest(F.ceil(F.col("bucket_size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    base = sized.join(sized.groupBy("key").agg(F.sum("length").alias("bytes")), "key").withColumn("n", n)
    base = base.select("key", "id", "comp", "side", "n", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block"))
    # A member outside main stands in its own row of blocks as one of some, and every member in each used row as one of all.
    rows = base.filter("side = 1").select("key", "id", "comp", F.col("block").alias("r"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"), F.lit(0).alias("what"))
    used = base.filter("side = 1").groupBy("key").agg(F.collect_set("block").alias("used"))
    cols = base.join(used, "key").select("key", "id", "comp", F.explode("used").alias("r"), F.col("block").alias("c"), F.lit(1).alias("what"))

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        """Of whole blocks, in which members that are one of some stand first."""
        ids, comps, keys, what = (np.asarray(table.column(c)) for c in ("id", "comp", "key", "what"))
        starts = _run_starts(table)
        ends = np.append(starts[1:], len(ids))
        some = np.add.reduceat(1 - what.astype(np.int64), starts)
        all_ = ends - starts - some
        payload = table.column("payload").to_pylist()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto = np.cumsum(some * all_)
        since = 0
        while since < len(starts):
            until = max(since + 1, int(np.searchsorted(upto, (upto[since - 1] if since else 0) + PAIRS, "right")))
            now = slice(since, until)
            i = np.repeat(_counted(starts[now], some[now]), np.repeat(all_[now], some[now]))
            j = _counted(np.repeat(starts[now] + some[now], some[now]), np.repeat(all_[now], some[now]))
            apart = comps[i] != comps[j]
            i, j = i[apart], j[apart]
            kept = match(payload, i, j, keys[i])
            a.append(ids[i[kept]]), b.append(ids[j[kept]])
            since = until
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            last = int(_run_starts(table)[-1])  # its block may go on in the next batch
            if last:
                yield pairs_of(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield pairs_of(held.combine_chunks())

    # The number is given, as comparing takes more than its bytes tell.
    n_tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(cols).join(narrow(payloads), "id").repartition(n_tasks, "key", "r", "c").sortWithinPartitions("key", "r", "c", "what")
    return in_batches(dealt.select("key", "r", "c", "what", "id", "comp", "payload")).mapInArrow(compare, "a long, b long").distinct()


def _run_starts(table: pa.Table) -> np.ndarray:
    """Where blocks start in rows sorted by them; there is a row at least."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for c in ("key", "r", "c"):
        x = np.asarray(table.column(c))
        changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed)


def _counted(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, so many as its size says."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of buckets (key, id, ...) whose key several rows have. Only keys and counts are shuffled, unless the keys
    that are shared are too many to be broadcast."""
    held = narrow(stored(buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "held"))
    return buckets.join(held, "key", "left_semi")


def bucket_components(members: DataFrame, payloads: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], match: Callable, exact_match: bool, possible: Callable[[Column, Column], Column] | None = None, rounds: int = STAR_ROUNDS) -> DataFrame:
    """(id, component) of ids with links; materialized. members: materialized distinct (key, id) of shared buckets, with
    further columns that possible reads.

    possible gets two members as structs and says whether they may be linked. verify takes materialized pairs (a, b),
    a < b, and returns those linked. payloads takes (id) and returns (id, payload), in bytes; match takes payloads,
    two arrays of indices into them, the pairs, and the pairs' buckets' keys, and returns which pairs are linked if
    exact_match, else which may be, for verify to decide. It may leave out a pair in all but one of the buckets that both
    are in.
    """
    # The hub is the member that meets most others; in a group of near copies that is the one closest to all.
    members = gathered(members)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    met = stored(members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("met")), "met")
    more = [c for c in members.columns if c != "key"]
    components = None
    for i in range(rounds + 1):
        held = None
        if components is None and i < rounds:
            # At first each member is a component of its own, so all buckets are open.
            now = _with_component(members, None)
        else:
            # Only star rounds read the further columns.
            own = members if i < rounds else members.select("key", "id")
            held = stored(_open_buckets(_with_component(own, components)), "open-members")
            if held.isEmpty():
                release(held)
                break
            now = gathered(held)
        if i < rounds:
            rank = F.struct("met", -F.col("id")) if i == 0 else F.struct(F.xxhash64("id", F.lit(i)))
            pivots = now.filter("comp = main") if i else now.join(narrow(met), "id")
            chosen = pivots.groupBy("key").agg(F.max_by(F.struct(*more, "comp"), rank).alias("pivot"))
            pairs = now.join(chosen, "key").filter("comp <> pivot.comp")
            if possible is not None:
                pairs = pairs.filter(possible(F.struct(*more), F.col("pivot")))
            pairs = stored(pairs.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct(), "pairs")
            found = verify(gathered(pairs))
        else:
            asked = stored(now.select("id").distinct(), "asked")
            pairs = None
            found = _blocks(now, materialize(payloads(asked), "payloads"), match)
            if not exact_match:
                pairs = stored(found, "pairs")
                found = verify(gathered(pairs))
        found = stored(found.select("a", "b"), "links")
        release(held, pairs)
        last, components = components, stored(merged_components(components, found), "components")
        release(last, found)
    release(met)
    return components if components is not None else members.sparkSession.createDataFrame([], "id long, component long")
