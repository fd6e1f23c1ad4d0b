"""Balanced label propagation over linked documents, in DataFrame functions only.

Documents that share a link (equal text, in the query) are neighbours.  Every document starts in a shard by its hash.
In each round a link's leading shard, among those with room, draws the link's documents there; a shard admits so many
as its quota of linked documents leaves, by a repeatable draw.  A link has one row for each shard that it touches and
documents meet their link's row by (link, shard), so no pairs of neighbours are made and the documents of a large
group spread over the shards' rows.  Rounds go on until nothing moves or agreement has stopped to rise.

A group above a shard's quota first claims as many shards as hold it, those with most of its documents among the free
ones, and its documents are dealt evenly to them.  All other documents start in the shards that are left.

Then the counts are made exact: the rows of a shard are numbered, linked ones first and links together, and those
numbered beyond the shard's quota, unlinked ones wherever there are enough, fill the shards that lack rows.  Numbering
goes by buckets of bounded size and running sums over the buckets' counts.

Law ``rows``: counts differ by one at most.  Slots are gapless from 0 in each shard.

Results: a null text has 0 bytes and the empty text's checksum and is linked with empty texts.  Repeated rows count
one by one.  An empty table gives an empty result.  Only the id and the text column are read, so others can't clash; of
a very long text only its size and hashes go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import HOT, materialize, on_key, unit

SHARDS = 40
#: Rounds without more agreement before propagation stops.
PATIENCE = 3
BUCKET_ROWS = 20_000


def _by_shard(values: dict[int, int | float], shard: Column, default) -> Column:
    """A value for each shard, as an array literal of the number of shards."""
    n = max(values, default=0) + 1
    return F.element_at(F.array(*[F.lit(values.get(k, default)) for k in range(n)]), shard + 1)


def _claims(placed: DataFrame, quota: int, shards: int) -> tuple[dict[int, list[int]], list[int]]:
    """Shards of each link above a quota, largest link first, and the shards that none has claimed."""
    large = placed.groupBy("link").agg(F.count("*").alias("n")).where(F.col("n") > max(1, quota))
    cells = placed.groupBy("link", "shard").agg(F.count("*").alias("c")).join(large, "link").collect()  # shards times as many at most
    size = {r["link"]: r["n"] for r in cells}
    held = {(r["link"], r["shard"]): r["c"] for r in cells}
    claims, free = {}, list(range(shards))
    for link in sorted(size, key=lambda x: (-size[x], x)):
        need = -(-size[link] // max(1, quota))
        mine = sorted(free, key=lambda s: (-held.get((link, s), 0), s))[:need]
        if len(mine) < need:
            continue
        claims[link] = mine
        free = [s for s in free if s not in mine]
    return claims, free


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """node, shard, tied (0 where linked, else 1): ``nodes`` (node) moved towards their neighbours.

    ``links`` (node, link) may have many rows a node; their nodes are of ``nodes``.
    """
    total = nodes.count()
    quota = total // shards
    # A link of one document draws nothing.
    shared = materialize(links.groupBy("link").agg(F.count("*").alias("n")).where("n > 1"), "shard-shared")
    hot = materialize(shared.where(F.col("n") * HOT > links.count()).select("link"), "shard-hot")  # fewer than HOT rows
    tied = materialize(on_key(links.select("node", "link"), shared.select("link"), hot, ["link"]), "shard-links")
    start = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(shards)).cast("int")
    state = nodes.select("node", start.alias("shard"))
    claims, free = _claims(tied.withColumn("shard", start), quota, shards)
    if claims:
        left = F.array(*[F.lit(s) for s in free or range(shards)])
        state = nodes.select("node", F.element_at(left, F.pmod(F.xxhash64("node", F.lit("start")), F.size(left)).cast("int") + 1).alias("shard"))
        named = [f"({link}L, array({', '.join(map(str, mine))}))" for link, mine in claims.items()]
        given = nodes.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(named)} AS t(link, given)")  # not more rows than shards, about
        mine = tied.join(F.broadcast(given), "link").groupBy("node").agg(F.min_by("given", "link").alias("given"))
        mine = mine.select("node", F.element_at("given", F.pmod(F.xxhash64("node", F.lit("deal")), F.size("given")).cast("int") + 1).alias("own"))
        state = state.join(mine, "node", "left").select("node", F.coalesce("own", "shard").alias("shard"))
        dealt = tied.where(F.col("link").isin(list(claims))).select("node").distinct()
    state = materialize(state, "shard-state")
    k, best, since = -1, -1, 0
    while rounds is None or k + 1 < rounds:
        k += 1
        placed = tied.join(state, "node")
        linked = placed.select("node", "shard").distinct().groupBy("shard").count().collect()  # a row a shard
        held = {r["shard"]: r["count"] for r in linked}
        room = {s: max(0, quota - held.get(s, 0)) for s in range(shards)}
        cells = materialize(placed.groupBy("link", "shard").agg(F.count("*").alias("c")), "shard-cells")
        agreed = cells.agg(F.coalesce(F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")), F.lit(0))).first()[0]
        best, since = (agreed, 0) if agreed > best else (best, since + 1)
        if since >= PATIENCE:
            break
        open_ = cells.where((_by_shard(room, F.col("shard"), 0) > 0))
        lead = open_.groupBy("link").agg(F.max(F.struct("c", F.xxhash64("link", "shard"), "shard")).alias("top")).select("link", F.col("top.shard").alias("to"), F.col("top.c").alias("top_c"))
        wish = cells.join(lead, "link").where("to <> shard").withColumn("gain", F.col("top_c") - F.col("c") + 1)
        votes = on_key(placed, wish.select("link", "shard", "to", "gain"), hot, ["link", "shard"])
        moves = votes.groupBy("node").agg(F.max_by("to", F.struct("gain", "to")).alias("to"), F.max_by("link", F.struct("gain", "to")).alias("link"), F.max("gain").alias("gain")).where("gain > 0")
        moves = materialize(moves.join(dealt, "node", "left_anti") if claims else moves, "shard-moves")
        demand = {r["to"]: r["count"] for r in moves.groupBy("to").count().collect()}  # a row a shard
        if not demand:
            break
        share = {s: min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0 for s in range(shards)}
        # The documents of a link draw alike, so that small groups move whole; a link above a tenth of a quota draws by
        # document.  There are ten times as many of those as shards, times the links of a document.
        large = cells.groupBy("link").agg(F.sum("c").alias("n")).where(F.col("n") > max(1, quota // 10)).select("link", F.lit(True).alias("large"))
        drawn = moves.join(F.broadcast(large), "link", "left").withColumn("u", F.when(F.col("large"), unit("node", F.lit(k))).otherwise(unit("link", F.lit(k))))
        taken = drawn.where(F.col("u") < _by_shard(share, F.col("to"), 0.0)).select("node", "to")
        state = materialize(state.join(taken, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "shard-state")
    mark = tied.select("node").distinct().withColumn("tied", F.lit(0))
    return state.join(mark, "node", "left").select("node", "shard", F.coalesce("tied", F.lit(1)).alias("tied"))


def exact_slots(state: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Counts at most one apart, gapless slots: ``state`` has node, link, tied (0 where linked, else 1), shard."""
    held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}  # a row a shard
    total = sum(held.values())
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    buckets = max(1, total // shards // bucket_rows + 1)
    salt = F.when(F.col("c") > bucket_rows, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / bucket_rows))).otherwise(0)
    cells = materialize(state.where("tied = 0").groupBy("link", "shard").agg(F.count("*").alias("c")).where(F.col("c") > min(bucket_rows, max(1, total // HOT))), "shard-large")
    hot = cells.where(F.col("c") * HOT > total).select("link").distinct()  # fewer than HOT rows
    spread = on_key(state, cells, hot, ["link", "shard"], "left").withColumn("bucket", F.struct("tied", F.pmod(F.xxhash64("link"), F.lit(buckets)).alias("h"), F.coalesce(salt, F.lit(0)).cast("long").alias("salt"))).drop("c")
    counts = spread.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("link", "node")) - 1
    numbered = spread.withColumn("number", number).join(starts, ["shard", "bucket"]).withColumn("number", F.col("before") + F.col("number"))

    surplus, lack, at, rules = {}, 0, 0, []
    for s in range(shards):
        surplus[s] = at
        at += max(0, held.get(s, 0) - quota[s])
    over = F.col("number") >= _by_shard(quota, F.col("shard"), 0)
    place = F.col("number") - _by_shard(quota, F.col("shard"), 0) + _by_shard(surplus, F.col("shard"), 0)
    for s in range(shards):
        missing = max(0, quota[s] - held.get(s, 0))
        if missing:
            rules.append((lack + missing, s, held.get(s, 0) - lack))
        lack += missing
    numbered = numbered.withColumn("place", F.when(over, place))
    new_shard = reduce(lambda a, r: a.when(F.col("place") < r[0], r[1]), rules, F.when(F.col("place").isNull(), F.col("shard")))
    new_slot = reduce(lambda a, r: a.when(F.col("place") < r[0], F.col("place") + r[2]), rules, F.when(F.col("place").isNull(), F.col("number")))
    return numbered.select("node", new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    picked = docs.select(
        F.monotonically_increasing_id().alias("node"),  # kept with the row by the table written next
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("link"),
    )
    nodes = materialize(picked, "shard-nodes")
    state = propagate(nodes.select("node"), nodes.select("node", "link"), shards, rounds)
    full = nodes.select("node", "link").join(state, "node")
    placed = exact_slots(materialize(full, "shard-full"), shards, bucket_rows)
    return nodes.join(placed, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
