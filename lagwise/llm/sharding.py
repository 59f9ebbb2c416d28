"""Sharding: histogram sort over a hash of the text, then one exchange by range.

Documents are ordered by (hash of the text, hash of the id). Splitters between the shards are found by counting exact
bytes: each round deals the keys of the still open key ranges into equal bins, sums the bytes of every bin over all
partitions, and narrows each range to the bin that holds its target. A splitter is done when the bytes below a bin's
edge lie within the tolerance of its target. Edges lie between different texts, so equal texts stay together, unless the
copies of one text hold more than the tolerance: their range is refined further by the hash of the id.

Only bins (at most `fanout` for each open range, with the least and largest key of each) reach the driver. The rows are then
exchanged once, straight to where the splitters put them: a shard is cut into equal pieces of its range of text hashes (of id
hashes for a text that is split), as many as its rows and bytes ask for, and `repartitionById` sends each piece to a partition of
its own, without sampling keys. A row's slot comes from its place in its piece and the rows of the shard's earlier pieces.

Defined results: a null text counts as empty; rows of equal text and id cannot be told apart and stay in one shard; an
empty table gives an empty result; input columns named `shard`, `slot`, `size`, `text_crc32` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import discard, materialise, text_of

TOP = (1 << 63) - 1
ADDED = ("size", "text_crc32", "shard", "slot")


@dataclass
class _Range:
    """Keys lo..hi at a level: level 0 is the text's hash, level 1 the id's hash under one text's hash `h`."""

    lo: int
    hi: int
    below: int  # bytes of all keys before lo
    h: int | None = None
    targets: list[int] = field(default_factory=list)

    def column(self) -> Column:
        return F.col("_h") if self.h is None else F.col("_t")

    def holds(self) -> Column:
        inside = self.column().between(self.lo, self.hi)
        return inside if self.h is None else inside & (F.col("_h") == self.h)


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.02, fanout: int = 1024) -> list[tuple[int, int]]:
    """(a, b) for each boundary: the keys below it are those with _h < a, or with _h = a and _t <= b. `keys` has _h, _t, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = total / n_shards * tolerance
    found: dict[int, tuple[int, int]] = {}
    targets = [total * j // n_shards for j in range(1, n_shards)]
    ranges = [_Range(0, TOP, 0, None, targets)] if total else []
    while ranges:
        which, at = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, r in enumerate(ranges):
            step = (r.hi - r.lo) // fanout + 1
            which = F.when(r.holds(), F.lit(k)).otherwise(which)
            at = F.when(r.holds(), F.expr(f"({'_h' if r.h is None else '_t'} - {r.lo}L) div {step}L")).otherwise(at)
        key = F.coalesce(*[F.when(F.col("_r") == k, r.column()) for k, r in enumerate(ranges)])
        bins = keys.select("_h", "_t", "size", which.alias("_r"), at.alias("_bin")).where("_r is not null").withColumn("_key", key)
        bins = bins.groupBy("_r", "_bin").agg(F.sum("size").alias("size"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        by: dict[int, list] = {}
        for row in bins.collect():
            by.setdefault(row["_r"], []).append(row)
        after: dict[tuple, _Range] = {}
        for k, r in enumerate(ranges):
            edge = lambda key, r=r: (key, TOP) if r.h is None else (r.h, key)
            for target in r.targets:
                below, last = r.below, r.lo - 1
                for row in sorted(by[k], key=lambda x: x["_bin"]):
                    if below + row["size"] >= target:
                        break
                    below, last = below + row["size"], row["hi"]
                over = below + row["size"]
                near = min(target - below, over - target)
                whole = row["lo"] == row["hi"]
                if near <= slack or whole and r.h is not None:
                    found[target] = edge(last) if target - below <= over - target else edge(row["hi"])
                    continue
                new = _Range(0, TOP, below, row["lo"]) if whole else _Range(row["lo"], row["hi"], below, r.h)
                after.setdefault((new.lo, new.hi, new.h), new).targets.append(target)
        ranges = list(after.values())
    return sorted(found[t] for t in targets if t in found)


def shard(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.02, piece_rows: int = 500_000, piece_bytes: int = 256 << 20, carry: bool = True,
) -> DataFrame:
    """The documents (carry: with all their columns; otherwise their ids alone, as doc_id) with size, text_crc32, shard and slot."""
    half = lambda c: F.shiftrightunsigned(c, 1)
    text = text_of(docs[text_col])
    rest = [F.struct(*[docs[c] for c in docs.columns if c not in ADDED]).alias("_row")] if carry else [docs[id_col].alias("doc_id")]
    keyed = docs.select(*rest, (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), half(F.xxhash64(text)).alias("_h"), half(F.xxhash64(docs[id_col])).alias("_t"))
    keys = materialise(keyed if not carry else keyed.drop("_row", "text_crc32"), "keys")
    bounds = splitters(keys, n_shards, tolerance)
    place = F.lit(0)
    for k, (a, b) in enumerate(bounds):
        place = F.when((F.col("_h") < a) | (F.col("_h") == a) & (F.col("_t") <= b), place).otherwise(F.lit(k + 1))
    rows, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    pieces = int(max(1, -(-rows // (n_shards * piece_rows)), -(-(size or 0) // (n_shards * piece_bytes)) if carry else 1))
    moved = (keyed if carry else keys).withColumn("shard", place.cast("int"))
    moved = moved.withColumn("_p", F.col("shard") * pieces + _piece(bounds, pieces)).repartitionById(n_shards * pieces, "_p").sortWithinPartitions("_p", "_h", "_t")
    moved = materialise(moved.withColumn("_i", F.monotonically_increasing_id()), "sharded")
    discard(keys)
    runs = moved.groupBy("_p", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("_p")) - F.col("n")
    # One row for each piece: a piece's share of the rows apart.
    runs = runs.select("_p", "shard", "first", ahead.alias("ahead"))
    out = moved.join(F.broadcast(runs) if n_shards * pieces <= 100_000 else runs, ["_p", "shard"]).withColumn("slot", (F.col("_i") - F.col("first") + F.col("ahead")).cast("long"))
    return out.select("_row.*" if carry else "doc_id", *ADDED)


def _piece(bounds: list[tuple[int, int]], pieces: int) -> Column:
    """Which of its shard's pieces a row falls into."""
    if pieces == 1:
        return F.lit(0)
    low, high = ([0, *(a for a, _ in bounds)], [*(a for a, _ in bounds), TOP])
    at = lambda edges: F.element_at(F.array(*[F.lit(float(x)) for x in edges]), F.col("shard") + 1)
    share = (F.col("_h").cast("double") - at(low)) / F.greatest(at(high) - at(low), F.lit(1.0))
    split = sorted({a for a, b in bounds if b < TOP})
    if split:  # texts whose copies lie on both sides of a boundary
        share = F.when(F.col("_h").isin(*split), F.col("_t").cast("double") / float(TOP)).otherwise(share)
    return F.least(F.greatest(F.floor(share * pieces), F.lit(0)), F.lit(pieces - 1)).cast("int")
