"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so that the leading
dimensions carry most of every product. Rows of a label are cut into blocks
along the first axis; only pairs of blocks (tiles) that lie near enough there
are compared. Inside a tile the products of the leading dimensions come first;
the rest is bounded by the product of the suffix norms, and a pair stops as soon
as its cosine can't reach the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, map_batches, settle
from .components import components, star_forest


@dataclass(frozen=True)
class TileRules:
    """``rows`` is the size a block has while a label has at most ``blocks`` of them; larger labels
    get larger blocks of up to ``block_bytes`` of components, then more blocks. A vector that occurs
    ``hot`` times has its result joined by salted keys."""

    threshold: float = 0.98
    rows: int = 1024
    block_bytes: int = 16 << 20
    blocks: int = 64
    stages: tuple[float, ...] = (0.25, 0.5)
    strip: int = 512
    hot: int = 1000
    salts: int = 16


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors of ``width`` dimensions; shorter ones count as ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares stay finite
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """(width, width) orthonormal axes of all rows' unit vectors, by falling variance.

    Each task sends the sums of its products, which are added by cell: what
    reaches the driver depends on the width alone.
    """

    def run(batches):
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0), width)
                total[:-1] += x.T @ x
                total[-1] += x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "x": total.ravel()})

    cells = arrow_map(rows.select("embedding"), run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width + 1) * width)
    for r in cells:
        total[r.cell] = r.x
    total = total.reshape(width + 1, width)
    n = max(1.0, np.trace(total[:-1]))  # unit vectors: the trace counts them
    mean = total[-1] / n
    values, axes = np.linalg.eigh(total[:-1] / n - np.outer(mean, mean))
    return axes[:, np.argsort(values)[::-1]]


def linked(a: np.ndarray, b: np.ndarray, rules: TileRules, plain_a: np.ndarray, plain_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs with a cosine of the threshold or more.

    ``a`` and ``b`` are rotated unit vectors; pairs within rounding of the
    threshold are decided on the vectors as given.
    """
    width = a.shape[1]
    ends = sorted({max(1, int(width * s)) for s in rules.stages})
    least = rules.threshold - 1e-9
    tail = lambda x, k: np.sqrt(np.maximum(0, (x[:, k:] ** 2).sum(axis=1)))
    k = ends[0]
    near = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(near + np.outer(tail(a, k), tail(b, k)) >= least)
    if not len(i):
        return i, j
    if len(i) * 8 > near.size:  # most pairs go on: whole products are cheaper
        near = a @ b.T
        i, j = np.nonzero(near >= least)
        value = near[i, j]
    else:
        value = near[i, j]
        for end in [*ends[1:], width]:
            value = value + np.einsum("ij,ij->i", a[i, k:end], b[j, k:end])
            go = value + (tail(a, end)[i] * tail(b, end)[j] if end < width else 0.0) >= least
            i, j, value, k = i[go], j[go], value[go], end
    close = np.flatnonzero(value < rules.threshold + 1e-9)
    if len(close):
        keep = np.ones(len(i), bool)
        keep[close] = np.einsum("ij,ij->i", plain_a[i[close]], plain_b[j[close]]) >= rules.threshold
        i, j = i[keep], j[keep]
    return i, j


def _compare(table: pa.Table, axes: np.ndarray, rules: TileRules) -> pa.Table:
    """One tile: the links of its rows, as counts for each row and a spanning forest."""
    side = table.column("right").to_numpy()
    ids, often = table.column("rep").to_numpy(), table.column("often").to_numpy()
    plain = _unit(table.column("embedding"), len(axes))
    turned = plain @ axes
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    within = not len(right)
    right = left if within else right
    degree = np.zeros(len(ids), np.int64)
    forest_v, forest_u = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in range(0, len(left), rules.strip):
        for y in range(x if within else 0, len(right), rules.strip):
            p, q = left[x : x + rules.strip], right[y : y + rules.strip]
            i, j = linked(turned[p], turned[q], rules, plain[p], plain[q])
            if within and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(degree, p[i], often[q[j]])
                np.add.at(degree, q[j], often[p[i]])
                v, u = star_forest(ids[p[i]], ids[q[j]])
                forest_v, forest_u = star_forest(np.concatenate([forest_v, v]), np.concatenate([forest_u, u]))
    some = np.flatnonzero(degree)
    return pa.table({"v": np.concatenate([ids[some], forest_v]), "u": pa.array(np.concatenate([degree[some], forest_u])), "is_link": np.concatenate([np.zeros(len(some), bool), np.ones(len(forest_v), bool)])})


def near_vectors(vectors: DataFrame, rules: TileRules = TileRules()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Only rows of equal, non-null labels are compared. A vector that is null,
    empty, zero or holds a null or a non-finite number links with nothing.
    Equal vectors of a label are compared once and counted as often as they
    occur; rows that repeat a vec_id count as vectors of their own. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    reps = settle(rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("often")), "reps")
    width = reps.agg(F.max(F.size("embedding"))).first()[0] or 1
    axes = principal_axes(reps, width)

    def project():
        return lambda batch: iter([pa.RecordBatch.from_arrays([*batch.columns, pa.array(_unit(batch.column(1), width) @ axes[:, 0])], [*batch.schema.names, "first"])])

    label_type = reps.schema["label"].dataType.simpleString()
    placed = settle(map_batches(reps, project, f"label {label_type}, embedding array<double>, rep long, often long, first double"), "placed")
    forget(reps)
    most = placed.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    most_rows = max(1, rules.block_bytes // (8 * width))
    rows_each = min(rules.rows, most_rows)
    n_blocks = lambda n: F.greatest(F.least(F.ceil(n / rows_each), F.lit(rules.blocks)), F.ceil(n / most_rows)).cast("int")
    grain = max(min(-(-most // rows_each), rules.blocks), -(-most // most_rows))
    steps = [k / grain for k in range(1, grain)] or [0.5]
    cuts = placed.groupBy("label").agg(n_blocks(F.count("*")).alias("m"), F.percentile_approx("first", steps, 10_000).alias("q"))
    cuts = cuts.select("label", F.when(F.col("m") > 1, F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.element_at("q", F.greatest(F.lit(1), F.round(k * F.lit(grain) / F.col("m"))).cast("int")))).otherwise(F.array().cast("array<double>")).alias("cut"))
    blocks = placed.join(cuts, "label").withColumn("block", F.size(F.filter("cut", lambda c: c < F.col("first")))).drop("cut")
    spread = blocks.groupBy("label", "block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    gap = float(np.sqrt(max(0.0, 2 - 2 * rules.threshold))) + 1e-9  # unit vectors that link lie this near in every coordinate
    one, two = (spread.select("label", *[F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi")]) for k in (1, 2))
    tiles = settle(one.join(two, "label").where((F.col("block1") <= F.col("block2")) & (F.col("lo2") - F.col("hi1") <= gap)).select("label", "block1", "block2"), "tiles")
    here = blocks.select("label", "block", "rep", "often", "embedding")
    first = here.join(tiles.withColumnRenamed("block1", "block"), ["label", "block"]).select("label", F.col("block").alias("one"), F.col("block2").alias("two"), "rep", "often", "embedding", F.lit(False).alias("right"))
    second = here.join(tiles.where("block1 <> block2").withColumnRenamed("block2", "block"), ["label", "block"]).select("label", F.col("block1").alias("one"), F.col("block").alias("two"), "rep", "often", "embedding", F.lit(True).alias("right"))
    found = settle(first.union(second).groupBy("label", "one", "two").applyInArrow(lambda t: _compare(t, axes, rules), "v long, u long, is_link boolean"), "found")
    degree = found.where("not is_link").groupBy(F.col("v").alias("rep")).agg(F.sum("u").alias("degree"))
    comps = components(found.where("is_link").select("v", "u"))
    result = placed.select("label", "embedding", "rep", "often").join(degree, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    result = settle(result.where("often > 1 or degree is not null or root is not null").select("label", "embedding", "often", (F.coalesce("degree", F.lit(0)) + F.col("often") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "result")
    apart = F.array(F.coalesce("vec_id", F.monotonically_increasing_id()).cast("double"))  # a key of their own for rows that match nothing
    out = rows.select("vec_id", F.when(F.col("valid"), F.col("label")).alias("label"), F.when(F.col("valid"), F.col("embedding")).otherwise(apart).alias("embedding"))
    hot = result.where(F.col("often") >= rules.hot).drop("often")
    if hot.isEmpty():
        out = out.join(result.drop("often"), ["label", "embedding"], "left")
    else:  # copies of one vector meet its result in salted parts; their keys then match nothing and lie apart
        parts = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1)))).withColumnsRenamed({"n_links": "hot_links", "component_id": "hot_component"})
        out = out.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(rules.salts)).cast("int")).join(parts, ["label", "embedding", "salt"], "left").drop("salt")
        done = F.col("hot_links").isNotNull()
        out = out.withColumns({"label": F.when(~done, F.col("label")), "embedding": F.when(done, apart).otherwise(F.col("embedding"))})
        out = out.join(result.where(F.col("often") < rules.hot).drop("often"), ["label", "embedding"], "left")
        out = out.withColumns({"n_links": F.coalesce("hot_links", "n_links"), "component_id": F.coalesce("hot_component", "component_id")})
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
