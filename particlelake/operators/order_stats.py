"""Exact percentiles and average ranks that hold for very large groups.

Small groups use Spark's own ``percentile`` aggregate. A group above the row
limit would keep all its distinct values in one task's buffer, so its percentiles come
from counters of the digits of its values, and its ranks from a range-partitioned table of value
counts: running counts inside each range plus a small table of range totals.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake.runtime import HOT_GROUP_ROWS, any_row, cut_lineage, has_more_rows_than, one_row, quoted

_RANGE = "__range"
# Bits of a double that one pass of counters settles.
DIGIT_BITS = 16
# Counters that a task holds before it passes them on, and targets that have all theirs in one array.
HELD_COUNTERS, DENSE_TARGETS = 1_000_000, 256
# A value held by more than this part of all rows is frequent; there are fewer such values than that.
FREQUENT_PARTS = 4_096
# Rows whose columns are packed together (codes of their values have 16 bits), and values of such a block that suggest ranges.
BLOCK_ROWS, BLOCK_SAMPLE = 16_384, 64
# Tables of no more blocks may come in few partitions and are dealt to all cores first.
SPREAD_BLOCKS = 64
# Rows of a column that one task ranks.
RANGE_ROWS = 1_000_000


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join; keeps the left columns and the right non-key columns."""
    renamed = right.select(
        *[quoted(c).alias(f"__r_{c}") if c in keys else quoted(c) for c in right.columns]
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & quoted(key).eqNullSafe(quoted(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def rank_counts(
    counts: DataFrame, partition: Sequence[str], value: str, carry: Sequence[str] = (), spread: bool = True
) -> DataFrame:
    """Ranks for a table with one row per (partition, value) and its count ``n``.

    With ``spread`` no partition ever sits in one task: the counts are range
    partitioned by (partition, value) and only per-range totals are combined.
    Without it (partitions known to be small) one window does. ``carry`` columns
    pass through. Adds ``rows_below`` and ``avg_rank``.
    """
    keys = list(partition)
    if not spread:
        whole = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(quoted(value))
        below = F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("rows_below", below)
        return placed.select(
            *[quoted(k) for k in keys], quoted(value), "n", *carry, "rows_below",
            (F.col("rows_below") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
        )
    ranged = cut_lineage(
        counts.select(*[quoted(k) for k in keys], quoted(value), "n", *carry)
        .repartitionByRange(*[quoted(k) for k in keys], quoted(value))
        .withColumn(_RANGE, F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*keys, _RANGE)
        .agg(F.sum("n").alias("range_rows"))
        .select(*keys, _RANGE, F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("offset_rows"))
    )
    inside = Window.partitionBy(*keys, _RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local_rows", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    below = F.col("offset_rows") + F.col("local_rows")
    return key_join(local, totals, [*keys, _RANGE]).select(
        *[quoted(k) for k in keys],
        quoted(value),
        "n",
        *carry,
        below.alias("rows_below"),
        (below + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
    )


def has_hot_group(df: DataFrame, keys: Sequence[str], hot_rows: int) -> bool:
    """True if some group (or the whole table, without keys) is above the limit.

    A table below the limit has no such group; only larger ones are grouped.
    """
    if not keys or not has_more_rows_than(df, hot_rows):
        return not keys and has_more_rows_than(df, hot_rows)
    sizes = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows"))
    return any_row(sizes.where(F.col("__rows") > hot_rows))


def ranked_value_counts(
    df: DataFrame, partition: Sequence[str], value: str, hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """One row per (partition, value): ``n``, ``rows_below`` and ``avg_rank``."""
    counts = df.groupBy(*[quoted(k) for k in partition], quoted(value)).agg(F.count(F.lit(1)).alias("n"))
    return rank_counts(counts, partition, value, spread=has_hot_group(df, partition, hot_rows))


def _percentile_parts(name: str, probs: Sequence[float]) -> list[Column]:
    return [F.percentile(quoted(name), F.array(*[F.lit(float(p)) for p in probs])).alias(f"__q_{name}")]


def _unpack(name: str, probs: Sequence[float], labels: Sequence[str]) -> list[Column]:
    return [quoted(f"__q_{name}")[i].alias(label) for i, label in enumerate(labels)]


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one, NaN comes last."""
    plain = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = plain.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _from_ordered_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def _digit_counts(slim: DataFrame, names: Sequence[str], done: int, targets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(target, digit, n): values that share the first ``done`` digits of a target, by their next one.

    A target is (group, column, those digits). Tasks send counters only and pass them on when they hold too many.
    """
    per_column: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    groups = np.array(sorted({g for g, _, _ in targets}), np.int64)
    for column in range(len(names)):
        own = [(np.searchsorted(groups, g), prefix, t) for t, (g, c, prefix) in enumerate(targets) if c == column]
        prefixes = np.array(sorted({prefix for _, prefix, _ in own}), np.uint64)
        coded = sorted((int(g) * len(prefixes) + int(np.searchsorted(prefixes, np.uint64(prefix))), t) for g, prefix, t in own)
        per_column.append((prefixes, np.array([x for x, _ in coded], np.int64), np.array([t for _, t in coded], np.int64)))
    shift = np.uint64(64 - DIGIT_BITS * (done + 1))

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [codes >> DIGIT_BITS, codes & ((1 << DIGIT_BITS) - 1), counts]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["target", "digit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        dense = np.zeros(len(targets) << DIGIT_BITS, np.int32) if len(targets) <= DENSE_TARGETS else None
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            place = np.searchsorted(groups, group).clip(max=len(groups) - 1)
            known = groups[place] == group
            for column, (prefixes, coded, target) in enumerate(per_column):
                if not len(coded):
                    continue
                cells = batch.column(column + 1)
                keep = known & cells.is_valid().to_numpy(zero_copy_only=False)
                bits = _ordered_bits(cells.fill_null(0.0).to_numpy(zero_copy_only=False)[keep])
                at = place[keep] * len(prefixes)
                if done:
                    first = bits >> np.uint64(64 - DIGIT_BITS * done)
                    near = np.searchsorted(prefixes, first).clip(max=len(prefixes) - 1)
                    same = prefixes[near] == first
                    bits, at = bits[same], (at + near)[same]
                slot = np.searchsorted(coded, at).clip(max=len(coded) - 1)
                same = coded[slot] == at
                digit = ((bits[same] >> shift) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64)
                code = (target[slot[same]] << DIGIT_BITS) | digit
                if dense is not None:
                    np.add.at(dense, code, 1)
                else:
                    parts.append(np.unique(code, return_counts=True))
                    held += len(parts[-1][0])
            if held > HELD_COUNTERS:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD_COUNTERS // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if dense is not None:
            used = np.flatnonzero(dense)
            yield rows(used, dense[used])
        elif parts:
            yield rows(*merged(parts))

    return slim.mapInArrow(run, "target long, digit long, n long").groupBy("target", "digit").agg(F.sum("n").alias("n"))


def counted_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]], fixed: bool = False
) -> DataFrame:
    """Exact percentiles of few large groups without moving their rows; one row per key.

    A double is read as four digits of 16 bits. A pass counts, for every wanted place, the values
    by the next digit among those that share the digits found so far, so four passes give the
    value, whatever the spread. All columns share a pass, and tasks send counters only. ``fixed``
    says that the rows are kept already; otherwise they are written once.
    """
    names = list(wanted)
    group = F.lit(0).cast("long").alias("__group")
    values = [quoted(n).cast("double").alias(n) for n in names]
    if keys:
        # as many rows as there are large groups
        known = cut_lineage(df.select(*[quoted(k) for k in keys]).distinct().withColumn("__group", F.monotonically_increasing_id()))
        renamed = known.select(*[quoted(k).alias(f"__s_{k}") for k in keys], "__group")
        same = F.lit(True)
        for k in keys:
            same = same & quoted(k).eqNullSafe(quoted(f"__s_{k}"))
        slim = df.join(F.broadcast(renamed), same).select("__group", *values)
        groups = sorted(r[0] for r in known.select("__group").collect())
    else:
        slim, groups = df.select(group, *values), [0]
    if not fixed:
        slim = cut_lineage(slim)
    targets = [(g, c, 0) for g in groups for c in range(len(names))]
    # few rows, read twice: totals give the wanted ranks
    counts = cut_lineage(_digit_counts(slim, names, 0, targets)) if targets else None
    totals = {} if counts is None else {targets[r["target"]][:2]: r["n"] for r in counts.groupBy("target").agg(F.sum("n").alias("n")).collect()}
    position = {(g, c, label): p * (n - 1) for (g, c), n in totals.items() for label, p in wanted[names[c]].items()}
    # the rank from 1 and, of those that share the digits found so far, the rank that is left
    left = {(g, c, rank): (0, rank) for (g, c, _), x in position.items() for rank in {math.floor(x) + 1, math.ceil(x) + 1}}
    for done in range(64 // DIGIT_BITS):
        if done:
            targets = sorted({(g, c, prefix) for (g, c, _), (prefix, _) in left.items()})
            counts = _digit_counts(slim, names, done, targets) if targets else None
        if not left:
            break
        number = {target: t for t, target in enumerate(targets)}
        places = {(number[g, c, prefix], rank) for (g, c, _), (prefix, rank) in left.items()}
        asked = df.sparkSession.createDataFrame(sorted(places), "target long, rank long")
        upto = F.sum("n").over(Window.partitionBy("target").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        held = counts.withColumn("upto", upto).join(F.broadcast(asked), "target").where("upto >= rank and upto - n < rank")
        found = {(r["target"], r["rank"]): (r["digit"], r["below"]) for r in held.select("target", "rank", "digit", F.expr("upto - n").alias("below")).collect()}
        for place, (prefix, rank) in left.items():
            digit, below = found[number[(*place[:2], prefix)], rank]
            left[place] = (prefix << DIGIT_BITS | digit, rank - below)
    value = {place: _from_ordered_bits(prefix) for place, (prefix, _) in left.items()}
    labels = [(c, label) for c, n in enumerate(names) for label in wanted[n]]
    out = []
    for g in groups:
        row: list = [g]
        for c, label in labels:
            x = position.get((g, c, label))
            if x is None:
                row.append(None)
                continue
            low, high = value[g, c, math.floor(x) + 1], value[g, c, math.ceil(x) + 1]
            row.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
        out.append(tuple(row))
    table = df.sparkSession.createDataFrame(out, ", ".join(["__group long", *[f"`{label}` double" for _, label in labels]]))
    if not keys:
        return table.drop("__group")
    return known.join(F.broadcast(table), "__group").drop("__group")


def aggregate_with_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, Mapping[str, float]],
    aggs: Sequence[Column] = (),
    hot_rows: int = HOT_GROUP_ROWS,
    approx: bool = False,
) -> DataFrame:
    """``groupBy(keys)`` with exact linear percentiles and other aggregates.

    ``wanted`` maps a column to {output name: probability}. One shuffle while no
    group is above ``hot_rows``; values of hot groups are found by counters, which moves none of
    their rows, and are united with the rest. ``approx=True`` uses ``percentile_approx``.
    """
    keys = list(keys)
    key_columns = [quoted(k) for k in keys]

    def plain(source: DataFrame) -> DataFrame:
        parts: list[Column] = []
        outputs: list[Column] = []
        for name, labels in wanted.items():
            probs = list(labels.values())
            if approx:
                parts.append(
                    F.percentile_approx(quoted(name).cast("double"), [float(p) for p in probs]).alias(f"__q_{name}")
                )
            else:
                parts += _percentile_parts(name, probs)
            outputs += _unpack(name, probs, list(labels))
        # A percentile buffer keeps every distinct value, so partial aggregation
        # would ship more than the rows themselves: shuffle the rows once instead.
        placed = source.repartition(*key_columns) if keys and wanted else source
        grouped = placed.groupBy(*key_columns).agg(*parts, *aggs)
        extra = grouped.columns[len(keys) + len(parts):]
        return grouped.select(*key_columns, *outputs, *[quoted(c) for c in extra])

    if approx or not wanted:
        return plain(df)
    if not has_hot_group(df, keys, hot_rows):
        return plain(df)
    hot = None
    if keys:
        hot = df.groupBy(*key_columns).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)

    spread_source = df if hot is None else key_join(df, hot, keys, "left_semi")
    spread = counted_percentiles(spread_source, keys, wanted)
    if aggs:
        algebra = spread_source.groupBy(*key_columns).agg(*aggs)
        extra = algebra.columns[len(keys):]
        if keys:
            spread = key_join(algebra, spread, keys, "left").select(
                *key_columns,
                *[quoted(label) for labels in wanted.values() for label in labels],
                *[quoted(c) for c in extra],
            )
        else:
            found = spread.select(F.struct("*")).scalar()
            spread = algebra.select(
                *[found[label].alias(label) for labels in wanted.values() for label in labels],
                *[quoted(c) for c in extra],
            )
    if hot is None:
        return spread
    rest = key_join(df, hot, keys, "left_anti")
    return plain(rest).unionByName(spread)


def split_frequent(df: DataFrame, ranked: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key is frequent, with the columns of ``ranked(*keys, n, ...)``, and the others.

    At most ``FREQUENT_PARTS`` keys can have more than that part of all rows, so their
    part of ``ranked`` is broadcast, and rows that share a frequent value are never moved.
    """
    total = one_row(ranked.agg(F.sum("n").alias("rows")))["rows"]
    frequent = F.broadcast(ranked.where(F.col("n") * FREQUENT_PARTS > total).withColumn("__met", F.lit(True)))
    looked_up = key_join(df, frequent, keys, "left")
    return looked_up.where("__met").drop("__met"), looked_up.where("__met is null").select(*[quoted(c) for c in df.columns])


def with_ranks(df: DataFrame, ranked: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``ranked(*keys, n, ...)``; only rare values are joined by a shuffle."""
    frequent, rest = split_frequent(df, ranked, keys)
    return frequent.unionByName(key_join(rest, ranked, keys, how)).drop("n")


def average_rank(
    df: DataFrame, value: str, partition: Sequence[str] = (), output: str = "avg_rank", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Each row with its rank among equal partition keys; ties share the mean rank."""
    ranked = cut_lineage(ranked_value_counts(df.where(quoted(value).isNotNull()), partition, value, hot_rows))
    lookup = ranked.select(*partition, value, F.col("n").alias("n"), F.col("avg_rank").alias(output))
    if "n" in df.columns:
        return key_join(df, lookup.drop("n"), [*partition, value], "left")
    return with_ranks(df, lookup, [*partition, value], "left")


def _value_blocks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per block of rows and column: its distinct values in order, their counts, and the code of every row's value.

    Nulls come first, as one value. Blocks are written once, so rows keep their places.
    """
    kinds = ["block long", "dim int", "rows long", "distinct binary", "counts binary", "codes binary", "sample binary"]

    def packed(block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for dim, values in enumerate(columns):
            distinct, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
            wanted = math.ceil(BLOCK_SAMPLE * len(values) / BLOCK_ROWS)
            places = (np.arange(wanted) + 0.5) * len(values) / wanted
            sample = distinct[np.searchsorted(np.cumsum(counts), places)]
            blobs = (distinct, counts.astype(np.int32), codes.astype(np.uint16), sample)
            rows.append((block, dim, len(values), *[x.tobytes() for x in blobs]))
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[k.split()[0] for k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                part = batch.slice(done, BLOCK_ROWS - rows)
                held.append([c.fill_null(-math.inf).to_numpy(zero_copy_only=False) for c in part.columns])
                done, rows = done + part.num_rows, rows + part.num_rows
                if rows == BLOCK_ROWS:
                    yield packed(block, [np.concatenate(x) for x in zip(*held)])
                    block, held, rows = block + 1, [], 0
        if held:
            yield packed(block, [np.concatenate(x) for x in zip(*held)])

    slim = df.select(*[quoted(c).cast("double") for c in names])
    if not has_more_rows_than(df, SPREAD_BLOCKS * BLOCK_ROWS):
        slim = slim.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(slim.mapInArrow(run, ", ".join(kinds)))


def _range_bounds(blocks: DataFrame, ranges: int) -> dict[int, np.ndarray]:
    """Per column the values that start a new range; ranges hold about as many rows each."""

    def run(table: pa.Table) -> pa.Table:
        sample = np.sort(np.concatenate([np.frombuffer(x.as_buffer()) for x in table.column("sample")]))
        cuts = np.unique(sample[len(sample) * np.arange(1, ranges) // ranges])
        return pa.table({"dim": table.column("dim")[:1], "cuts": pa.array([cuts.tobytes()], pa.binary())})

    found = blocks.select("dim", "sample").groupBy("dim").applyInArrow(run, "dim int, cuts binary").collect()
    return {r["dim"]: np.frombuffer(r["cuts"]) for r in found}


def rank_correlations(df: DataFrame, names: Sequence[str], range_rows: int = RANGE_ROWS) -> np.ndarray:
    """Pearson correlations of the average ranks of all columns; those of a constant column are 0.

    Blocks of rows send the distinct values of a column with their counts to the task of their range and get
    ranks back, so neither a cell nor a frequent value is moved by itself. Then a block has the ranks of all
    columns side by side and adds up their products around the mean rank.
    """
    p = len(names)
    blocks = _value_blocks(df, names)
    total = blocks.where("dim = 0").agg(F.sum("rows")).first()[0] or 0
    ranges = math.ceil(total / range_rows)
    bounds = _range_bounds(blocks, ranges) if ranges > 1 else {}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for block, dim, distinct, counts in zip(*[c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)]):
                distinct, counts = np.frombuffer(distinct.as_buffer()), np.frombuffer(counts.as_buffer(), np.int32)
                edges = [0, *np.searchsorted(distinct, bounds.get(dim, distinct[:0])), len(distinct)]
                for part, (a, b) in enumerate(zip(edges, edges[1:])):
                    if a < b:
                        rows.append((block, dim, part, int(counts[a:b].sum()), distinct[a:b].tobytes(), counts[a:b].tobytes()))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            labels = ["block", "dim", "part", "rows", "distinct", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=labels)

    sent = blocks.select("block", "dim", "distinct", "counts").mapInArrow(
        send, "block long, dim int, part int, rows long, distinct binary, counts binary"
    )
    below = dict.fromkeys(((dim, 0) for dim in range(p)), 0)
    if ranges > 1:
        sizes = {(r["dim"], r["part"]): r["n"] for r in sent.groupBy("dim", "part").agg(F.sum("rows").alias("n")).collect()}
        before = dict.fromkeys(range(p), 0)
        for dim, part in sorted(sizes):
            below[dim, part] = before[dim]
            before[dim] += sizes[dim, part]

    def rank(table: pa.Table) -> pa.Table:
        offset = below[table.column("dim")[0].as_py(), table.column("part")[0].as_py()]
        values = [np.frombuffer(x.as_buffer()) for x in table.column("distinct")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("counts")])
        distinct, place = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(place, counts, len(distinct))
        # counts below 2**53 are exact in doubles
        ranks = (offset + np.cumsum(n) - n + (n + 1) / 2.0)[place]
        parts = np.split(ranks, np.cumsum([len(x) for x in values])[:-1])
        return table.select(["block", "dim", "part"]).append_column("ranks", pa.array([x.tobytes() for x in parts], pa.binary()))

    upper = np.triu_indices(p)

    def multiply(codes: pa.Table, ranked: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for dim, part, ranks in zip(ranked.column("dim").to_pylist(), ranked.column("part").to_pylist(), ranked.column("ranks")):
            parts.setdefault(dim, []).append((part, np.frombuffer(ranks.as_buffer())))
        around = [None] * p
        for dim, code in zip(codes.column("dim").to_pylist(), codes.column("codes")):
            ranks = np.concatenate([x for _, x in sorted(parts[dim], key=lambda x: x[0])])
            around[dim] = ranks[np.frombuffer(code.as_buffer(), np.uint16)] - (total + 1) / 2.0
        matrix = np.array(around)
        return pa.table({"a": pa.array(upper[0], pa.int32()), "b": pa.array(upper[1], pa.int32()), "s": pa.array((matrix @ matrix.T)[upper])})

    ranked = sent.groupBy("dim", "part").applyInArrow(rank, "block long, dim int, part int, ranks binary")
    products = (
        blocks.select("block", "dim", "codes").groupBy("block").cogroup(ranked.groupBy("block"))
        .applyInArrow(multiply, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
    )
    matrix = np.zeros((p, p))
    for r in products.collect():
        matrix[r["a"], r["b"]] = matrix[r["b"], r["a"]] = r["s"]
    spread = np.sqrt(matrix.diagonal())
    scale = np.outer(spread, spread)
    matrix = np.divide(matrix, scale, out=np.zeros((p, p)), where=scale > 0)
    np.fill_diagonal(matrix, 1.0)
    return matrix
