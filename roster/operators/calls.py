"""Matching VoIP call records with dialler records by phone and time."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.functions.dates import wall_micros
from roster.functions.ids import phone, phone_no_ddi
from roster.functions.numbers import decimal_br, parse_decimal, tariff
from roster.functions.text import column
from roster.operators.lists import drop_listed
from roster.operators.order import number_rows
from roster.operators.pairing import DIALER, OUTPUT, POINT, VOIP, pair_partition
from roster.session import cut_lineage

TOLERANCE_SECONDS = 90  # fixed value: default match window


def _points(calls: DataFrame, number: Column, ts: str, row: str, side: int) -> DataFrame:
    return calls.select(
        number.alias("phone"),
        wall_micros(ts).alias("ts"),
        F.lit(side).cast("bigint").alias("side"),
        column(row).cast("bigint").alias("row"),
    ).where((F.col("phone") != "") & F.col("ts").isNotNull())


def _settle_instants(
    points: DataFrame, instants: DataFrame, tolerance: int
) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows left) of instants (phone, ts) whose rows are in several tasks.

    Rows of the same phone and instant are always paired first with first, second with second, and
    so on. Ranks come from consecutive row numbers, so no task holds a whole instant, and the join
    by rank has unique keys. What is left at such an instant is of one side; its rows go in order,
    so of those only as many can ever be paired as there are rows of the other side in reach.
    """
    spot = ["phone", "ts"]
    numbered = number_rows(points.join(F.broadcast(instants), spot), [*spot, "side", "row"], "_n")
    sides = numbered.groupBy(*spot, "side").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))

    def size(side: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col("_size"))), F.lit(0))

    equal = sides.groupBy(*spot).agg(F.least(size(VOIP), size(DIALER)).alias("_equal"))
    near = instants.select(F.col("phone").alias("_phone"), F.col("ts").alias("_ts"))
    apart = F.abs(F.col("ts") - F.col("_ts"))
    reach = (
        points.join(F.broadcast(near), (F.col("phone") == F.col("_phone")) & (apart <= tolerance) & (apart > 0))
        .groupBy("phone", F.col("_ts").alias("ts"), (1 - F.col("side")).alias("side"))
        .agg(F.count(F.lit(1)).alias("_reach"))
    )
    # one row per instant and side
    limits = cut_lineage(sides.join(equal, spot).join(reach, [*spot, "side"], "left"))
    ranked = numbered.join(F.broadcast(limits), [*spot, "side"]).withColumn("_rank", F.col("_n") - F.col("_first"))
    level = ranked.where(F.col("_rank") < F.col("_equal"))
    pairs = (
        level.where(F.col("side") == VOIP).select(*spot, "_rank", F.col("row").alias("voip_row"))
        .join(level.where(F.col("side") == DIALER).select(*spot, "_rank", F.col("row").alias("dialer_row")), [*spot, "_rank"])
        .select("voip_row", "dialer_row", F.lit(0).cast("bigint").alias("distance"))
    )
    last = F.col("_equal") + F.coalesce(F.col("_reach"), F.lit(0))
    rest = ranked.where((F.col("_rank") >= F.col("_equal")) & (F.col("_rank") < last))
    return pairs, rest.select(*POINT)


def match_points(points: DataFrame, tolerance: int, tasks: int | None = None) -> DataFrame:
    """Closest-first 1:1 pairs of points (phone, ts in microseconds, side, row).

    Points are range-partitioned by all their columns, so neither a phone nor an instant with much of the
    data is in one task. The closest free pair is always made of neighbours in time order, so a task needs
    no list of all pairs: it makes, by passes over its sorted rows, every pair that rows of neighbouring
    partitions cannot take away. Instants that a cut goes through are settled by rank. Rows that depend on a neighbour
    partition are kept for the next round, where the few that are left are cut elsewhere, into at most half as many tasks.
    The driver sees the first and the last instant of each task. Sorted points and each round are kept in
    the checkpoint folder, since range bounds come from a sample and must not be drawn twice. The result
    is the one of a single closest-first pass over all pairs ordered by (distance, voip row,
    dialler row). ``tasks``: partitions of the first round, by default those of the session.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in OUTPUT.items())
    # points may be dear to compute, and a range exchange reads its input twice
    made, left = [], cut_lineage(points.select(*POINT))
    per_task = None
    while True:
        cuts = left.repartitionByRange(*POINT) if tasks is None else left.repartitionByRange(tasks, *POINT)
        placed = cut_lineage(cuts.sortWithinPartitions(*POINT).withColumn("part", F.spark_partition_id()))
        spot = F.struct("phone", "ts")
        ends = placed.groupBy("part").agg(
            F.min(spot).alias("first"), F.max(spot).alias("last"), F.count(F.lit(1)).alias("rows")
        ).orderBy("part").collect()  # one row a task
        if not ends:
            break
        rows = sum(e["rows"] for e in ends)
        per_task = per_task or -(-rows // len(ends))
        edges, settled = {}, set()
        for n, end in enumerate(ends):
            before = tuple(ends[n - 1]["last"]) if n else None
            after = tuple(ends[n + 1]["first"]) if n + 1 < len(ends) else None
            edges[end["part"]] = (before, after)
            if before == tuple(end["first"]):
                settled.add(before)
        solve = partial(pair_partition, tolerance=tolerance, edges=edges, settled=settled)
        solved = cut_lineage(placed.mapInPandas(solve, schema))
        made.append(solved.where(F.col("voip_row").isNotNull()).select("voip_row", "dialer_row", "distance"))
        left = solved.where(F.col("row").isNotNull()).select(*POINT)
        if settled:
            instants = points.sparkSession.createDataFrame(list(settled), "phone string, ts bigint")
            pairs, rest = _settle_instants(placed, instants, tolerance)
            made.append(pairs)
            left = left.unionByName(cut_lineage(rest))
        if len(ends) == 1:
            break
        still = left.count()
        if still == 0:
            break
        tasks = max(1, min(len(ends) // 2, -(-still // per_task)))
    return reduce(DataFrame.unionByName, made) if made else points.select(
        F.col("row").alias("voip_row"), F.col("row").alias("dialer_row"), F.col("ts").alias("distance")
    ).limit(0)


def match_calls(
    voip: DataFrame,
    dialer: DataFrame,
    voip_phone: str,
    voip_ts: str,
    voip_row: str,
    dialer_phone: str,
    dialer_ts: str,
    dialer_row: str,
    tolerance_seconds: int = TOLERANCE_SECONDS,
) -> DataFrame:
    """1:1 pairs of calls with the same phone at most ``tolerance_seconds`` apart.

    Columns ``voip_row, dialer_row, distance`` (microseconds). Timestamps are wall-clock times;
    ``*_row`` are unique whole numbers in file order. Blank phones and missing times never match.
    """
    points = _points(voip, phone_no_ddi(voip_phone), voip_ts, voip_row, VOIP).unionByName(
        _points(dialer, phone(dialer_phone, null_as_blank=True), dialer_ts, dialer_row, DIALER)
    )
    return match_points(points, tolerance_seconds * 1_000_000)


def _paired(voip: DataFrame, dialer: DataFrame, pairs: DataFrame, voip_row: str, dialer_row: str, *columns: Column) -> DataFrame:
    """All voip rows with columns of their dialler row and the flag ``_matched``.

    Both joins are on unique row numbers, so no key is hot.
    """
    partner = pairs.select("voip_row", "dialer_row").join(
        dialer.select(column(dialer_row).cast("bigint").alias("_drow"), *columns),
        F.col("dialer_row") == F.col("_drow"),
    )
    joined = voip.join(partner, column(voip_row).cast("bigint") == F.col("voip_row"), "left")
    return joined.withColumn("_matched", F.col("voip_row").isNotNull())


def merge_matched_calls(
    voip: DataFrame,
    dialer: DataFrame,
    pairs: DataFrame,
    voip_phone: str,
    dialer_phone: str,
    price: str,
    voip_row: str,
    dialer_row: str,
) -> DataFrame:
    """All voip rows, with the dialler columns of their partner (empty text without one).

    The phone is the normalised one and the price is text with a decimal comma. A name on both
    sides comes out as ``name_voip`` and ``name_discador``; then the dialler-only columns by name.
    Row-number columns are helpers and left out.
    """
    own = [c for c in voip.columns if c != voip_row]
    other = [c for c in dialer.columns if c != dialer_row]
    clash = sorted((set(own) & set(other)) - {voip_phone, dialer_phone})
    only = sorted(set(other) - set(own) - {dialer_phone})
    taken = [F.coalesce(column(c).cast("string"), F.lit("")).alias(f"_d{i}") for i, c in enumerate([*clash, *only])]
    joined = _paired(voip, dialer, pairs, voip_row, dialer_row, *taken)

    def shown(name: str) -> Column:
        if name == voip_phone:
            return phone_no_ddi(name).alias(name)
        value = decimal_br(name) if name == price else column(name)
        return value.alias(f"{name}_voip" if name in clash else name)

    names = [*[f"{c}_discador" for c in clash], *only]
    return joined.select(
        *[shown(c) for c in own],
        *[F.coalesce(F.col(f"_d{i}"), F.lit("")).alias(n) for i, n in enumerate(names)],
    )


def calls_absent(
    dialer: DataFrame, voip: DataFrame, dialer_phone: str, voip_phone: str
) -> DataFrame:
    """Dialler rows with a phone that no voip row has."""
    number = phone(dialer_phone, null_as_blank=True)
    return drop_listed(dialer.where(number != ""), [number], voip, [phone_no_ddi(voip_phone)])


def call_report(
    voip: DataFrame,
    dialer: DataFrame,
    pairs: DataFrame,
    voip_ts: str,
    price: str,
    voip_seconds: str,
    dialer_seconds: str,
    voip_row: str,
    dialer_row: str,
) -> DataFrame:
    """Totals of all, unmatched and matched voip rows; a sum of nothing is null.

    Amounts are added as exact decimals, so the totals do not depend on the order of the rows.
    """
    joined = _paired(
        voip, dialer, pairs, voip_row, dialer_row, parse_decimal(dialer_seconds).alias("_dialed")
    ).select(
        "_matched",
        column(voip_ts).alias("_ts"),
        exact(parse_decimal(price)).alias("_price"),
        exact(parse_decimal(voip_seconds)).alias("_spoken"),
        exact(F.col("_dialed")).alias("_dialed"),
    )
    cohorts = {"all": F.lit(True), "unmatched": ~F.col("_matched"), "matched": F.col("_matched")}

    def totals(where: Column) -> list[Column]:
        def pick(name: str) -> Column:
            return F.when(where, F.col(name))

        return [
            F.count_if(where).alias("calls"),
            F.sum(pick("_price")).cast("double").alias("price"),
            F.min(pick("_ts")).alias("first_ts"),
            F.max(pick("_ts")).alias("last_ts"),
            F.sum(pick("_spoken")).cast("double").alias("voip_seconds"),
            F.sum(pick("_dialed")).cast("double").alias("dialer_seconds"),
        ]

    wide = joined.agg(*[F.struct(*totals(where)).alias(name) for name, where in cohorts.items()])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("cohort"), F.col(n).alias("t")) for n in cohorts]))
    ).select("cohort", "t.*")


def exact(amount: Column) -> Column:
    """Amount as decimal; sums of it are the same in any order."""
    return amount.try_cast("decimal(28,9)")


def absent_report(dialer_absent: DataFrame, dialer_phone: str, ts: str, seconds: str) -> DataFrame:
    """Rows, phones, time range, bad times, seconds, estimated charge, charged and free rows."""
    spent = parse_decimal(seconds)
    charged = F.count_if(F.coalesce(spent >= 1, F.lit(False)))
    number = phone(dialer_phone, null_as_blank=True)
    rows = dialer_absent.groupBy(number.alias("_phone")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(column(ts)).alias("_first"),
        F.max(column(ts)).alias("_last"),
        F.count_if(column(ts).isNull()).alias("_bad"),
        F.sum(exact(spent)).alias("_seconds"),
        F.sum(exact(tariff(spent))).alias("_charge"),
        charged.alias("_charged"),
    )
    total = F.coalesce(F.sum("_rows"), F.lit(0))
    paid = F.coalesce(F.sum("_charged"), F.lit(0))
    return rows.agg(
        total.alias("rows"),
        F.count(F.lit(1)).alias("phones"),
        F.min("_first").alias("first_ts"),
        F.max("_last").alias("last_ts"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_ts"),
        F.sum("_seconds").cast("double").alias("seconds"),
        F.sum("_charge").cast("double").alias("charge"),
        paid.alias("charged_rows"),
        (total - paid).alias("free_rows"),
    )
