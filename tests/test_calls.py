import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roster.operators import calls
from roster.operators.pairing import pair_partition


def closest_first(points, tolerance):
    """All pairs in order of (distance, voip row, dialler row); each row once."""
    voip = [p for p in points if p[2] == 0]
    dialer = [p for p in points if p[2] == 1]
    pairs = sorted(
        (abs(a[1] - b[1]), a[3], b[3]) for a in voip for b in dialer if a[0] == b[0] and abs(a[1] - b[1]) <= tolerance
    )
    used, made = (set(), set()), set()
    for distance, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            made.add((i, j, distance))
    return made


def in_rounds(points, tolerance, blocks, batch):
    """The rounds of ``match_points`` without Spark, cut anywhere but within an instant."""
    made, left = set(), sorted(points)
    while left:
        size, parts = -(-len(left) // blocks), [[]]
        for p in left:
            if len(parts[-1]) >= size and parts[-1][-1][:2] != p[:2]:
                parts.append([])
            parts[-1].append(p)
        edges = {
            n: (parts[n - 1][-1][:2] if n else None, parts[n + 1][0][:2] if n + 1 < len(parts) else None) for n in range(len(parts))
        }
        left = []
        for n, part in enumerate(parts):
            table = pd.DataFrame(part, columns=["phone", "ts", "side", "row"]).assign(part=n)
            cut = (table.iloc[i : i + batch] for i in range(0, len(table), batch))
            for out in pair_partition(cut, tolerance, edges, ()):
                pairs = out[out.voip_row.notna()]
                made |= set(zip(pairs.voip_row.astype(int), pairs.dialer_row.astype(int), pairs.distance.astype(int)))
                still = out[out.row.notna()]
                left += list(zip(still.phone, still.ts.astype(int), still.side.astype(int), still.row.astype(int)))
        blocks = max(1, blocks // 2)
    return made


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 120), st.integers(0, 1)), min_size=1, max_size=50),
    st.integers(0, 40), st.integers(1, 6), st.integers(1, 20), st.booleans(),
)
def test_blocks_give_the_closest_first_pairs(spots, tolerance, blocks, batch, in_order):
    numbers = list(range(len(spots)))
    if not in_order:
        random.Random(len(spots)).shuffle(numbers)
    points = [(phone, ts, side, n) for n, (phone, ts, side) in zip(numbers, spots)]
    assert in_rounds(points, tolerance, blocks, batch) == closest_first(points, tolerance)


def test_chain_of_equal_distances():
    points = [("x", 5 * n, n % 2, n) for n in range(301)]
    assert in_rounds(points, 10, 7, 10) == closest_first(points, 10)


@pytest.mark.parametrize("tasks", [1, 9, 60])
def test_hot_phone_is_spread_and_paired_right(spark, tasks):
    """One phone holds most calls, dense enough that no gap separates them."""
    generator = random.Random(5)
    points = [("hot", generator.randrange(20_000), n % 2, n) for n in range(1500)]
    points += [(f"p{n % 300}", generator.randrange(20_000), (n // 300) % 2, n) for n in range(1500, 2700)]
    table = spark.createDataFrame(points, "phone string, ts bigint, side bigint, row bigint").repartition(8)
    pairs = calls.match_points(table, 60, tasks)
    assert {tuple(r) for r in pairs.collect()} == closest_first(points, 60)
    spread = table.repartitionByRange(8, "phone", "ts").where("phone = 'hot'")
    assert spread.select(F.spark_partition_id()).distinct().count() > 2


@pytest.mark.parametrize("tasks", [3, 25])
def test_instants_with_very_many_rows(spark, tasks):
    """Rows of one phone and instant outnumber what one task gets, on one side or on both."""
    generator = random.Random(9)
    points = []
    for ts, voip, dialer in ((100, 80, 30), (130, 0, 90), (150, 20, 0), (400, 70, 0), (700, 50, 50), (735, 0, 3)):
        points += [("hot", ts, side) for side, count in ((0, voip), (1, dialer)) for _ in range(count)]
    points += [("hot", generator.randrange(900), generator.randrange(2)) for _ in range(60)]
    points += [("cold", 100, 0), ("cold", 100, 1), ("cold", 135, 1)]
    numbers = list(range(len(points)))
    generator.shuffle(numbers)
    points = [(*p, n) for p, n in zip(points, numbers)]
    table = spark.createDataFrame(points, "phone string, ts bigint, side bigint, row bigint").repartition(6)
    pairs = calls.match_points(table, 40, tasks)
    assert {tuple(r) for r in pairs.collect()} == closest_first(points, 40)


def test_no_points(spark):
    none = spark.createDataFrame([], "phone string, ts bigint, side bigint, row bigint")
    assert calls.match_points(none, 40).collect() == []


def voip_and_dialer(spark):
    voip = spark.createDataFrame(
        [(0, "5551999990001", "2024-01-01 10:00:00", "0,0250", "30", "a"), (1, "51999990001", "2024-01-01 10:01:00", "x", "5", "b"),
         (2, "", "2024-01-01 10:00:00", "1", "1", "c"), (3, "51888", None, "2,5", "x", "d")],
        "row int, fone string, t string, price string, seconds string, nota string",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    dialer = spark.createDataFrame(
        [(0, "(51) 99999-0001", "2024-01-01 10:00:50", "45", "z"), (1, "51888", "2024-01-01 10:00:00", "0", "y"),
         (2, "777", "2024-01-01 09:00:00", "10,5", "w"), (3, None, None, "1", "v")],
        "row int, tel string, t string, seconds string, agente string",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return voip, dialer


def test_merge_and_reports(spark):
    voip, dialer = voip_and_dialer(spark)
    pairs = calls.match_calls(voip, dialer, "fone", "t", "row", "tel", "t", "row")
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, 10_000_000)]
    merged = calls.merge_matched_calls(voip, dialer, pairs, "fone", "tel", "price", "row", "row")
    assert merged.columns == ["fone", "t_voip", "price", "seconds_voip", "nota", "seconds_discador", "t_discador", "agente"]
    got = {r.nota: (r.fone, r.price, r.agente, r.seconds_discador) for r in merged.collect()}
    assert got == {"a": ("51999990001", "0,025", "", ""), "b": ("51999990001", "", "z", "45"), "c": ("", "1", "", ""), "d": ("51888", "2,5", "", "")}
    report = {r.cohort: r for r in calls.call_report(voip, dialer, pairs, "t", "price", "seconds", "seconds", "row", "row").collect()}
    assert (report["all"].calls, report["all"].price, report["all"].dialer_seconds) == (4, 3.525, 45.0)
    assert (report["matched"].price, report["matched"].voip_seconds) == (None, 5.0)
    absent = calls.calls_absent(dialer, voip, "tel", "fone")
    assert [r.tel for r in absent.collect()] == ["777"]
    figures = calls.absent_report(absent, "tel", "t", "seconds").first()
    assert (figures.rows, figures.phones, figures.seconds, figures.charge, figures.free_rows) == (1, 1, 10.5, 0.025, 0)
    nothing = calls.absent_report(absent.where("false"), "tel", "t", "seconds").first()
    assert (nothing.rows, nothing.phones, nothing.seconds, nothing.free_rows) == (0, 0, None, 0)
