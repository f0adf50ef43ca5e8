"""Call matching: every event has a side; clicks, views and signups stand in for VoIP calls, the others for dialler calls."""

from pyspark.sql import functions as F

from queries.functions import joined
from queries.registry import query
from roster import functions as R
from roster.operators import calls, reports

TOLERANCE = 14400
VOIP, DIALER = ("click", "view", "signup"), ("purchase", "error")


def _calls(t, kinds, prefix):
    """Calls with text times (whole seconds), text prices and durations."""
    return t.events.where(F.col("event_type").isin(*kinds)).select(
        F.col("event_id").alias("row"),
        joined(prefix, F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("fone"),
        R.parse_ts(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("ts"),
        F.translate(F.format_string("%.2f", "value"), ".", ",").alias("price"),
        F.format_string("%.2f", "value").alias("seconds"),
    )


def voip(t):
    return _calls(t, VOIP, "+55 (51) 9").withColumnRenamed("fone", "numero")


def dialer(t):
    return _calls(t, DIALER, "(51) 9").withColumnRenamed("price", "agente")


def pairs(t):
    return calls.match_calls(voip(t), dialer(t), "numero", "ts", "row", "fone", "ts", "row", TOLERANCE)


# Closest-first pairing as a fold over the candidates of each phone in order of distance.
PAIRS = f"""v AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts, value FROM events WHERE event_type IN {VOIP}),
d AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts, value FROM events WHERE event_type IN {DIALER}),
cand AS (SELECT v.user_id AS u, v.event_id AS i, d.event_id AS j, abs(epoch_us(v.ts) - epoch_us(d.ts)) AS dist,
    row_number() OVER (PARTITION BY v.user_id ORDER BY abs(epoch_us(v.ts) - epoch_us(d.ts)), v.event_id, d.event_id) AS n
  FROM v JOIN d ON v.user_id = d.user_id AND abs(epoch_us(v.ts) - epoch_us(d.ts)) <= {TOLERANCE}000000),
fold AS (
  SELECT DISTINCT u, 0::BIGINT AS n, []::BIGINT[] AS used_i, []::BIGINT[] AS used_j, []::BIGINT[] AS dists FROM cand
  UNION ALL
  SELECT f.u, c.n,
    CASE WHEN free THEN list_append(f.used_i, c.i) ELSE f.used_i END,
    CASE WHEN free THEN list_append(f.used_j, c.j) ELSE f.used_j END,
    CASE WHEN free THEN list_append(f.dists, c.dist) ELSE f.dists END
  FROM fold f JOIN cand c ON c.u = f.u AND c.n = f.n + 1,
  LATERAL (SELECT NOT list_contains(f.used_i, c.i) AND NOT list_contains(f.used_j, c.j) AS free)),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1),
pairs AS (SELECT unnest(used_i) AS voip_row, unnest(used_j) AS dialer_row, unnest(dists) AS distance FROM last)"""


@query("match_calls", f"WITH RECURSIVE {PAIRS} SELECT voip_row, dialer_row, distance FROM pairs")
def match_calls(t):
    return pairs(t)


@query(
    "merge_calls",
    f"""WITH RECURSIVE {PAIRS}
    SELECT '519' || lpad(CAST(v.user_id AS VARCHAR), 8, '0') AS numero, strftime(v.ts, '%d/%m/%Y %H:%M:%S') AS ts_voip,
      replace(regexp_replace(printf('%.12f', v.value), '\\.?0+$', ''), '.', ',') AS price, printf('%.2f', v.value) AS seconds_voip,
      coalesce(printf('%.2f', d.value), '') AS seconds_discador, coalesce(strftime(d.ts, '%Y-%m-%d %H:%M:%S'), '') AS ts_discador,
      coalesce(replace(printf('%.2f', d.value), '.', ','), '') AS agente
    FROM v LEFT JOIN pairs ON voip_row = v.event_id LEFT JOIN d ON dialer_row = d.event_id""",
)
def _(t):
    merged = calls.merge_matched_calls(voip(t), dialer(t), pairs(t), "numero", "fone", "price", "row", "row")
    return merged.withColumn("ts_voip", R.ts_br("ts_voip"))


@query(
    "calls_absent",
    f"""SELECT event_id AS row FROM events WHERE event_type IN {DIALER} AND user_id NOT IN
    (SELECT user_id FROM events WHERE event_type IN {VOIP} AND value > 150)""",
)
def _(t):
    called = voip(t).where(R.parse_decimal("price") > 150)
    return calls.calls_absent(dialer(t), called, "fone", "numero").select("row")


def _cohort(name, where):
    return f"""SELECT '{name}' AS cohort, count(*) AS calls, CAST(sum(CAST(v.value AS DECIMAL(18,2))) AS DOUBLE) AS price,
      strftime(min(v.ts), '%d/%m/%Y %H:%M:%S') AS first_ts, strftime(max(v.ts), '%d/%m/%Y %H:%M:%S') AS last_ts,
      CAST(sum(CAST(v.value AS DECIMAL(18,2))) AS DOUBLE) AS voip_seconds,
      CAST(sum(CAST(d.value AS DECIMAL(18,2))) AS DOUBLE) AS dialer_seconds
    FROM v LEFT JOIN pairs ON voip_row = v.event_id LEFT JOIN d ON dialer_row = d.event_id WHERE {where}"""


@query(
    "call_report",
    f"WITH RECURSIVE {PAIRS} " + " UNION ALL ".join(
        [_cohort("all", "true"), _cohort("unmatched", "voip_row IS NULL"), _cohort("matched", "voip_row IS NOT NULL")]
    ),
)
def _(t):
    report = calls.call_report(voip(t), dialer(t), pairs(t), "ts", "price", "seconds", "seconds", "row", "row")
    return report.withColumns({"first_ts": R.ts_br("first_ts"), "last_ts": R.ts_br("last_ts")})


@query(
    "absent_report",
    f"""SELECT count(*) AS rows, count(DISTINCT user_id) AS phones,
      strftime(min(ts), '%d/%m/%Y %H:%M:%S') AS first_ts, strftime(max(ts), '%d/%m/%Y %H:%M:%S') AS last_ts, 0::BIGINT AS bad_ts,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS seconds,
      round(CAST(sum(CASE WHEN value >= 1 THEN greatest(0.025, CAST(value AS DECIMAL(18,2)) / 60 * 0.05) ELSE 0 END) AS DOUBLE), 4) AS charge,
      count(*) FILTER (WHERE value >= 1) AS charged_rows, count(*) FILTER (WHERE value < 1) AS free_rows
    FROM events WHERE event_type IN {DIALER} AND user_id NOT IN (SELECT user_id FROM events WHERE event_type IN {VOIP} AND value > 150)""",
)
def _(t):
    called = voip(t).where(R.parse_decimal("price") > 150)
    absent = calls.calls_absent(dialer(t), called, "fone", "numero")
    report = calls.absent_report(absent, "fone", "ts", "seconds")
    return report.withColumns(
        {"first_ts": R.ts_br("first_ts"), "last_ts": R.ts_br("last_ts"), "charge": F.round("charge", 4)}
    )


@query(
    "price_report",
    """SELECT count(*) AS rows, count(CASE WHEN event_type <> 'error' THEN 1 END) AS priced,
      count(CASE WHEN event_type <> 'error' AND value > 0 THEN 1 END) AS positive,
      CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS total,
      strftime(min(ts), '%d/%m/%Y %H:%M:%S') AS first_ts, strftime(max(ts), '%d/%m/%Y %H:%M:%S') AS last_ts, 0::BIGINT AS bad_ts
    FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-20'""",
)
def _(t):
    from roster.operators.clean import filter_date_range

    priced = t.events.withColumn(
        "price", F.when(F.col("event_type") == "error", "-").otherwise(F.translate(F.format_string("%.2f", "value"), ".", ","))
    )
    report = reports.price_report(filter_date_range(priced, "ts", "2024-01-10", "2024-01-20"), "price", "ts")
    return report.withColumns({"first_ts": R.ts_br("first_ts"), "last_ts": R.ts_br("last_ts")})


@query(
    "date_span",
    """WITH last AS (SELECT max(CAST(ts AS DATE)) AS day FROM events)
    SELECT strftime(min(ts), '%d/%m/%Y') AS first_day, strftime(max(ts), '%d/%m/%Y') AS last_day,
      strftime(min(ts) FILTER (WHERE CAST(ts AS DATE) = day), '%H:%M:%S') AS low, strftime(max(ts), '%H:%M:%S') AS high
    FROM events, last""",
)
def _(t):
    span = reports.date_span(t.events, "ts")
    return span.select(
        F.date_format("first_day", "dd/MM/yyyy").alias("first_day"), F.date_format("last_day", "dd/MM/yyyy").alias("last_day"),
        F.date_format("last_day_first_ts", "HH:mm:ss").alias("low"), F.date_format("last_day_last_ts", "HH:mm:ss").alias("high"),
    )
