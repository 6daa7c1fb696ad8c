"""Check SQL (DuckDB) for the registered queries, built from shared WITH parts."""

from __future__ import annotations

TRADES = """
trades AS (
  SELECT event_type AS symbol, ts, event_id AS seq,
         CAST(1000 + value AS DECIMAL(20,8)) AS price,
         CAST(CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS DOUBLE) / 100 AS DECIMAL(18,8)) AS amount
  FROM events)"""

BARS = TRADES + """,
numbered AS (
  SELECT *, row_number() OVER w AS rn, sum(price * amount) OVER w AS p FROM trades
  WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
starts AS (SELECT symbol, rn, p - price * amount + 5000 AS goal FROM numbered),
closing AS (
  SELECT s.symbol, s.rn AS first_rn, n.rn AS last_rn
  FROM starts s ASOF LEFT JOIN numbered n ON s.symbol = n.symbol AND s.goal <= n.p),
walk AS (
  SELECT symbol, first_rn, last_rn, CAST(0 AS BIGINT) AS bar_seq FROM closing WHERE first_rn = 1
  UNION ALL
  SELECT c.symbol, c.first_rn, c.last_rn, w.bar_seq + 1
  FROM walk w JOIN closing c ON c.symbol = w.symbol AND c.first_rn = w.last_rn + 1),
all_bars AS (
  SELECT w.symbol, w.bar_seq, min(ts) AS bar_start_ts, max(ts) AS bar_end_ts,
         CAST(arg_min(price, rn) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
         CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, rn) AS DOUBLE) AS close,
         CAST(sum(amount) AS DOUBLE) AS volume, CAST(sum(price * amount) AS DOUBLE) AS dollar_volume,
         count(*) AS num_ticks, bool_and(last_rn IS NOT NULL) AS is_complete
  FROM walk w JOIN numbered n
    ON n.symbol = w.symbol AND n.rn >= w.first_rn AND n.rn <= coalesce(w.last_rn, 9000000000)
  GROUP BY w.symbol, w.bar_seq),
bars AS (SELECT * FROM all_bars WHERE is_complete)"""

RETURNS = BARS + """,
rets AS (
  SELECT symbol, bar_seq, bar_end_ts, close,
         ln(close / lag(close) OVER w) AS log_ratio,
         ln(close) - lag(ln(close)) OVER w AS log_diff
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq))"""

# span 10: q = 1 - 2/11
VOL = RETURNS + """,
sums AS (
  SELECT a.symbol, a.bar_seq,
         sum(pow(9.0/11, a.bar_seq - b.bar_seq)) AS s0,
         sum(pow(9.0/11, a.bar_seq - b.bar_seq) * b.log_ratio) AS s1,
         sum(pow(9.0/11, a.bar_seq - b.bar_seq) * b.log_ratio * b.log_ratio) AS s2,
         sum(pow(9.0/11, 2 * (a.bar_seq - b.bar_seq))) AS w2
  FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.bar_seq <= a.bar_seq AND b.bar_seq >= 1
  WHERE a.bar_seq >= 10 GROUP BY a.symbol, a.bar_seq),
vols AS (
  SELECT r.*, sqrt(greatest(s2/s0 - (s1/s0)*(s1/s0), 0) * s0*s0 / (s0*s0 - w2)) AS vol
  FROM rets r LEFT JOIN sums s ON s.symbol = r.symbol AND s.bar_seq = r.bar_seq)"""

CUSUM = VOL + """,
arms AS (
  SELECT symbol, bar_seq, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, 0 AS fired
  FROM vols WHERE bar_seq = 10
  UNION ALL
  SELECT symbol, bar_seq,
         CASE WHEN d < -h THEN u WHEN u > h THEN 0 ELSE u END,
         CASE WHEN d < -h THEN 0 ELSE d END,
         CASE WHEN d < -h OR u > h THEN 1 ELSE 0 END
  FROM (SELECT v.symbol, v.bar_seq, v.vol AS h, greatest(0, a.up + v.log_diff) AS u,
               least(0, a.down + v.log_diff) AS d
        FROM arms a JOIN vols v ON v.symbol = a.symbol AND v.bar_seq = a.bar_seq + 1)),
sampled AS (
  SELECT a.symbol, a.bar_seq AS t0_seq, v.vol AS trgt, v.bar_end_ts AS t0, v.close AS close0,
         CASE WHEN v.log_diff >= 0 THEN 1 ELSE -1 END AS momentum
  FROM arms a JOIN vols v ON v.symbol = a.symbol AND v.bar_seq = a.bar_seq WHERE fired = 1)"""


def touches(side: str) -> str:
    return CUSUM + f""",
path AS (
  SELECT s.*, {side} AS side, b.bar_seq, b.close, b.bar_end_ts, (b.close / s.close0 - 1) * {side} AS r
  FROM sampled s JOIN bars b ON b.symbol = s.symbol AND b.bar_seq BETWEEN s.t0_seq AND s.t0_seq + 10
  WHERE s.trgt > 0),
hit AS (
  SELECT symbol, t0_seq, any_value(t0) AS t0, any_value(close0) AS close0, any_value(trgt) AS trgt,
         any_value(side) AS side,
         min(CASE WHEN r > trgt OR r < -trgt THEN bar_seq END) AS touch_seq,
         max(CASE WHEN bar_seq = t0_seq + 10 THEN bar_seq END) AS end_seq
  FROM path GROUP BY symbol, t0_seq),
touched AS (
  SELECT h.symbol, h.t0_seq, h.t0, h.close0, h.trgt, h.side, coalesce(touch_seq, end_seq) AS t1_seq,
         b.bar_end_ts AS t1, b.close AS close1,
         CASE WHEN touch_seq IS NOT NULL THEN CAST(sign((b.close / h.close0 - 1) * h.side) AS INTEGER)
              WHEN end_seq IS NOT NULL THEN 0 END AS barrier
  FROM hit h LEFT JOIN bars b ON b.symbol = h.symbol AND b.bar_seq = coalesce(touch_seq, end_seq))"""


LABELS = touches("1") + """,
labels_ AS (
  SELECT symbol, t0_seq, t1_seq, t0, t1, trgt, close1 / close0 - 1 AS ret, barrier,
         CAST(sign(close1 / close0 - 1) AS INTEGER) AS bin
  FROM touched WHERE t1_seq IS NOT NULL)"""

META_LABELS = touches("s.momentum") + """,
labels_ AS (
  SELECT symbol, t0_seq, t1_seq, t0, t1, trgt, (close1 / close0 - 1) * side AS ret, barrier, side,
         CASE WHEN (close1 / close0 - 1) * side > 0 THEN 1 ELSE 0 END AS bin
  FROM touched WHERE t1_seq IS NOT NULL)"""

LABEL_SPANS = LABELS + """,
grid AS (SELECT symbol, bar_seq, bar_end_ts, log_diff FROM rets),
spans AS (SELECT symbol, t0_seq AS event_id, t0_seq, t1_seq, t1 FROM labels_)"""

ORDER_SPANS = """
series AS (
  SELECT o_orderpriority AS symbol, o_orderkey AS event_id, o_orderdate AS bar_end_ts, o_totalprice AS close,
         o_custkey % 20 AS width,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS bar_seq,
         count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM orders),
grid AS (
  SELECT symbol, bar_seq, bar_end_ts,
         ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_seq) AS log_diff FROM series),
spans AS (SELECT symbol, event_id, bar_seq AS t0_seq, least(bar_seq + width, n - 1) AS t1_seq FROM series)"""

COUNTED = """,
counted AS (
  SELECT g.symbol, g.bar_seq, g.log_diff, count(s.event_id) AS co_events
  FROM grid g LEFT JOIN spans s ON s.symbol = g.symbol AND g.bar_seq BETWEEN s.t0_seq AND s.t1_seq
  GROUP BY g.symbol, g.bar_seq, g.log_diff)"""

MEASURED = COUNTED + """,
measured AS (
  SELECT s.symbol, s.event_id, any_value(s.t0_seq) AS t0_seq, any_value(s.t1_seq) AS t1_seq,
         avg(1.0 / c.co_events) AS avg_uniqueness,
         abs(sum(coalesce(c.log_diff, 0) / c.co_events)) AS attribution
  FROM spans s JOIN counted c ON c.symbol = s.symbol AND c.bar_seq BETWEEN s.t0_seq AND s.t1_seq
  GROUP BY s.symbol, s.event_id),
weighted AS (
  SELECT *, CASE WHEN sum(attribution) OVER p = 0 THEN attribution
                 ELSE attribution * count(*) OVER p / sum(attribution) OVER p END AS norm,
         sum(avg_uniqueness) OVER (PARTITION BY symbol ORDER BY t0_seq, event_id ROWS UNBOUNDED PRECEDING) AS cum,
         sum(avg_uniqueness) OVER p AS total
  FROM measured WINDOW p AS (PARTITION BY symbol)),
decayed AS (SELECT *, greatest(1 - 0.5 / total * total + 0.5 / total * cum, 0) AS decay FROM weighted)"""


def folds(groups: int, picked: int, embargo: float) -> str:
    """Folds over ``spans`` and ``grid`` as (fold_id, symbol, event_id, role)."""
    from itertools import combinations

    members = ", ".join(
        f"({k}, {g})" for k, combo in enumerate(combinations(range(groups), picked)) for g in combo)
    return f""",
sized AS (SELECT symbol, count(*) AS n_bars, CAST(floor(count(*) * {embargo}) AS BIGINT) AS step FROM grid GROUP BY symbol),
tiled AS (SELECT *, ntile({groups}) OVER (PARTITION BY symbol ORDER BY t0_seq, event_id) - 1 AS tile FROM spans),
members(fold_id, tile) AS (VALUES {members}),
blocks AS (
  SELECT t.symbol, t.tile, min(t0_seq) AS i_seq,
         least(max(t1_seq) + any_value(step), any_value(n_bars) - 1) AS j_seq
  FROM tiled t JOIN sized USING (symbol) GROUP BY t.symbol, t.tile),
fold_blocks AS (SELECT m.fold_id, b.* FROM members m JOIN blocks b ON b.tile = m.tile),
folds_ AS (
  SELECT m.fold_id, t.symbol, t.event_id, t.t0_seq, t.t1_seq, 'test' AS role
  FROM tiled t JOIN members m ON m.tile = t.tile
  UNION ALL
  SELECT f.fold_id, t.symbol, t.event_id, t.t0_seq, t.t1_seq, 'train' AS role
  FROM tiled t CROSS JOIN (SELECT DISTINCT fold_id FROM members) f
  WHERE NOT EXISTS (SELECT 1 FROM fold_blocks b WHERE b.fold_id = f.fold_id AND b.symbol = t.symbol
                    AND t.t0_seq <= b.j_seq AND t.t1_seq >= b.i_seq))"""


CANDLES = TRADES + """,
candles AS (
  SELECT symbol, '4h' AS timeframe,
         make_timestamp(CAST(floor(epoch_us(ts) / 14400000000) AS BIGINT) * 14400000000) AS timestamp,
         arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, seq)) AS close, sum(amount) AS volume
  FROM trades GROUP BY ALL)"""

LANDED = CANDLES + """,
landed AS (
  SELECT symbol, timeframe, timestamp, open, high, low, close + copy AS close, volume,
         epoch_ms(timestamp) + copy * 1000000000 AS ingest_seq
  FROM candles, (VALUES (0), (1)) c(copy)
  WHERE copy = 0 OR hour(timestamp) % 8 = 0)"""


#: Candles of both timeframes, and the series that a bad page fails with the reason.
BOTH_CANDLES = CANDLES + """,
both_ AS (
  SELECT * FROM candles
  UNION ALL
  SELECT symbol, '15m', make_timestamp(CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) * 900000000), arg_min(price, (ts, seq)),
         max(price), min(price), arg_max(price, (ts, seq)), sum(amount)
  FROM trades GROUP BY symbol, CAST(floor(epoch_us(ts) / 900000000) AS BIGINT)),
broken AS (
  SELECT DISTINCT b.symbol, b.timeframe, p.reason
  FROM both_ b JOIN (VALUES ('error', '15m', 27, 'not JSON'), ('signup', '4h', 12, 'record 0 cannot be read'), ('view', '15m', 28, 'timed out'))
    p(symbol, timeframe, day, reason)
    ON p.symbol = b.symbol AND p.timeframe = b.timeframe AND CAST(b.timestamp AS DATE) - DATE '2024-01-01' = p.day)"""


def indicators(source: str) -> str:
    """Recursive averages over ``source`` (symbol, timeframe, timestamp, o/h/l/c/v, bar_seq)."""
    return f""",
framed AS (
  SELECT *, CAST(close AS DOUBLE) AS px, CAST(close AS DOUBLE) - lag(CAST(close AS DOUBLE)) OVER w AS chg
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq)),
seeded AS (
  SELECT *, greatest(chg, 0) AS gain, greatest(-chg, 0) AS loss,
         avg(px) OVER (w ROWS 8 PRECEDING) AS seed9, avg(px) OVER (w ROWS 20 PRECEDING) AS seed21,
         avg(greatest(chg, 0)) OVER (w ROWS 13 PRECEDING) AS seed_up,
         avg(greatest(-chg, 0)) OVER (w ROWS 13 PRECEDING) AS seed_down,
         sum(volume) OVER (w ROWS 19 PRECEDING) AS vol_sum, count(*) OVER (w ROWS 19 PRECEDING) AS vol_n,
         min(low) OVER (w ROWS 4 PRECEDING) AS swing_low, max(high) OVER (w ROWS 4 PRECEDING) AS swing_high
  FROM framed WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq)),
smooth AS (
  SELECT symbol, bar_seq, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS u,
         CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS pf, CAST(NULL AS DOUBLE) AS ps
  FROM seeded WHERE bar_seq = 0
  UNION ALL
  SELECT x.symbol, x.bar_seq,
         CASE WHEN x.bar_seq = 8 THEN seed9 ELSE x.px * 0.2 + y.f * 0.8 END,
         CASE WHEN x.bar_seq = 20 THEN seed21 ELSE x.px * (2.0/22) + y.s * (20.0/22) END,
         CASE WHEN x.bar_seq = 14 THEN seed_up ELSE (y.u * 13 + x.gain) / 14 END,
         CASE WHEN x.bar_seq = 14 THEN seed_down ELSE (y.d * 13 + x.loss) / 14 END,
         y.f, y.s
  FROM smooth y JOIN seeded x ON x.symbol = y.symbol AND x.bar_seq = y.bar_seq + 1),
indicated AS (
  SELECT x.*, round(y.f, 8) AS ema_fast, round(y.s, 8) AS ema_slow, round(y.pf, 8) AS prev_fast,
         round(y.ps, 8) AS prev_slow,
         round(CAST(CASE WHEN y.d = 0 THEN 100 ELSE 100 - 100 / (1 + y.u / y.d) END AS DECIMAL(20,10)), 2) AS rsi,
         CAST(vol_sum AS DOUBLE) / vol_n AS volume_sma,
         CASE WHEN vol_sum > 0 THEN CAST(volume AS DOUBLE) * vol_n / CAST(vol_sum AS DOUBLE) ELSE 0 END AS volume_ratio
  FROM seeded x JOIN smooth y ON y.symbol = x.symbol AND y.bar_seq = x.bar_seq),
crossed AS (
  SELECT *, CASE WHEN prev_fast < prev_slow AND ema_fast > ema_slow THEN 'long'
                 WHEN prev_fast > prev_slow AND ema_fast < ema_slow THEN 'short' END AS direction
  FROM indicated),
gated AS (
  SELECT *, CAST(close AS DOUBLE) AS entry_price,
         CAST(CASE WHEN direction = 'long' THEN swing_low ELSE swing_high END AS DOUBLE) AS stop_loss
  FROM crossed
  WHERE bar_seq >= 34 AND ((direction = 'long' AND rsi < 70) OR (direction = 'short' AND rsi > 30))
    AND vol_sum > 0 AND volume * vol_n > vol_sum),
signals_ AS (
  SELECT symbol, timeframe, timestamp, direction, entry_price, stop_loss,
         entry_price + CASE WHEN direction = 'long' THEN 2 ELSE -2 END * abs(entry_price - stop_loss) AS take_profit,
         CASE WHEN entry_price = stop_loss THEN 0 ELSE 2 END AS risk_reward,
         ema_fast, ema_slow, rsi, volume_ratio,
         CASE WHEN rsi BETWEEN 40 AND 60 THEN 'high' ELSE 'medium' END AS confidence
  FROM gated)"""


NUMBERED_CANDLES = CANDLES + """,
series AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS bar_seq FROM candles)"""
LATEST_CANDLES = CANDLES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS back FROM candles),
series AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS bar_seq
  FROM ranked WHERE back <= 100)"""
EVERY_SIGNAL = NUMBERED_CANDLES + indicators("series")
LATEST_SIGNAL = LATEST_CANDLES + indicators("series") + """,
latest AS (
  SELECT g.* FROM signals_ g JOIN (SELECT symbol, max(timestamp) AS timestamp FROM series GROUP BY symbol) m
    ON m.symbol = g.symbol AND m.timestamp = g.timestamp)"""


def gate(source: str) -> str:
    """The ordered risk rules over ``source`` (prices, direction, account columns)."""
    return f""",
sized_ AS (
  SELECT *, abs(entry_price - stop_loss) AS risk, abs(take_profit - entry_price) AS reward,
         total_capital * 0.01 AS amount FROM {source}),
reasoned AS (
  SELECT *, CASE
    WHEN kill_switch_active THEN 'kill_switch_active'
    WHEN daily_pnl_pct <= -0.05 THEN 'kill_switch_active'
    WHEN open_positions >= 3 THEN 'max_positions_reached'
    WHEN entry_price IS NULL OR entry_price = 0 OR stop_loss IS NULL OR stop_loss = 0 OR take_profit IS NULL
      OR take_profit = 0 OR direction IS NULL OR direction = '' THEN 'invalid_signal'
    WHEN risk = 0 THEN 'invalid_signal'
    WHEN reward < CAST(1.5 AS DECIMAL(2,1)) * risk THEN 'invalid_risk_reward'
    WHEN CAST(amount AS DOUBLE) / CAST(risk AS DOUBLE) * CAST(entry_price AS DOUBLE) > available_capital
      THEN 'insufficient_capital' END AS rejection_reason
  FROM sized_),
judged AS (
  SELECT *, rejection_reason IS NULL AS approved,
         CASE WHEN rejection_reason IS NULL THEN CAST(amount AS DOUBLE) / CAST(risk AS DOUBLE) END AS position_size,
         CASE WHEN rejection_reason IS NULL THEN round_even(CAST(amount AS DOUBLE), 2) END AS risk_amount
  FROM reasoned)"""


OUTCOMES = """
sized_events AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
outcomes AS (
  SELECT event_id AS signal_id, event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
         least((k + 1) / 100, 1.0) AS confidence, value / 100 AS recommended_size, ts AS made,
         CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'cancel' ELSE 'timeout' END AS decision,
         CASE WHEN event_id % 3 = 2 THEN 90.0 ELSE (k % 90) / 4 END AS latency
  FROM sized_events),
sessions AS (
  SELECT *, CASE WHEN decision <> 'timeout' THEN made END AS decided_at,
         decision <> 'approve' AND confidence >= 0.7 AS is_override
  FROM outcomes)"""

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

IDEAS = """
ideas AS (
  SELECT CAST(event_id AS VARCHAR) AS signal_ref, event_type AS symbol, ts AS submitted_at, user_id, event_id,
         CASE user_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'flat' END AS direction,
         (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 14) / 10 AS conviction
  FROM events),
good AS (SELECT * FROM ideas WHERE direction IN ('long', 'short') AND conviction BETWEEN 0 AND 1)"""

RESPONSES = """
sized_events AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
responses AS (
  SELECT event_id AS signal_id, ts + to_seconds(2 * k) AS responded_at,
         CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE 'cancel' END AS response FROM sized_events
  UNION ALL
  SELECT event_id, ts + to_seconds(3 * (user_id % 60) + 1),
         CASE WHEN event_id % 2 = 0 THEN 'cancel' ELSE 'approve' END FROM sized_events),
firsts AS (
  SELECT e.event_id AS signal_id, min(struct_pack(t := responded_at, r := response)) AS f
  FROM events e JOIN responses r ON r.signal_id = e.event_id
  WHERE r.responded_at >= e.ts AND r.responded_at < e.ts + INTERVAL 90 SECONDS GROUP BY e.event_id),
resolved AS (
  SELECT e.event_id AS signal_id, coalesce(f.f.r, 'timeout') AS decision, f.f.t AS decided_at
  FROM events e LEFT JOIN firsts f ON f.signal_id = e.event_id)"""


def newton(rounds: int) -> str:
    """Scores of one-against-the-rest logistic models on (trgt, log_diff), by Newton steps with a penalty of 1 on the slopes.
    A step solves its three equations by Cramer's rule."""
    text = """,
cast_ AS MATERIALIZED (
  SELECT f.fold_id, f.role, l.bin AS y, 1 + abs(l.ret) AS w, l.trgt AS x1, g.log_diff AS x2
  FROM folds_ f JOIN labels_ l ON l.symbol = f.symbol AND l.t0_seq = f.event_id
  JOIN grid g ON g.symbol = l.symbol AND g.bar_seq = l.t0_seq),
scales AS (SELECT fold_id, avg(x1) AS m1, stddev_pop(x1) AS d1, avg(x2) AS m2, stddev_pop(x2) AS d2 FROM cast_ WHERE role = 'train' GROUP BY fold_id),
placed AS MATERIALIZED (
  SELECT c.fold_id, role, y, w, coalesce(CASE WHEN d1 > 0 THEN (x1 - m1) / d1 END, 0) AS z1,
    coalesce(CASE WHEN d2 > 0 THEN (x2 - m2) / d2 END, 0) AS z2 FROM cast_ c JOIN scales USING (fold_id)),
beta0 AS MATERIALIZED (
  SELECT DISTINCT fold_id, y AS c, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM placed WHERE role = 'train')"""
    det = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    for k in range(rounds):
        steps = []
        for at in range(3):
            swapped = list(h)
            swapped[at::3] = ["g0", "g1", "g2"]
            steps.append(f"b{at} + {det(*swapped)} / {det(*h)} AS b{at}")
        text += f""",
sums{k} AS (
  SELECT fold_id, c, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
    sum(s) AS g0, sum(s * z1) - any_value(b1) AS g1, sum(s * z2) - any_value(b2) AS g2, sum(v) AS h00, sum(v * z1) AS h01, sum(v * z2) AS h02,
    sum(v * z1 * z1) + 1 AS h11, sum(v * z1 * z2) AS h12, sum(v * z2 * z2) + 1 AS h22
  FROM (SELECT *, w * (CASE WHEN y = c THEN 1 ELSE 0 END - p) AS s, w * p * (1 - p) AS v
    FROM (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, b0 + b1 * z1 + b2 * z2)))) AS p FROM placed JOIN beta{k} USING (fold_id) WHERE role = 'train'))
  GROUP BY fold_id, c),
beta{k + 1} AS MATERIALIZED (SELECT fold_id, c, {", ".join(steps)} FROM sums{k})"""
    return text + f""",
numbered_tests AS (SELECT *, row_number() OVER () AS i FROM placed WHERE role = 'test'),
judged AS (SELECT i, fold_id, y, w, c, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM numbered_tests JOIN beta{rounds} USING (fold_id)),
shared AS (
  SELECT i, any_value(fold_id) AS fold_id, any_value(y) AS y, any_value(w) AS w, coalesce(sum(p) FILTER (c = y), 0) / sum(p) AS p,
    first(c ORDER BY p DESC, c) AS top FROM judged GROUP BY i),
result AS (
  SELECT fold_id, sum(w * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) / sum(w) AS score,
    sum(CASE WHEN y = top THEN w ELSE 0 END) / sum(w) AS accuracy FROM shared GROUP BY fold_id)"""
