"""DuckDB forms of the shared views, as one chain of common table expressions."""

LEDGER = """e0 AS (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
e1 AS (SELECT *, round(value * 100, 2) AS paid,
  CASE user_id % 10 WHEN 8 THEN 'Euro' WHEN 9 THEN 'Yen' ELSE 'US Dollar' END AS pc, CASE k % 10 WHEN 8 THEN 'Euro' WHEN 9 THEN 'Yen' ELSE 'US Dollar' END AS rc,
  cast(CASE user_id % 10 WHEN 8 THEN 1.25 WHEN 9 THEN 0.01 ELSE 1 END AS double) AS rp, cast(CASE k % 10 WHEN 8 THEN 1.25 WHEN 9 THEN 0.01 ELSE 1 END AS double) AS rr FROM e0),
ledger AS (SELECT event_id AS row_id, date_trunc('minute', ts) AS ts, lpad(cast(user_id % 7 AS varchar), 3, '0') AS from_bank, concat('U', cast(user_id AS varchar)) AS from_account,
  lpad(cast(k % 7 AS varchar), 3, '0') AS to_bank, concat('U', cast(k AS varchar)) AS to_account, round(CASE WHEN pc = rc THEN paid ELSE paid * rp / rr END, 6) AS amount_received, rc AS receiving_currency,
  paid AS amount_paid, pc AS payment_currency, CASE event_type WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'Cheque' WHEN 'purchase' THEN 'Credit Card' WHEN 'signup' THEN 'Wire' ELSE 'Cash' END AS payment_format,
  CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END AS is_laundering, CASE WHEN event_id % 202 = 0 THEN cast(floor(event_id / 1010.0) AS int) END AS attempt_id,
  concat(lpad(cast(user_id % 7 AS varchar), 3, '0'), '|U', cast(user_id AS varchar)) AS from_key, concat(lpad(cast(k % 7 AS varchar), 3, '0'), '|U', cast(k AS varchar)) AS to_key,
  paid * rp AS usd_paid, round(CASE WHEN pc = rc THEN paid ELSE paid * rp / rr END, 6) * rr AS usd_received FROM e1)"""

LEGS = (
    LEDGER
    + """,
legs AS (SELECT row_id, ts, date_trunc('day', ts) AS window_start, payment_format, is_laundering, attempt_id, payment_currency <> receiving_currency AS crossed, payment_format IN ('Cash', 'Bitcoin') AS high_risk,
  from_key AS account_key, to_key AS counterparty, 'out' AS direction, usd_paid AS usd, amount_paid AS amount, payment_currency AS currency FROM ledger WHERE from_key <> to_key
  UNION ALL SELECT row_id, ts, date_trunc('day', ts), payment_format, is_laundering, attempt_id, payment_currency <> receiving_currency, payment_format IN ('Cash', 'Bitcoin'),
  to_key, from_key, 'in', usd_received, amount_received, receiving_currency FROM ledger WHERE from_key <> to_key)"""
)

STATS = (
    LEGS
    + """,
s0 AS (SELECT account_key, window_start, max(usd) AS max_txn_usd, sum(usd) AS volume_usd, count(*) FILTER (usd >= 9000 AND usd < 10000) AS n_near_threshold,
  count(DISTINCT counterparty) FILTER (direction = 'in') AS n_distinct_senders, count(DISTINCT counterparty) FILTER (direction = 'out') AS n_distinct_receivers,
  coalesce(sum(usd) FILTER (high_risk), 0) AS high_risk_channel_usd, count(*) FILTER (crossed) AS n_cross_currency,
  count(*) FILTER (amount >= 1000 AND abs(round(amount / 1000) * 1000 - amount) < 1e-6) AS n_round_amounts, count(*) AS n_txn,
  coalesce(sum(usd) FILTER (direction = 'in'), 0) AS in_usd, coalesce(sum(usd) FILTER (direction = 'out'), 0) AS out_usd,
  min(ts) FILTER (direction = 'in') AS first_in, max(ts) FILTER (direction = 'out') AS last_out FROM legs GROUP BY ALL),
stats AS (SELECT *, CASE WHEN in_usd > 0 AND out_usd > 0 AND out_usd / in_usd BETWEEN 0.8 AND 1.25 AND last_out > first_in THEN least(in_usd, out_usd) ELSE 0 END AS pass_through_usd FROM s0)"""
)

FIRED = (
    STATS
    + """,
fired AS (SELECT *, max_txn_usd >= 10000 AS f1, volume_usd >= 10000 AS f2, n_near_threshold >= 2 AS f3, n_distinct_senders >= 5 AS f4, n_distinct_receivers >= 5 AS f5, pass_through_usd >= 5000 AS f6,
  high_risk_channel_usd >= 10000 AS f7, n_cross_currency >= 3 AS f8, n_round_amounts >= 3 AS f9 FROM stats),
alerts AS (SELECT *, f1::int + f2::int + f3::int + f4::int + f5::int + f6::int + f7::int + f8::int + f9::int AS n_rules_triggered FROM fired)"""
)

EDGES = LEDGER + """,
edges AS (SELECT date_trunc('day', ts) AS window_start, from_key AS src, to_key AS dst, min(ts) AS first_ts, max(ts) AS last_ts FROM ledger WHERE from_key <> to_key GROUP BY ALL)"""

ACCOUNTS = """accounts AS (SELECT cast(c_custkey % 7 AS varchar) AS bank_id, concat('U', cast(c_custkey AS varchar)) AS account_number,
  CASE WHEN c_nationkey % 3 = 0 THEN concat('First Bank of ', n_name) WHEN c_nationkey = 1 THEN concat('Crytpo Bank #', cast(c_custkey AS varchar)) ELSE concat(n_name, ' Bank #', cast(c_nationkey AS varchar)) END AS bank_name,
  c_mktsegment AS entity_type FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PERIOD = """CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-02' THEN 'BURN_IN' WHEN ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-14' THEN 'TRAIN'
  WHEN ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15' THEN 'EMBARGO_1' WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-19' THEN 'VALIDATION'
  WHEN ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20' THEN 'EMBARGO_2' WHEN ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-24' THEN 'CALIBRATION'
  WHEN ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-25' THEN 'EMBARGO_3' WHEN ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-31' THEN 'TEST' END"""

SCORED = "scored AS (SELECT n_chars AS score, quality AS y, lang FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
BY_SCORE = SCORED + """,
g AS (SELECT score, cast(sum(y) AS bigint) AS pos, count(*) AS n FROM scored GROUP BY score),
ranked AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS flagged, sum(pos) OVER () AS all_pos, sum(n) OVER () AS all_n FROM g WINDOW d AS (ORDER BY score DESC))"""
