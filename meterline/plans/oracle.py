"""DuckDB oracle SQL: the same derived service tables and queries, written in plain SQL.

Each query's SQL is a ``WITH`` prefix defining the derived views (identical rules to
``meterline.sources.derived``) followed by the reference's own query shape (correlated
subqueries, ``ROW_NUMBER`` P95, ``COUNT(DISTINCT ...)``) in DuckDB syntax.  Integer
results are cast to BIGINT (DuckDB sums to HUGEINT); integer division is ``//``.
"""

from __future__ import annotations

DAY = 86_400_000

BASE_CTES = {
    "ev0": """ev0 AS (SELECT event_id, epoch_us(ts) // 1000 AS created_at, user_id, event_type, value,
      CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "analytics_events": """analytics_events AS (SELECT event_id AS id,
      CASE event_type WHEN 'error' THEN 'run_failed' WHEN 'click' THEN 'run_succeeded'
        WHEN 'view' THEN 'run_succeeded' ELSE event_type END AS event_name,
      CASE WHEN k = 97 THEN NULL ELSE user_id END AS user_id,
      concat('wf-', CAST(k % 6 AS VARCHAR)) AS slug,
      CASE WHEN event_type IN ('click','view') THEN 200 WHEN event_type = 'error' THEN
        CASE k % 4 WHEN 0 THEN 402 WHEN 1 THEN 422 WHEN 2 THEN 429 ELSE 502 END END AS status,
      CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms,
      CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'iphone-app' WHEN k % 3 = 1 THEN 'shortcut-key'
        ELSE 'api' END AS source, created_at FROM ev0)""",
    "users": f"""users AS (SELECT user_id AS id, MIN(created_at) + (user_id % 20) * {DAY} AS created_at
      FROM ev0 GROUP BY user_id)""",
    "app_store_transactions": """app_store_transactions AS (SELECT
      concat(CASE WHEN k % 5 = 3 THEN 'Production:' ELSE 'Sandbox:' END, CAST(event_id AS VARCHAR)) AS id,
      user_id, CASE WHEN k % 5 = 3 THEN 'Production' ELSE 'Sandbox' END AS environment
      FROM ev0 WHERE event_type = 'purchase' AND k % 5 >= 3)""",
    "ledger": """ledger AS (SELECT event_id AS id, user_id,
      CASE WHEN event_type = 'purchase' THEN 'topup' ELSE 'usage' END AS kind,
      CAST(CASE WHEN event_type = 'purchase' THEN floor(value * 1000000) ELSE -floor(value * 1000) END AS BIGINT) AS amount_micros,
      CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN concat('cs_test_', CAST(event_id AS VARCHAR))
        WHEN event_type = 'purchase' AND k % 5 = 1 THEN concat('cs_live_', CAST(event_id AS VARCHAR)) END AS stripe_session_id,
      CASE WHEN event_type = 'purchase' AND k % 5 = 3 THEN concat('purchase:Production:', CAST(event_id AS VARCHAR))
        WHEN event_type = 'purchase' AND k % 5 = 4 THEN concat('purchase:Sandbox:', CAST(event_id AS VARCHAR)) END AS apple_event_id,
      created_at FROM ev0 WHERE event_type IN ('purchase','click','view'))""",
    "usage_requests": """usage_requests AS (SELECT event_id AS id, user_id,
      CASE k % 8 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' WHEN 2 THEN 'classifier' ELSE 'text' END AS kind,
      CASE k % 8 WHEN 0 THEN '@cf/openai/whisper-large-v3-turbo' WHEN 1 THEN 'gpt-image-2' WHEN 2 THEN 'typesafe/jev'
        ELSE CASE k % 4 WHEN 0 THEN '@cf/meta/llama-3.3-70b-instruct-fp8-fast'
          WHEN 1 THEN '@cf/mistralai/mistral-small-3.1-24b-instruct'
          WHEN 2 THEN '@cf/meta/llama-3.1-8b-instruct-fp8-fast' ELSE 'retired/model-x' END END AS model,
      CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(-5.0 AS DOUBLE) WHEN 2 THEN CAST(9000.0 AS DOUBLE)
        ELSE CAST(k * 40 AS DOUBLE) END AS requested_max_tokens,
      CAST(floor(value * 500) AS BIGINT) AS body_chars, k % 3 AS images,
      CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value * 40) AS BIGINT) END AS input_tokens,
      CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value * 9) AS BIGINT) END AS output_tokens,
      CAST(floor(value * 60) AS BIGINT) AS response_chars, CAST(floor(value * 100000) AS BIGINT) AS audio_bytes,
      CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(floor(value * 2) AS BIGINT) END AS audio_seconds,
      CASE WHEN k % 13 = 0 THEN concat('AiError: ', CAST(3000 + k % 50 AS VARCHAR), ': upstream rejected')
        WHEN k % 13 = 1 THEN 'Error 5006: content blocked by safety policy' WHEN k % 13 = 2 THEN 'network timeout'
        END AS provider_error, created_at
      FROM ev0 WHERE event_type IN ('click', 'view'))""",
    "checkout_feed": """checkout_feed AS (
      WITH b AS (SELECT *, concat(CASE WHEN k % 5 = 1 THEN 'cs_live_' ELSE 'cs_test_' END, CAST(event_id AS VARCHAR)) AS session_id,
        CASE WHEN k % 7 = 0 THEN 'checkout.session.expired' WHEN k % 2 = 0 THEN 'checkout.session.completed'
          ELSE 'checkout.session.async_payment_succeeded' END AS type,
        CASE WHEN k % 9 = 0 THEN 'unpaid' ELSE 'paid' END AS payment_status,
        CASE k % 23 WHEN 0 THEN '0' WHEN 1 THEN '1.5' WHEN 2 THEN '999999' ELSE CAST(user_id AS VARCHAR) END AS meta_user_id,
        CASE k % 17 WHEN 0 THEN 'Infinity' WHEN 1 THEN '1e6' WHEN 2 THEN '-1' WHEN 3 THEN '9007199254740992'
          WHEN 4 THEN 'not-a-number' WHEN 5 THEN '0'
          ELSE CAST(CAST(floor(value) AS BIGINT) * 1000000 AS VARCHAR) END AS meta_credit
        FROM ev0 WHERE event_type = 'purchase' AND k % 5 IN (0, 1))
      SELECT session_id, type, payment_status, meta_user_id, meta_credit, created_at AS arrival, 0 AS delivery FROM b
      UNION ALL SELECT session_id, type, payment_status, meta_user_id, meta_credit, created_at + 1000, 1 FROM b WHERE k % 4 = 0)""",
    "store_feed": """store_feed AS (
      WITH sb AS (SELECT event_id, user_id, k, created_at,
        CASE WHEN k % 59 = 0 THEN concat(CAST(event_id AS VARCHAR), '/x') ELSE CAST(event_id AS VARCHAR) END AS transaction_id,
        CASE WHEN k % 19 = 0 THEN 'com.other.app' ELSE 'com.example.credits' END AS bundle_id,
        CASE WHEN k % 29 = 0 THEN 'Non-Consumable' ELSE 'Consumable' END AS type,
        CASE WHEN k % 31 = 0 THEN 'FAMILY_SHARED' ELSE 'PURCHASED' END AS ownership,
        CASE WHEN k % 37 = 0 THEN 2 ELSE 1 END AS quantity,
        CASE WHEN k % 41 = 0 THEN 'unknown' ELSE concat('com.example.credits',
          CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN '10' WHEN 2 THEN '25' ELSE '50' END) END AS product_id,
        CASE WHEN k % 5 = 3 THEN 'Production' WHEN k % 43 = 0 THEN 'Xcode' ELSE 'Sandbox' END AS environment,
        CASE WHEN k % 47 = 0 THEN sha256(CAST(user_id + 1 AS VARCHAR)) WHEN k % 53 = 0 THEN NULL
          WHEN k % 2 = 0 THEN upper(sha256(CAST(user_id AS VARCHAR))) ELSE sha256(CAST(user_id AS VARCHAR)) END AS app_account_token
        FROM ev0 WHERE event_type = 'purchase' AND k % 5 IN (3, 4))
      SELECT event_id * 8 + 0 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 0 AS seq, false AS revoked, created_at + 0 AS signed_date, created_at + (0) AS arrival FROM sb
      UNION ALL SELECT event_id * 8 + 1 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 1 AS seq, false AS revoked, created_at + 0 AS signed_date, created_at + (500) AS arrival FROM sb WHERE k % 8 = 0
      UNION ALL SELECT event_id * 8 + 2 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 2 AS seq, true AS revoked, created_at + 172800000 AS signed_date, created_at + (172800000) AS arrival FROM sb WHERE k % 3 = 0
      UNION ALL SELECT event_id * 8 + 3 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 3 AS seq, false AS revoked, created_at + 259200000 AS signed_date, created_at + (259200000) AS arrival FROM sb WHERE k % 6 = 0
      UNION ALL SELECT event_id * 8 + 4 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 4 AS seq, true AS revoked, created_at + 86400000 AS signed_date, created_at + (345600000) AS arrival FROM sb WHERE k % 12 = 0
      UNION ALL SELECT event_id * 8 + 5 AS id, user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, app_account_token, 5 AS seq, true AS revoked, created_at + 1 AS signed_date, created_at + (-1000) AS arrival FROM sb WHERE k % 7 = 0
      UNION ALL SELECT event_id * 8 + 6 AS id, user_id + 1 AS user_id, transaction_id, bundle_id, type, ownership, quantity, product_id, environment, sha256(CAST(user_id + 1 AS VARCHAR)) AS app_account_token, 6 AS seq, false AS revoked, created_at + 0 AS signed_date, created_at + (1000) AS arrival FROM sb WHERE k % 23 = 4)""",
}


def with_base(body: str, *extra: str, recursive: bool = False) -> str:
    """Prefix ``body`` with all base views plus ``extra`` CTE definitions."""
    ctes = list(BASE_CTES.values()) + list(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
