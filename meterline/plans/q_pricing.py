"""Registered metering / pricing queries (phase 3) and their DuckDB oracles."""

from __future__ import annotations

from meterline.operators import pricing as pr
from meterline.plans.oracle import with_base
from meterline.plans.registry import register
from meterline.sources import dims as D
from meterline.sources.derived import Model


def _dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


_rows = ", ".join(f"('{m}', {_dbl(i)}, {_dbl(o)}, {str(v).lower()})" for m, _l, i, o, v in D.TEXT_MODELS)
PRICES = f"prices(model, price_in, price_out, vision) AS (VALUES {_rows})"
PRICED = f"""priced AS (SELECT u.*, p.model IS NOT NULL AS listed,
  COALESCE(p.price_in, d.price_in) AS price_in, COALESCE(p.price_out, d.price_out) AS price_out, p.vision
  FROM usage_requests u LEFT JOIN prices p ON p.model = u.model
  CROSS JOIN (SELECT price_in, price_out FROM prices WHERE model = '{D.DEFAULT_MODEL}') d)"""
TOKENS = """tok AS (SELECT *,
  COALESCE(input_tokens, CASE WHEN kind = 'classifier' THEN CAST(ceil(body_chars / 4) AS BIGINT) + 300
    ELSE CAST(ceil(body_chars / 4) AS BIGINT) END) AS in_tokens,
  COALESCE(output_tokens, CASE WHEN kind = 'image' THEN 800 WHEN kind = 'text' THEN CAST(ceil(response_chars / 4) AS BIGINT)
    ELSE 0 END) AS out_tokens FROM priced)"""
M = _dbl(D.MARKUP)
COST = f"""cost AS (SELECT id, user_id, kind, model,
  CAST(CASE WHEN kind = 'audio' THEN 0 ELSE in_tokens END AS BIGINT) AS input_tokens,
  CAST(CASE WHEN kind = 'audio' THEN 0 ELSE out_tokens END AS BIGINT) AS output_tokens,
  CAST(CASE kind WHEN 'text' THEN ceil((in_tokens * price_in + out_tokens * price_out) * {M})
    WHEN 'audio' THEN ceil(COALESCE(audio_seconds, 60) / 60 * {_dbl(D.AUDIO_PER_MINUTE)} * {M} * {_dbl(D.MICROS)})
    WHEN 'image' THEN ceil((in_tokens * {_dbl(D.IMAGE_TEXT_INPUT)} + out_tokens * {_dbl(D.IMAGE_OUTPUT)}) * {M})
    WHEN 'classifier' THEN greatest(1, ceil(in_tokens * {_dbl(D.CLASSIFIER_INPUT)} * {M})) END AS BIGINT) AS cost_micros
  FROM tok)"""
MAXTOK = (f"LEAST(CASE WHEN requested_max_tokens IS NOT NULL AND isfinite(requested_max_tokens) AND requested_max_tokens > 0 "
          f"THEN requested_max_tokens ELSE {_dbl(D.DEFAULT_MAX_TOKENS)} END, {_dbl(D.MAX_TOKENS_CAP)})")
RESERVE = f"""res0 AS (SELECT id, user_id, kind, model, CASE WHEN kind = 'text' THEN {MAXTOK} END AS max_tokens,
  CAST(CASE kind WHEN 'text' THEN CASE WHEN NOT listed THEN 400 WHEN images > 0 AND NOT COALESCE(vision, false) THEN 400
      WHEN body_chars > {D.MAX_BODY_CHARS} THEN 413 ELSE 200 END
    WHEN 'classifier' THEN CASE WHEN body_chars > {D.MAX_BODY_CHARS} THEN 413 ELSE 200 END
    WHEN 'image' THEN CASE WHEN body_chars = 0 THEN 400 WHEN body_chars > 2048 THEN 413 ELSE 200 END
    WHEN 'audio' THEN CASE WHEN audio_bytes = 0 THEN 400 WHEN audio_bytes > {25 * 1024 * 1024} THEN 413 ELSE 200 END END AS INTEGER) AS status,
  CAST(CASE kind WHEN 'text' THEN ceil(((body_chars + CASE WHEN COALESCE(vision, false) THEN images ELSE 0 END * {D.IMAGE_TOKENS}) * price_in
        + {MAXTOK} * price_out) * {M})
    WHEN 'classifier' THEN greatest(1, ceil((body_chars + {D.CLASSIFIER_OVERHEAD_TOKENS}) * {_dbl(D.CLASSIFIER_INPUT)} * {M}))
    WHEN 'image' THEN ceil((body_chars * {_dbl(D.IMAGE_TEXT_INPUT)} + 800 * {_dbl(D.IMAGE_OUTPUT)}) * {M})
    WHEN 'audio' THEN ceil(greatest({_dbl(1)}, audio_bytes / {D.MIN_AUDIO_BYTES_PER_MINUTE}) * {_dbl(D.AUDIO_PER_MINUTE)} * {M} * {_dbl(D.MICROS)})
    END AS BIGINT) AS reserved0 FROM priced)""" + """,
res AS (SELECT id, user_id, kind, model, max_tokens, status, CASE WHEN status = 200 THEN reserved0 END AS reserved_micros FROM res0)"""
CODE = r"regexp_extract(provider_error, '\b(\d{4})\b', 1)"
ERRSTATUS = (f"CASE WHEN kind = 'text' THEN CASE WHEN {CODE} IN ('3036', '3040') THEN 429 "
             f"WHEN {CODE} <> '' AND CAST({CODE} AS INTEGER) >= 5000 AND CAST({CODE} AS INTEGER) < 6000 THEN 400 ELSE 502 END "
             f"WHEN kind = 'image' AND regexp_matches(provider_error, '(?i)safety|policy|moderation') THEN 400 ELSE 502 END")
SETTLE = f"""settled AS (SELECT r.id, c.user_id,
  CAST(CASE WHEN r.status = 200 AND u.provider_error IS NOT NULL THEN {ERRSTATUS.replace('kind', 'u.kind').replace('provider_error', 'u.provider_error')}
    ELSE r.status END AS INTEGER) AS status,
  r.reserved_micros,
  CASE WHEN r.status <> 200 THEN NULL WHEN u.provider_error IS NOT NULL THEN 0 ELSE LEAST(c.cost_micros, r.reserved_micros) END AS actual_micros
  FROM res r JOIN cost c ON c.id = r.id JOIN usage_requests u ON u.id = r.id)"""
SETTLE_OUT = """SELECT id, user_id, status, reserved_micros, actual_micros, reserved_micros - actual_micros AS refund_micros,
  CASE WHEN actual_micros > 0 THEN -actual_micros END AS ledger_amount FROM settled"""


def _m(spark, sf_dir):
    m = Model(spark, sf_dir)
    return m.usage, D.text_prices(spark)


@register("usage_cost", with_base("SELECT * FROM cost", PRICES, PRICED, TOKENS, COST))
def q_usage_cost(spark, sf_dir):
    return pr.usage_cost(*_m(spark, sf_dir))


@register("text_cost", with_base("SELECT id, model, input_tokens, output_tokens, cost_micros FROM cost WHERE kind = 'text'",
                                 PRICES, PRICED, TOKENS, COST))
def q_text_cost(spark, sf_dir):
    u, p = _m(spark, sf_dir)
    return (pr.usage_cost(u.where(u.kind == "text"), p)
            .select("id", "model", "input_tokens", "output_tokens", "cost_micros"))


@register("reservation", with_base("SELECT * FROM res", PRICES, PRICED, RESERVE))
def q_reservation(spark, sf_dir):
    return pr.reservation(*_m(spark, sf_dir))


@register("provider_errors", with_base(
    f"""SELECT id, kind, CASE WHEN {CODE} <> '' THEN CAST({CODE} AS INTEGER) END AS code,
  CAST({ERRSTATUS} AS INTEGER) AS status FROM usage_requests WHERE provider_error IS NOT NULL"""))
def q_provider_errors(spark, sf_dir):
    return pr.provider_errors(Model(spark, sf_dir).usage)


@register("settlement", with_base(SETTLE_OUT, PRICES, PRICED, TOKENS, COST, RESERVE, SETTLE))
def q_settlement(spark, sf_dir):
    return pr.settlement(*_m(spark, sf_dir))


@register("usage_by_user", with_base(
    """SELECT user_id, CAST(COUNT(*) AS BIGINT) AS requests,
  CAST(COUNT(CASE WHEN actual_micros > 0 THEN 1 END) AS BIGINT) AS charged_requests,
  CAST(COALESCE(SUM(actual_micros), 0) AS BIGINT) AS charged_micros FROM settled GROUP BY user_id""",
    PRICES, PRICED, TOKENS, COST, RESERVE, SETTLE))
def q_usage_by_user(spark, sf_dir):
    return pr.usage_by_user(pr.settlement(*_m(spark, sf_dir)))


RECORDINGS_SQL = with_base(f"""SELECT id, user_id, CAST(status AS INTEGER) AS status, CASE WHEN admitted <> 200 THEN 0 WHEN status = 200 THEN 2 ELSE 1 END AS n_calls,
  audio_micros, notes_micros, audio_micros + notes_micros AS cost_micros
FROM (SELECT *, CASE WHEN status IN (200, 422) THEN least(said, worst) ELSE 0 END AS audio_micros, CASE WHEN status = 200 THEN least(notes, most) ELSE 0 END AS notes_micros
  FROM (SELECT *, CASE WHEN admitted <> 200 THEN admitted WHEN provider_error IS NOT NULL THEN 502 WHEN response_chars = 0 THEN 422 ELSE 200 END AS status
    FROM (SELECT u.*, CASE WHEN audio_bytes = 0 THEN 400 WHEN audio_bytes > {25 * 1024 * 1024} THEN 413 ELSE 200 END AS admitted,
        CAST(ceil(COALESCE(audio_seconds, 60) / 60 * {_dbl(D.AUDIO_PER_MINUTE)} * {M} * {_dbl(D.MICROS)}) AS BIGINT) AS said,
        CAST(ceil(greatest({_dbl(1)}, audio_bytes / {D.MIN_AUDIO_BYTES_PER_MINUTE}) * {_dbl(D.AUDIO_PER_MINUTE)} * {M} * {_dbl(D.MICROS)}) AS BIGINT) AS worst,
        CAST(ceil((ceil(response_chars / 4) * p.price_in + ceil(response_chars / 16) * p.price_out) * {M}) AS BIGINT) AS notes,
        CAST(ceil((response_chars * p.price_in + {_dbl(D.DEFAULT_MAX_TOKENS)} * p.price_out) * {M}) AS BIGINT) AS most
      FROM usage_requests u CROSS JOIN (SELECT * FROM prices WHERE model = '{D.DEFAULT_MODEL}') p WHERE u.kind = 'audio')))""", PRICES)


@register("recording_costs", RECORDINGS_SQL)
def q_recording_costs(spark, sf_dir):
    """P10: recordings with notes, two calls a request."""
    return pr.recording_costs(*_m(spark, sf_dir))
