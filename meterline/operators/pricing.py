"""Usage metering and pricing (P1-P6, P9, P10, J22, X16, X24, F21 size rules, F22).

All price arithmetic is IEEE double followed by ``ceil`` (micro-dollars), evaluated
left to right exactly as the service does, so results match to the micro-dollar.  The
price dimension is a fixed three-row table joined with an explicit broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.sources import dims as D


def _d(x: float) -> Column:
    return F.lit(float(x))


def text_cost_expr(in_tok: Column, out_tok: Column, p_in: Column, p_out: Column) -> Column:
    """ceil((in * $in + out * $out) * markup)."""
    return F.ceil((in_tok * p_in + out_tok * p_out) * _d(D.MARKUP)).cast("long")


def audio_cost_expr(minutes: Column) -> Column:
    """ceil(minutes * $/min * markup * 1e6)."""
    return F.ceil(minutes * _d(D.AUDIO_PER_MINUTE) * _d(D.MARKUP) * _d(D.MICROS)).cast("long")


def image_cost_expr(in_tok: Column, out_tok: Column) -> Column:
    """ceil((in * 5 + out * 30) * markup)."""
    return F.ceil((in_tok * _d(D.IMAGE_TEXT_INPUT) + out_tok * _d(D.IMAGE_OUTPUT)) * _d(D.MARKUP)).cast("long")


def classifier_cost_expr(in_tok: Column) -> Column:
    """max(1, ceil(in * 0.042 * markup))."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(in_tok * _d(D.CLASSIFIER_INPUT) * _d(D.MARKUP)).cast("long"))


def clamp_max_tokens(requested: Column) -> Column:
    """Finite positive request else 1024, capped at 4096."""
    ok = requested.isNotNull() & ~F.isnan(requested) & (requested > 0) & \
        (requested != F.lit(float("inf")))
    return F.least(F.when(ok, requested).otherwise(_d(D.DEFAULT_MAX_TOKENS)), _d(D.MAX_TOKENS_CAP))


def ceil_div4(c: Column) -> Column:
    return F.ceil(c / F.lit(4)).cast("long")


def with_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Price lookup with default -- an unlisted model is priced as the default model."""
    default = (prices.where(F.col("model") == D.DEFAULT_MODEL)
               .select(F.col("price_in").alias("d_in"), F.col("price_out").alias("d_out")))
    p = prices.select("model", "price_in", "price_out", "vision")
    return (usage.join(F.broadcast(p), "model", "left").crossJoin(F.broadcast(default))
            .withColumn("listed", F.col("price_in").isNotNull())
            .withColumn("price_in", F.coalesce("price_in", "d_in"))
            .withColumn("price_out", F.coalesce("price_out", "d_out"))
            .drop("d_in", "d_out"))


def usage_tokens(u: DataFrame) -> DataFrame:
    """Reported token counts, else estimated from characters (ceil(chars / 4))."""
    kind = F.col("kind")
    in_est = (F.when(kind == "classifier", ceil_div4(F.col("body_chars")) + D.CLASSIFIER_ESTIMATE_EXTRA)
              .otherwise(ceil_div4(F.col("body_chars"))))
    out_est = (F.when(kind == "image", F.lit(D.IMAGE_MAX_OUTPUT_TOKENS).cast("long"))
               .when(kind == "text", ceil_div4(F.col("response_chars")))
               .otherwise(F.lit(0).cast("long")))
    return (u.withColumn("in_tokens", F.coalesce(F.col("input_tokens"), in_est))
            .withColumn("out_tokens", F.coalesce(F.col("output_tokens"), out_est)))


def _cost() -> Column:
    """Cost by kind, over the columns of ``usage_tokens``."""
    kind = F.col("kind")
    minutes = F.coalesce(F.col("audio_seconds"), F.lit(D.DEFAULT_AUDIO_SECONDS)) / F.lit(60)
    return (F.when(kind == "text", text_cost_expr(F.col("in_tokens"), F.col("out_tokens"),
                                                  F.col("price_in"), F.col("price_out")))
            .when(kind == "audio", audio_cost_expr(minutes))
            .when(kind == "image", image_cost_expr(F.col("in_tokens"), F.col("out_tokens")))
            .when(kind == "classifier", classifier_cost_expr(F.col("in_tokens"))))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each metered request by kind (model call assumed to succeed)."""
    u = usage_tokens(with_prices(usage, prices))
    kind = F.col("kind")
    return u.select("id", "user_id", "kind", "model",
                    F.when(kind == "audio", F.lit(0).cast("long")).otherwise(F.col("in_tokens")).alias("input_tokens"),
                    F.when(kind == "audio", F.lit(0).cast("long")).otherwise(F.col("out_tokens")).alias("output_tokens"),
                    _cost().alias("cost_micros"))


def _admission() -> tuple[Column, Column, Column]:
    """Admission status, output-token cap and worst-case cost, over the columns of ``with_prices``."""
    kind, size = F.col("kind"), F.col("body_chars")
    max_tokens = clamp_max_tokens(F.col("requested_max_tokens"))
    images = F.col("images").cast("long")
    text_status = (F.when(~F.col("listed"), 400)
                   .when((images > 0) & ~F.coalesce(F.col("vision"), F.lit(False)), 400)
                   .when(size > D.MAX_BODY_CHARS, 413).otherwise(200))
    audio_bytes = F.col("audio_bytes")
    status = (F.when(kind == "text", text_status)
              .when(kind == "classifier", F.when(size > D.MAX_BODY_CHARS, 413).otherwise(200))
              .when(kind == "image", F.when(size == 0, 400).when(size > 2048, 413).otherwise(200))
              .when(kind == "audio", F.when(audio_bytes == 0, 400)
                    .when(audio_bytes > 25 * 1024 * 1024, 413).otherwise(200)))
    text_images = F.when(F.coalesce(F.col("vision"), F.lit(False)), images).otherwise(F.lit(0).cast("long"))
    reserved = (F.when(kind == "text", text_cost_expr(size + text_images * D.IMAGE_TOKENS, max_tokens,
                                                      F.col("price_in"), F.col("price_out")))
                .when(kind == "classifier", classifier_cost_expr(size + D.CLASSIFIER_OVERHEAD_TOKENS))
                .when(kind == "image", image_cost_expr(size, F.lit(D.IMAGE_MAX_OUTPUT_TOKENS)))
                .when(kind == "audio", audio_cost_expr(
                    F.greatest(_d(1.0), audio_bytes / F.lit(D.MIN_AUDIO_BYTES_PER_MINUTE)))))
    return status.cast("int"), max_tokens, reserved.cast("long")


def reservation(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """P5 + P9 + F21 (size/model rules): admission status and worst-case reservation."""
    status, max_tokens, reserved = _admission()
    return with_prices(usage, prices).select(
        "id", "user_id", "kind", "model", F.when(F.col("kind") == "text", max_tokens).alias("max_tokens"),
        status.alias("status"), F.when(status == 200, reserved).alias("reserved_micros"))


def provider_error_status(message: Column, kind: Column) -> Column:
    """first 4-digit code -> 429 (rate limit) / 400 (5xxx) / 502; image moderation -> 400."""
    code = F.regexp_extract(message, r"\b(\d{4})\b", 1)
    code_i = F.when(code != "", code.cast("int"))
    moderated = message.rlike("(?i)safety|policy|moderation")
    by_code = (F.when(code_i.isin(*D.RATE_LIMIT_CODES), 429)
               .when((code_i >= 5000) & (code_i < 6000), 400).otherwise(502))
    return (F.when(kind == "text", by_code)
            .when((kind == "image") & moderated, 400)
            .otherwise(502))


def provider_errors(usage: DataFrame) -> DataFrame:
    """F22 over the failed calls: id, code, status."""
    e = usage.where(F.col("provider_error").isNotNull())
    code = F.regexp_extract(F.col("provider_error"), r"\b(\d{4})\b", 1)
    return e.select("id", "kind", F.when(code != "", code.cast("int")).alias("code"),
                    provider_error_status(F.col("provider_error"), F.col("kind")).cast("int").alias("status"))


def metered_outcomes(usage: DataFrame, prices: DataFrame, *more: str) -> DataFrame:
    """Admission, reservation and actual cost of each request in one projection: ``actual = min(cost, reserved)``,
    0 when the provider failed, null when the request was not admitted. ``more``: columns of ``usage`` to keep."""
    admitted, _, reserved = _admission()
    u = usage_tokens(with_prices(usage, prices)).select(
        "id", "user_id", "kind", *more, "provider_error", admitted.alias("admitted"), reserved.alias("worst"), _cost().alias("cost"))
    ok, failed = F.col("admitted") == 200, F.col("provider_error").isNotNull()
    actual = F.when(ok, F.when(failed, F.lit(0).cast("long")).otherwise(F.least("cost", "worst")))
    status = F.when(ok & failed, provider_error_status(F.col("provider_error"), F.col("kind"))).otherwise(F.col("admitted"))
    return u.select("id", "user_id", *more, status.cast("int").alias("status"),
                    F.when(ok, F.col("worst")).alias("reserved_micros"), actual.alias("actual_micros"))


def settlement(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Refund what was reserved beyond the actual cost;
    a usage ledger row of -actual only when actual > 0.  Rejected requests reserve nothing."""
    actual = F.col("actual_micros")
    return metered_outcomes(usage, prices).select(
        "id", "user_id", "status", "reserved_micros", "actual_micros", (F.col("reserved_micros") - actual).alias("refund_micros"),
        F.when(actual > 0, -actual).alias("ledger_amount"))


def usage_by_user(settled: DataFrame) -> DataFrame:
    """P10: charged totals per user (multi-call requests sum their calls)."""
    return settled.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("ledger_amount").isNotNull(), 1)).alias("charged_requests"),
        F.coalesce(F.sum("actual_micros"), F.lit(0)).cast("long").alias("charged_micros"))


def recording_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """P10: a recording is one request of two calls, the transcription and the notes on its transcript, each settled by itself.

    ``(id, user_id, status, n_calls, audio_micros, notes_micros, cost_micros)``, one row per recording. The notes are made from
    the transcript (``response_chars`` signs, a quarter as many tokens in, a sixteenth out, at the default model's price); none are made where the
    transcription failed (its error's status, nothing charged) or nothing was heard (422, the transcription is charged). Inadmissible recordings
    have no call.
    """
    default = prices.where(F.col("model") == D.DEFAULT_MODEL).select("price_in", "price_out")
    u = usage.where(F.col("kind") == "audio").crossJoin(F.broadcast(default))  # one row
    size = F.col("response_chars")
    admitted = F.when(F.col("audio_bytes") == 0, 400).when(F.col("audio_bytes") > 25 * 1024 * 1024, 413).otherwise(200)
    heard = (F.col("admitted") == 200) & F.col("provider_error").isNull()
    minutes = F.coalesce(F.col("audio_seconds"), F.lit(D.DEFAULT_AUDIO_SECONDS)) / F.lit(60)
    worst = audio_cost_expr(F.greatest(_d(1.0), F.col("audio_bytes") / F.lit(D.MIN_AUDIO_BYTES_PER_MINUTE)))
    notes = F.least(text_cost_expr(ceil_div4(size), F.ceil(size / F.lit(16)).cast("long"), F.col("price_in"), F.col("price_out")),
                    text_cost_expr(size, _d(D.DEFAULT_MAX_TOKENS), F.col("price_in"), F.col("price_out")))
    zero = F.lit(0).cast("long")
    u = u.select("id", "user_id", "provider_error", "kind", size.alias("size"), admitted.alias("admitted"),
                 F.least(audio_cost_expr(minutes), worst).alias("audio"), notes.alias("notes"))
    return u.select("id", "user_id", F.when(F.col("admitted") != 200, F.col("admitted")).when(
                        F.col("provider_error").isNotNull(), 502).when(F.col("size") == 0, 422).otherwise(200).cast("int").alias("status"),
                    F.when(F.col("admitted") != 200, 0).when(heard & (F.col("size") > 0), 2).otherwise(1).alias("n_calls"),
                    F.when(heard, F.col("audio")).otherwise(zero).alias("audio_micros"),
                    F.when(heard & (F.col("size") > 0), F.col("notes")).otherwise(zero).alias("notes_micros")) \
        .withColumn("cost_micros", F.col("audio_micros") + F.col("notes_micros"))


def retail_prices(prices: DataFrame) -> DataFrame:
    """Price list as sold (provider price x markup), plus the 2-decimal display text."""
    m = _d(D.MARKUP)
    return prices.select("model", "label", (F.col("price_in") * m).alias("retail_in"),
                         (F.col("price_out") * m).alias("retail_out"),
                         F.format_string("$%.2f", F.col("price_in") * m).alias("retail_in_text"),
                         F.format_string("$%.2f", F.col("price_out") * m).alias("retail_out_text"))


def products_by_credit(products: DataFrame) -> DataFrame:
    """K9: consumable credit products, smallest first."""
    return products.orderBy("credit_micros")


def audio_payload(raw: Column) -> Column:
    """base64 of raw audio bytes (the model API takes base64 text)."""
    return F.base64(raw)
