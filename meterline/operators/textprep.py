"""Text preparation for batch model inputs and answer post-processing (X4-X13, X20-X24,
L1-L5, S9, K8, K10).  Whole texts are processed; everything is built-in column logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.text import JS_TRIM
from meterline.sources import dims as D

# The service's key format, the "empty section" clean-up pattern, the
# structured-answer ("meal") caps and the image data-URL prefixes.
SECRET_PATTERN = r"aa_live_[A-Za-z0-9_-]+"
SECRET_REDACTION = "aa_live_[redacted]"
# ``\z`` (end of input), not ``$``: in Java ``$`` also matches before a final line
# terminator, while the service's pattern ends only at the true end of the text.
EMPTY_SECTION = r"(?i)\n\n[^\n]+\n- None\.?[ \t]*(?=\n\n|\z)"
MEAL_CAPS = {"calories": 10_000, "protein": 1_000, "carbs": 1_000, "fat": 1_000}
MEAL_NAME_MAX = 120
DATA_URL = r"^data:image/(jpeg|png|webp|gif);base64,"
MAX_INDEX = 4_294_967_295  # array indices lie below it


def js_length(c: Column) -> Column:
    """String.length: UTF-16 code units (a character above U+FFFF counts twice), which is
    what the service's size caps and ``ceil(length / 4)`` token estimates measure."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def js_trim(c: Column) -> Column:
    """String.trim() semantics (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(c, JS_TRIM, "")


# ---- X4 / L4 choices ------------------------------------------------------------------

def parse_choices(text: Column) -> Column:
    """``array<struct<name, description>>`` in first-appearance order, last duplicate
    description wins.  Split on newlines/semicolons when present, else on commas; trim;
    drop empties; ``name: description`` at the first colon (position > 0), description
    defaults to the name."""
    parts = F.when(text.rlike("[\n;]"), F.split(text, "[\n;]+")).otherwise(F.split(text, ",+"))
    items = F.filter(F.transform(parts, js_trim), lambda c: c != "")

    def entry(c):
        at = F.instr(c, ":")
        name = F.when(at > 1, js_trim(F.substring(c, 1, at - 1))).otherwise(c)
        desc = F.when(at > 1, js_trim(F.substring(c, at + 1, 1 << 30)))
        desc = F.when(F.coalesce(desc, F.lit("")) == "", name).otherwise(desc)
        return F.struct(name.alias("name"), desc.alias("description"))

    entries = F.transform(items, entry)
    # LAST_WIN map dedup keeps the last description per name.
    m = F.map_from_entries(entries)
    seen = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    # own keys of an object: array indices first in ascending order, then names as they came
    at = F.transform(seen, lambda n: F.struct(
        F.when(n.rlike(r"^(0|[1-9]\d{0,9})\z"), n.try_cast("long")).alias("i"), n.alias("n")))
    index = F.filter(at, lambda e: F.coalesce(e["i"] < MAX_INDEX, F.lit(False)))
    others = F.filter(at, lambda e: ~F.coalesce(e["i"] < MAX_INDEX, F.lit(False)))
    names = F.transform(F.concat(F.array_sort(index), others), lambda e: e["n"])
    return F.transform(names, lambda n: F.struct(n.alias("name"), m[n].alias("description")))


def choice_or_first(choice: Column, choices: Column) -> Column:
    """A listed choice, else the first option ('' when the automation has none)."""
    return F.when(choices.isNull(), F.lit("")) \
        .when(F.array_contains(choices, choice), choice).otherwise(F.element_at(choices, 1))


# ---- X5 template -----------------------------------------------------------------------

def replace_first(s: Column, token: str, value: Column) -> Column:
    """String.replace with a string pattern: first occurrence only."""
    i = F.instr(s, token)
    return F.when(i == 0, s).otherwise(
        F.concat(F.substring(s, 1, i - 1), value, F.substring(s, i + len(token), 1 << 30)))


def fill_prompt(template: Column, choice: Column, instructions: Column) -> Column:
    return js_trim(replace_first(replace_first(template, "{{choice}}", choice), "{{instructions}}", instructions))


def wrap_input(prompt: Column, inp: Column) -> Column:
    """Prompt with the input wrapped in ``<input>`` tags (prompt alone when no input)."""
    return F.when(F.coalesce(inp, F.lit("")) == "", prompt) \
        .otherwise(F.concat(prompt, F.lit("\n\n<input>\n"), inp, F.lit("\n</input>")))


def prompt_table(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """L1 + L2 + X5 + X6 + F21: requests joined to their automation (fixed-size catalog,
    broadcast) -> admission status, model, system prompt and user content.

    ``requests``: request_id, slug, input, choice, instructions, has_image.
    """
    cat = catalog.select("slug", "model", "system", "prompt", "choices", "image", "acceptsImage",
                         "imageModel", "defaultInstructions", "needsInstructions")
    r = requests.join(F.broadcast(cat), "slug", "left")
    inp = js_trim(F.coalesce(F.col("input"), F.lit("")))
    takes_image = F.coalesce(F.col("image"), F.lit(False)) | F.coalesce(F.col("acceptsImage"), F.lit(False))
    image = takes_image & F.col("has_image")
    instr = F.coalesce(F.nullif(js_trim(F.coalesce(F.col("instructions"), F.lit(""))), F.lit("")),
                       F.col("defaultInstructions"), F.lit(""))
    choice = choice_or_first(F.col("choice"), F.col("choices"))
    prompt = fill_prompt(F.col("prompt"), choice, instr)
    status = (F.when(F.col("model").isNull(), 404)
              .when(F.coalesce(F.col("image"), F.lit(False)) & ~image, 400)
              .when((inp == "") & ~image, 400)
              .when(js_length(instr) > D.MAX_INSTRUCTIONS, 413)
              .when(F.col("needsInstructions").isNotNull() & (instr == ""), 400)
              .otherwise(200))
    # Empty prompt: the input itself is the prompt (no wrapping).
    content = F.when(prompt == "", inp).otherwise(wrap_input(prompt, inp))
    model = F.when(image & F.col("imageModel").isNotNull(), F.col("imageModel")).otherwise(F.col("model"))
    return r.select("request_id", "slug", status.alias("status"),
                    F.when(status == 200, model).alias("model"),
                    F.when(status == 200, F.col("system")).alias("system"),
                    F.when(status == 200, content).alias("content"))


def request_admission(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """F21 + L1: ``(request_id, slug, route, status)``: which handler a run goes to and the first rule that it breaks.

    ``requests``: request_id, slug, input, instructions, has_image, recipe_version, audio_bytes. Routes: ``audio`` (the recording itself),
    ``image`` (makes one), ``choice``, ``text``; null for an unknown slug (404). 426: an automation with a recipe version got another
    one. 400: nothing to work on, fewer than two choices, missing picture or instructions. 413: recording over 25 MiB, picture description over
    2,048 signs, instructions over 8,000, text and instructions (choices: as JSON) over 200,000.
    """
    cat = catalog.select("slug", "audio", "makesImage", "picksChoice", "recipeVersion", "image", "acceptsImage", "defaultInstructions",
                         "needsInstructions", F.lit(True).alias("known"))
    r = requests.join(F.broadcast(cat), "slug", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    given = F.coalesce(F.col("instructions"), F.lit(""))
    route = (F.when(F.col("known").isNull(), F.lit(None).cast("string")).when(flag("audio"), "audio").when(flag("makesImage"), "image")
             .when(flag("picksChoice"), "choice").otherwise("text"))
    r = r.select("request_id", "slug", route.alias("route"), js_trim(F.coalesce(F.col("input"), F.lit(""))).alias("inp"), given.alias("given"),
                 js_trim(given).alias("instr"), "audio_bytes", "has_image", flag("image").alias("image"), flag("acceptsImage").alias("accepts"),
                 "defaultInstructions", "needsInstructions",
                 (F.col("recipeVersion").isNotNull() & ~F.col("recipeVersion").eqNullSafe(F.col("recipe_version"))).alias("outdated"))
    choices = F.when(F.col("route") == "choice", parse_choices(F.col("given")))
    r = r.withColumn("names", F.coalesce(F.size(choices), F.lit(0))).withColumn("criteria", js_length(F.to_json(F.map_from_entries(choices))))
    sized = F.coalesce(F.col("audio_bytes"), F.lit(0).cast("long"))
    audio = F.when(sized == 0, 400).when(sized > 25 * 1024 * 1024, 413).otherwise(200)
    words = js_trim(F.concat_ws(". ", F.nullif(F.col("inp"), F.lit("")), F.nullif(F.col("instr"), F.lit(""))))
    picture = F.when(words == "", 400).when(js_length(words) > 2048, 413).otherwise(200)
    choice = (F.when((F.col("inp") == "") | (F.col("names") < 2), 400)
              .when(js_length(F.col("inp")) + F.col("criteria") > D.MAX_BODY_CHARS, 413).otherwise(200))
    seen = (F.col("image") | F.col("accepts")) & F.col("has_image")
    instr = F.coalesce(F.nullif(F.col("instr"), F.lit("")), F.col("defaultInstructions"), F.lit(""))
    text = (F.when((F.col("image") & ~seen) | ((F.col("inp") == "") & ~seen), 400).when(js_length(instr) > D.MAX_INSTRUCTIONS, 413)
            .when(F.col("needsInstructions").isNotNull() & (instr == ""), 400)
            .when(js_length(F.col("inp")) + js_length(instr) > D.MAX_BODY_CHARS, 413).otherwise(200))
    status = (F.when(F.col("route").isNull(), 404).when(F.col("route") == "audio", audio).when(F.col("outdated"), 426)
              .when(F.col("route") == "image", picture).when(F.col("route") == "choice", choice).otherwise(text))
    return r.select("request_id", "slug", "route", status.alias("status"))


# ---- X20-X22 / L3 structured answers --------------------------------------------------

def json_object_text(text: Column) -> Column:
    """First '{' .. last '}' of the text when it parses as a JSON *object*."""
    cand = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(cand)
    return F.when((cand != "") & F.schema_of_variant(v).startswith("OBJECT"), cand)


def json_clean_keys(obj_text: Column) -> Column:
    """Keys kept after dropping ``false``, ``''`` and ``null`` values (0 is kept),
    sorted, as an array."""
    raw = F.from_json(obj_text, "map<string,variant>")
    kept = F.map_filter(raw, lambda k, v: ~(v.isNull() | F.is_variant_null(v)
                                             | (F.to_json(v) == "false") | (F.to_json(v) == '""')))
    return F.array_sort(F.map_keys(kept))


def meal_valid(obj_text: Column) -> Column:
    """``meal`` a non-blank string <= 120 chars; calories/protein/carbs/fat JSON
    integers (integral numbers, not strings) within their caps."""
    v = F.try_parse_json(obj_text)
    meal = F.try_variant_get(v, "$.meal", "string")
    meal_t = F.schema_of_variant(F.variant_get(v, "$.meal", "variant"))
    ok = (meal_t == "STRING") & (js_trim(meal) != "") & (js_length(meal) <= MEAL_NAME_MAX)
    for key, cap in MEAL_CAPS.items():
        t = F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant"))
        num = F.try_variant_get(v, f"$.{key}", "double")
        ok = ok & (t.startswith("BIGINT") | t.startswith("DECIMAL") | t.startswith("DOUBLE")
                   | t.startswith("INT")) \
            & (num == F.floor(num)) & (num >= 0) & (num <= cap)
    return F.coalesce(ok, F.lit(False))


_JSON_STRING = r'("(?:[^"\\\\]|\\\\.)*+")'


def plain_numbers(json_text: Column) -> Column:
    """Numbers of a compact JSON text without a fraction of zeros (``5.0`` becomes ``5``, ``1.50`` becomes ``1.5``), strings as they are."""
    whole = F.regexp_replace(json_text, _JSON_STRING + r"|(?<=[:,\[])(-?\d+)\.0+(?=[,}\]])", "$1$2")
    return F.regexp_replace(whole, _JSON_STRING + r"|(?<=[:,\[])(-?\d+\.\d*[1-9])0+(?=[,}\]])", "$1$2")


def cleaned_object(obj_text: Column) -> Column:
    """The object as compact JSON without the entries that are ``false``, ``''`` or ``null`` (0, empty lists and empty objects stay).

    Index-like names come first in their order, then the others in theirs; of a repeated name the last value counts, at the first
    one's place. Numbers written with an exponent keep the spelling of ``to_json``.
    """
    raw = F.map_from_entries(F.map_entries(F.from_json(obj_text, "map<string,variant>")))  # a repeated name is one entry then
    kept = F.map_filter(raw, lambda k, v: ~(v.isNull() | F.is_variant_null(v) | F.to_json(v).isin("false", '""')))
    names = F.map_keys(kept)
    number = lambda n: F.when(n.rlike(r"^(0|[1-9]\d{0,9})\z"), n.try_cast("long"))
    low = lambda n: F.coalesce(number(n) < MAX_INDEX, F.lit(False))
    first = F.transform(F.array_sort(F.transform(F.filter(names, low), lambda n: F.struct(number(n).alias("i"), n.alias("n")))), lambda s: s["n"])
    order = F.concat(first, F.filter(names, lambda n: ~low(n)))
    entry = lambda n: F.concat(_json_text(n), F.lit(":"), F.to_json(F.element_at(kept, n)))
    return plain_numbers(F.concat(F.lit("{"), F.array_join(F.transform(order, entry), ","), F.lit("}")))


def _json_text(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}\z", 1)


def answer_document(kind: Column, text: Column) -> tuple[Column, Column]:
    """L3: ``(status, document)`` of a model's answer: what the format makes of it, or 422 and no document.

    ``kind``: ``meal`` (the checked fields alone), ``json`` (the cleaned object), null for an answer that is handed on as it is. The run is
    charged either way.
    """
    obj = json_object_text(text)
    v = F.try_parse_json(obj)
    meal = F.to_json(F.struct(js_trim(F.try_variant_get(v, "$.meal", "string")).alias("meal"),
                              *[F.try_variant_get(v, f"$.{k}", "double").cast("long").alias(k) for k in MEAL_CAPS]))
    made = (F.when(kind.isNull(), text).when(kind == "meal", F.when(meal_valid(obj), meal))
            .when(kind == "json", F.when(obj.isNotNull(), cleaned_object(obj))))
    return F.when(made.isNull() & kind.isNotNull(), 422).otherwise(200), made


# ---- X7 / X13 clean-up, X8 image sniff, X10 secrets -----------------------------------

def drop_empty_sections(text: Column) -> Column:
    return F.regexp_replace(text, EMPTY_SECTION, "")


def with_transcript(summary: Column, transcript: Column) -> Column:
    """Cleaned summary followed by the transcript."""
    return F.concat(drop_empty_sections(js_trim(summary)), F.lit("\n\nTranscript\n"), transcript)


def text_lines(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """X11: one row per line of a text, blank lines left out; ``line_no`` counts all lines from 0."""
    return (df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
            .where(js_trim(F.col("line")) != ""))


def image_url(value: Column) -> Column:
    """Strip whitespace; keep a typed data URL; bare JPEG/PNG base64 gets a prefix."""
    v = F.regexp_replace(value, r"\s+", "")
    return (F.when(v.rlike(DATA_URL), v)
            .when(v.startswith("/9j/"), F.concat(F.lit("data:image/jpeg;base64,"), v))
            .when(v.startswith("iVBOR"), F.concat(F.lit("data:image/png;base64,"), v))
            .otherwise(F.lit("")))


def secret_scan(df: DataFrame, id_col: str, text_col: str, pattern: str = SECRET_PATTERN) -> DataFrame:
    """Count and redact leaked keys in whole texts."""
    t = F.col(text_col)
    redacted = F.regexp_replace(t, pattern, SECRET_REDACTION)
    return df.select(id_col, F.size(F.regexp_extract_all(t, F.lit(pattern), 0)).cast("long").alias("n_secrets"),
                     F.length(t).cast("long").alias("chars"), F.length(redacted).cast("long").alias("redacted_chars"))


# ---- L5 / X24 budgets ------------------------------------------------------------------

def token_budget(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Characters, estimated tokens ``ceil(chars / 4)`` and the per-request size cap."""
    n = js_length(F.col(text_col))
    return docs.select(id_col, n.alias("chars"), F.ceil(n / F.lit(4)).cast("long").alias("est_tokens"),
                       (n > D.MAX_BODY_CHARS).alias("too_large"))


# ---- S9 receipts, X11/X12/K10 agenda, K8 newest matching -------------------------------

def receipt_rows(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Model answers ``merchant,date,total`` parsed into typed rows."""
    p = F.from_csv(F.col(line_col), "merchant STRING, date DATE, total DOUBLE", {"dateFormat": "yyyy-MM-dd"})
    return lines.select("*", p.alias("r")).select(*lines.columns, "r.merchant", "r.date", "r.total")


def agenda(items: DataFrame, key: str, ts: str, text: str, n: int = 12) -> DataFrame:
    """K10 + X12: the first ``n`` upcoming items per key as a bullet list, in time order.
    ``row_number() <= n`` gets Spark's partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(key).orderBy(ts, text)
    top = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return (top.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_rn", text))).alias("_items"))
            .select(key, F.array_join(F.transform("_items", lambda x: F.concat(F.lit("- "), x[text])), "\n")
                    .alias("agenda"), F.size("_items").alias("n_items")))


def newest_matching(docs: DataFrame, key: str, order: str, title: Column, needle: str) -> DataFrame:
    """K8: per key, the newest row whose title contains ``needle``, whole (``max_by``, no sort)."""
    rest = [c for c in docs.columns if c not in (key, order)]
    return (docs.where(F.instr(title, needle) > 0).groupBy(key)
            .agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("_row"))
            .select(key, order, "_row.*"))


# ---- L4 / X23 classification answers ---------------------------------------------------

ANSWER_SCHEMA = ("answers struct<category: struct<choice: string, confidence: double>>, "
                 "result struct<answers: struct<category: struct<choice: string, confidence: double>>>")


def answered_choice(answer_json: Column) -> Column:
    """The chosen name at either nesting level (``answers`` or ``result.answers``)."""
    a = F.from_json(answer_json, ANSWER_SCHEMA)
    return F.coalesce(a["answers"]["category"]["choice"], a["result"]["answers"]["category"]["choice"])


def classification_result(names: Column, choice: Column, input_chars: Column) -> tuple[Column, Column]:
    """L4: keep only a listed name; a listed answer is charged the classifier price for
    ``ceil(chars / 4) + 300`` estimated tokens, anything else costs 0 and fails (502).
    Fewer than two choices never reaches the model (400)."""
    from meterline.operators import pricing as pr
    ok = F.array_contains(names, choice)
    status = F.when(F.size(names) < 2, 400).when(ok, 200).otherwise(502)
    tokens = F.ceil(input_chars / F.lit(4)).cast("long") + D.CLASSIFIER_ESTIMATE_EXTRA
    reserved = pr.classifier_cost_expr(input_chars + D.CLASSIFIER_OVERHEAD_TOKENS)
    cost = F.when(status == 200, F.least(pr.classifier_cost_expr(tokens), reserved)).when(status == 502, F.lit(0).cast("long"))
    return status, cost
