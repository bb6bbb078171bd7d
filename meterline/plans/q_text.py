"""Registered text / catalog queries (phase 6) over documents, conversations, orders, events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterline.operators import catalog as cg
from meterline.operators import pricing as pr
from meterline.operators import search
from meterline.operators import textprep as tp
from meterline.plans import q_pricing as qp
from meterline.plans.oracle import with_base
from meterline.plans.registry import register
from meterline.session import checkpoint_dir
from meterline.sources import dims as D
from meterline.sources.catalog import catalog_dict, read_catalog
from meterline.sources.derived import Model
from meterline.sources.tables import read_table

SEARCH_QUERY = "tion"
SEARCH_LANGS = ("en", "fr")
# RE2 spelling of the service's trim() character set (same set as textprep.JS_WS).
_RE2_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM_WS = f"^{_RE2_WS}+|{_RE2_WS}+$"


def _jslen(x: str) -> str:
    """UTF-16 length in DuckDB: code points + one more per character above U+FFFF."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _m(spark, sf_dir):
    return Model(spark, sf_dir)


# --- X11 lines to rows ------------------------------------------------------------------

@register("answer_lines", f"""SELECT conv_id, turn, line_no::INTEGER AS line_no, line FROM (
  SELECT conv_id, turn, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))
WHERE regexp_replace(line, '{TRIM_WS}', '', 'g') <> ''""")
def q_answer_lines(spark, sf_dir):
    return tp.text_lines(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


# --- X3 / F20 / A18 document search -----------------------------------------------------
@register("document_search", f"""SELECT doc_id, lang, source, n_chars FROM documents
WHERE contains(lower(concat_ws(' ', text, lang, source)), '{SEARCH_QUERY}') AND lang IN {SEARCH_LANGS}""")
def q_document_search(spark, sf_dir):
    docs = _m(spark, sf_dir).table("documents").where(F.col("lang").isin(*SEARCH_LANGS))
    return cg.matching(docs, SEARCH_QUERY, ["text", "lang", "source"], tags=None) \
        .select("doc_id", "lang", "source", "n_chars")


_QUERIES = "SELECT doc_id AS query_id, lower(substring(text, 11, 12)) AS query FROM documents WHERE doc_id % 20 = 0"


@register("indexed_search", f"""SELECT query_id, d.doc_id FROM ({_QUERIES}) q JOIN documents d
  ON contains(lower(d.text), q.query) WHERE q.query <> ''""")
def q_indexed_search(spark, sf_dir):
    """F20 + X3: twelve signs of every 20th document looked up in all documents by a trigram index."""
    docs = _m(spark, sf_dir).table("documents")
    path = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    search.write_index(docs, path)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 11, 12).alias("query"))
    return search.search(search.read_index(spark, path), docs, queries)


@register("search_counts", f"""SELECT lang, CAST(COUNT(*) AS BIGINT) AS matches FROM documents
WHERE contains(lower(concat_ws(' ', text, lang, source)), '{SEARCH_QUERY}') GROUP BY lang""")
def q_search_counts(spark, sf_dir):
    docs = _m(spark, sf_dir).table("documents")
    return cg.result_count(cg.matching(docs, SEARCH_QUERY, ["text", "lang", "source"], tags=None), "lang") \
        .select("lang", F.col("matches").cast("long"))


# --- X10 secret scan --------------------------------------------------------------------
# Every 7th document leaks its key once, every 21st twice.
_LEAKY = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' aa_live_', doc_id, '-x_Y ', CASE WHEN doc_id % 21 = 0 THEN 'key=aa_live_z;' ELSE '' END)
  ELSE text END AS text FROM documents)"""


@register("secret_scan", f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{tp.SECRET_PATTERN}')) AS BIGINT) AS n_secrets,
  CAST(length(text) AS BIGINT) AS chars,
  CAST(length(regexp_replace(text, '{tp.SECRET_PATTERN}', '{tp.SECRET_REDACTION}', 'g')) AS BIGINT) AS redacted_chars
FROM {_LEAKY}""")
def q_secret_scan(spark, sf_dir):
    i = F.col("doc_id")
    leak = F.concat(F.col("text"), F.lit(" aa_live_"), i.cast("string"), F.lit("-x_Y "), F.when(i % 21 == 0, "key=aa_live_z;").otherwise(""))
    docs = _m(spark, sf_dir).table("documents").select("doc_id", F.when(i % 7 == 0, leak).otherwise(F.col("text")).alias("text"))
    return tp.secret_scan(docs, "doc_id", "text")


# --- L5 token budgets -------------------------------------------------------------------
# A request holds its document 1 + doc_id % 40 times, so that some are too large.
_REQUEST = f"({_jslen('text')} * (1 + doc_id % 40))"


@register("token_budget", f"""SELECT doc_id, CAST({_REQUEST} AS BIGINT) AS chars,
  CAST(ceil({_REQUEST} / 4) AS BIGINT) AS est_tokens, {_REQUEST} > 200000 AS too_large FROM documents""")
def q_token_budget(spark, sf_dir):
    docs = _m(spark, sf_dir).table("documents")
    return tp.token_budget(docs.select("doc_id", F.expr("repeat(text, cast(1 + doc_id % 40 as int))").alias("text")), "doc_id", "text")


@register("conversation_budget", f"""SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS turns, CAST(SUM({_jslen('text')}) AS BIGINT) AS chars,
  CAST(ceil(SUM({_jslen('text')}) / 4) AS BIGINT) AS est_tokens, SUM({_jslen('text')}) > 200000 AS too_large
FROM conversations GROUP BY conv_id""")
def q_conversation_budget(spark, sf_dir):
    c = _m(spark, sf_dir).table("conversations")
    n = F.sum(tp.js_length(F.col("text"))).cast("long")
    return (c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("long").alias("turns"), n.alias("chars"))
            .select("conv_id", "turns", "chars", F.ceil(F.col("chars") / F.lit(4)).cast("long").alias("est_tokens"),
                    (F.col("chars") > 200000).alias("too_large")))


# --- X4 choices parsed from user turns --------------------------------------------------
CHOICES_SQL = f"""WITH p AS (SELECT conv_id, turn,
    CASE WHEN regexp_matches(text, '[\\n;]') THEN regexp_split_to_array(text, '[\\n;]+')
      ELSE regexp_split_to_array(text, ',+') END AS parts FROM conversations WHERE role = 'user'),
  e AS (SELECT conv_id, turn, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM p),
  t AS (SELECT conv_id, turn, pos, regexp_replace(raw, '{TRIM_WS}', '', 'g') AS c FROM e),
  nd AS (SELECT conv_id, turn, pos,
    CASE WHEN strpos(c, ':') > 1 THEN regexp_replace(substr(c, 1, strpos(c, ':') - 1), '{TRIM_WS}', '', 'g') ELSE c END AS name,
    CASE WHEN strpos(c, ':') > 1 THEN regexp_replace(substr(c, strpos(c, ':') + 1), '{TRIM_WS}', '', 'g') ELSE '' END AS d0
    FROM t WHERE c <> ''),
  nd2 AS (SELECT conv_id, turn, pos, name, CASE WHEN d0 = '' THEN name ELSE d0 END AS description FROM nd),
  g AS (SELECT conv_id, turn, name, MIN(pos) AS first_pos, arg_max(description, pos) AS description FROM nd2
    GROUP BY conv_id, turn, name)
SELECT conv_id, turn, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY first_pos) AS BIGINT) AS idx,
  name, description FROM g"""


@register("conversation_choices", CHOICES_SQL)
def q_conversation_choices(spark, sf_dir):
    c = _m(spark, sf_dir).table("conversations").where(F.col("role") == "user")
    return (c.select("conv_id", "turn", F.posexplode(tp.parse_choices(F.col("text"))).alias("i", "ch"))
            .select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("idx"),
                    F.col("ch.name").alias("name"), F.col("ch.description").alias("description")))


# --- L1 prompt table --------------------------------------------------------------------
CHOICE_WORDS = ("official", "a headline", "shouty")


def _catalog_values() -> str:
    def s(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    def lst(v):
        return "NULL" if v is None else "[" + ", ".join(s(x) for x in v) + "]::VARCHAR[]"

    def b(v):
        return "NULL" if v is None else ("true" if v else "false")

    rows = []
    for i, a in enumerate(catalog_dict()["automations"]):
        rows.append(f"({i}, {s(a['slug'])}, {s(a.get('model'))}, {s(a.get('system'))}, {s(a.get('prompt'))}, "
                    f"{lst(a.get('choices'))}, {b(a.get('image'))}, {b(a.get('acceptsImage'))}, "
                    f"{s(a.get('imageModel'))}, {s(a.get('defaultInstructions'))}, {s(a.get('needsInstructions'))})")
    return ("catalog(pos, slug, model, system, prompt, choices, image, acceptsImage, imageModel, "
            "defaultInstructions, needsInstructions) AS (VALUES " + ", ".join(rows) + ")")


N_CATALOG = len(catalog_dict()["automations"])
REQ_SQL = f"""req AS (SELECT conv_id * 1000 + turn AS request_id, c.slug, x.text AS input,
  CASE x.turn % 3 WHEN 0 THEN '{CHOICE_WORDS[0]}' WHEN 1 THEN '{CHOICE_WORDS[1]}' ELSE '{CHOICE_WORDS[2]}' END AS choice,
  CASE WHEN x.conv_id % 5 = 0 THEN '' ELSE split_part(x.text, chr(10), 1) END AS instructions,
  x.conv_id % 4 = 0 AS has_image
  FROM conversations x JOIN catalog c ON c.pos = x.conv_id % {N_CATALOG} WHERE x.role = 'user')"""


def _rf(s: str, tok: str, val: str) -> str:
    return (f"CASE WHEN strpos({s}, '{tok}') = 0 THEN {s} ELSE concat(substr({s}, 1, strpos({s}, '{tok}') - 1), {val}, "
            f"substr({s}, strpos({s}, '{tok}') + {len(tok)})) END")


PROMPT_SQL = with_base(f"""SELECT request_id, slug, status, CASE WHEN status = 200 THEN mdl END AS model,
  CASE WHEN status = 200 THEN system END AS system, CASE WHEN status = 200 THEN content END AS content FROM (
  SELECT *, CASE WHEN model IS NULL THEN 404 WHEN COALESCE(image, false) AND NOT img THEN 400
    WHEN inp = '' AND NOT img THEN 400 WHEN {_jslen('instr')} > 8000 THEN 413
    WHEN needsInstructions IS NOT NULL AND instr = '' THEN 400 ELSE 200 END AS status,
    CASE WHEN prompt2 = '' THEN inp WHEN inp = '' THEN prompt2 ELSE concat(prompt2, chr(10), chr(10), '<input>', chr(10), inp, chr(10), '</input>') END AS content,
    CASE WHEN img AND imageModel IS NOT NULL THEN imageModel ELSE model END AS mdl FROM (
    SELECT *, regexp_replace({_rf(_rf('prompt', '{{choice}}', 'ch'), '{{instructions}}', 'instr')}, '{TRIM_WS}', '', 'g') AS prompt2 FROM (
      SELECT r.request_id, r.slug, regexp_replace(COALESCE(r.input, ''), '{TRIM_WS}', '', 'g') AS inp,
        (COALESCE(c.image, false) OR COALESCE(c.acceptsImage, false)) AND r.has_image AS img,
        COALESCE(NULLIF(regexp_replace(COALESCE(r.instructions, ''), '{TRIM_WS}', '', 'g'), ''), c.defaultInstructions, '') AS instr,
        CASE WHEN c.choices IS NULL THEN '' WHEN list_contains(c.choices, r.choice) THEN r.choice ELSE c.choices[1] END AS ch,
        c.model, c.system, c.prompt, c.image, c.imageModel, c.needsInstructions
      FROM req r LEFT JOIN catalog c ON c.slug = r.slug)))""", _catalog_values(), REQ_SQL)


@register("prompt_table", PROMPT_SQL)
def q_prompt_table(spark, sf_dir):
    cat = read_catalog(spark)
    conv = _m(spark, sf_dir).table("conversations").where(F.col("role") == "user")
    t = F.col("turn") % 3
    req = (conv.join(F.broadcast(cat.select("pos", "slug")), (F.col("conv_id") % N_CATALOG) == F.col("pos"))
           .select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "slug", F.col("text").alias("input"),
                   F.when(t == 0, CHOICE_WORDS[0]).when(t == 1, CHOICE_WORDS[1]).otherwise(CHOICE_WORDS[2])
                   .alias("choice"),
                   F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
                   .alias("instructions"),
                   (F.col("conv_id") % 4 == 0).alias("has_image")))
    return tp.prompt_table(req, cat)


# --- F21 / L1 admission of runs ---------------------------------------------------------
def _admission_values() -> str:
    rows = []
    for i, a in enumerate(catalog_dict()["automations"]):
        route = "audio" if a.get("audio") else "image" if a.get("makesImage") else "choice" if a.get("picksChoice") else "text"
        extra = [str(a.get(k, False)).lower() for k in ("image", "acceptsImage")]
        default = "'" + a.get("defaultInstructions", "").replace("'", "''") + "'"
        rows.append(f"({i}, '{a['slug']}', '{route}', {a.get('recipeVersion', 'NULL')}, {', '.join(extra)}, {str('needsInstructions' in a).lower()}, {default})")
    return "cat(pos, slug, route, version, image, accepts, needs, dflt) AS (VALUES " + ", ".join(rows) + ")"


# Runs of all user turns: one in eleven names an unknown slug, one in nine is 3,000 times as long, one in thirteen is blank.
_RUN_SQL = f"""runs AS (SELECT x.conv_id * 1000 + x.turn AS request_id, CASE WHEN x.conv_id % 11 = 0 THEN 'gone' ELSE c.slug END AS slug,
  CASE WHEN x.turn % 13 = 0 THEN ' ' WHEN x.conv_id % 9 = 0 THEN repeat(x.text, 3000) ELSE x.text END AS input,
  CASE x.conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'yes: it is; no' WHEN 2 THEN x.text ELSE 'one' END AS instructions, x.conv_id % 3 <> 0 AS has_image,
  CASE WHEN x.conv_id % 2 = 0 THEN 2 WHEN x.conv_id % 5 = 0 THEN NULL ELSE 1 END AS recipe_version, (x.conv_id % 7) * 6000000 AS audio_bytes
  FROM conversations x JOIN cat c ON c.pos = (x.conv_id + x.turn) % {N_CATALOG} WHERE x.role = 'user')"""


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_WS}', '', 'g')"


_CHOICE_NAMES = f"""list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(r.instructions, if(regexp_matches(r.instructions, '[\\n;]'), '[\\n;]+', ',+')),
    lambda p: {_trimmed('p')}), lambda p: p <> ''), lambda p: if(strpos(p, ':') > 1, {_trimmed("substr(p, 1, strpos(p, ':') - 1)")}, p)))"""
ADMISSION_SQL = f"""WITH {_admission_values()}, {_RUN_SQL}
SELECT request_id, slug, route, CASE WHEN route IS NULL THEN 404 WHEN route = 'audio' THEN CASE WHEN audio_bytes = 0 THEN 400 WHEN audio_bytes > 26214400 THEN 413 ELSE 200 END
  WHEN version IS NOT NULL AND version IS DISTINCT FROM recipe_version THEN 426
  WHEN route = 'image' THEN CASE WHEN words = '' THEN 400 WHEN {_jslen('words')} > 2048 THEN 413 ELSE 200 END
  WHEN route = 'choice' THEN CASE WHEN inp = '' OR names < 2 THEN 400 WHEN {_jslen('inp')} > 200000 THEN 413 ELSE 200 END
  ELSE CASE WHEN image AND NOT seen OR inp = '' AND NOT seen THEN 400 WHEN {_jslen('wish')} > 8000 THEN 413 WHEN needs AND wish = '' THEN 400
    WHEN {_jslen('inp')} + {_jslen('wish')} > 200000 THEN 413 ELSE 200 END END AS status
FROM (SELECT *, {_trimmed("concat_ws('. ', nullif(inp, ''), nullif(instr, ''))")} AS words, (image OR accepts) AND has_image AS seen,
    coalesce(nullif(instr, ''), dflt) AS wish
  FROM (SELECT r.*, c.route, c.version, c.image, c.accepts, c.needs, c.dflt, {_trimmed('r.input')} AS inp, {_trimmed('r.instructions')} AS instr,
    len({_CHOICE_NAMES}) AS names FROM runs r LEFT JOIN cat c ON c.slug = r.slug))"""


@register("request_admission", ADMISSION_SQL)
def q_request_admission(spark, sf_dir):
    """route and status of every run; all routes, 404, 400, 413 and 426 occur."""
    cat = read_catalog(spark)
    conv, turn = F.col("conv_id"), F.col("turn")
    x = _m(spark, sf_dir).table("conversations").where(F.col("role") == "user")
    runs = x.join(F.broadcast(cat.select("pos", F.col("slug").alias("listed"))), ((conv + turn) % N_CATALOG) == F.col("pos")).select(
        (conv * 1000 + turn).alias("request_id"), F.when(conv % 11 == 0, "gone").otherwise(F.col("listed")).alias("slug"),
        F.when(turn % 13 == 0, " ").when(conv % 9 == 0, F.repeat("text", 3000)).otherwise(F.col("text")).alias("input"),
        F.when(conv % 4 == 0, "").when(conv % 4 == 1, "yes: it is; no").when(conv % 4 == 2, F.col("text")).otherwise("one").alias("instructions"),
        (conv % 3 != 0).alias("has_image"), F.when(conv % 2 == 0, 2).when(conv % 5 == 0, F.lit(None)).otherwise(1).cast("long").alias("recipe_version"),
        ((conv % 7) * 6_000_000).alias("audio_bytes"))
    return tp.request_admission(runs, cat)


# --- X20-X22 structured answers derived from view events --------------------------------
ANSWER_SQL_TEXT = """CASE WHEN k % 23 = 0 THEN 'Sorry, no JSON today.' ELSE concat('Here is the result: {"meal": "',
    CASE WHEN k % 11 = 0 THEN '  ' WHEN k % 13 = 0 THEN repeat('x', 130) ELSE concat('Meal ', CAST(k AS VARCHAR)) END,
    '", "calories": ', CASE WHEN k % 7 = 0 THEN concat('"', CAST(k * 10 AS VARCHAR), '"') WHEN k % 9 = 0 THEN concat(CAST(k AS VARCHAR), '.5')
      WHEN k % 17 = 0 THEN '20000' ELSE CAST(k * 10 AS VARCHAR) END,
    ', "protein": ', CAST(k % 50 AS VARCHAR), ', "carbs": ', CASE WHEN k % 19 = 0 THEN 'null' ELSE CAST(k % 80 AS VARCHAR) END,
    ', "fat": ', CAST(k % 30 AS VARCHAR), ', "flag": ', CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END,
    ', "note": ', CASE WHEN k % 3 = 0 THEN '""' ELSE '"ok"' END, '} Enjoy!') END"""


def _answer_text():
    k = F.col("k")
    ks = k.cast("string")
    meal = F.when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.repeat(F.lit("x"), 130)) \
        .otherwise(F.concat(F.lit("Meal "), ks))
    cal = (F.when(k % 7 == 0, F.concat(F.lit('"'), (k * 10).cast("string"), F.lit('"')))
           .when(k % 9 == 0, F.concat(ks, F.lit(".5"))).when(k % 17 == 0, F.lit("20000"))
           .otherwise((k * 10).cast("string")))
    body = F.concat(F.lit('Here is the result: {"meal": "'), meal, F.lit('", "calories": '), cal,
                    F.lit(', "protein": '), (k % 50).cast("string"), F.lit(', "carbs": '),
                    F.when(k % 19 == 0, F.lit("null")).otherwise((k % 80).cast("string")),
                    F.lit(', "fat": '), (k % 30).cast("string"), F.lit(', "flag": '),
                    F.when(k % 2 == 0, F.lit("false")).otherwise(F.lit("true")), F.lit(', "note": '),
                    F.when(k % 3 == 0, F.lit('""')).otherwise(F.lit('"ok"')), F.lit("} Enjoy!"))
    return F.when(k % 23 == 0, F.lit("Sorry, no JSON today.")).otherwise(body)


def _num_ok(key: str, cap: int) -> str:
    return (f"(json_type(o, '$.{key}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND "
            f"CAST(json_extract(o, '$.{key}') AS DOUBLE) = floor(CAST(json_extract(o, '$.{key}') AS DOUBLE)) AND "
            f"CAST(json_extract(o, '$.{key}') AS DOUBLE) BETWEEN 0 AND {cap})")


_MEAL_TEXT = "json_extract_string(o, '$.meal')"
_MEAL_OK = ("COALESCE(json_type(o, '$.meal') = 'VARCHAR' AND "
            f"regexp_replace(json_extract_string(o, '$.meal'), '{TRIM_WS}', '', 'g') <> '' "
            f"AND {_jslen(_MEAL_TEXT)} <= {tp.MEAL_NAME_MAX} AND "
            + " AND ".join(_num_ok(k, c) for k, c in tp.MEAL_CAPS.items()) + ", false)")
_MEAL_NUMBERS = ", ".join(f"CASE WHEN {_MEAL_OK} THEN CAST(CAST(json_extract(o, '$.{k}') AS DOUBLE) AS BIGINT) END AS {k}"
                          for k in tp.MEAL_CAPS)
ANSWERS_SQL = with_base(f"""SELECT a.answer_id, a.o IS NOT NULL AS has_object, kk.kept_keys, {_MEAL_OK} AS meal_ok,
  CASE WHEN {_MEAL_OK} THEN regexp_replace(json_extract_string(o, '$.meal'), '{TRIM_WS}', '', 'g') END AS meal,
  {_MEAL_NUMBERS}
FROM ans a LEFT JOIN (SELECT answer_id, array_to_string(list_sort(list(key)), ',') AS kept_keys FROM (
  SELECT answer_id, unnest(json_keys(o)) AS key, o FROM ans WHERE o IS NOT NULL) z
  WHERE CAST(json_extract(o, '$."' || key || '"') AS VARCHAR) NOT IN ('false', '""', 'null') GROUP BY answer_id) kk
  ON kk.answer_id = a.answer_id""",
    f"""ans0 AS (SELECT event_id AS answer_id, {ANSWER_SQL_TEXT} AS text FROM ev0 WHERE event_type = 'view')""",
    """ans AS (SELECT answer_id, CASE WHEN regexp_extract(text, '(?s)\\{.*\\}') <> '' AND json_valid(regexp_extract(text, '(?s)\\{.*\\}'))
  AND json_type(regexp_extract(text, '(?s)\\{.*\\}')) = 'OBJECT' THEN regexp_extract(text, '(?s)\\{.*\\}') END AS o FROM ans0)""")


@register("structured_answers", ANSWERS_SQL)
def q_structured_answers(spark, sf_dir):
    ev0 = _m(spark, sf_dir).ev0
    a = ev0.where(F.col("event_type") == "view").select(F.col("event_id").alias("answer_id"),
                                                         _answer_text().alias("text"))
    o = a.select("answer_id", tp.json_object_text(F.col("text")).alias("o"))
    keys = tp.json_clean_keys(F.col("o"))
    ok = tp.meal_valid(F.col("o"))
    v = F.try_parse_json(F.col("o"))
    return o.select("answer_id", F.col("o").isNotNull().alias("has_object"),
                    F.when(F.size(keys) > 0, F.array_join(keys, ",")).alias("kept_keys"),
                    ok.alias("meal_ok"),
                    F.when(ok, tp.js_trim(F.try_variant_get(v, "$.meal", "string"))).alias("meal"),
                    *[F.when(ok, F.try_variant_get(v, f"$.{k}", "double").cast("long")).alias(k) for k in tp.MEAL_CAPS])


_ENTRY = "CAST(json_extract(o, '$.\"' || key || '\"') AS VARCHAR)"
DOCUMENT_SQL = with_base(f"""SELECT answer_id, CASE WHEN kind IS NULL OR made IS NOT NULL THEN 200 ELSE 422 END AS status,
  CASE WHEN kind IS NULL THEN text ELSE made END AS document
FROM (SELECT d.answer_id, d.kind, d.text, CASE d.kind WHEN 'meal' THEN CASE WHEN s.meal_ok THEN concat('{{"meal":"', s.meal, '","calories":', s.calories,
    ',"protein":', s.protein, ',"carbs":', s.carbs, ',"fat":', s.fat, '}}') END
  WHEN 'json' THEN CASE WHEN s.has_object THEN concat('{{', c.entries, '}}') END END AS made
  FROM (SELECT *, CASE answer_id % 3 WHEN 0 THEN 'meal' WHEN 1 THEN 'json' END AS kind FROM ans0) d
  JOIN ({ANSWERS_SQL}) s USING (answer_id) LEFT JOIN cleaned c USING (answer_id))""",
    f"""ans0 AS (SELECT event_id AS answer_id, {ANSWER_SQL_TEXT} AS text FROM ev0 WHERE event_type = 'view')""",
    f"""cleaned AS (SELECT answer_id, string_agg(concat('"', key, '":', {_ENTRY}), ',' ORDER BY place)
      FILTER (WHERE {_ENTRY} NOT IN ('false', '""', 'null')) AS entries
  FROM (SELECT answer_id, o, unnest(json_keys(o)) AS key, generate_subscripts(json_keys(o), 1) AS place
    FROM (SELECT answer_id, regexp_extract(text, '(?s)\\{{.*\\}}') AS o FROM ans0) WHERE o <> '') GROUP BY answer_id)""")


@register("answer_documents", DOCUMENT_SQL)
def q_answer_documents(spark, sf_dir):
    """L3: a third of the answers as meals, a third as JSON, a third as they are; the document, or 422."""
    ev0 = _m(spark, sf_dir).ev0
    i = F.col("answer_id") % 3
    a = ev0.where(F.col("event_type") == "view").select(F.col("event_id").alias("answer_id"), _answer_text().alias("text"))
    status, document = tp.answer_document(F.when(i == 0, "meal").when(i == 1, "json"), F.col("text"))
    return a.select("answer_id", status.alias("status"), document.alias("document"))


# --- X7 / X13 meeting notes (rows-only: the clean-up needs a look-ahead) -----------------
def _drop_empty_sections_sql(x: str) -> str:
    """RE2 has no look-ahead: mark every "\\n\\n" with a sentinel first, consume the sentinel
    instead of looking ahead (so back-to-back sections still match), then drop sentinels."""
    marked = f"replace({x}, chr(10) || chr(10), chr(1) || chr(10) || chr(10))"
    cleaned = f"regexp_replace({marked}, '(?i)\\n\\n[^\\n]+\\n- None\\.?[ \\t]*(\\x01|$)', '\\1', 'g')"
    return f"replace({cleaned}, chr(1), '')"


# Sections that a model adds: empty ones in two of three conversations, in the middle or at the end.
_SECTIONS = ("\n\nRisks\n- None.\n\nNext\n- write", "\n\nNext\n- call\n\nOpen\n- none", "\n\nRisks\n- None of them")
_SECTIONS_SQL = "(CASE conv_id % 3 " + " ".join(
    f"WHEN {i} THEN '" + x.replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(_SECTIONS)) + " END)"


MEETING_SQL = f"""SELECT conv_id, concat({_drop_empty_sections_sql(f"regexp_replace(COALESCE(summary, '') || {_SECTIONS_SQL}, '{TRIM_WS}', '', 'g')")},
  chr(10) || chr(10) || 'Transcript' || chr(10), COALESCE(transcript, '')) AS text FROM (
  SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS summary,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS transcript FROM conversations GROUP BY conv_id)"""


@register("meeting_notes", MEETING_SQL)
def q_meeting_notes(spark, sf_dir):
    c = _m(spark, sf_dir).table("conversations")
    per = c.groupBy("conv_id").agg(
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("summary"),
        F.min_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("transcript"))
    k = F.col("conv_id") % 3
    added = F.when(k == 0, _SECTIONS[0]).when(k == 1, _SECTIONS[1]).when(k == 2, _SECTIONS[2])
    return per.select("conv_id", tp.with_transcript(F.concat(F.coalesce("summary", F.lit("")), added),
                                                    F.coalesce("transcript", F.lit(""))).alias("text"))


# --- S9 receipt rows from orders --------------------------------------------------------
RECEIPT_LINE_SQL = """concat(c.c_name, ',', strftime(o.o_orderdate, '%Y-%m-%d'), ',',
  CAST(CAST(round(o.o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR), '.',
  lpad(CAST(CAST(round(o.o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"""


@register("receipt_rows", f"""SELECT o_orderkey, line, split_part(line, ',', 1) AS merchant,
  CAST(split_part(line, ',', 2) AS DATE) AS date, CAST(split_part(line, ',', 3) AS DOUBLE) AS total FROM (
  SELECT o.o_orderkey, {RECEIPT_LINE_SQL} AS line FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)""")
def q_receipt_rows(spark, sf_dir):
    m = _m(spark, sf_dir)
    o, c = m.table("orders"), m.table("customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    line = F.concat(F.col("c_name"), F.lit(","), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","),
                    F.expr("CAST(CAST(round(o_totalprice * 100) AS BIGINT) div 100 AS STRING)"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))
    lines = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", line.alias("line"))
    return tp.receipt_rows(lines)


# --- K10 / X11 / X12 agenda -------------------------------------------------------------
AGENDA_FROM = "1995-01-01"


@register("agenda", f"""SELECT o_custkey, string_agg(concat('- ', item), chr(10) ORDER BY o_orderdate, item) AS agenda,
  CAST(COUNT(*) AS BIGINT) AS n_items FROM (
  SELECT o_custkey, o_orderdate, concat(strftime(o_orderdate, '%Y-%m-%d'), ' ', o_orderpriority) AS item,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, concat(strftime(o_orderdate, '%Y-%m-%d'), ' ', o_orderpriority)) AS rn
  FROM orders WHERE o_orderdate >= TIMESTAMP '{AGENDA_FROM}') WHERE rn <= 12 GROUP BY o_custkey""")
def q_agenda(spark, sf_dir):
    o = _m(spark, sf_dir).table("orders").where(F.col("o_orderdate") >= F.lit(AGENDA_FROM).cast("timestamp_ntz"))
    items = o.select("o_custkey", "o_orderdate",
                     F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))
                     .alias("item"))
    a = tp.agenda(items, "o_custkey", "o_orderdate", "item", 12)
    return a.select("o_custkey", "agenda", F.size(F.split("agenda", "\n")).cast("long").alias("n_items"))


# --- K8 newest matching note ------------------------------------------------------------
NOTE_NEEDLE = "ment"


@register("newest_matching_note", f"""SELECT source, MAX(doc_id) AS doc_id, arg_max(text, doc_id) AS text, arg_max(lang, doc_id) AS lang FROM documents
WHERE strpos(split_part(text, chr(10), 1), '{NOTE_NEEDLE}') > 0 GROUP BY source""")
def q_newest_matching_note(spark, sf_dir):
    d = _m(spark, sf_dir).table("documents").select("source", "doc_id", "text", "lang")
    return tp.newest_matching(d, "source", "doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), NOTE_NEEDLE)


# --- F9 / F10 request telemetry ---------------------------------------------------------
def _request_log(ev0):
    k = F.col("k")
    slugs = [a["slug"] for a in catalog_dict()["automations"]]
    by_pos = F.element_at(F.array(*[F.lit(s) for s in slugs]), (k % len(slugs) + 1).cast("int"))
    path = (F.when(k % 6 == 0, "/api/v1/generate")
            .when(k % 6 == 1, "/api/v1/ai/run/@cf/meta/llama-3.1-8b-instruct-fp8-fast")
            .when(k % 6 == 2, "/api/v1/keys").when(k % 6 == 3, "/api/v1/run/old-shortcut")
            .otherwise(F.concat(F.lit("/api/v1/run/"), by_pos)))
    failed = F.when(k % 4 == 0, 402).when(k % 4 == 1, 422).when(k % 4 == 2, 429).otherwise(502)
    status = F.when(F.col("event_type") == "error", failed).when(F.col("event_type") == "signup", 400).otherwise(200)
    finished = F.col("created_at") + F.floor(F.col("value") * 10).cast("long") - \
        F.when(k % 13 == 0, F.lit(100000)).otherwise(F.lit(0))
    return ev0.select(F.col("event_id").alias("request_id"),
                      F.when(k % 17 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"),
                      status.cast("int").alias("status"), F.col("created_at").alias("started_at"),
                      finished.alias("finished_at"),
                      F.when(k % 19 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
                      (k % 4 == 0).alias("can_mint"))


def _request_log_sql() -> str:
    slugs = [a["slug"] for a in catalog_dict()["automations"]]
    arr = "[" + ", ".join(f"'{s}'" for s in slugs) + "]"
    return f"""reqlog AS (SELECT event_id AS request_id, CASE WHEN k % 17 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE k % 6 WHEN 0 THEN '/api/v1/generate' WHEN 1 THEN '/api/v1/ai/run/@cf/meta/llama-3.1-8b-instruct-fp8-fast'
    WHEN 2 THEN '/api/v1/keys' WHEN 3 THEN '/api/v1/run/old-shortcut'
    ELSE concat('/api/v1/run/', {arr}[k % {len(slugs)} + 1]) END AS path,
  CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 402 WHEN 1 THEN 422 WHEN 2 THEN 429 ELSE 502 END
    WHEN event_type = 'signup' THEN 400 ELSE 200 END AS status,
  created_at AS started_at,
  created_at + CAST(floor(value * 10) AS BIGINT) - CASE WHEN k % 13 = 0 THEN 100000 ELSE 0 END AS finished_at,
  CASE WHEN k % 19 = 0 THEN NULL ELSE user_id END AS user_id, k % 4 = 0 AS can_mint FROM ev0),
known(slug) AS (SELECT unnest({arr}))"""


REQUEST_EVENTS_SQL = with_base("""SELECT request_id AS id, CASE WHEN status = 200 THEN 'run_succeeded' ELSE 'run_failed' END AS event_name,
  user_id, CASE WHEN starts_with(path, '/api/v1/run/') THEN COALESCE(k.slug, 'retired-shortcut')
    WHEN ends_with(path, '/generate') THEN 'custom-api' ELSE 'raw-api' END AS slug, status,
  greatest(0, finished_at - started_at) AS duration_ms,
  CASE WHEN can_mint THEN 'iphone-app' WHEN starts_with(path, '/api/v1/run/') THEN 'shortcut-key' ELSE 'api' END AS source,
  finished_at AS created_at
FROM reqlog r LEFT JOIN known k ON starts_with(r.path, '/api/v1/run/') AND k.slug = split_part(r.path, '/', 5)
WHERE method = 'POST' AND regexp_matches(path, '^/api/v1/(run/[^/]+|generate|ai/run/.+)$') AND user_id IS NOT NULL""",
    _request_log_sql())


@register("request_events", REQUEST_EVENTS_SQL)
def q_request_events(spark, sf_dir):
    from meterline.operators.telemetry import request_events
    return request_events(_request_log(_m(spark, sf_dir).ev0), read_catalog(spark))


# --- L4 / X23 classification answers over parsed choices ---------------------------------
# Fixed rule: the model answers the choice at position (conv_id % n) + 1, except every third
# turn, which answers an unlisted "Other"; even conversations nest the answer under "result".
CLASSIFICATION_SQL = f"""WITH ch AS ({CHOICES_SQL}),
  lists AS (SELECT conv_id, turn, list(name ORDER BY idx) AS names FROM ch GROUP BY conv_id, turn),
  turns AS (SELECT c.conv_id, c.turn, {_jslen('c.text')} AS chars, COALESCE(l.names, []::VARCHAR[]) AS names
    FROM conversations c LEFT JOIN lists l ON l.conv_id = c.conv_id AND l.turn = c.turn WHERE c.role = 'user'),
  ans AS (SELECT *, CASE WHEN turn % 3 = 0 OR len(names) = 0 THEN 'Other' ELSE names[conv_id % len(names) + 1] END AS pick FROM turns),
  js AS (SELECT *, CASE WHEN conv_id % 2 = 0
      THEN json_object('result', json_object('answers', json_object('category', json_object('choice', pick, 'confidence', 0.9))))
      ELSE json_object('answers', json_object('category', json_object('choice', pick, 'confidence', 0.9))) END AS answer FROM ans),
  r AS (SELECT conv_id, turn, chars, names, COALESCE(json_extract_string(answer, '$.answers.category.choice'),
    json_extract_string(answer, '$.result.answers.category.choice')) AS choice FROM js)
SELECT conv_id, turn, choice, CAST(CASE WHEN len(names) < 2 THEN 400 WHEN list_contains(names, choice) THEN 200 ELSE 502 END AS INTEGER) AS status,
  CAST(CASE WHEN len(names) < 2 THEN NULL WHEN list_contains(names, choice)
    THEN greatest(1, ceil((CAST(ceil(chars / 4) AS BIGINT) + 300) * CAST(0.042 AS DOUBLE) * CAST(1.5 AS DOUBLE))) ELSE 0 END AS BIGINT) AS cost_micros
FROM r"""


@register("classification_answers", CLASSIFICATION_SQL)
def q_classification_answers(spark, sf_dir):
    turns = (_m(spark, sf_dir).table("conversations").where(F.col("role") == "user")
             .select("conv_id", "turn", tp.js_length(F.col("text")).alias("chars"),
                     F.coalesce(F.transform(tp.parse_choices(F.col("text")), lambda c: c["name"]),
                                F.array().cast("array<string>")).alias("names")))
    n = F.size("names")
    pick = F.when((F.col("turn") % 3 == 0) | (n == 0), F.lit("Other")) \
        .otherwise(F.element_at("names", (F.col("conv_id") % n + 1).cast("int")))
    inner = F.struct(F.struct(F.struct(pick.alias("choice"), F.lit(0.9).alias("confidence")).alias("category"))
                     .alias("answers"))
    answer = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(inner.alias("result")))) \
        .otherwise(F.to_json(inner))
    a = turns.withColumn("choice", tp.answered_choice(answer))
    status, cost = tp.classification_result(F.col("names"), F.col("choice"), F.col("chars"))
    return a.select("conv_id", "turn", "choice", status.cast("int").alias("status"), cost.alias("cost_micros"))


# --- X8 image values, X18 cost labels ---------------------------------------------------
_IMAGE = """CASE doc_id % 5 WHEN 0 THEN concat('data:image/png;base64,', base64(encode(substring(text, 1, 30)))) WHEN 1 THEN concat(' /9j/', doc_id, chr(10), 'ab')
  WHEN 2 THEN concat('iVBOR', substring(text, 1, 9)) WHEN 3 THEN 'data:image/tiff;base64,AAAA' ELSE text END"""


@register("image_values", f"""SELECT doc_id, CASE WHEN regexp_matches(v, '^data:image/(jpeg|png|webp|gif);base64,') THEN v
  WHEN starts_with(v, '/9j/') THEN concat('data:image/jpeg;base64,', v) WHEN starts_with(v, 'iVBOR') THEN concat('data:image/png;base64,', v)
  ELSE '' END AS image_url FROM (SELECT doc_id, regexp_replace({_IMAGE}, '[\\t\\n\\x0B\\f\\r ]+', '', 'g') AS v FROM documents)""")
def q_image_values(spark, sf_dir):
    """X8 over typed, bare and other values derived from the documents."""
    i = F.col("doc_id") % 5
    v = (F.when(i == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.substring("text", 1, 30), "UTF-8"))))
         .when(i == 1, F.concat(F.lit(" /9j/"), F.col("doc_id").cast("string"), F.lit("\nab")))
         .when(i == 2, F.concat(F.lit("iVBOR"), F.substring("text", 1, 9))).when(i == 3, "data:image/tiff;base64,AAAA").otherwise(F.col("text")))
    return _m(spark, sf_dir).table("documents").select("doc_id", tp.image_url(v).alias("image_url"))


@register("cost_labels", with_base("""SELECT id, CASE WHEN c < 0.01 THEN '<0.01¢' ELSE concat('~', regexp_replace(CAST(two AS VARCHAR), '\\.0$', ''), '¢') END AS label
FROM (SELECT id, c, CASE WHEN e < 0 THEN round(c / pow(10.0, e)) / pow(10.0, -e) ELSE round(c / pow(10.0, e)) * pow(10.0, e) END AS two
  FROM (SELECT *, floor(log10(c)) - 1 AS e FROM (SELECT id, cost_micros / 1000000.0::DOUBLE * 100 AS c FROM cost WHERE cost_micros > 0)))""",
    qp.PRICES, qp.PRICED, qp.TOKENS, qp.COST))
def q_cost_labels(spark, sf_dir):
    """The cost of each metered request in cents, two significant digits."""
    cost = pr.usage_cost(_m(spark, sf_dir).usage, D.text_prices(spark)).where("cost_micros > 0")
    return cost.select("id", cg.cost_label(F.col("cost_micros") / F.lit(1_000_000.0)).alias("label"))
