"""Golden cases G11, G12, G17 and text helpers."""

import json

from pyspark.sql import functions as F

from meterline.operators import catalog as cg
from meterline.operators import textprep as tp
from meterline.sources import dims as D
from meterline.sources.catalog import read_catalog


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r.x for r in df.select(expr(F.col("v")).alias("x")).collect()]


def test_g12_choices(spark):
    out = col1(spark, ["Urgent: needs action today, or tomorrow\nNeeds reply; FYI", "Only one", "a,b: x,a: y"],
               tp.parse_choices)
    assert [(c.name, c.description) for c in out[0]] == [
        ("Urgent", "needs action today, or tomorrow"), ("Needs reply", "Needs reply"), ("FYI", "FYI")]
    assert len(out[1]) == 1  # fewer than two choices -> the request is rejected
    assert [(c.name, c.description) for c in out[2]] == [("a", "y"), ("b", "x")]  # last duplicate wins


def test_g11_structured_answers(spark):
    bad = ['{"meal":"","calories":1,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"' + "x" * 121 + '","calories":1,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","calories":"100","protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","calories":8.5,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","calories":-1,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","calories":10001,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","calories":null,"protein":1,"carbs":1,"fat":1}',
           '{"meal":"Toast","protein":1,"carbs":1,"fat":1}']
    good = 'Sure! {"meal":" Toast ","calories":250,"protein":8,"carbs":30,"fat":5} Enjoy.'
    obj = col1(spark, bad + [good, "[1,2]", "no json"], lambda c: tp.meal_valid(tp.json_object_text(c)))
    assert obj == [False] * 8 + [True, False, False]
    keys = col1(spark, ['x {"a":0,"b":false,"c":"","d":null,"e":[1],"f":"x"} y'],
                lambda c: tp.json_clean_keys(tp.json_object_text(c)))
    assert keys == [["a", "e", "f"]]


def test_g17_drop_empty_sections_and_transcript(spark):
    s = "Summary line\n\nDecisions\n- None\n\nActions\n- Call Bob\n\nRisks\n- none."
    out = col1(spark, [s], lambda c: tp.with_transcript(c, F.lit("hello")))
    assert out == ["Summary line\n\nActions\n- Call Bob\n\nTranscript\nhello"]
    # A section followed by a lone trailing newline is not at the end of the text: kept.
    kept = col1(spark, ["S\n\nDecisions\n- None\n", "S\n\nA\n- None\n\nB\n- NONE."], tp.drop_empty_sections)
    assert kept == ["S\n\nDecisions\n- None\n", "S"]


def test_secret_scan_and_redaction(spark):
    df = spark.createDataFrame([(1, "key aa_live_AbC-12_x and aa_live_z end"), (2, "clean")], "id long, t string")
    got = {r.id: (r.n_secrets, r.chars - r.redacted_chars) for r in tp.secret_scan(df, "id", "t").collect()}
    assert got[1][0] == 2 and got[2] == (0, 0)
    red = df.select(F.regexp_replace("t", tp.SECRET_PATTERN, tp.SECRET_REDACTION).alias("r")).collect()[0].r
    assert "AbC" not in red and red.count("aa_live_[redacted]") == 2


def test_image_sniff(spark):
    out = col1(spark, ["data:image/png;base64,iVBOR", "/9j/ab c\n", "iVBORxx", "hello", None], tp.image_url)
    assert out == ["data:image/png;base64,iVBOR", "data:image/jpeg;base64,/9j/abc",
                   "data:image/png;base64,iVBORxx", "", ""]


def test_prompt_template_and_choice_fallback(spark):
    cat = read_catalog(spark)
    req = spark.createDataFrame([
        (1, "letter-polish", "hi there", "official", "Keep it short.", False),
        (2, "letter-polish", "hi", "sarcastic", "", False),        # unknown choice -> first option
        (3, "free-request", "  ", None, "", False),                      # empty input -> 400
        (4, "free-request", "what is 2+2", None, "", False),             # empty prompt -> input is the prompt
        (5, "plate-check", "", None, None, False),               # image required
        (6, "field-finder", "text", None, "", False),          # needs instructions
        (7, "no-such", "x", None, None, False)],
        "request_id long, slug string, input string, choice string, instructions string, has_image boolean")
    out = {r.request_id: r for r in tp.prompt_table(req, cat).collect()}
    assert out[1].content == "Give the letter a official voice. Keep it short.\n\n<input>\nhi there\n</input>"
    assert out[2].content.startswith("Give the letter a warm voice.")
    assert out[3].status == 400 and out[4].content == "what is 2+2" and out[4].status == 200
    assert out[5].status == 400 and out[6].status == 400 and out[7].status == 404


def test_catalog_related_featured_public(spark):
    cat = read_catalog(spark)
    rel = [r.slug for r in cg.related(cat, "free-request").collect()]
    assert rel == ["boil-down", "letter-polish"]  # pairWith order, unknown slugs dropped
    feat = [r.slug for r in cg.featured(cat, ["letter-polish", "missing", "free-request"]).collect()]
    assert feat == ["letter-polish", "free-request"]
    pub = cg.export_json(cg.public_catalog(cat)).collect()
    first = json.loads(pub[0].json)
    assert "prompt" not in first and "model" not in first and "icloudUrl" not in first and first["slug"] == "free-request"
    hits = {r.slug for r in cg.matching(cat, "branching", ["name", "tagline", "category"]).collect()}
    assert hits == {"drawer-sorter"}
    blocks = {r.slug for r in cg.matching(cat, "", ["name"], blocks_only=True).collect()}
    assert "letter-polish" not in blocks and "free-request" in blocks
    costs = {r.slug: r.typicalCost for r in cg.typical_cost(cat, D.text_prices(spark)).collect()}
    assert abs(costs["free-request"] - (__import__("math").ceil((700 * 0.293 + 300 * 2.253) * 1.5)) / 1e6) < 1e-12
    assert costs["drawer-sorter"] == 32 / 1e6  # ceil(500 * 0.042 * 1.5) micro-dollars


def test_cost_label(spark):
    out = col1(spark, [0.0000001, 0.001109, 0.0123], cg.cost_label, "double")
    assert out[0] == "<0.01¢" and out[1] == "~0.11¢" and out[2] == "~1.2¢"


def test_js_length_and_trim(spark):
    out = col1(spark, ["a\U0001F600", "abc", ""], tp.js_length)
    assert out == [3, 3, 0]  # a character above U+FFFF is two UTF-16 code units
    out = col1(spark, ["\t  x y　\n", "﻿z"], tp.js_trim)
    assert out == ["x y", "z"]


def test_catalog_category_pruning_and_metadata_merge(spark):
    from meterline.sources.catalog import catalog_dict
    cat = read_catalog(spark)
    cats = catalog_dict()["categories"]
    assert [r.category for r in cg.visible_categories(cat, cats).collect()] == \
        ["Basics", "Wording", "Recordings", "Kitchen"]  # no Household items in this catalog
    hidden = ["plate-check"]
    assert "Kitchen" not in [r.category for r in cg.visible_categories(cat, cats, hidden).collect()]
    assert [r.category for r in cg.categories_without_blocks(cat, cats).collect()] == \
        ["Wording", "Household", "Recordings", "Kitchen"]
    meta = spark.createDataFrame([("free-request", "Other", ["x"]), ("no-such", "Y", ["y"])],
                                 "slug string, input string, extra array<string>")
    merged = {r.slug: r for r in cg.merge_metadata(cat, meta).collect()}
    assert merged["free-request"].input == "Plain text" and merged["free-request"].extra == ["x"]
    assert "no-such" not in merged and merged["letter-polish"].extra is None


def test_answer_documents(spark):
    rows = [("json", 'Sure: {"b": 1.0, "a": false, "2": "x", "1": [], "n": null, "e": "", "z": 0, "s": "1.0, \\"5.0\\"", "o": {"k": 2.50, "f": false}} ok'),
            ("json", "no object"), ("json", "{}"), ("json", '{"a": 1, "b": 2, "a": 3}'),
            ("meal", '{"meal": " Soup ", "calories": 10.0, "protein": 1, "carbs": 2, "fat": 0, "more": 1}'),
            ("meal", '{"meal": "Soup", "calories": "10", "protein": 1, "carbs": 2, "fat": 0}'), (None, "as it is"), ("meal", None)]
    status, document = tp.answer_document(F.col("kind"), F.col("text"))
    out = [tuple(r) for r in spark.createDataFrame(rows, "kind string, text string").coalesce(1).select(status, document).collect()]
    assert out == [(200, '{"1":[],"2":"x","b":1,"z":0,"s":"1.0, \\"5.0\\"","o":{"f":false,"k":2.5}}'), (422, None), (200, "{}"), (200, '{"a":3,"b":2}'),
                   (200, '{"meal":"Soup","calories":10,"protein":1,"carbs":2,"fat":0}'), (422, None), (200, "as it is"), (422, None)]
