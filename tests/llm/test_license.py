import re

from meterline.llm import license
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for label, phrase in license.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = ["Released UNDER the MIT-License. under the mit license", "cc by nc cc by nc, CC BY-NC 4.0", "cc cc by nc",
         "Licensed under the Apache License, Version 2.0.", "under the mit licenses", "é under é the mit license",
         "under the mit Kicense liſcense", "x" * 5000 + " cc by nc",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its "
         "associated documentation files (the Software), to deal in the Software without restriction"]


def test_scan_matches_plain_search_and_handles_edges(make_docs):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = license.scan(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, plain(t))) for i, t in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)))
                  for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got) and by_id[2].score == 0 and by_id[2].labels == ""
    assert by_id[103].labels == "apache-2" and by_id[101].labels == "cc-by-nc"
    assert by_id[108].n_base == 0 and by_id[108].labels == "mit" and by_id[108].score < 1  # a word put in
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license.scan(make_docs([])).count() == 0


def test_main_path_is_native(make_docs):
    plan = license.scan(make_docs(EDGE))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
