"""Secret scan (operator 4): fixed patterns plus dictionary-primed zstandard novelty.

Besides the fixed kinds, a long run of key-like signs behind a name part such as ``key`` or ``secret`` is a candidate if it looks like a
value: an equals sign, a colon or a quote stands before it, or letters of both cases and digits take turns in it. Its novelty is its marginal
compressed size: the bytes that it adds when it is compressed after its surrounding code and the common words that
it holds, with a dictionary of common identifiers to draw on. Names, paths, words and numbers that these already know add little; a random
string adds nearly a byte a sign and is reported as kind ``novel``.

The time grows with the length of a text: spans are compared in one sorted sweep, and a candidate is measured with a context of bounded length.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import column, doc_columns, map_texts, texts
from meterline.llm.tokens import public_path

KINDS = ("assign", "access", "hex", "novel")
# The base patterns; keywords in either case of A-Z only.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", k) for k in _KEYWORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 characters or more
_MAY_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Signs of a value; an equals sign parts name and value, and only pads a value at its end.
_PART = re.compile("[A-Za-z0-9+/_.-]+")
_RUN = re.compile("[A-Za-z0-9+/_.=-]*")
_PAD = re.compile("={1,2}(?![A-Za-z0-9+/_.=-])")
# Sensitive name parts, and what a part may be besides them: a plural or a longer form.
_SENSITIVE = ("key", "token", "secret", "passw", "passphrase", "pwd", "auth", "credential", "bearer", "private", "signature")
_PARTS = {*_SENSITIVE, "keys", "tokens", "secrets", "password", "passwords", "passwd", "authorization", "credentials", "signatures",
          "apikey", "apikeys", "authkey", "authtoken", "accesskey", "secretkey", "privatekey", "sshkey", "signingkey"} - {"passw"}
LEAST, LOOK_BACK, AROUND = 12, 48, 256
# Marginal compressed bytes per sign from which a candidate counts as incompressible.
NOVELTY = 0.7
# A run in which the class of signs (small, capital, digit) changes once every so many signs is mixed.
MIXED = 6
_BEFORE = re.compile(r"""(?:[=:]\x20*["'`]?|["'`])\Z""")
_LETTERS = re.compile("[a-z]+")
WORD, LONGEST_WORD = 4, 20  # letters of the common words that are looked for in a candidate
# Common code and identifier words that prime the compressor.
DICTIONARY = " ".join(
    f"{a}{b}{c}" for a in ("get", "set", "is", "new", "the", "my") for b in ("_", "", ".")
    for c in ("user", "name", "value", "config", "client", "service", "request", "response", "version", "example",
              "default", "string", "import", "return", "function", "public", "static", "class", "authorization",
              "localhost", "https://www.example.com/", "application/json", "0123456789", "abcdefghijklmnopqrstuvwxyz",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "2024-01-01T00:00:00Z", "00000000", "1.0.0", "xxxxxxxx"))


class Novelty:
    """Marginal compressed bytes of a string after its context, with the identifier dictionary."""

    def __init__(self, dictionary: str = DICTIONARY, words: frozenset[str] = frozenset()):
        import zstandard
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False)
        self.words = words

    def common(self, candidate: str) -> str:
        """The common words that the letters of a candidate hold, longest first at each place."""
        found = []
        for run in _LETTERS.findall(candidate.lower()):
            at = 0
            while at + WORD <= len(run):
                size = next((n for n in range(min(LONGEST_WORD, len(run) - at), WORD - 1, -1) if run[at:at + n] in self.words), 0)
                if size:
                    found.append(run[at:at + size])
                at += size or 1
        return " ".join(found)

    def marginal(self, candidate: str, context: str) -> int:
        known = f"{self.common(candidate)} {context}".encode("utf-8", "replace")
        return len(self.zstd.compress(known + candidate.encode("utf-8", "replace"))) - len(self.zstd.compress(known))


def common_words(path: str) -> frozenset[str]:
    """Whole words of small letters in a public word-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in vocab if w.endswith("</w>") and WORD <= len(w) - 4 <= LONGEST_WORD and _LETTERS.fullmatch(w[:-4]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed kinds: leftmost non-overlapping matches of each pattern that meet its length, as ``(kind, start, end)``."""
    found = []
    small = text.encode("utf-8", "replace").lower()
    if any(k in small for k in _MAY_ASSIGN):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def sensitive_words(text: str) -> list[tuple[int, int]]:
    """Places of all sensitive name parts in either case, as ``(start, end)`` by start.

    A part begins where no letter stands before it or, as in ``apiKey``, at a capital behind a small letter, and ends where its letters or
    their case end.
    """
    small = text.lower()
    if len(small) != len(text):  # a letter whose small form is longer would shift the places
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = set()
    for word in _SENSITIVE:
        at = small.find(word)
        while at >= 0:
            lo, hi = at, at + len(word)
            at = small.find(word, at + 1)
            least = max(0, hi - LONGEST_WORD)
            while lo > least and text[lo - 1].isalpha() and not (text[lo - 1].islower() and text[lo].isupper()):
                lo -= 1
            upper, most = text[hi - 1].isupper(), min(len(text), lo + LONGEST_WORD)
            while hi < most and text[hi].isalpha() and text[hi].isupper() == upper:
                hi += 1
            if small[lo:hi] in _PARTS:
                found.add((lo, hi))
    return sorted(found)


def mixed(run: str) -> bool:
    """Whether small letters, capitals and digits take turns in a run, more often than in a name."""
    kinds = [c.isdigit() + 2 * c.isupper() for c in run if c.isalnum()]
    return MIXED * sum(a != b for a, b in zip(kinds, kinds[1:])) >= len(run)


def candidates(text: str) -> list[tuple[int, int]]:
    """Values of ``LEAST`` or more key-like signs behind a sensitive word, as ``(start, end)`` by start.

    The word ends before the value and starts at most ``LOOK_BACK`` signs before it, or stands in a name that an
    equals sign joins to the value (``NAME=value``).
    """
    found, at, run_end = [], 0, 0
    for lo, hi in sensitive_words(text):
        if hi > run_end:
            run_end = _RUN.match(text, hi).end()
        begin = max(hi, at)
        if begin == hi and (inside := _PART.match(text, hi - 1)):  # the word's own part is no value
            begin = at = inside.end()
        last = max(lo + LOOK_BACK, run_end)
        while m := _PART.search(text, begin, last + 1):
            start, begin = m.start(), _PART.match(text, m.start()).end()
            at, end = begin, start + len(text[start:begin].rstrip("."))
            if end - start >= LEAST:
                found.append((start, end))
    return found


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Sensitive-context candidates outside the ``taken`` spans (by start) that look like values and whose marginal bytes are near their length."""
    found = []
    starts, reach = [lo for _, lo, _ in taken], list(accumulate((hi for _, _, hi in taken), max))
    for start, end in candidates(text):
        before = bisect_left(starts, end)
        if before and reach[before - 1] > start:
            continue
        run = text[start:end]
        if not _BEFORE.search(text[max(0, start - 8):start]) and not mixed(run):
            continue
        context = text[max(0, start - AROUND):start] + text[end:end + AROUND]
        if novelty.marginal(run, context) >= NOVELTY * len(run):
            pad = _PAD.match(text, end)
            found.append(("novel", start, pad.end() if pad and (pad.end() - start) % 4 == 0 else end))
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_NOVELTY: dict[str, Novelty] = {}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_path: str | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)``: one row per input row.

    Spans are code-point offsets into the whole text, end exclusive, by start and then kind.
    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows
    and null ids are kept; other columns are ignored, whatever their names; empty input gives no rows. Very long texts are scanned whole, in
    time that grows with their length. Spans of one start are ordered by kind. ``words_path``: file of a public word-level vocabulary
    (default: the one of the ``word_bpe_49k`` tokenizer).
    """
    words_path = words_path or public_path("word_bpe_49k.json")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        novelty = _NOVELTY.get(words_path)
        if novelty is None:
            novelty = _NOVELTY[words_path] = Novelty(words=common_words(words_path))
        rows = []
        for text in texts(batch):
            base = base_spans(text)
            more = novel_spans(text, base, novelty)
            count = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
            rows.append((*count, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c) for c in cols[4:]]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return map_texts(docs, doc_columns(id_col, text_col),
                     "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
                     run)


def spans(scanned: DataFrame) -> DataFrame:
    """``(doc_id, kind, start, end)``: one row per span of a scan."""
    part = F.split("s", ":")
    return (scanned.where("spans <> ''").select("doc_id", F.explode(F.split("spans", ",")).alias("s"))
            .select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end")))
