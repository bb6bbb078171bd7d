"""Token ids of whole texts with the ``tokenizers`` library, each different segment encoded once per worker.

Both public vocabularies split a text before any merge: the byte-level one in front of a
space that starts a word and around line feeds, the word-level one at white space. Segments cut there encode
on their own to the same ids as in the text, so a worker keeps the ids of segments it has
seen. Texts with rarer white space or control signs are encoded whole. The memory is bounded: a
cache that reaches ``CACHE`` segments is emptied.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

CACHE = 1_500_000
PIECE = 1 << 20  # characters of a text that are looked at together
_JOIN = 512  # new segments that go to the library in one string, set apart by a special token
_ODD = {
    "space": re.compile(r"[\x00-\x09\x0b-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"),
    "word": re.compile(r"[\x00-\x08\x0e-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]"),
}
_RUNS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_BETWEEN = re.compile(r"(?<=[^ \n]) (?=[^ \n])")
_OPEN: dict[str, "Encoder"] = {}


def _space_segments(text: str) -> list[str]:
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
        return _RUNS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.joined = Tokenizer.from_file(path)
        self.vocabulary = self.plain.get_vocab_size()
        self.mark, self.mark_id = "<|endoftext|>", self.plain.token_to_id("<|endoftext|>")
        self.kind = "word" if self.plain.normalizer is not None else "space"
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        easy = [s for s in new if "<|" not in s]
        for s in new:
            if "<|" in s:
                self.cache[s] = self.whole(s)
        parts = [easy[at:at + _JOIN] for at in range(0, len(easy), _JOIN)]
        found = self.joined.encode_batch_fast([self.mark.join(p) for p in parts], add_special_tokens=False)
        for part, encoding in zip(parts, found):
            ids = np.array(encoding.ids, dtype="<u4")
            raw = ids.tobytes()
            cuts = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            if len(cuts) != len(part) - 1:
                raise RuntimeError("the segments of a batch were not set apart")
            for s, lo, hi in zip(part, [-4, *cuts], [*cuts, len(raw)]):
                self.cache[s] = raw[lo + 4:hi]

    def _pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces that end where a new segment starts: before a space between two words."""
        at = 0
        while len(text) - at > PIECE and (m := _BETWEEN.search(text, at + PIECE)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = str.split if self.kind == "word" else _space_segments
        cut = [split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set().union(*cut).difference(self.cache)
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, segments)) for segments in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; at most about ``PIECE`` characters are held as segments at a time."""
        odd, out, held, size = _ODD[self.kind], [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if odd.search(text):
                out[i] = self.whole(text)
            elif len(text) > PIECE:
                out[i] = b"".join(self._encode([piece])[0] for piece in self._pieces(text))
            else:
                held.append(i)
                size += len(text)
            if size > PIECE:
                for k, raw in zip(held, self._encode([texts[k] for k in held])):
                    out[k] = raw
                held, size = [], 0
        if held:
            for k, raw in zip(held, self._encode([texts[k] for k in held])):
                out[k] = raw
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it stays open between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
