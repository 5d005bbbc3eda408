"""Token ids of whole texts, encoded inside tasks.

The vocabulary lower-cases, drops white space and never joins letters with other characters, so
a text encodes as the concatenation of its parts between blanks and line feeds, and a final full
stop or comma after a letter is a part of its own. Each worker encodes a part once and remembers
its ids; unknown words of letters are encoded together and cut apart where a token ends a word.
Texts beyond Latin-1, or with what may be a special token, take parts unchanged.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Parts remembered by a worker before it starts afresh, and the longest part remembered.
REMEMBERED_PARTS = 700_000
LONGEST_PART = 64
#: Characters handled at a time inside an Arrow batch.
GROUP_CHARS = 1 << 20
_SHELF = "_terrapanel_llm_worker"
_STOP = re.compile(r"([a-z\xdf-\xf6\xf8-\xff])([.,])(?= |$)")


def worker_shelf() -> dict:
    """A dictionary that lives as long as the Python worker, which Spark reuses between tasks."""
    if _SHELF not in sys.modules:
        module = types.ModuleType(_SHELF)
        module.kept = {}
        sys.modules[_SHELF] = module
    return sys.modules[_SHELF].kept


class PartEncoder:
    """Encode texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.ends_word = np.zeros(self.vocabulary_size, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of_worker(cls, path: str) -> PartEncoder:
        shelf = worker_shelf()
        if ("encoder", path) not in shelf:
            shelf["encoder", path] = cls(path)
        return shelf["encoder", path]

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        letters = [p for p in parts if p.isalpha()]
        out = {}
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(letters):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                out = {p: raw[a:b] for p, a, b in zip(letters, [0, *ends[:-1]], ends)}
        rest = [p for p in parts if p not in out]
        if rest:
            found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            out.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(rest, found))
        return out

    @staticmethod
    def _parts(text: str | None) -> list[str]:
        if not text:
            return []
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if "<|" in text:
            return text.replace("\n", " ").split(" ")
        return _STOP.sub(r"\1 \2", text.lower().replace("\n", " ")).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        split = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED_PARTS:
            self.known = {"": b""}
        known = self.known
        missing = list({p for parts in split for p in parts}.difference(known))
        fresh = self._encode(missing) if missing else {}
        long = {p: ids for p, ids in fresh.items() if len(p) > LONGEST_PART}
        if not long:
            known.update(fresh)
            return [b"".join(map(known.__getitem__, parts)) for parts in split]
        known.update((p, ids) for p, ids in fresh.items() if p not in long)
        return [b"".join(known[p] if p in known else long[p] for p in parts) for parts in split]


def in_groups(texts: Iterable[str | None], size: int = GROUP_CHARS) -> Iterator[list[str | None]]:
    """Consecutive texts, cut into lists of about ``size`` characters."""
    group, total = [], 0
    for t in texts:
        group.append(t)
        total += len(t or "")
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def encoded(encoder: PartEncoder, texts: Iterable[str | None]) -> Iterator[bytes]:
    """Ids of the texts in order, a bounded group of texts at a time."""
    for group in in_groups(texts):
        yield from encoder.encode(group)
