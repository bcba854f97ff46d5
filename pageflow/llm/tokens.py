"""Ids of a byte-level BPE vocabulary: those of the tokenizers library, at several times its speed.

The library reads the vocabulary and says what is an added token.  Merging is done by
tiktoken, which takes the adjacent pair that makes the entry of least rank; the library
takes the pair that comes first in its list of merges.  ``ranked`` proves for a
vocabulary that both are one: the rank rule alone splits every entry into just the two
parts that its own merge joins.  As no pair that crosses an entry's edges was merged
before the entry is made, its inside was merged as it would be alone, so no other pair
can make it.  Both cut texts by one pattern, which is applied here only to texts whose
characters lie in ranges whose Unicode categories never changed.  Any other text, one
that holds an added token, and every text of a vocabulary without the proof goes to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: The pre-token pattern of byte-level vocabularies (a fixed value; \s spelt out).
_SPACE = r"\t-\r \x85\xa0"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_UNSURE = re.compile("[^\x00-ɏ‐-‧]")
#: Characters from which on a text's ids are fetched as a buffer, not as a list.
LONG = 1 << 20


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _entries(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]] | None:
    """(id of each entry, merges in order) of a plain byte-level BPE, else None."""
    with open(path, encoding="utf-8") as source:
        held = json.load(source)
    model, cut = held["model"], held["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or held["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    byte_of = {letter: byte for byte, letter in _byte_letters().items()}
    ids = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    merges = [tuple(bytes(byte_of[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return ids, merges


def _split(entry: bytes, ids: dict[bytes, int]) -> list[bytes]:
    """What the rank rule makes of an entry's bytes without the entry itself."""
    parts, limit = [entry[i : i + 1] for i in range(len(entry))], ids[entry]
    while len(parts) > 2:
        rank, i = min((ids.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=4)
def ranked(path: str) -> bool:
    """Whether merging by rank gives the library's ids (see above); the driver proves it once."""
    found = _entries(path)
    if found is None or any(bytes([b]) not in found[0] for b in range(256)):
        return False
    ids, merges = found
    made = [a + b for a, b in merges]
    order = [ids.get(entry, -1) for entry in made]
    if len(ids) != 256 + len(made) or order != sorted(order) or order and order[0] < 256:
        return False
    return all(_split(a + b, ids) == [a, b] for a, b in merges)


class Encoder:
    """``encode(text)`` -> unsigned 32-bit ids of a text; equal to the library's own."""

    def __init__(self, path: str, by_rank: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.rank = Tokenizer.from_file(path), None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([_UNSURE.pattern, *added])).search
        if by_rank:
            import tiktoken

            self.rank = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=_entries(path)[0], special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        """The ids of one text, then ``end_id`` if there is one."""
        last = [] if end_id is None else [end_id]
        if not text:
            return np.array(last, np.uint32)
        if self.rank is None or self.special(text):  # the library cuts added tokens out before its pattern
            return np.append(self.whole(text), np.array(last, np.uint32))
        if len(text) >= LONG:
            return np.append(self.rank.encode_to_numpy(text, disallowed_special=()), np.array(last, np.uint32))
        ids = self.rank.encode_ordinary(text)
        ids += last
        return np.array(ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, by_rank: bool) -> Encoder:
    """One encoder a Python worker and vocabulary; threads stay with Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, by_rank)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
