"""Token ids by the tokenizers library; a word that was seen before is not encoded again."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from fieldglass.llm import words as W

#: Words kept by one worker, after which it starts anew: about 120 MB.
MOST_WORDS = 1_500_000
#: A tokenizer that cuts texts so cuts them at every ASCII white space, and between a-z and ASCII punctuation but the
#: apostrophe, whatever stands around; so the pieces between can be encoded one by one. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: 0 white space, 1 a-z and A-Z, 2 ASCII punctuation but the apostrophe, 3 anything else.
KIND = np.full(256, 3, np.uint8)
KIND[W.SPACE] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
#: Words that are one piece for SPLIT.
WHOLE = re.compile("[a-zà-öø-ÿÀ-ÖØ-ß]+|[!-&(-/:-@\\[-`{-~]+")


def word_wise(path: str) -> bool:
    """Whether the tokenizer in this file cuts texts by SPLIT after NFC, white space and lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": SPLIT}
        and not cuts[1]["add_prefix_space"]
        and not cuts[1].get("use_regex", True)
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    )


class Encoder:
    """texts -> ids, the same as Tokenizer.encode(text, add_special_tokens=False).

    Words that were encoded before are told apart by 128 bits: those of up to 15 bytes by the bytes themselves, longer
    ones by a cryptographic hash.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_wise = word_wise(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.last = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known = W.Numbering(2)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.n_ids = 0

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def add(self, low: np.ndarray, high: np.ndarray, found: list[str]) -> None:
        """Encode words that aren't known, and keep them."""
        ids: list[list[int] | None] = [None] * len(found)
        plain = [i for i, w in enumerate(found) if WHOLE.fullmatch(w)]
        for k in range(0, len(plain), 400):
            some = plain[k : k + 400]
            flat = np.array(self.tokenizer.encode(" ".join(found[i] for i in some), add_special_tokens=False).ids)
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(some) and ends[-1] == len(flat):
                for i, part in zip(some, np.split(flat, ends[:-1]), strict=True):
                    ids[i] = part
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.encode_all([found[i] for i in rest]), strict=True):
            ids[i] = x
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.asarray(x, self.kind) for x in ids]).astype(self.kind)
        new = slice(self.known.n, self.known.n + len(low))
        self.known.add(low, high)
        if new.stop > len(self.start):
            grown = lambda x: np.concatenate([x[: new.start], np.zeros(2 * new.stop - new.start, np.int64)])
            self.start, self.length = grown(self.start), grown(self.length)
        if self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(1 << 15, self.n_ids + 2 * len(flat)), self.kind)])
        self.start[new], self.length[new] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[at[i]:at[i + 1]]."""
        odd = self._odd(data, at)
        if len(odd) == len(at) - 1:
            return self._directly(data, at, odd)
        kind = KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] ^ kind[:-1]) == 3
        cut[1:] &= (kind[1:] != 0) & (kind[1:] != 3)
        starts, lengths, row = W.spans(kind != 0, at, cut)
        lower = W.LOWER[data]
        low, high = W.word_values(lower, starts, lengths)
        if self.known.n > MOST_WORDS:
            self.clear()
        number = self.known.find(low, high)
        raw = None
        while len(missing := np.flatnonzero(number < 0)):
            # One word of each hash; should two words share one, the other is left for the next turn.
            first = missing[np.unique(W.fold(low[missing], high[missing]), return_index=True)[1]]
            raw = lower.tobytes() if raw is None else raw
            words = [raw[b : b + n].decode("utf-8", "replace") for b, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
            self.add(low[first], high[first], words)
            number[missing] = self.known.find(low[missing], high[missing])
        n = self.length[number]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[number] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[row]
        if not len(odd):
            return ids, offsets
        fixed, own = self._directly(data, at, odd)
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(at) - 1)]
        for k, i in enumerate(odd):
            parts[i] = fixed[own[k] : own[k + 1]]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that have to be encoded whole: they may hold the string of a special token."""
        if not self.word_wise:
            return np.arange(len(at) - 1)
        where = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        return np.unique(np.searchsorted(at, where, "right") - 1)

    def _directly(self, data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = self.encode_all([raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in rows.tolist()])
        flat = np.concatenate([np.zeros(0, self.kind), *(np.asarray(x, self.kind) for x in ids)]).astype(self.kind)
        return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file, kept from task to task."""
    return Encoder(path)


def encoded(column: pa.Array, path: str, end_id: int):
    """For a few rows at a time: (first row, ids with end_id after each text, offsets)."""
    tool = encoder(path)
    data, at = W.texts(column)
    for i, j in W.chunks(at):
        ids, offsets = tool.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
        n = j - i
        out = np.empty(len(ids) + n, np.uint32)
        ends = offsets[1:] + np.arange(n)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[ends], out[body] = end_id, ids
        yield i, out, np.concatenate([[0], ends + 1])
