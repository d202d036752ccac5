"""Token ids of whole texts: each distinct pre-token is encoded once in a worker process and kept for its later tasks."""
from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from deltascope.llm import pretokens

#: A worker forgets its pre-tokens when it knows this many. Ids do not depend on it.
KNOWN_PRETOKENS = 600_000


class PretokenIds:
    """Ids of texts, put together from the ids of their pre-tokens.

    `encode_new` turns a list of pre-tokens into a list of id lists; it is called for those not yet known.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[list[int]]], most: int = KNOWN_PRETOKENS):
        self.encode_new, self.most = encode_new, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[k + 1] is where the ids of pre-token k end

    def _learn(self, words: list[str]) -> None:
        lists = self.encode_new(words)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        have, used = len(self.known), int(self.ends[len(self.known)])
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(2 * used + len(ids), np.uint32)])
        if have + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: have + 1], np.zeros(2 * have + len(words), np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.ends[have + 1 : have + 1 + len(words)] = used + np.cumsum(lengths)
        self.known.update(zip(words, range(have, have + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) and the len + 1 places where the ids of each text begin and end."""
        tokens, places = pretokens.split(texts)
        if not len(tokens):
            return np.zeros(0, np.uint32), np.zeros(len(places), np.int64)
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > self.most:
            self._forget()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        begin = self.ends[rows]
        lengths = self.ends[rows + 1] - begin
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends + lengths, lengths)]
        return ids, np.concatenate([[0], ends])[places]


class AddedTokenIds:
    """Ids of texts in which added tokens stand: those found first get their ids, `between` codes what lies between.

    `find` gives the characters of a text that an added token takes, with its id: (id, start, stop), ascending.
    `marks` are contents without which a text has none.
    """

    def __init__(self, between: PretokenIds, marks: list[str], find: Callable[[str], list[tuple[int, int, int]]]):
        self.between, self.find = between, find
        self.pattern = "|".join(re.escape(x) for x in marks)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As PretokenIds.encode."""
        marked = np.flatnonzero(pc.match_substring_regex(texts, self.pattern).to_numpy(zero_copy_only=False))
        if not len(marked):
            return self.between.encode(texts)
        parts, owners, added = [], [], []  # after each part comes its added token, or none (-1)
        last = 0
        for k in marked.tolist():
            parts.append(texts.slice(last, k - last))
            owners.append(np.arange(last, k))
            added.append(np.full(k - last, -1, np.int64))
            text, at, pieces, ids = texts[k].as_py(), 0, [], []
            for number, start, stop in self.find(text):
                pieces.append(text[at:start])
                ids.append(number)
                at = stop
            parts.append(pa.array([*pieces, text[at:]], texts.type))
            owners.append(np.full(len(pieces) + 1, k))
            added.append(np.array([*ids, -1], np.int64))
            last = k + 1
        parts.append(texts.slice(last))
        owners.append(np.arange(last, len(texts)))
        added.append(np.full(len(texts) - last, -1, np.int64))
        owner, after = np.concatenate(owners), np.concatenate(added)
        coded, bounds = self.between.encode(pa.concat_arrays(parts))
        out = np.insert(coded, bounds[1:][after >= 0], after[after >= 0].astype(np.uint32))
        ends = bounds[1:] + np.cumsum(after >= 0)
        lengths = np.diff(np.concatenate([[0], ends]))
        return out, np.concatenate([[0], np.cumsum(np.bincount(owner, lengths, minlength=len(texts)).astype(np.int64))])


@functools.lru_cache(maxsize=1)
def library_encoder(path: str) -> PretokenIds | AddedTokenIds:
    """Ids by the tokenizers library, as encode(text, add_special_tokens=False) of the file gives them.

    The file's added tokens are matched in whole texts, by the library; the texts between them are coded by
    pre-tokens. The file's pre-tokenizer must be the byte-level one with its pattern, which `pretokens` has applied by
    then; the library is only spared the search for matches within a pre-token. A worker process keeps the encoder.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    file = json.loads(tokenizer.to_str())
    form = file["pre_tokenizer"]
    if not (form and form["type"] == "ByteLevel" and form["use_regex"] and not form["add_prefix_space"]):
        raise ValueError(f"{path}: not a byte-level pre-tokenizer without a prefix space")
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    between = PretokenIds(lambda words: [x.ids for x in encode(words, add_special_tokens=False)])
    if not file["added_tokens"]:
        return between
    if file["normalizer"] is not None:
        raise ValueError(f"{path}: added tokens and a normalizer")
    numbers = {x["id"] for x in file["added_tokens"]}
    finder = Tokenizer.from_file(path)

    def find(text: str) -> list[tuple[int, int, int]]:
        coded = finder.encode(text, add_special_tokens=False)
        return [(i, *span) for i, span in zip(coded.ids, coded.offsets) if i in numbers]

    return AddedTokenIds(between, [x["content"] for x in file["added_tokens"]], find)


def with_end_ids(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end` after each text."""
    longer = bounds + np.arange(len(bounds))
    out = np.full(longer[-1], end, np.uint32)
    kept = np.ones(longer[-1], bool)
    kept[longer[1:] - 1] = False
    out[kept] = ids
    return out, longer
