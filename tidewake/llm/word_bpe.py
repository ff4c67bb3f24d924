"""Encoding with the tokenizers library, each distinct word once.

For tokenizers whose normaliser and splitter never look across ASCII white space (BPE with word ends that drops white space), a
text's ids are its words' ids in order; so words go through the library and texts are put together from them.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewake.llm._shared import WordMemory, offsets, ragged

#: Latin letters that stay letters when lower-cased, in UTF-8.
_plain = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?").fullmatch


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 500_000) -> Encoder:
    """This worker's encoder, whose memory of ``most`` words outlives a task."""
    return Encoder(path, most)


class Encoder:
    def __init__(self, path: str, most: int = 500_000):
        self.library = _library(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.memory = WordMemory(self._encode_words, most)
        special = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special]
        self.ends = np.zeros(self.vocabulary, bool)
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.fence_id, self.fence = (special[0][0], special[0][1].encode()) if special else (-1, b"")

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words go through the library some hundreds at once.

        Plain words (letters that stay letters, then a full stop or comma at most) are joined by spaces: a token that ends a word
        shows where each stops. Others are joined by a special token, those that might hold one go alone.
        """
        kinds = [0 if _plain(w) else 2 if b"<" in w or not self.fence else 1 for w in words]
        out_len = np.zeros(len(words), np.int64)
        runs: list[tuple[np.ndarray, np.ndarray]] = []  # (places, flat ids)
        places = [np.flatnonzero(np.array(kinds, np.int8) == k) for k in range(3)]
        for at in range(0, len(places[0]), 500):
            mine = places[0][at : at + 500]
            some = [words[k] for k in mine.tolist()]
            flat = np.array(self._library_ids(b" ".join(some)), np.int64)
            ends = np.flatnonzero(self.ends[flat])
            parts = np.cumsum(np.fromiter((1 + (w[-1] in b".,") for w in some), np.int64, len(some)))
            if len(ends) != parts[-1]:
                raise ValueError("the vocabulary doesn't mark the ends of words")
            out_len[mine] = np.diff(ends[parts - 1], prepend=-1)
            runs.append((mine, flat))
        for at in range(0, len(places[1]), 500):
            mine = places[1][at : at + 500]
            flat = np.array(self._library_ids(self.fence.join([*(words[k] for k in mine.tolist()), b""])), np.int64)
            out_len[mine] = np.diff(np.flatnonzero(flat == self.fence_id), prepend=-1) - 1
            runs.append((mine, flat[flat != self.fence_id]))
        for k in places[2].tolist():
            flat = np.array(self._library_ids(words[k]), np.int64)
            out_len[k] = len(flat)
            runs.append((np.array([k]), flat))
        if not runs:
            return np.zeros(0, np.int32), out_len
        order = np.concatenate([mine for mine, _ in runs])
        flat = np.concatenate([ids for _, ids in runs])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(out_len[order]) - out_len[order]
        return ragged(flat, starts, out_len), out_len

    def _library_ids(self, text: bytes) -> list[int]:
        return self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text); null texts are empty; ``end`` is put behind each text."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = np.asarray(words.value_lengths()).astype(np.int64)
        flat, per_word = self.memory.ids_of(words.flatten().cast(pa.binary()))
        lengths = np.diff(np.concatenate([[0], np.cumsum(per_word)])[offsets(counts)])
        if end is None:
            return flat, lengths
        out = np.empty(len(flat) + len(counts), np.int32)
        stop = np.cumsum(lengths + 1) - 1
        keep = np.ones(len(out), bool)
        keep[stop] = False
        out[keep], out[stop] = flat, end
        return out, lengths + 1


def binary_array(flat: np.ndarray, lengths: np.ndarray):
    """Each run of ids as its little-endian bytes."""
    data = pa.py_buffer(np.ascontiguousarray(flat))
    return pa.Array.from_buffers(pa.large_binary() if flat.nbytes > 2**31 - 1 else pa.binary(), len(lengths), [None, pa.py_buffer((offsets(lengths) * flat.itemsize).astype(np.int64 if flat.nbytes > 2**31 - 1 else np.int32)), data])
