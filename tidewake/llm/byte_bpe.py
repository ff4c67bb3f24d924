"""Byte-level BPE by backtracking over longest token matches.

A run of tokens is what merging by rank gives exactly if each token comes out of its own bytes and no two neighbours would have merged across
their border. So a piece is encoded from the left: an Aho-Corasick automaton over the vocabulary gives the longest token at each place, the
pair-compatibility table says whether it may stand behind the token before. If not, the next shorter token at the place is tried, and
where none is left the place is marked dead and the token before is shortened. A place dies once, so the work is linear in the piece.
Decoding gathers tokens' bytes from one flat buffer by a table of offsets.

Texts are split into pieces by the library's own pattern, and each worker encodes a distinct piece once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewake.llm._shared import WordMemory, offsets, ragged, text_slices
from tidewake.llm.word_bpe import _library, binary_array

#: How the byte-level splitter cuts texts (a fixed value of the tokenizer's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens that a worker remembers, pieces and characters that it handles at once.
PAIRS, PIECES, JOINED = 2_000_000, 500_000, 1 << 18
NEVER = 1 << 40


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def doubtful() -> frozenset[str]:
    """Characters of which this Python and the pattern's library don't agree that they are letters or numbers: newer than one of them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = regex.findall(r"[\p{L}\p{N}]", every)
    return frozenset(c for c in known if unicodedata.category(c)[0] not in "LN")


class PairTable:
    """Which two tokens may stand side by side, of a vocabulary in which each token comes from one merge.

    ``halves`` has each merged token's two parts, ``rank`` the merge's place (-1: a byte).
    """

    def __init__(self, halves: dict[int, tuple[int, int]], rank: list[int]):
        self.halves, self.rank = halves, rank
        self.merged = {pair: rank[t] for t, pair in halves.items()}
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int, end: int = NEVER) -> bool:
        """Whether nothing merges across the border of ``a`` and ``b`` before rank ``end``.

        Goes back in time from both whole tokens: the part at the border that was merged last is taken apart. Two parts that were there at
        the same time would merge if their pair's rank came before both were used up; of equal pairs the left one goes first.
        """
        merged, rank, halves = self.merged, self.rank, self.halves
        a_end = b_end = end
        while True:
            m = merged.get((a, b))
            if m is not None and m < a_end and m <= b_end:
                return False
            if rank[a] > rank[b]:
                a_end, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                b_end, b = rank[b], halves[b][0]
            else:  # both are bytes
                return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[a, b] = self.apart(a, b)
        return got


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library; refuses files that it wouldn't encode exactly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or spec["normalizer"] or odd:
            raise ValueError("not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("an added token takes more than its own characters")
        self.library = _library(path)
        byte = byte_characters()
        vocab, size = model["vocab"], self.library.get_vocab_size(with_added_tokens=True)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank, halves = [-1] * size, {}
        for k, (a, b) in enumerate(pairs):
            t = vocab[a + b]
            if t in halves:
                raise ValueError("two merges make the same token")
            rank[t], halves[t] = k, (vocab[a], vocab[b])
        spelt = {t: bytes(byte[c] for c in word) for word, t in vocab.items()}
        if sum(len(x) == 1 for x in spelt.values()) != 256 or any(len(x) > 1 and t not in halves for t, x in spelt.items()):
            raise ValueError("a byte has no token or a token no merge")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.table = PairTable(halves, rank)
        # tokens that their own bytes don't merge to never come out
        self.tokens = {x.decode("latin-1"): t for t, x in spelt.items() if rank[t] < 0 or self.table.apart(*halves[t], rank[t])}
        self.size = np.zeros(size, np.int64)
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for word, t in self.tokens.items():
            self.automaton.add_word(word, t)
            self.size[t] = len(word)
            self.shorter[t] = next((self.tokens[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.tokens), -1)
        self.automaton.make_automaton()
        self.sizes = self.size.tolist()
        spelt |= {i: t.encode() for t, i in self.added.items()}
        self.bytes_of = np.frombuffer(b"".join(spelt.get(t, b"") for t in range(size)), np.uint8)
        self.starts = offsets(np.array([len(spelt.get(t, b"")) for t in range(size)], np.int64))
        self.pattern = regex.compile(PATTERN)
        self.memory = WordMemory(self.encode_pieces)

    def longest(self, joined: str) -> np.ndarray:
        """The longest token that starts at each place (-1: none)."""
        out, matches = np.full(len(joined), -1, np.int64), self.automaton.iter(joined)
        while some := list(islice(matches, 1 << 16)):
            end, token = np.array(some, np.int64).T
            out[end - self.size[token] + 1] = token  # ends ascend, so the longest comes last
        return out

    def _backtrack(self, at: int, end: int, longest: list[int]) -> list[int]:
        size, shorter, compatible = self.sizes, self.shorter, self.table.compatible
        out: list[int] = []
        dead: set[int] = set()
        token = longest[at]
        while at < end:
            to = at + size[token]
            if to not in dead and (not out or compatible(out[-1], token)):
                out.append(token)
                at = to
                if at < end:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing can stand here: shorten the token before
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per piece)."""
        words = [p.encode().decode("latin-1") for p in pieces]
        out: list[int] = []
        lengths = np.ones(len(words), np.int64)
        k = 0
        while k < len(words):
            some, chars = [], 0
            while k + len(some) < len(words) and chars < JOINED:
                some.append(words[k + len(some)])
                chars += len(some[-1]) + 1
            longest = self.longest("Ā".join(some)).tolist()  # no token holds the border
            at = 0
            for n, word in enumerate(some, k):
                token, end = longest[at], at + len(word)
                if self.sizes[token] == len(word):
                    out.append(token)
                else:
                    ids = self._backtrack(at, end, longest)
                    lengths[n] = len(ids)
                    out += ids
                at = end + 1
            k += len(some)
        return np.array(out, np.int32), lengths

    def sure(self, text: str) -> bool:
        """Whether the pattern cuts the text as the library does."""
        return text.isascii() or doubtful().isdisjoint(text)

    def pieces(self, text: str) -> Iterator[str | int]:
        """The text's pieces in order; added tokens as their ids."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                yield self.added[part]
            elif not self.sure(part):
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                    yield part[a:b]
            else:
                for found in self.pattern.finditer(part):
                    yield found[0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text); a null text is empty."""
        done: list[np.ndarray] = []
        lengths = np.zeros(len(texts), np.int64)
        words: list[str] = []
        counts: list[tuple[int, int]] = []  # pieces of each text that wait

        def flush() -> None:
            flat, per = self.memory.ids(words)
            at = offsets(per)[offsets(np.array([n for _, n in counts], np.int64))]
            for (k, _), n in zip(counts, np.diff(at).tolist()):
                lengths[k] += n
            done.append(flat)
            words.clear()
            counts.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            if any(t in text for t in self.added) or len(text) > PIECES or not self.sure(text):
                run = self.pieces(text)
                while some := list(islice(run, PIECES)):
                    at = 0
                    for x in [*(j for j, p in enumerate(some) if isinstance(p, int)), len(some)]:
                        counts.append((k, x - at))
                        words += some[at:x]
                        if x < len(some):
                            flush()
                            done.append(np.array([some[x]], np.int32))
                            lengths[k] += 1
                        at = x + 1
                    if len(words) > PIECES:
                        flush()
            else:
                found = self.pattern.findall(text)
                counts.append((k, len(found)))
                words += found
                if len(words) > PIECES:
                    flush()
        flush()
        return np.concatenate(done), lengths

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD as the library has them."""
        sizes = np.diff(self.starts)
        data = ragged(self.bytes_of, self.starts[flat], sizes[flat])
        ends = offsets(sizes[flat])[offsets(lengths)]
        raw = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder, whose memory of pieces outlives a task."""
    return Encoder(path)


def encode_decode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (the text of those ids) of every row.

    A narrow operator: no shuffle, rows in any number of partitions. A null text counts as empty: no ids, an empty decoded text. An added
    token's characters in a text are that token, as the library has it. Very long texts are handled in slices of rows, a text being the
    least slice, and by ``PIECES`` pieces at once. Equal rows each give a row. Other columns of ``df`` are left out, whatever their
    names. An empty table gives an empty one.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_path)
        for batch in batches:
            for part in text_slices(batch, text):
                flat, lengths = bpe.encode(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(lengths), binary_array(flat.astype("<u4"), lengths).cast(pa.binary()), bpe.decode(flat, lengths).cast(pa.string())], [key, "n_tokens", "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, schema)
