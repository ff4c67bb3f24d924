"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read without the library's encoder: its pieces and scores give a table of symbol pairs. Words (a run of word
marks and what follows it, up to the next mark or line feed) can't be joined by any piece, so each distinct word of a batch is
encoded once. All words are encoded together in flat numpy arrays. One round finds each word's best pair (a segmented minimum over
pair ranks), merges its leftmost occurrences, drops merged symbols, and sets aside words that have no pair left. An occurrence
whose merge makes a pair at least as good ends its word's round, as the sequential algorithm would take that pair first.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewake.llm._shared import WordMemory, list_array, offsets, ragged, text_slices

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: After so many rounds, the few words still open (runs of thousands of marks) are finished by a queue.
ROUNDS = 400


class PieceModel:
    """Encoder and decoder for a BPE model with byte fallback, identity normalizer and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only plain BPE models with an identity normalizer and a dummy prefix are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.types = np.array([p.type for p in model.pieces])
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.types == 6):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p and p != "\n" for p in normal):
            raise ValueError("pieces with a mark behind other characters, or with a line feed, join words: words can't be encoded apart")
        order = sorted({-p.score for p in model.pieces if p.type == 1})
        rank = {s: i for i, s in enumerate(order)}
        self.char_symbol = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        self.size = len(self.pieces)
        pairs = [(normal[p[:k]] * self.size + normal[p[k:]], rank[-model.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self._fill(np.array(pairs, np.int64).reshape(-1, 3))
        text = [b"" if t in (3,) else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types)]
        for b, i in enumerate(self.byte_ids):
            text[i] = bytes([b])
        text[int(np.flatnonzero(self.types == 2)[0])] = model.trainer_spec.unk_surface.encode()
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.text_len = np.array([len(x) for x in text], np.int64)
        self.text_start = np.cumsum(self.text_len) - self.text_len
        self.marked = np.array([p.startswith(MARK) and t == 1 for p, t in zip(self.pieces, self.types)])
        self.silent = self.types == 3
        self.is_byte = self.types == 6

    def _fill(self, pairs: np.ndarray) -> None:
        """An open-addressed table from pair key to (rank, piece)."""
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.made = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(pairs))
        slot = self._slot(pairs[:, 0])
        self.probes = 0
        while len(left):
            self.probes += 1
            first = np.full(1 << bits, -1, np.int64)
            free = self.keys[slot] < 0
            first[slot[free][::-1]] = left[free][::-1]
            won = first[first >= 0]
            at = np.flatnonzero(first >= 0)
            self.keys[at], self.ranks[at], self.made[at] = pairs[won, 0], pairs[won, 1], pairs[won, 2]
            keep = ~np.isin(left, won)
            left, slot = left[keep], (slot[keep] + 1) & ((1 << bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table's slot of each pair of symbols, -1 if they don't merge."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(len(key), -1, np.int64)
        slot, todo = self._slot(key), None
        for _ in range(self.probes):
            k = self.keys[slot]
            want = key if todo is None else key[todo]
            hit = k == want
            if todo is None:
                out[hit] = slot[hit]
                todo = np.flatnonzero(~hit & (k >= 0) & (key >= 0))
                slot = slot[todo]
            else:
                out[todo[hit]] = slot[hit]
                more = ~hit & (k >= 0)
                todo, slot = todo[more], slot[more]
            if not len(todo):
                break
            slot = (slot + 1) & (len(self.keys) - 1)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.pair(a, b)
        return np.where(at >= 0, self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of words that hold marks instead of spaces."""
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.char_symbol[chars].astype(np.int64)
        sym = np.where(sym < 0, -chars - 1, sym)  # a character without a piece: never merged, later its bytes
        open_words = np.arange(len(words))
        done_sym: list[np.ndarray] = []
        done_len: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        nonempty = lengths > 0
        if not nonempty.all():
            done_sym.append(sym[:0])
            done_len.append(lengths[~nonempty])
            done_word.append(open_words[~nonempty])
            open_words, lengths = open_words[nonempty], lengths[nonempty]
        slots = None
        rounds = 0
        while len(open_words):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            nxt = np.empty_like(sym)
            nxt[:-1] = sym[1:]
            nxt[ends - 1] = -1
            slots = self.pair(sym, nxt)
            ranks = np.where(slots >= 0, self.ranks[slots], NONE)
            best = np.minimum.reduceat(ranks, starts)
            over = best == NONE
            if over.any() or rounds >= ROUNDS:
                closing = over if rounds < ROUNDS else np.ones_like(over)
                which = np.repeat(closing, lengths)
                out, out_len = sym[which], lengths[closing]
                if rounds >= ROUNDS:
                    runs = [self._by_queue(x) for x in np.split(out, np.cumsum(out_len)[:-1])]
                    out, out_len = np.concatenate(runs), np.array([len(x) for x in runs], np.int64)
                done_sym.append(out)
                done_len.append(out_len)
                done_word.append(open_words[closing])
                keep = ~which
                sym, ranks, slots = sym[keep], ranks[keep], slots[keep]
                open_words, lengths, best = open_words[~closing], lengths[~closing], best[~closing]
                if not len(open_words):
                    break
                ends = np.cumsum(lengths)
                starts = ends - lengths
            rounds += 1
            at = np.flatnonzero(ranks == np.repeat(best, lengths))
            # of overlapping occurrences every other one, from the left
            run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[place % 2 == 0]
            word = np.searchsorted(ends, at, side="right")
            merged = self.made[slots[at]].astype(np.int64)
            # an occurrence that makes a pair as good as its own is the last of its word in this round
            has_left, has_right = at > starts[word], at + 2 < ends[word]
            joined = np.zeros(len(at), bool)
            joined[1:] = (at[1:] - at[:-1] == 2) & (word[1:] == word[:-1])
            left = np.where(has_left, sym[np.maximum(at - 1, 0)], -1)
            left[1:][joined[1:]] = merged[:-1][joined[1:]]
            right = np.where(has_right, sym[np.minimum(at + 2, len(sym) - 1)], -1)
            stop = np.minimum(self.rank(left, merged), self.rank(merged, right)) <= best[word]
            if stop.any():
                seen = np.cumsum(stop) - stop
                first = np.searchsorted(word, word, side="left")
                go = seen == seen[first]
                at, merged, word = at[go], merged[go], word[go]
            sym[at] = merged
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym = sym[keep]
            lengths = lengths - np.bincount(word, minlength=len(lengths))
        flat = np.concatenate(done_sym) if done_sym else sym[:0]
        lens = np.concatenate(done_len) if done_len else lengths[:0]
        words_at = np.concatenate(done_word) if done_word else open_words
        order = np.empty(len(words_at), np.int64)
        order[words_at] = np.arange(len(words_at))
        starts = np.cumsum(lens) - lens
        return self._with_bytes(ragged(flat, starts[order], lens[order]), lens[order])

    def _with_bytes(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = sym < 0
        if not unknown.any():
            return sym, lengths
        cp = np.where(unknown, -sym - 1, 0)
        width = np.where(unknown, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        starts = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[starts[~unknown]] = sym[~unknown]
        raw = np.frombuffer("".join(map(chr, cp[unknown].tolist())).encode(), np.uint8)
        out[np.repeat(unknown, width)] = self.byte_ids[raw]
        return out, np.add.reduceat(width, np.cumsum(lengths) - lengths) * (lengths > 0) if len(lengths) and (lengths > 0).all() else np.diff(np.concatenate([[0], np.cumsum(width)])[offsets(lengths)])

    def _by_queue(self, sym: np.ndarray) -> np.ndarray:
        """The sequential algorithm from any state on: best score first, then leftmost."""
        sym = sym.tolist()
        n = len(sym)
        prev, nxt, size = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        heap: list = []

        def push(pairs: list[tuple[int, int]]) -> None:
            pairs = [(i, j) for i, j in pairs if i >= 0 and j >= 0]
            if pairs:
                at = self.pair(np.array([sym[i] for i, _ in pairs]), np.array([sym[j] for _, j in pairs]))
                for (i, j), s in zip(pairs, at.tolist()):
                    if s >= 0:
                        heapq.heappush(heap, (int(self.ranks[s]), i, j, int(self.made[s]), size[i], size[j]))

        push([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, j, piece, was_i, was_j = heapq.heappop(heap)
            if size[i] != was_i or size[j] != was_j or nxt[i] != j:
                continue
            sym[i], size[i], size[j], nxt[i] = piece, size[i] + size[j], 0, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            push([(prev[i], i), (i, nxt[i])])
        return np.array([s for s, k in zip(sym, size) if k], np.int64)

    def decode_flat(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = np.asarray(ids, np.int64)
        skip = np.zeros(len(ids), np.int64)
        first = offsets(lengths)[:-1][lengths > 0]
        skip[first] = self.marked[ids[first]]
        width = self.text_len[ids] - skip
        data = ragged(self.text_bytes, self.text_start[ids] + skip, width).tobytes()
        cut = np.concatenate([[0], np.cumsum(width)])[offsets(lengths)].tolist()
        out = []
        at = offsets(lengths)
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            run = ids[at[k] : at[k + 1]]
            if len(run) and self.silent[run[0]]:
                out.append(self._decode_slow(run))
                continue
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(self._decode_slow(run))
        return out

    def _decode_slow(self, ids: np.ndarray) -> str:
        """Ids that no text encodes to: control pieces in front, or bytes that aren't UTF-8 (each wrong byte becomes U+FFFD)."""
        out, raw, seen = "", b"", False

        def text(raw: bytes) -> str:
            got = ""
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        got, raw = got + raw[:n].decode(), raw[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    got, raw = got + "�", raw[1:]
            return got

        for i in ids.tolist():
            if self.is_byte[i]:
                raw += self.text_bytes[self.text_start[i] : self.text_start[i] + 1].tobytes()
                continue
            out, raw = out + text(raw), b""
            piece = self.text_bytes[self.text_start[i] : self.text_start[i] + self.text_len[i]].tobytes().decode()
            if not out and not seen and self.marked[i]:
                piece, seen = piece[1:], True
            out += piece
        return out + text(raw)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


#: A run of marks with what follows it; a line feed alone (no piece holds one).
WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")


class Encoder:
    """Encodes texts, each distinct word once."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.memory = WordMemory(self.model.encode_words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = WORDS.findall(MARK + text.replace(" ", MARK))
                counts[k] = len(found)
                words += found
        flat, per_word = self.memory.ids(words)
        return flat, np.concatenate([[0], np.cumsum(per_word)])[offsets(counts)][1:] - np.concatenate([[0], np.cumsum(per_word)])[offsets(counts)][:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder, whose memory of words outlives a task."""
    return Encoder(path)


def encode_decode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array<int>, without begin or end ids) and ``decoded`` (the text of those ids) of every row.

    A narrow operator: no shuffle, rows in any number of partitions. A null text counts as empty: no ids, an empty decoded text.
    Very long texts are handled in slices of rows, a text being the least slice. Equal rows each give a row. Other columns of
    ``df`` are left out, whatever their names. An empty table gives an empty one.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model_path)
        for batch in batches:
            for part in text_slices(batch, text):
                flat, lengths = pieces.encode(part.column(text).to_pylist())
                decoded = pieces.model.decode_flat(flat, lengths)
                yield pa.RecordBatch.from_arrays([part.column(key), list_array(flat.astype(np.int32), lengths), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, schema)
