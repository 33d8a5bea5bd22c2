"""Byte-level BPE: pre-tokens by scanning arrays, merges by rank, and decoding.

Text is split without regular expressions. Code points become classes, classes and their neighbours
become input symbols of a small automaton, and the automaton runs over all positions at once: the
transition functions of blocks are composed by an associative scan, which gives every block its
first state, and the blocks are then walked in step. Pre-tokens are hashed, each different one is
merged once per slice and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.llm.columns import shield
from topiclake.llm.text import ragged, run_hashes, slices

# White space beyond categories, and the contractions that are tokens of their own.
WHITE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CONTRACTIONS = "'s 't 're 've 'm 'll 'd"

# Input symbols: letter, number, other, apostrophe of a contraction with one or two letters, white
# space, and the space that opens the token of the character behind it.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, OPENER = range(7)
# States: nothing open, an open run of letters, numbers or others, an opener, and letters of a
# contraction still to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, OPENED, ONE_LEFT, TWO_LEFT = range(7)
# Different pre-tokens whose ids a task keeps; the cache starts anew beyond that.
CACHE = 1_000_000
BLOCK = 64
# Longer pre-tokens are merged one by one with a heap.
MATRIX_BYTES = 48
NO_PAIR = np.iinfo(np.int32).max


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by symbol and state.

    Symbols from 7 on are those of a text's first character: they forget the state. Symbol 14 is
    padding and keeps it.
    """
    step = np.zeros((15, 7), np.uint8)
    starts = np.zeros((15, 7), bool)
    opened = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_LEFT, TWO_LEFT, CLOSED, OPENED]
    runs = {IN_LETTERS: [LETTER], IN_NUMBERS: [NUMBER], IN_OTHERS: [OTHER, SHORT, LONG]}
    for symbol in range(7):
        for state in range(7):
            step[symbol, state], starts[symbol, state] = opened[symbol], True
        for state, same in runs.items():
            if symbol in same:
                step[symbol, state], starts[symbol, state] = state, False
                step[symbol, OPENED], starts[symbol, OPENED] = state, False
        step[symbol, ONE_LEFT], starts[symbol, ONE_LEFT] = CLOSED, False
        step[symbol, TWO_LEFT], starts[symbol, TWO_LEFT] = ONE_LEFT, False
        step[symbol + 7], starts[symbol + 7] = step[symbol, CLOSED], starts[symbol, CLOSED]
    step[14] = np.arange(7)
    return step, starts


def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[[ord(c) for c in WHITE]] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    points = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        rows = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0xF8)[size - 2]))
        value = lead[rows] & mask
        for i in range(1, size):
            value = (value << 6) | (data[at[rows] + i] & 0x3F)
        points[rows] = value
    return points, at


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start; ``first`` flags the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = classes[points]
    last = np.append(first[1:], True)
    space = symbols == SPACE
    # A code point's right neighbour in its own text, 0 beyond the end.
    right = np.where(last, 0, np.append(points[1:], 0))
    before_solid = space & ~last & ~np.append(space[1:], True)
    symbols[before_solid & (points == 32)] = OPENER
    marks = np.flatnonzero((points == 39) & ~last)
    one, two = right[marks], right[np.minimum(marks + 1, n - 1)]
    for text in CONTRACTIONS.split():
        if len(text) == 2:
            symbols[marks[one == ord(text[1])]] = SHORT
        else:
            inner = ~last[np.minimum(marks + 1, n - 1)]
            symbols[marks[(one == ord(text[1])) & (two == ord(text[2])) & inner]] = LONG
    body = space & ~first & np.append(False, space[:-1])
    symbols[first] += 7
    starts = _scan(symbols)
    # In a run of white space the first starts a token, and the last if a solid one follows.
    starts[space] = ~body[space] | before_solid[space]
    return np.flatnonzero(starts)


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Run the automaton over all symbols, from the closed state."""
    step, opens = _automaton()
    flat_step, flat_opens = step.ravel(), opens.ravel()
    n = len(symbols)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, 14, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.int16) * 7
    # The function of each block: where it leads from every state.
    whole = np.repeat(np.arange(7, dtype=np.uint8)[:, None], rows, axis=1)
    for column in columns:
        whole = flat_step[column + whole]
    # Inclusive scan of the functions, which compose associatively.
    gap = 1
    while gap < rows:
        later = whole[:, gap:].copy()
        whole[:, gap:] = np.take_along_axis(later, whole[:, :-gap].astype(np.intp), axis=0)
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[CLOSED, :-1]
    out = np.empty((BLOCK, rows), bool)
    for i, column in enumerate(columns):
        at = column + state
        out[i] = flat_opens[at]
        state = flat_step[at]
    return out.T.ravel()[:n]


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Tokens and ranks of a vocabulary file, one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, file) if a]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the neighbours of lowest rank merge first, the left one among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends = list(range(1, n + 1))  # end of the part that begins at i
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n and (r := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= end or not alive[ends[i]] or ends[ends[i]] != end:
            continue
        j = ends[i]
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Pairs:
    """Rank of the merge of two neighbouring tokens, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(found, np.int32)[order], NO_PAIR).astype(np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)


def merge_matrix(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, single: np.ndarray, pairs: Pairs):
    """Token ids of many short pieces: (ids, piece of each id), pieces in any order.

    Pieces with equally many parts are rows of one matrix. In a round every row merges its best
    pair and so loses one part, which makes it a row of the next shorter matrix; rows without a
    pair are finished.
    """
    out, owner = [], []
    rows, parts, best = np.zeros(0, np.int64), None, None
    for n in range(int(lengths.max(initial=1)), 0, -1):
        new = np.flatnonzero(lengths == n)
        symbols = single[data[begins[new][:, None] + np.arange(n)]]
        ranks = pairs.of(symbols[:, :-1], symbols[:, 1:]) if len(new) else np.zeros((0, n - 1), np.int32)
        rows = np.append(rows, new)
        parts = symbols if parts is None else np.concatenate([parts, symbols])
        best = ranks if best is None else np.concatenate([best, ranks])
        if n == 1 or not len(rows):
            done = np.ones(len(rows), bool)
        else:
            at = best.argmin(axis=1)
            low = best[np.arange(len(rows)), at]
            done = low == NO_PAIR
        out.append(parts[done].ravel())
        owner.append(np.repeat(rows[done], n))
        if n == 1:
            break
        go = np.flatnonzero(~done)
        if not len(go):
            rows = rows[go]
            parts, best = parts[go, : n - 1], best[go, : max(n - 2, 0)]
            continue
        rows, parts, best, at, low = rows[go], parts[go], best[go], at[go], low[go]
        line = np.arange(len(rows))
        parts[line, at] = low
        keep = np.ones(parts.shape, bool)
        keep[line, at + 1] = False
        parts = parts[keep].reshape(len(rows), n - 1)
        keep = np.ones(best.shape, bool)
        keep[line, at] = False
        best = best[keep].reshape(len(rows), n - 2)
        for shift in (-1, 0):
            place = at + shift
            good = np.flatnonzero((place >= 0) & (place < n - 2))
            best[good, place[good]] = pairs.of(parts[good, place[good]], parts[good, place[good] + 1])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


class Codec:
    """Encodes and decodes slices of UTF-8 text with one vocabulary.

    Pre-tokens are told apart by 64-bit hashes. ``known`` (sorted hashes) and ``firsts``, ``sizes``,
    ``ids`` cache what has been merged.
    """

    def __init__(self, vocabulary: list[tuple[bytes, int]]):
        self.ranks = dict(vocabulary)
        self.pairs = Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.classes = class_table()
        size = max(self.ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for token, rank in vocabulary:
            pieces[rank] = token
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.firsts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each pre-token, and the first pre-token of each text."""
        points, at = code_points(data)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
        begins = at[token_starts(points, first, self.classes)]
        return begins, np.searchsorted(begins, offsets)

    def _merged(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
        """Sizes and ids of pieces, in order."""
        short = np.flatnonzero(lengths <= MATRIX_BYTES)
        ids, owner = merge_matrix(data, begins[short], lengths[short], self.single, self.pairs)
        parts, owners = [ids], [short[owner]]
        for k in np.flatnonzero(lengths > MATRIX_BYTES):
            piece = data[begins[k] : begins[k] + lengths[k]].tobytes()
            parts.append(np.array(merge(piece, self.ranks), np.int64))
            owners.append(np.full(len(parts[-1]), k))
        ids, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(lengths)), ids[order].astype(np.uint32)

    def _learn(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Merge the pieces that are not cached; ``hashes`` are sorted and different."""
        if len(self.known) > CACHE:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        seen = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.known))
        seen[inside] = self.known[at[inside]] == hashes[inside]
        new = np.flatnonzero(~seen)
        if not len(new):
            return
        sizes, ids = self._merged(data, begins[new], lengths[new])
        firsts = np.cumsum(sizes) - sizes + len(self.ids)
        self.known = np.insert(self.known, at[new], hashes[new])
        self.firsts = np.insert(self.firsts, at[new], firsts)
        self.sizes = np.insert(self.sizes, at[new], sizes)
        self.ids = np.append(self.ids, ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and the first token of each text."""
        begins, bounds = self.pieces(data, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(np.append(begins, len(data)))
        kinds, example, kind = np.unique(
            run_hashes(data, lengths), return_index=True, return_inverse=True
        )
        self._learn(data, begins[example], lengths[example], kinds)
        at = np.searchsorted(self.known, kinds)[kind]
        sizes = self.sizes[at]
        return self.ids[ragged(self.firsts[at], sizes)], np.append(0, np.cumsum(sizes))[bounds]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte behind each token, over all ids."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.begins[ids], self.lengths[ids])]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values between byte bounds."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def encode(
    df: DataFrame, keep: list[str], text: str, vocabulary: str, ids: str = "ids", ends: str = "ends",
    decoded: str | None = None,
) -> DataFrame:
    """``keep`` columns and the token ids of each text, in one narrow pass.

    ``ids`` holds little-endian unsigned 32-bit ids, ``ends`` the byte of the text behind each token
    in the same form, so any range of tokens can be decoded or cut out of the text. ``decoded``
    names a column with the bytes decoded from the ids again. Null and empty texts give empty
    values; rows are independent, so ties, repeated rows and null keys need no care. The vocabulary
    file is read on the driver and travels with the tasks (its size is that of the file).
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    picked = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                tokens, bounds = codec.encode(data, offsets)
                ends_of = codec.ends(tokens) - np.repeat(offsets[:-1], np.diff(bounds))
                out = {c: rows.column(i) for i, c in enumerate(keep)}
                out[ids] = _binary(tokens.view(np.uint8), bounds * 4)
                out[ends] = _binary(ends_of.astype(np.uint32).view(np.uint8), bounds * 4)
                if decoded:
                    turned = codec.decode(tokens)
                    out[decoded] = _binary(turned, np.append(0, codec.ends(tokens))[bounds])
                yield pa.RecordBatch.from_arrays(
                    [v.cast(pa.binary()) if pa.types.is_large_binary(v.type) else v for v in out.values()],
                    list(out),
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text"]
    schema += [f"`{c}` binary" for c in [ids, ends, decoded] if c]
    return picked.mapInArrow(run, ", ".join(schema))


def decode(df: DataFrame, keep: list[str], ids: str, vocabulary: str, text: str = "text") -> DataFrame:
    """``keep`` columns and the text of the ids; null ids give the empty text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    picked = df.select(*keep, df[ids].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for rows, data, offsets in slices(batch, "_ids"):
                tokens = np.frombuffer(data.tobytes(), "<u4")
                turned = codec.decode(tokens)
                bounds = np.append(0, codec.ends(tokens))[offsets // 4]
                column = _binary(turned, bounds).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), column], [*keep, text]
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_ids"]
    return picked.mapInArrow(run, ", ".join([*schema, f"`{text}` string"]))


def encode_all(df: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """All columns but the text, with ``ids``, ``ends`` and ``n_tokens``, which replace equal names."""
    df, restore = shield(df, text)
    encoded = encode(df, [c for c in df.columns if c != text], text, vocabulary)
    counted = encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    return restore(counted, "ids", "ends", "n_tokens")
