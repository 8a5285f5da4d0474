"""SentencePiece encoding and decoding as a weighted transducer over an input.

The model file is compiled to three parts that are composed with each text: the normaliser (spaces become the mark ``▁``, one
is put in front), the pieces as a trie of states with one arc per character, and the byte fallback for characters that are
no piece. A path through the composition is a segmentation; its weight is the sum of the pieces' negated scores, and the
shortest path in the tropical semiring is taken by one forward pass that relaxes all arcs. That is all for models of the
Unigram kind.

Models that join neighbours, the best-scored pair first, are not reproduced by a plain sum of scores. What
does is one more acceptor: two pieces may follow each other only if joining their characters alone gives just these two.
A segmentation all of whose neighbours pass is the model's own. Its states are the pieces, so the pass keeps a weight per
arc instead of one per place. Whether two pieces pass is found by undoing their last joins, the later first, and
looking at each step whether the two that then meet would have been joined before.
Pieces made of marks alone share one score, the lowest, and are joined from the left after everything else; a run of marks is
therefore joined apart. As no piece has a mark after another character, texts are composed word by word. The words of a batch
that are new are composed together, as arrays; words are remembered in a table of bounded size.

Defined results: null and empty texts give no ids and decode to the empty text; texts of any length and with any
characters are encoded whole; the mark ``▁`` in a text counts as a space, as in the model's own normaliser, which is
what decoding returns for it; repeated rows are encoded each; other columns pass through, and columns of theirs
called like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import unused

MARK = "▁"

#: Fixed by the model format: kinds of pieces, kinds of models, and what an unknown character of a Unigram model costs
#: beyond the worst piece.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, JOINING = 1, 2
UNKNOWN_COST = 10.0

#: Largest model file that is sent to the executors, words remembered in a worker, bits of the table of pairs of pieces
#: remembered there, and characters composed at once.
MAX_MODEL_BYTES = 64 << 20
MAX_WORDS = 400_000
PAIR_BITS = 21
MAX_CHARACTERS = 1 << 18


def fields(data: bytes):
    """Fields of a protobuf message as (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Table:
    """Whole numbers by whole numbers, looked up as arrays; -1 for what is not there."""

    def __init__(self, known: dict[int, int]):
        bits = max(4, (4 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(known.keys(), np.int64, len(known))
        values = np.fromiter(known.values(), np.int64, len(known))
        at = self.slots(keys)
        while len(keys):
            # Of those that want one free slot the last one written gets it; the others go on.
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[str | int | None] = []
        self.byte_ids: dict[int, int] = {}
        self.dummy_prefix, escape = True, True
        kind_of_model = UNIGRAM
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                kind = piece.get(3, NORMAL)
                name = piece[1].decode()
                at = len(self.surface)
                self.surface.append(None)
                if kind in (NORMAL, USER_DEFINED):
                    if kind == USER_DEFINED:
                        raise ValueError("user-defined symbols are not supported")
                    self.ids[name], self.surface[at] = at, name
                    self.scores[name] = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
                elif kind == BYTE:
                    self.byte_ids[int(name[3:5], 16)], self.surface[at] = at, int(name[3:5], 16)
            elif number == 2:
                # A later message of the same number goes on where the earlier one ended.
                kind_of_model = dict(fields(value)).get(3, kind_of_model)
            elif number == 3:
                spec = dict(fields(value))
                self.dummy_prefix, escape = bool(spec.get(3, 1)), bool(spec.get(5, 1))
                if spec.get(2) or spec.get(4, 1) or not escape:
                    raise ValueError("only the identity normaliser that keeps all white space is supported")
        if kind_of_model not in (UNIGRAM, JOINING):
            raise ValueError("only models of pieces with scores are supported")
        self.joins = kind_of_model == JOINING
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        runs = [score for piece, score in self.scores.items() if len(piece) > 1 and not piece.strip(MARK)]
        rest = [score for piece, score in self.scores.items() if len(piece) > 1 and piece.strip(MARK)]
        if any(MARK in piece.lstrip(MARK) or piece.startswith(2 * MARK) and piece.strip(MARK) for piece in self.ids):
            raise ValueError("pieces that go across words are not supported")
        if self.joins and runs and rest and max(runs) >= min(rest):
            raise ValueError("runs of marks must score below all other pieces")
        self.break_lines = not any("\n" in piece for piece in self.ids)
        self.words: dict[str, int] = {}
        self.bounds, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.byte_table = np.array([self.byte_ids[byte] for byte in range(256)], np.int32)
        self.encoded = [
            b"" if item is None else bytes([item]) if isinstance(item, int) else item.encode() for item in self.surface
        ]
        self.compile()

    def compile(self) -> None:
        """The trie of the pieces that can arise, and the acceptor's tables."""
        names = list(self.ids)
        number = {name: at for at, name in enumerate(names)}
        self.id_of = np.array([self.ids[name] for name in names], np.int32)
        self.cost = np.array([-self.scores[name] for name in names])
        arises = np.ones(len(names), bool)
        if self.joins:
            ranks = {score: at for at, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
            self.rank = np.array([ranks[self.scores[name]] if len(name) > 1 else -1 for name in names], np.int64)
            self.left, self.right = np.full(len(names), -1, np.int64), np.full(len(names), -1, np.int64)
            whole: dict[int, int] = {}
            for at, name in enumerate(names):
                for cut in range(1, len(name)):
                    left, right = number.get(name[:cut]), number.get(name[cut:])
                    if left is not None and right is not None:
                        whole[left << 32 | right] = at
                if len(name) > 1:
                    last: list[tuple[str, str]] = []
                    arises[at] = len(self.joined(name, last)) == 1
                    if arises[at]:
                        self.left[at], self.right[at] = (number[part] for part in last[-1])
            self.whole = Table(whole)
            # Undoing the later join first needs parts that arise before what they are joined to.
            some = np.flatnonzero(self.left >= 0)
            if (np.maximum(self.rank[self.left[some]], self.rank[self.right[some]]) > self.rank[some]).any():
                raise ValueError("pieces must score below the parts they are joined from")
            self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
            self.pair_passes = np.zeros(1 << PAIR_BITS, bool)
        steps: dict[int, int] = {}
        ends = [-1]
        for at, name in enumerate(names):
            # Runs of marks are joined apart.
            if not arises[at] or self.joins and len(name) > 1 and not name.strip(MARK):
                continue
            state = 0
            for mark in name:
                key = state << 21 | ord(mark)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = at
        self.steps, self.ends = Table(steps), np.array(ends, np.int64)
        self.unknown_cost = float(self.cost.max()) + UNKNOWN_COST

    def joined(self, text: str, joins: list[tuple[str, str]] | None = None) -> list[str]:
        """The model's own rule: neighbours are joined, the best-scored pair first and of equals the leftmost.

        ``joins`` is given what is joined, in order.
        """
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            if left >= 0 and (right := after[left]) < len(symbols):
                both = symbols[left] + symbols[right]
                if (score := self.scores.get(both)) is not None:
                    heapq.heappush(heap, (-score, left, right, len(both)))

        for at in range(len(symbols) - 1):
            offer(at)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if symbols[left] is None or symbols[right] is None or len(symbols[left]) + len(symbols[right]) != size:
                continue
            if joins is not None:
                joins.append((symbols[left], symbols[right]))
            symbols[left] += symbols[right]
            symbols[right] = None
            after[left] = after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [symbol for symbol in symbols if symbol is not None]

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether joining the characters of two pieces gives just these two."""
        passes = np.ones(len(left), bool)
        limit = np.full(len(left), np.iinfo(np.int64).max)
        open_ = np.arange(len(left))
        while len(open_):
            both = self.whole.get(left << 32 | right)
            clash = (both >= 0) & (self.rank[both] < limit)
            passes[open_[clash]] = False
            first, second = self.rank[left], self.rank[right]
            on = ~clash & (np.maximum(first, second) >= 0)
            open_, left, right, first, second = open_[on], left[on], right[on], first[on], second[on]
            # What was joined last is undone; of two equal joins the left one came first.
            undo = first > second
            limit = np.where(undo, first, second + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return passes

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the acceptor lets pieces follow each other, remembered by pair; -1 is a character without a piece."""
        out = np.ones(len(left), bool)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[known] << 32 | right[known]
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        passes = self.pair_passes[slots]
        missed = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(missed):
            new, place = np.unique(keys[missed], return_inverse=True)
            found = self.stay_apart(new >> 32, new & 0xFFFFFFFF)
            passes[missed] = found[place]
            # Of pairs that share a slot one is kept, and its verdict with it.
            self.pair_keys[slots[missed]] = keys[missed]
            kept = self.pair_keys[slots[missed]] == keys[missed]
            self.pair_passes[slots[missed][kept]] = passes[missed][kept]
        out[known] = passes
        return out

    def arcs(self, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the composition by start, then end: start, end, and piece or -1 for a character without one.

        ``ends`` holds for each character the place where its word ends.
        """
        starts, stops, pieces = [], [], []
        at, state, size = np.arange(len(marks)), np.zeros(len(marks), np.int64), 0
        single = np.zeros(len(marks), bool)
        while len(at):
            state = self.steps.get(state << 21 | marks[at + size])
            size += 1
            on = state >= 0
            at, state = at[on], state[on]
            piece = self.ends[state]
            full = piece >= 0
            starts.append(at[full])
            stops.append(at[full] + size)
            pieces.append(piece[full])
            if size == 1:
                single[at[full]] = True
            more = at + size < ends[at]
            at, state = at[more], state[more]
        bare = np.flatnonzero(~single)
        starts, stops = np.concatenate([*starts, bare]), np.concatenate([*stops, bare + 1])
        pieces = np.concatenate([*pieces, np.full(len(bare), -1)])
        order = np.argsort(starts * np.int64(1 << 32) + stops, kind="stable")
        return starts[order], stops[order], pieces[order]

    def shortest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids along the shortest paths of the composition with each word, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        marks = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        start, stop, piece = self.arcs(marks, ends)
        taken = self.relaxed(len(marks), start, stop, piece)
        start, piece = start[taken], piece[taken]
        owner = np.repeat(np.arange(len(words)), sizes)[start]
        ids = self.id_of[piece]
        if (piece >= 0).all():
            return ids, np.bincount(owner, minlength=len(words))
        codes = [b"" if at >= 0 else chr(mark).encode("utf-8", "surrogatepass") for at, mark in zip(piece, marks[start])]
        times = np.maximum(1, np.fromiter(map(len, codes), np.int64, len(codes)))
        ids = np.repeat(ids, times)
        ids[np.repeat(piece < 0, times)] = self.byte_table[np.frombuffer(b"".join(codes), np.uint8)]
        return ids, np.bincount(np.repeat(owner, times), minlength=len(words))

    def relaxed(self, places: int, start: np.ndarray, stop: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which arcs lie on shortest paths. Arcs come by start.

        Places that no arc goes across cut the input to segments with shortest paths of their own. Arcs of all segments are
        relaxed in step, by their distance from the segment's start.
        """
        across = np.zeros(places + 1, np.int64)
        np.add.at(across, start + 1, 1)
        np.add.at(across, stop, -1)
        cut = np.cumsum(across) == 0
        place = np.arange(places + 1)
        segment = np.maximum.accumulate(np.where(cut, place, 0))
        first = np.searchsorted(start, np.arange(places + 1))
        n_after = np.append(np.diff(first), 0)
        cost = np.where(piece >= 0, self.cost[piece], self.unknown_cost)
        weight = np.full(len(start), np.inf)
        back = np.full(len(start), -1, np.int64)
        opens = cut[start]
        weight[opens] = cost[opens]
        # Pairs of arcs that meet at a place inside a segment.
        inner = np.flatnonzero(~cut[stop])
        many = n_after[stop[inner]]
        before = np.repeat(inner, many)
        after = np.arange(len(before)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[stop[inner]], many)
        if self.joins:
            passes = self.may_follow(piece[before], piece[after])
            before, after = before[passes], after[passes]
        step = start[after] - segment[start[after]]
        # By step, then arc; of equal weights the arc that came from furthest back is kept.
        order = np.lexsort((before, after, step))
        before, after, step = before[order], after[order], step[order]
        group = np.flatnonzero(np.diff(after, prepend=-1))
        bounds = np.append(np.flatnonzero(np.diff(step[group], prepend=-1)), len(group))
        group = np.append(group, len(after))
        for low, high in zip(bounds, bounds[1:]):
            a, b = group[low], group[high]
            total = weight[before[a:b]]
            heads = group[low:high] - a
            least = np.minimum.reduceat(total, heads)
            own = np.repeat(np.arange(high - low), np.diff(np.append(heads, b - a)))
            hit = np.flatnonzero(total == least[own])
            hit = hit[np.diff(own[hit], prepend=-1) > 0]
            target = after[a + heads]
            weight[target] = least + cost[target]
            back[target] = before[a + hit]
        # The best arc that ends each segment, and from there back to its start.
        last = np.flatnonzero(cut[stop])
        last = last[np.lexsort((start[last], weight[last], stop[last]))]
        now = last[np.diff(stop[last], prepend=-1) > 0]
        taken = np.zeros(len(start), bool)
        while len(now):
            taken[now] = True
            now = back[now]
            now = now[now >= 0]
        return np.flatnonzero(taken)

    def parts(self, text: str) -> list[str]:
        """A text's words, each behind its marks; a line break that is no piece is a word."""
        if not text:
            return []
        text = text.replace(MARK, " ").replace(" ", " " + MARK)
        if self.dummy_prefix:
            text = MARK + text
        if self.break_lines and "\n" in text:
            text = text.replace("\n", " \n ")
        found = text.split(" ")
        if MARK not in found:
            return found
        out, marks = [], 0
        for part in found:
            if part == MARK:
                marks += 1
            elif part.startswith(MARK):
                out.append(marks * MARK + part)
                marks = 0
            else:
                out += [marks * MARK, part] if marks else [part]
                marks = 0
        return [*out, marks * MARK] if marks else out

    def composed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``shortest`` for words behind any number of marks."""
        if not self.joins:
            return self.shortest(words)
        ids, counts = self.shortest([word if not word.startswith(2 * MARK) else MARK + word.lstrip(MARK) for word in words])
        crowded = [at for at, word in enumerate(words) if word.startswith(2 * MARK)]
        if not crowded:
            return ids, counts
        each = np.split(ids, np.cumsum(counts)[:-1])
        for at in crowded:
            marks = len(words[at]) - len(words[at].lstrip(MARK))
            alone = each[at][0] == self.ids.get(MARK)
            run = [self.ids[part] for part in self.joined((marks if alone else marks - 1) * MARK)]
            each[at] = np.concatenate((np.array(run, np.int32), each[at][1:] if alone else each[at]))
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def learn(self, words: list[str]) -> None:
        """Adds words to the table."""
        place = 0
        while place < len(words):
            stop, size = place, 0
            while stop < len(words) and (stop == place or size + len(words[stop]) <= MAX_CHARACTERS):
                size += len(words[stop])
                stop += 1
            ids, counts = self.composed(words[place:stop])
            known = len(self.words)
            end = int(self.bounds[known])
            self.bounds = grown(self.bounds, known + len(counts) + 1)
            self.flat = grown(self.flat, end + len(ids))
            self.bounds[known + 1 : known + len(counts) + 1] = end + np.cumsum(counts)
            self.flat[end : end + len(ids)] = ids
            self.words.update(zip(words[place:stop], range(known, known + len(counts))))
            place = stop

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each text's begin."""
        parts: list[str] = []
        bounds = [0]
        for text in texts:
            parts += self.parts(text or "")
            bounds.append(len(parts))
        found = np.array(list(map(self.words.get, parts)), np.float64)
        missed = np.flatnonzero(np.isnan(found))
        if len(missed):
            own = [parts[at] for at in missed.tolist()]
            self.learn(list(dict.fromkeys(own)))
            found[missed] = list(map(self.words.__getitem__, own))
        place = found.astype(np.int64)
        counts = self.bounds[place + 1] - self.bounds[place]
        total = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(total[-1]) + np.repeat(self.bounds[place] - total[:-1], counts)
        ids = self.flat[at]
        # The words met first are the frequent ones; what does not fit is forgotten.
        while len(self.words) > MAX_WORDS:
            self.words.popitem()
        return ids, total[bounds]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        out = b"".join(map(self.encoded.__getitem__, ids))
        try:
            text = out.decode()
        except UnicodeDecodeError:
            text = out.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for so many."""
    if size <= len(values):
        return values
    return np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)))


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, kept for the life of a worker with the words it has met."""
    kept = sys.modules.setdefault("_haulbook_transducers", types.ModuleType("_haulbook_transducers"))
    key = "m" + hashlib.sha256(model).hexdigest()
    if not hasattr(kept, key):
        setattr(kept, key, Transducer(model))
    return getattr(kept, key)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: larger than {MAX_MODEL_BYTES} bytes")
    return model


def encoder(model: bytes):
    """A column function from texts to ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        transducer = compiled(model)
        ids, offsets = transducer.encode_all(texts.to_pylist())
        return pa.ListArray.from_arrays(offsets.astype(np.int32), ids)

    return encode


def decoder(model: bytes):
    """A column function from ids to texts."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        transducer = compiled(model)
        return pa.array([transducer.decode(row or ()) for row in ids.to_pylist()], pa.string())

    return decode


def both_ways(text: Column, model: bytes) -> Column:
    """A struct of ``ids`` and the ``decoded`` text, in one pass."""

    @F.arrow_udf("ids array<int>, decoded string")
    def run(texts: pa.Array) -> pa.Array:
        transducer = compiled(model)
        ids, offsets = transducer.encode_all(texts.to_pylist())
        decoded = [transducer.decode(ids[a:b].tolist()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        both = pa.ListArray.from_arrays(offsets.astype(np.int32), ids)
        return pa.StructArray.from_arrays([both, pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run(text)


def with_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents with ``ids``, ``n_ids``, ``decoded`` and ``round_trip``: whether decoding gives the text back."""
    model = read_model(model_path)
    rest = docs.drop("ids", "n_ids", "decoded", "round_trip")
    both = unused(rest, "__both")
    return rest.withColumn(both, both_ways(F.col("text"), model)).select(
        *rest.columns,
        F.col(f"{both}.ids").alias("ids"),
        F.size(f"{both}.ids").cast("long").alias("n_ids"),
        F.col(f"{both}.decoded").alias("decoded"),
        (F.col(f"{both}.decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("round_trip"),
    )
