"""Language-model scores by context mixing over the bits of the running text.

A text is its words, A-Z lower-cased, each followed by a blank, and an end, which is a blank alone. Its bytes are predicted
bit by bit, from everything that stands before, across words:
* predictors: counts of ones and zeros in hashed contexts of the last 2, 3, 4 and 6 bytes, of the word so far with the text's
  gate word, and of the word so far with the word before it;
* gated mixing: a logistic mixer adds the predictions; a gate, which long contexts were seen before, selects its weights,
  which are trained online over all training texts, a text's own counts taken out;
* refinement: an adaptive map, by the bits of the byte so far, corrects the mixer's chance by how often it came true. Each
  text weighs mixer and map anew: its chance is the mean of both, so each bit moves the weights for the bits after it.
A text's gate word is the first of the GATES most frequent words that it holds, from there on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import saved, share, ship, whole

ship(__name__)

# Gates, words of the broadcast lexicon (the rest is joined by a shuffle), texts from which one task trains its weights of
# the mixer, tasks that fill the tables at least, and tokens that one of them reads beyond that.
GATES, LEXICON, MIX_TYPES, FILL_TASKS, FILL_TOKENS = 6, 200_000, 2_000, 12, 30_000_000
BYTES = (2, 3, 4, 6)  # bytes of the contexts; behind them the two contexts of words
ORDERS = (18, 20, 22, 22, 22, 22)  # log2 of the slots of each context
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in ORDERS]))).astype(np.int64)
GATING = (2, 3, 5)  # contexts that make the gate
N_GATES = 1 << len(GATING)
# Bytes that are predicted together, bytes after which a long text's contexts begin anew, counts that are added up together,
# bytes of texts sorted together and of those whose words are counted together, steps of a stretched chance, and classes of the
# map.
STEP, PIECE, BLOCK, SORTED, COUNTED, SCALE, CLASSES = 4_096, 65_536, 4_096, 64_000_000, 4_000_000, 16, 25
# Bytes whose contexts are hashed together, and halves of bytes whose entries are scored together: they change no result.
TOGETHER, WINDOW = 65_536, 8_192

# By half byte the slots on the way to its bits, and its bits; by bit and half how far a bit stands from its byte's end.
_WAY = (np.arange(16)[:, None] | 16) >> np.arange(4, 0, -1)
_WAY_BITS = np.arange(16)[:, None] >> np.arange(3, -1, -1) & 1
_SHIFT = np.array([[[7 - j], [3 - j]] for j in range(4)], np.uint8)
# By what a half byte is in its byte (an upper one, or a lower one behind its upper one): its bits, and where the map's classes
# lie that belong to the bits of the byte up to each of them, itself included.
_BITS = np.concatenate([_WAY_BITS, np.tile(_WAY_BITS, (16, 1))]).astype(np.float32)
_PREFIXES = np.concatenate([(np.arange(16)[:, None] | 16) >> np.arange(3, -1, -1), (np.arange(256)[:, None] | 256) >> np.arange(3, -1, -1)])
_CLASS = (_PREFIXES * CLASSES + CLASSES // 2).astype(np.float32)
_SIGN = 1 - 2 * _BITS
_MASKS = np.array([(1 << (8 * j)) - 1 for j in range(BYTES[-1] + 1)], np.uint64)
_LOWER = bytes(32 if c in b"\t\n\v\f\r" else c for c in bytes(range(256)).lower())
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def running(text: bytes) -> bytes:
    """The bytes that are predicted, but for the end."""
    text = text.translate(_LOWER).strip(b" ")
    if b"  " in text:
        text = b" ".join(text.split())
    return text + b" " if text else text


def _mix(x: np.ndarray, shifted: np.ndarray | None = None) -> np.ndarray:
    """x itself, mixed in place."""
    x *= _ODD
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    x *= _ODD2
    return x


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Room:
    """Arrays that are filled anew for each group of texts: fresh memory for each costs more than the sums do."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, name: str, shape: tuple[int, ...], dtype: type) -> np.ndarray:
        size, found = prod(shape), self.kept.get(name)
        if found is None or len(found) < size:
            found = self.kept[name] = np.empty(size + size // 4, dtype)
        return found[:size].reshape(shape)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of the words' factor and of its inverse."""
        if len(self.up) < n:
            self.up, self.down = _powers(_ODD, n + n // 4), _powers(_INVERSE, n + n // 4)
        return self.up[:n], self.down[:n]


def word_hash(word: bytes) -> int:
    """What `Bits` names a word by, its blank left out."""
    with np.errstate(over="ignore"):
        return int(np.sum((np.frombuffer(word, np.uint8) + np.uint64(1)) * _powers(_ODD, len(word)), dtype=np.uint64))


def _at_blanks(run: bytes) -> Iterator[bytes]:
    """A running text's parts of whole words, of at most PIECE bytes if no word is longer."""
    a = 0
    while len(run) - a > PIECE:
        b = run.rfind(b" ", a, a + PIECE) + 1 or run.index(b" ", a + PIECE) + 1
        yield run[a:b]
        a = b
    if a < len(run):
        yield run[a:]


def word_hashes(runs: list[bytes], room: Room) -> np.ndarray:
    """The hash of each word of running texts, one text after the other."""
    found = [np.zeros(0, np.uint64)]
    for group in _groups([part for r in runs for part in _at_blanks(r)], TOGETHER):
        data = np.frombuffer(b"".join(group), np.uint8)
        ends = np.flatnonzero(data == 32)
        up, down = room.powers(len(data))
        terms = room("terms", (len(data),), np.uint64)
        np.add(data, np.uint64(1), out=terms, dtype=np.uint64)
        terms *= up
        sums = np.cumsum(terms, out=terms)[ends] - np.uint64(33) * up[ends]  # each up to its word's blank, left out
        own = sums.copy()
        own[1:] -= sums[:-1] + np.uint64(33) * up[ends[:-1]]
        own[1:] *= down[ends[:-1] + 1]
        found.append(own)
    return np.concatenate(found)


class Bits:
    """The bits of texts laid end to end, each closed by a blank: their values and a slot for each context. A context's 16
    slots for half a byte lie together as a row; the first of them stands for no bit. Arrays over halves hold all upper halves,
    then all lower ones. kind: what each half byte is in its byte. gates: hashes of the gate words. closed: the blank is there
    already. room: where the arrays lie until the next texts take their place."""

    def __init__(self, texts: list[bytes], gates: tuple[int, ...] = (), closed: bool = False, room: Room | None = None):
        texts = texts if closed else [t + b" " for t in texts]
        self.lengths, self.joined = np.array([len(t) for t in texts], np.int64), b"".join(texts)
        self.data, self.room, self.gates = np.frombuffer(self.joined, np.uint8), room or Room(), gates
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.kind = self.room("kind", (2, len(self.data)), np.intp)
        np.right_shift(self.data, 4, out=self.kind[0])
        np.add(self.data, 16, out=self.kind[1], dtype=np.intp)
        self.kind = self.kind.reshape(-1)

    def contexts(self) -> Iterator[np.ndarray]:
        """By context, for each half byte, 16 times its row among the context's, plus the half byte; the next takes its place."""
        n, lengths, room = len(self.data), self.lengths, self.room
        # the 8 bytes before each byte as one number, the last of them lowest; none from before its text
        back, wide, line, spare = (room(x, (n,), np.uint64) for x in ("back", "wide", "line", "spare"))
        back[:] = np.ndarray(n, ">u8", bytes(8) + self.joined, 0, (1,))
        near = np.arange(BYTES[-1])
        early = near < lengths[:, None]
        back[(self.starts[:, None] + near)[early]] &= _MASKS[np.broadcast_to(near, early.shape)[early]]
        wide[:] = self.data
        word = room("word", (n,), np.uint64)
        full, at, sizes = self._words(wide, word, spare)
        text_of = np.searchsorted(self.starts, at, "right") - 1
        half = room("half", (2, n), np.uint64)
        np.right_shift(wide, np.uint64(4), out=half[0])
        np.bitwise_and(wide, np.uint64(15), out=half[1])
        np.add(half[0], np.uint64(1), out=wide)
        wide *= np.uint64(0xD6E8FEB86659FD93)
        for j, order in zip(BYTES, ORDERS):
            np.bitwise_and(back, _MASKS[j], out=line)
            line += np.uint64(1)
            yield self._entries(_mix(line, spare), order, half, wide)
        before = np.zeros(len(at), np.uint64)
        before[1:] = np.where(text_of[1:] == text_of[:-1], full[:-1] + np.uint64(1), 0)
        word += np.uint64(1)
        _mix(word, spare)
        for own, order in zip((self._gates(full, text_of, len(lengths), self.gates), before + np.uint64(99)), ORDERS[len(BYTES):]):
            np.add(word, np.repeat(_mix(own), sizes), out=line)
            yield self._entries(line, order, half, wide)

    def _entries(self, context: np.ndarray, order: int, half: np.ndarray, wide: np.ndarray) -> np.ndarray:
        out = self.room("entries", half.shape, np.uint64)
        np.right_shift(context, np.uint64(64 - order), out=out[0])
        context += wide
        context *= _ODD
        np.right_shift(context, np.uint64(64 - order), out=out[1])
        out &= np.uint64(~15 & (1 << 64) - 1)
        out |= half
        return out.view(np.int64).reshape(-1)

    @staticmethod
    def _gates(full: np.ndarray, text_of: np.ndarray, n: int, gates: tuple[int, ...]) -> np.ndarray:
        """For each word the gate word that comes first in its text, if it stands before; else 0."""
        hit = np.flatnonzero((full == np.array(gates, np.uint64)[:, None]).any(0))[::-1]
        first, which = np.full(n, len(full)), np.zeros(n, np.uint64)
        first[text_of[hit]], which[text_of[hit]] = hit, full[hit]  # of a text's hits the first is put last
        return np.where(np.arange(len(full)) > first[text_of], which[text_of], np.uint64(0))

    def _words(self, wide: np.ndarray, out: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Puts into out, for each byte, the hash of its word before it; for each word its hash, first byte and bytes."""
        first = np.empty(len(wide), bool)
        np.equal(self.data[:-1], 32, out=first[1:])
        first[self.starts] = True
        at = np.flatnonzero(first)
        sizes = np.diff(at, append=len(wide))
        up, down = self.room.powers(len(wide))
        np.add(wide, np.uint64(1), out=terms)
        terms *= up
        np.cumsum(terms, out=out)
        out -= terms
        out -= np.repeat(out[at], sizes)
        out *= np.repeat(down[at], sizes)
        return out[at + sizes - 1], at, sizes

    def looked_up(self, paths: list[np.ndarray], met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """By context the entries of the four bits of each half byte, as one number; for each half byte its gate, by the rows
        (met) that have a bit of it."""
        found, gate = self.room("found", (len(paths), len(self.kind)), np.uint32), self.room("gate", self.kind.shape, np.uint8)
        own, row = self.room("met", gate.shape, np.uint8), self.room("row", gate.shape, np.int64)
        gate.fill(0)
        for k, (path, entries) in enumerate(zip(paths, self.contexts())):
            path.take(entries, out=found[k], mode="clip")
            if k in GATING:
                gate |= met[GATING.index(k)].take(np.right_shift(entries, 4, out=row), out=own, mode="clip")
        return found, gate

    @property
    def row(self) -> np.ndarray:
        """Rows by context, byte and half."""
        rows = np.stack([(a + entries) >> 4 for a, entries in zip(STARTS, self.contexts())])
        return rows.reshape(len(ORDERS), 2, -1).transpose(0, 2, 1)

    @property
    def value(self) -> np.ndarray:
        """The bits."""
        return (self.data >> _SHIFT & 1).transpose(2, 1, 0).reshape(-1).astype(np.int64)

    @property
    def slots(self) -> np.ndarray:
        """By context the slot of each bit."""
        half = np.stack([self.data >> 4, self.data & 15], 1)
        return (self.row[..., None] * 16 + _WAY[half]).reshape(len(ORDERS), -1)


class Tables:
    """What the slots say, a row for 16: the stretched chance of a one in steps of 1 / SCALE, and the same once a zero or a one
    is taken out (for texts that the counts hold). In place of the slot for no bit: how often, up to 3 times, a row was met."""

    def __init__(self, chance: np.ndarray | None, without: np.ndarray):
        self.chance, self.without, self.looks = chance, without, None

    def ready(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The paths and gates of `chance`, made once."""
        if self.looks is None:
            self.looks = self.paths(self.chance), self.met(self.chance, 2)
        return self.looks

    @staticmethod
    def paths(table: np.ndarray) -> list[np.ndarray]:
        """Per context, by row and half byte, the entries of its four bits side by side, as one number."""
        values = table.shape[1] // 16
        way = _WAY if values == 1 else 2 * _WAY + _WAY_BITS
        out = np.empty((len(table), 64), np.int8)  # one array, whose memory goes back as a whole when a task ends
        for a in range(0, len(table), BLOCK):  # few at a time stay near
            table[a:a + BLOCK].take(way.reshape(-1), axis=1, out=out[a:a + BLOCK], mode="clip")
        return np.split(out.view(np.uint32).reshape(-1), STARTS[1:-1])

    @staticmethod
    def met(table: np.ndarray, least: int) -> list[np.ndarray]:
        """Per context that makes the gate, by row, its bit of the gate: was the row met that often?"""
        return [(table[STARTS[k] >> 4:STARTS[k + 1] >> 4, 0] >= least).astype(np.uint8) << np.uint8(i) for i, k in enumerate(GATING)]

    @classmethod
    def of(cls, counts: np.ndarray | Tables) -> Tables:
        """counts: all and ones by slot."""
        return counts if isinstance(counts, Tables) else cls(*_chances(counts[0].reshape(-1, 16), counts[1].reshape(-1, 16)))


def _stretched(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = np.log((n1 + np.float32(0.2)) / (n - n1 + np.float32(0.2)))
    return np.clip(np.rint(x * SCALE), -127, 127).astype(np.int8)


def _chances(n: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, n1 = n.astype(np.float32), n1.astype(np.float32)
    met, less = np.minimum(n[:, 1], 3).astype(np.int8), np.maximum(n - 1, 0)
    chance = _stretched(n1, n)
    without = np.stack([_stretched(np.minimum(n1, less), less), _stretched(np.maximum(n1 - 1, 0), less)], 2).reshape(-1, 32)
    chance[:, 0] = without[:, 0] = met
    return chance, without


def _by_slot(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all, ones) by slot from how often each half byte came in each row."""
    n, n1 = np.zeros(halves.shape, np.int64), np.zeros(halves.shape, np.int64)
    for size in (8, 4, 2, 1):
        pairs = halves.reshape(len(halves), size, 2)
        halves = pairs.sum(2)
        n[:, size:2 * size], n1[:, size:2 * size] = halves, pairs[:, :, 1]
    return n, n1


def _numbers(found: np.ndarray, room: Room) -> np.ndarray:
    """By context the entry of each bit."""
    out = room("numbers", (len(found), 4 * found.shape[1]), np.float32)
    for line, four in zip(out, found):
        line[:] = four.view(np.int8)
    return out


def _mixed(weights: np.ndarray, numbers: np.ndarray, gate: np.ndarray, room: Room) -> tuple[np.ndarray, list]:
    """The weighted sums of the numbers, weights by gate, within 12 of 0; (gate, its halves, their numbers) of all gates but
    the commonest, which comes first with none: its weights add up all of them, the others' halves are added up anew."""
    times = np.bincount(gate, minlength=N_GATES)
    most = int(times.argmax())
    dot, others = np.dot(weights[most], numbers, out=room("dot", numbers.shape[1:], np.float32)), [(most, None, None)]
    for g in np.flatnonzero(times):
        if g != most:
            at = np.flatnonzero(gate == g)
            own = numbers.reshape(len(numbers), -1, 4)[:, at].reshape(len(numbers), -1)
            dot.reshape(-1, 4)[at] = np.dot(weights[g], own).reshape(-1, 4)
            others.append((g, at, own))
    return np.clip(dot, -12, 12, out=dot), others


def _by_kind(table: np.ndarray, kind: np.ndarray, room: Room, name: str) -> np.ndarray:
    """What the table holds for each bit of these halves."""
    return table.take(kind, axis=0, out=room(name, (len(kind), 4), table.dtype), mode="clip").reshape(-1)


def _groups(texts: list[bytes], least: int = STEP) -> Iterator[list[bytes]]:
    """Neighbouring texts of that many bytes or more."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= least:
            yield group
            group, size = [], 0
    if group:
        yield group


def _pieces(text: bytes) -> list[bytes]:
    """The text with its end, cut into pieces of at most PIECE bytes."""
    text += b" "
    return [text[a:a + PIECE] for a in range(0, len(text), PIECE)]


def _untrained() -> tuple[np.ndarray, np.ndarray]:
    """Weights (gate, context) and the map's counts before any text."""
    return np.full((N_GATES, len(ORDERS)), 0.25, np.float32), np.zeros((2, 256 * CLASSES))


class Training:
    """Weights (gate, context) and the map's counts (all, ones), trained online: a step down the coding cost for each group
    of texts, smaller as there are more of them."""

    def __init__(self, tables: np.ndarray | Tables, gates: tuple[int, ...] = ()):
        self.gates, self.steps, without = gates, 0, Tables.of(tables).without
        self.paths, self.met = Tables.paths(without), Tables.met(without, 3)
        self.weights, self.counts, self.room = *_untrained(), Room()

    def read(self, texts: list[bytes]) -> None:
        held, size = [], 0
        for group in _groups([p for t in texts for p in _pieces(t)]):
            held.append(group)
            size += sum(map(len, group))
            if size >= TOGETHER:
                self._steps(held)
                held, size = [], 0
        if held:
            self._steps(held)

    def _steps(self, groups: list[list[bytes]]) -> None:
        """A step for each group; what they look up doesn't depend on the weights."""
        bits = Bits([t for g in groups for t in g], self.gates, True, self.room)
        ends = np.cumsum([sum(map(len, g)) for g in groups])
        both = lambda x: x.reshape(*x.shape[:-1], 2, -1)
        found, gate, kind = map(both, (*bits.looked_up(self.paths, self.met), bits.kind))
        classes = self.room("classes", (8 * len(bits.data),), np.intp)
        for a, b in zip([0, *ends], ends):
            self._step(found[..., a:b].reshape(len(found), -1), gate[:, a:b].reshape(-1), kind[:, a:b].reshape(-1), classes[8 * a:8 * b])
        # by the bits of the byte and the step of the mixer's chance
        zeros, ones = np.bincount(classes, minlength=512 * CLASSES).reshape(256, 2, CLASSES).swapaxes(0, 1).reshape(2, -1)
        self.counts += np.stack([zeros + ones, ones])

    def _step(self, found: np.ndarray, gate: np.ndarray, kind: np.ndarray, classes: np.ndarray) -> None:
        numbers = _numbers(found, self.room)
        dot, others = _mixed(self.weights * np.float32(1 / SCALE), numbers, gate, self.room)
        error = self.room("error", dot.shape, np.float32)
        np.exp(np.negative(dot, out=error), out=error)
        error += 1
        np.subtract(_by_kind(_BITS, kind, self.room, "bits"), np.divide(1, error, out=error), out=error)
        self.steps += 1
        rate, least = max(0.02, 0.5 / (1 + self.steps / 16)) / SCALE, 500
        for g, at, own in others[1:]:
            its = error.reshape(-1, 4)[at].reshape(-1)
            self.weights[g] += rate / max(len(its), least) * np.dot(own, its)
            error.reshape(-1, 4)[at] = 0
        left = len(error) - sum(4 * len(at) for _, at, _ in others[1:])
        self.weights[others[0][0]] += rate / max(left, least) * np.dot(numbers, error)
        np.rint(dot, out=dot)
        dot += _by_kind(_CLASS, kind, self.room, "class")
        classes[:] = dot


def train_mixer(tables: np.ndarray | Tables, texts: list[bytes]) -> np.ndarray:
    """Weights (gate, context) trained on these texts alone."""
    training = Training(tables)
    training.read(texts)
    return training.weights.astype(float)


def spell(tables: np.ndarray | Tables, weights: np.ndarray, texts: list[bytes], counts: np.ndarray | None = None, gates: tuple[int, ...] = ()) -> np.ndarray:
    """log10 of the chance of each text's bytes and the end behind them; counts are those of the map, if there is one."""
    (paths, met), weights = Tables.of(tables).ready(), (weights / SCALE).astype(np.float32)
    pieces = [_pieces(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    lines = None if counts is None else _map_lines(counts)
    costs, room = [], Room()
    for group in _groups([p for parts in pieces for p in parts], TOGETHER):
        bits = Bits(group, gates, True, room)
        found, gate = bits.looked_up(paths, met)
        own = room("costs", (1 if lines is None else 2, len(gate)), np.float64)
        for a in range(0, len(gate), WINDOW):
            few = slice(a, a + WINDOW)
            dot, _ = _mixed(weights, _numbers(found[:, few], room), gate[few], room)
            if lines is not None:
                step = np.floor(dot, out=room("step", dot.shape, np.float32))
                step += _by_kind(_CLASS, bits.kind[few], room, "class")
                at = room("classes", dot.shape, np.intp)
                at[:] = step
                rise = lines[1].take(at, out=room("rise", dot.shape, np.float32), mode="clip")
                rise *= dot
                rise += lines[0].take(at, out=step, mode="clip")
                _cost(rise, own[1, few], room)
            dot *= _by_kind(_SIGN, bits.kind[few], room, "class")
            _cost(dot, own[0, few], room)
        costs.append(np.add.reduceat(own.reshape(len(own), 2, -1).sum(1), bits.starts, axis=1))
    if not costs:
        return np.zeros(0)
    logs = np.stack([-np.bincount(owner, c, len(texts)) for c in np.concatenate(costs, 1)])
    return (np.logaddexp.reduce(logs, 0) - np.log(len(logs))) / np.log(10)


def _map_lines(counts: np.ndarray) -> np.ndarray:
    """By the bits of the byte, the last included, and the step below the mixer's stretched chance x: a and b, where a + b x is
    the mean of x and what the map says, drawn straight from step to step, negative if the last bit is a one."""
    middle = np.arange(CLASSES) - CLASSES // 2
    n, n1 = counts.reshape(2, 256, CLASSES)
    ones = (n1 + 8 / (1 + np.exp(-middle))) / (n + 8)
    said = np.log(ones / (1 - ones))
    rise = np.diff(said, append=said[:, -1:])
    line = np.stack([said - rise * middle, 1 + rise]) / 2
    return np.stack([line, -line], 2).astype(np.float32).reshape(2, -1)


def _cost(x: np.ndarray, out: np.ndarray, room: Room) -> None:
    """Per half byte the sum of log(1 + exp(x)) over its four bits: one logarithm in place of four. x is lost."""
    np.exp(x, out=x)
    x += 1
    for name in ("pairs", "fours"):
        x = np.multiply(x[::2], x[1::2], out=room(name, (len(x) // 2,), np.float32))
    out[:] = x
    np.log(out, out=out)


def _count(counts: np.ndarray, texts: list[bytes], gates: tuple[int, ...]) -> None:
    """Add to counts (row, half byte) what these running texts hold."""
    flat, one, room = counts.reshape(-1), counts.dtype.type(1), Room()
    for group in _groups([p for t in texts for p in _pieces(t)], TOGETHER):
        bits = Bits(group, gates, True, room)
        for a, b, entries in zip(STARTS, STARTS[1:], bits.contexts()):
            np.add.at(flat[a:b], entries, one)


def packed(counts: np.ndarray) -> bytes:
    """Counts by their lowest bytes, then by the next ones, as many as the largest needs: most counts need one."""
    size = max(1, -(-int(counts.max()).bit_length() // 8))
    return counts.astype("<i4").view(np.uint8).reshape(-1, 4).T[:size].tobytes()


def unpacked(cell: bytes) -> np.ndarray:
    """The BLOCK counts that were packed."""
    planes = np.frombuffer(cell, np.uint8).reshape(-1, BLOCK).astype(np.int64)
    return sum(plane << (8 * k) for k, plane in enumerate(planes))


def _fill(train: DataFrame, gates: tuple[int, ...], n: int) -> Tables:
    """The tables over the texts (a binary column `word`) of n training tokens. Each task counts into rows of a fixed number
    and gives them as blocks; blocks are added up, and made into chances, by their number."""
    rows = int(STARTS[-1]) // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((rows, 16), np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                _count(counts, [running(t) for t in batch.column(0).slice(a, 512).to_pylist()], gates)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for a in range(0, len(used), 64):
            part = used[a:a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([packed(blocks[b]) for b in part], pa.binary())],
                                             names=["block", "counts"])

    def add(key: tuple, found: pa.Table) -> pa.Table:
        both = sum(unpacked(c.as_py()) for c in found.column("counts"))
        made = [pa.array([x.tobytes()], pa.binary()) for x in _chances(*_by_slot(both.reshape(-1, 16)))]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *made], names=["block", "chance", "without"])

    counted = train.coalesce(max(FILL_TASKS, n // FILL_TOKENS)).mapInArrow(run, "block int, counts binary")
    found = counted.groupBy("block").applyInArrow(add, "block int, chance binary, without binary").toArrow()
    out = np.zeros((rows, 16), np.int8), np.zeros((rows, 32), np.int8)
    for block, *parts in zip(*(c.to_pylist() for c in found.columns)):
        for table, part in zip(out, parts):
            table.reshape(-1)[block * len(part):(block + 1) * len(part)] = np.frombuffer(part, np.int8)
    return Tables(*out)


def _words_of(joined: bytes) -> pa.Array:
    """The words, with their blanks, of running texts laid end to end."""
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def _vocabulary(texts: DataFrame) -> DataFrame:
    """The words of the texts (binary columns `text`, `out`): word (binary), its hash h, and c, how often it comes in texts that
    aren't out. Words of some megabytes are counted together before they are moved."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = (batch.slice(a, 512) for a in range(0, batch.num_rows, 512))
            cells = (cell for few in slices for cell in zip(*(c.to_pylist() for c in few.columns)))
            for group in _sized((running(t), out) for t, out in cells):
                for out in (False, True):
                    found = _words_of(b"".join(run for run, its in group if its == out)).value_counts()
                    word = pc.binary_slice(found.field("values"), 0, -1)
                    c = found.field("counts")
                    yield pa.RecordBatch.from_arrays([word, pc.multiply(c, 0) if out else c], names=["word", "c"])
                    del found, word, c
            pa.default_memory_pool().release_unused()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room()
        for batch in batches:
            h = word_hashes([w + b" " for w in batch.column(0).to_pylist()], room)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), batch.column(1)], names=["word", "h", "c"])

    counts = texts.select("text", "out").mapInArrow(counted, "word binary, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("c")).mapInArrow(hashed, "word binary, h long, c long")


def _sized(rows: Iterator[tuple[bytes, bool]]) -> Iterator[list[tuple[bytes, bool]]]:
    """Rows in groups of about COUNTED bytes of text."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[0])
        if size >= COUNTED:
            yield group
            group, size = [], 0
    if group:
        yield group


def _gate_words(docs: DataFrame) -> list[str]:
    """The most frequent words of all training texts, of two signs or more."""
    return _frequent(_vocabulary(docs.select(whole(F.col("text")).cast("binary").alias("text"), F.lit(False).alias("out"))))


def _frequent(counts: DataFrame) -> list[str]:
    named = counts.select(F.col("word").cast("string").alias("word"), "c")
    top = named.where("c > 0 AND length(word) >= 2").orderBy(F.desc("c"), "word").limit(GATES)
    return [r["word"] for r in top.collect()]


def _train(texts: DataFrame, tables: Tables, n: int, gates: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's weights and the map's counts over n texts (a column `word`): each task trains on about MIX_TYPES of them
    or more; weights are averaged by the tasks' texts, counts added up. Few texts are one task's."""
    tables = Tables(None, tables.without)  # the other half is as large and needn't be sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        training, read, held, size = Training(tables, gates), 0, [], 0
        tables.without = None  # a task keeps its paths alone
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                held.append(running(cell)[:-1] if isinstance(cell, bytes) else cell.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > SORTED:  # the order is the texts' as far as memory allows
                    training.read(sorted(held))
                    read, held, size = read + len(held), [], 0
        training.read(sorted(held))
        read += len(held)
        if read:
            values = np.concatenate([training.weights.reshape(-1).astype(float) * read, training.counts.reshape(-1), [read]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "x"])

    trained = texts.select("word").coalesce(max(1, n // MIX_TYPES)).mapInArrow(run, "i int, x double")
    rows = trained.groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # as many as the model has numbers
    weights, counts = _untrained()
    if not rows.num_rows:
        return weights.astype(float), counts
    values = rows.column("x").to_numpy()[np.argsort(rows.column("i").to_numpy())]
    size = weights.size
    return (values[:size] / values[-1]).reshape(weights.shape), values[size:-1].reshape(counts.shape)


def _mixer(types: DataFrame, tables: np.ndarray | Tables, n: int) -> np.ndarray:
    """The mixer's weights alone, without gate words."""
    return _train(types, Tables.of(tables), n, ())[0]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, held_out (crc32 of the id modulo 5 is 1), n_tokens, n_known, train_tokens, base_score,
    score (log10 chance of the text) and bits_per_byte (by the text's UTF-8 bytes; null for an empty text).

    Learns from all rows that aren't held out; a null id isn't. Null and empty texts are an end alone. Rows that repeat
    count and are scored each. With no training text, each bit is as likely as not. No rows give no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), (share(F.col(id_col), 5) == 1).alias("out"))
    train = base.where("NOT out").select(F.col("text").cast("binary").alias("word"))
    vocabulary = _vocabulary(base.select(F.col("text").cast("binary").alias("text"), "out")).persist(StorageLevel.DISK_ONLY)
    try:
        train_docs = train.count()
        sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
        n, v = sums["n"] + train_docs, sums["v"] + (train_docs > 0)
        gates = tuple(word_hash(w.encode()) for w in _frequent(vocabulary))
        tables = _fill(train, gates, n)
        weights, counts = _train(train, tables, train_docs, gates)

        own = Tables(tables.chance, None)

        def chances(runs: list[bytes]) -> np.ndarray:
            own.ready()
            own.chance = None  # a task keeps its paths alone
            return spell(own, weights, runs, counts, gates)

        return _scored(base, vocabulary.select("h", "c"), n, v, train_docs, chances, id_col)
    finally:
        vocabulary.unpersist()


def _finder(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives for each number its place among the keys, or their number: by a slot of its own for most keys
    (of those that share one the first), by search for the others."""
    bits = max(4, len(keys).bit_length() + 2)
    slot = lambda h: (h.view(np.uint64) * _ODD2 >> np.uint64(64 - bits)).view(np.int64)
    slots, places, none = np.zeros(1 << bits, np.int32), np.arange(len(keys), dtype=np.int32), len(keys)
    slots[slot(keys)[::-1]] = places[::-1]
    second = np.flatnonzero(slots[slot(keys)] != places)
    second = second[np.argsort(keys[second])]
    held, others = np.append(keys, 0), np.append(keys[second], 0)

    def find(h: np.ndarray) -> np.ndarray:
        at = slots.take(slot(h)).astype(np.int64)
        other = np.flatnonzero(held.take(at) != h)
        if none == 0:
            at[:] = 0
        elif len(other):
            near = np.searchsorted(others[:-1], h[other])
            hit = (near < len(second)) & (others.take(near) == h[other])
            at[other] = np.where(hit, np.append(second, none).take(near), none)
        return at

    return find


def _scored(base: DataFrame, known: DataFrame, n: int, v: int, train_docs: int, chances, id_col: str) -> DataFrame:
    """The base's columns by a lexicon of the frequent words, and by a join for the others; chances gives the scores."""
    floor = n + 0.5 * (v + 1)
    measures = lambda c: (np.log10((c + 0.5) / floor), (c > 0).astype(float))
    top = known.orderBy(F.desc("c"), "h").limit(LEXICON).toArrow()
    keys = top.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
    lexicon = [np.append(x, 0) for x in measures(top.column("c").to_numpy(zero_copy_only=False).astype(float))]
    find, end = _finder(keys), [float(x[0]) for x in measures(np.array([float(train_docs)]))]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room()
        for batch in batches:
            totals, tails, left, scores, counted = np.tile(np.array(end)[:, None], batch.num_rows), [np.zeros(0, np.int64)], [[0]], [], []
            for a in range(0, batch.num_rows, 512):  # few texts at a time, so that memory stays bounded
                runs = [running(t) for t in batch.column("text").slice(a, 512).to_pylist()]
                h, sizes = word_hashes(runs, room).view(np.int64), np.array([r.count(b" ") for r in runs], np.int64)
                at, full = find(h), np.flatnonzero(sizes)
                missing, own = at == len(keys), np.zeros(len(runs), np.int32)
                if len(full):
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for total, x in zip(totals, lexicon):
                        total[a + full] += np.add.reduceat(x.take(at), starts)
                    own[full] = np.add.reduceat(missing, starts, dtype=np.int32)
                left.append(own)
                tails.append(h[missing])
                counted.append(sizes + 1)
                scores.append(chances(runs))
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(left), dtype=np.int32)), pa.array(np.concatenate(tails)))
            n_tokens, score = (np.concatenate([np.zeros(0), *x]) for x in (counted, scores))
            bits = pc.binary_length(batch.column("text")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], bits, pa.array(n_tokens.astype(np.int64)), rest, *map(pa.array, totals), pa.array(score)],
                names=["row", "id", "out", "bytes", "n_tokens", "rest", "b", "known", "score"])

    id_type = base.schema["id"].dataType.simpleString()
    numbered = base.select(F.monotonically_increasing_id().alias("row"), "id", "out", F.col("text").cast("binary").alias("text"))
    first = saved(numbered.mapInArrow(look_up, f"row long, id {id_type}, out boolean, bytes int, n_tokens long, rest array<long>, b double, known double, score double"))

    c = F.col("c").cast("double")
    rated = known.select("h", F.log10((c + 0.5) / floor).alias("b"), (c > 0).cast("double").alias("known"))
    tail = first.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    more = tail.join(rated, "h").groupBy(F.col("row").alias("r")).agg(*(F.sum(F.col(x) * F.col("times")).alias(f"m_{x}") for x in ("b", "known")))
    met = first.join(more, F.col("row") == F.col("r"), "left")
    full = {x: F.col(x) + F.coalesce(f"m_{x}", F.lit(0.0)) for x in ("b", "known")}
    bits = F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes"))
    return saved(met.select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", F.round(full["known"]).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), full["b"].alias("base_score"), "score", bits.alias("bits_per_byte")))
