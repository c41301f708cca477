"""Weighted acyclic automata over labels: phrases and how often each was seen.

A transducer reads a phrase label by label from its root and gives the weight of the state
it ends in. It is held level by level: the states of a depth are sorted by the state they
come from and their label, which is the order in which sorted phrases open them, and each
has its weight, zero where nothing ends. Labels are numbered in byte order when a shard is
built, and in the order they are met when transducers are united; every step works on
whole levels and label tables as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Level(NamedTuple):
    parent: np.ndarray  # state of the level before, ascending
    label: np.ndarray  # index of the label, ascending within a parent
    weight: np.ndarray


class Transducer(NamedTuple):
    labels: pa.Array  # binary, distinct
    levels: list[Level]

    def size(self) -> int:
        return sum(len(level.label) for level in self.levels)


def _unique(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def distinct(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the place of each key among them, and their summed weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(fresh)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    total = np.diff(np.append(first, len(keys))) if weight is None else np.add.reduceat(weight[order], first)
    return ordered[first], place, total


def _level(keys: np.ndarray, many: int, weight: np.ndarray) -> Level:
    return Level(keys // many, keys % many, weight)


def from_stream(words: np.ndarray, root: np.ndarray, labels: list[bytes], longest: int, until: int) -> Transducer:
    """All phrases of up to ``longest`` words that begin before place ``until``.

    ``words`` has a label's number per place, a negative one where phrases end; ``root``
    has the number of the first label of each phrase that begins there.
    """
    order = sorted(range(len(labels)), key=labels.__getitem__)
    rank = np.empty(len(labels), np.int64)
    rank[order] = np.arange(len(labels))
    many = max(1, len(labels))
    number = np.where(words < 0, -1, rank[words])
    begin = np.flatnonzero(number[:until] >= 0)
    keys, state, count = distinct(rank[root[begin]])
    levels = [Level(np.zeros(len(keys), np.int64), keys, np.zeros_like(count))]
    for depth in range(longest):
        at = begin + depth
        goes = at < len(number)
        goes[goes] = number[at[goes]] >= 0
        begin, state = begin[goes], state[goes]
        keys, state, count = distinct(state * many + number[begin + depth])
        levels.append(_level(keys, many, count))
    return Transducer(pa.array([labels[i] for i in order], pa.binary()), levels)


def from_phrases(phrases: Sequence[Sequence[bytes]], weights: Sequence[int]) -> tuple[Transducer, list[tuple[int, int]]]:
    """A transducer of given phrases, and the level and state each of them ends in."""
    labels = sorted({word for phrase in phrases for word in phrase})
    number = {word: i for i, word in enumerate(labels)}
    many = max(1, len(labels))
    longest = max(map(len, phrases), default=0)
    grid = np.full((len(phrases), longest), -1, np.int64)
    for row, phrase in enumerate(phrases):
        grid[row, : len(phrase)] = [number[word] for word in phrase]
    length, weight = np.array([len(p) for p in phrases], np.int64), np.array(weights, np.int64)
    state, ends, levels = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64), []
    for depth in range(longest):
        own = np.flatnonzero(length > depth)
        last = length[own] == depth + 1
        keys, place, total = distinct(state[own] * many + grid[own, depth], np.where(last, weight[own], 0))
        state[own] = place
        ends[own[last]] = place[last]
        levels.append(_level(keys, many, total))
    return Transducer(pa.array(labels, pa.binary()), levels), list(zip((length - 1).tolist(), ends.tolist()))


def union(parts: Sequence[Transducer]) -> Transducer:
    """One transducer that gives each phrase the sum of its weights in all parts."""
    if len(parts) == 1:
        return parts[0]
    met = pa.concat_arrays([p.labels for p in parts]).dictionary_encode()
    labels = met.dictionary
    ends = np.cumsum([len(p.labels) for p in parts])
    names = np.split(met.indices.to_numpy().astype(np.int64), ends[:-1])
    many = max(1, len(labels))
    states: list[np.ndarray] = [np.zeros(1, np.int64)] * len(parts)
    levels = []
    for depth in range(max(len(p.levels) for p in parts)):
        at = [i for i, p in enumerate(parts) if depth < len(p.levels)]
        here = [parts[i].levels[depth] for i in at]
        keys = np.concatenate([states[i][level.parent] * many + names[i][level.label] for i, level in zip(at, here)])
        keys, place, total = distinct(keys, np.concatenate([level.weight for level in here]))
        levels.append(_level(keys, many, total))
        ends = np.cumsum([len(level.label) for level in here])
        for i, part in zip(at, np.split(place, ends[:-1])):
            states[i] = part
    return Transducer(labels, levels)


def follow(counts: Transducer, asked: Transducer) -> list[np.ndarray]:
    """The composition: per level, the weight ``counts`` gives each state of ``asked``.

    Both are walked in step; a state that ``counts`` does not have weighs nothing.
    """
    names = pc.fill_null(pc.index_in(asked.labels, value_set=counts.labels), -1).to_numpy().astype(np.int64)
    many = max(1, len(counts.labels))
    state, out = np.zeros(1, np.int64), []
    for depth, level in enumerate(asked.levels):
        before, label = state[level.parent], names[level.label]
        state = np.full(len(label), -1)
        weight = np.zeros(len(label), np.int64)
        if depth < len(counts.levels):
            here = counts.levels[depth]
            keys = here.parent * many + here.label
            wanted = before * many + label
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            met = (before >= 0) & (label >= 0) & (keys[place] == wanted)
            state[met] = place[met]
            weight[met] = here.weight[place[met]]
        out.append(weight)
    return out


def split(whole: Transducer, homes: Sequence[np.ndarray]) -> Iterator[tuple[int, Transducer]]:
    """One transducer per home, each with the phrases whose last state lives there.

    ``homes`` has the home of every state, by level. States on the way to others come
    along with no weight.
    """
    deepest = len(whole.levels) - 1
    rows: list[tuple[np.ndarray, ...]] = []
    above = np.zeros(0, np.int64)
    # From the leaves up: a home needs its own states and those before them.
    for depth in range(deepest, -1, -1):
        level, home = whole.levels[depth], homes[depth].astype(np.int64)
        many = max(1, len(level.label))
        own = home * many + np.arange(len(level.label))
        keys = np.sort(own) if not len(above) else _unique(np.concatenate([own, above]))
        at, state = keys // many, keys % many
        weight = np.where(home[state] == at, level.weight[state], 0)
        # A state that only stands for its own weight of none is needed by nobody.
        if depth == 0:
            used = np.isin(keys, above, assume_unique=True)
            keys, at, state, weight = keys[used], at[used], state[used], weight[used]
        rows.append((keys, at, state, weight))
        if depth:
            before = max(1, len(whole.levels[depth - 1].label))
            above = _unique(at * before + level.parent[state])
    rows.reverse()
    ids = _unique(rows[0][1])
    number = np.zeros(len(whole.labels), np.int64)
    edges = [np.searchsorted(at, np.append(ids, ids[-1] + 1 if len(ids) else 0)) for _, at, _, _ in rows]
    for i, home_id in enumerate(ids.tolist()):
        parts = []
        for depth, (keys, at, state, weight) in enumerate(rows):
            a, b = edges[depth][i], np.searchsorted(at, home_id, side="right")
            level = whole.levels[depth]
            if depth:
                before, many = rows[depth - 1][0], max(1, len(whole.levels[depth - 1].label))
                parent = np.searchsorted(before, home_id * many + level.parent[state[a:b]]) - edges[depth - 1][i]
            else:
                parent = np.zeros(b - a, np.int64)
            parts.append(Level(parent, level.label[state[a:b]], weight[a:b]))
        mark = np.zeros(len(whole.labels), bool)
        for part in parts:
            mark[part.label] = True
        used = np.flatnonzero(mark)
        number[used] = np.arange(len(used))
        levels = [Level(p.parent, number[p.label], p.weight) for p in parts]
        yield home_id, Transducer(whole.labels.take(pa.array(used)), levels)


def phrases(of: Transducer, least: int = 1) -> Iterator[tuple[int, list[pa.Array], np.ndarray]]:
    """Per level, phrases of at least that weight: a column for each of their labels, and the weights."""
    for depth, level in enumerate(of.levels):
        state = np.flatnonzero(level.weight >= least)
        weight, columns = level.weight[state], []
        for back in range(depth, -1, -1):
            columns.append(of.labels.take(pa.array(of.levels[back].label[state])))
            state = of.levels[back].parent[state]
        yield depth, columns[::-1], weight


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def _packed(values: np.ndarray) -> bytes:
    top = int(values.max()) if len(values) else 0
    width = next(i for i, kind in enumerate(_WIDTHS) if top <= np.iinfo(kind).max)
    data = values.astype(_WIDTHS[width]).tobytes()
    return np.array([width, len(values)], np.int64).tobytes() + data


def _unpacked(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    width, many = np.frombuffer(data, np.int64, 2, at).tolist()
    kind = np.dtype(_WIDTHS[width])
    at += 16
    return np.frombuffer(data, kind, many, at).astype(np.int64), at + many * kind.itemsize


def encode(of: Transducer) -> bytes:
    """As bytes: labels, then per level the number of states from each state before it,
    labels and weights, in the narrowest integers, compressed."""
    offsets = np.frombuffer(of.labels.buffers()[1], np.int32, len(of.labels) + 1, 4 * of.labels.offset)
    words = memoryview(of.labels.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    parts = [_packed(np.diff(offsets).astype(np.int64)), words]
    before = 1
    for level in of.levels:
        parts += [_packed(np.bincount(level.parent, minlength=before)), _packed(level.label), _packed(level.weight)]
        before = len(level.label)
    raw = b"".join(parts)
    return np.array([len(raw), len(of.levels)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def decode(data: bytes) -> Transducer:
    size, many = np.frombuffer(data, np.int64, 2).tolist()
    raw = memoryview(pa.decompress(data[16:], size, "zstd", asbytes=True))
    lengths, at = _unpacked(raw, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    end = at + int(offsets[-1])
    labels = pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes(raw[at:end]))])
    at = end
    levels = []
    for _ in range(many):
        children, at = _unpacked(raw, at)
        label, at = _unpacked(raw, at)
        weight, at = _unpacked(raw, at)
        levels.append(Level(np.repeat(np.arange(len(children)), children), label, weight))
    return Transducer(labels, levels)
