"""Count transducers: weighted acyclic automata over symbol sequences, built from sorted rows, united, packed and looked up."""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

PACKED = "alphabet binary, arcs binary, labels binary, weights binary, targets binary, sizes array<bigint>"
COLUMNS = tuple(c.split()[0] for c in PACKED.split(", "))


class Automaton(NamedTuple):
    """States by depth, in sorted order: a state's weight is the count of its prefix.

    ``labels[k]`` are places in the sorted ``alphabet``, ``up[k]`` the states one level above (ascending),
    ``weights[k]`` how often the sequence that leads there was seen.
    """
    alphabet: np.ndarray
    labels: list[np.ndarray]
    up: list[np.ndarray]
    weights: list[np.ndarray]

    @property
    def size(self) -> int:
        return sum(map(len, self.labels))


def build(rows: np.ndarray, weights: np.ndarray, alphabet: np.ndarray) -> Automaton:
    """From sequences in sorted order (-1 after their end): each adds the states past what it shares with the one before."""
    n, depth = rows.shape
    length = (rows >= 0).sum(1)
    shared = np.zeros(n, np.int64)
    if n > 1:
        shared[1:] = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)
    labels, up, sums, at = [], [], [], np.zeros(n, np.int64)
    for k in range(depth):
        begins = np.flatnonzero((length > k) & (shared <= k))
        if not len(begins):
            break
        labels.append(rows[begins, k])
        up.append(at[begins])
        sums.append(np.add.reduceat(np.where(length > k, weights, 0), begins))
        at = np.searchsorted(begins, np.arange(n), "right") - 1
    return Automaton(alphabet, labels, up, sums)


def united(parts: list[Automaton]) -> Automaton:
    """The union: sequences of any part, their weights added up level by level."""
    if len(parts) == 1:
        return parts[0]
    alphabet = np.unique(np.concatenate([p.alphabet for p in parts]))
    moved = [np.zeros(1, np.int64) for _ in parts]
    place = [np.searchsorted(alphabet, p.alphabet) for p in parts]
    labels, up, weights = [], [], []
    for k in range(max(len(p.labels) for p in parts)):
        held = [k < len(p.labels) for p in parts]
        keys = [m[p.up[k]] << 32 | s[p.labels[k]] for p, m, s, h in zip(parts, moved, place, held) if h]
        key, weight = np.concatenate(keys), np.concatenate([p.weights[k] for p, h in zip(parts, held) if h])
        order = np.argsort(key, kind="stable")  # merges sorted runs
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        state = np.empty(len(key), np.int64)
        state[order] = np.cumsum(new) - 1
        labels.append(key[new] & 0xFFFFFFFF)
        up.append(key[new] >> 32)
        weights.append(np.add.reduceat(weight[order], np.flatnonzero(new)))
        moved = [np.zeros(0, np.int64)] * len(parts)
        at = 0
        for i in np.flatnonzero(held):
            moved[i] = state[at: at + len(parts[i].labels[k])]
            at += len(moved[i])
    return Automaton(alphabet, labels, up, weights)


def part(a: Automaton, keep: np.ndarray) -> Automaton:
    """The states below the first-level states that ``keep`` marks."""
    return _filtered(a, lambda k, alive: keep if k == 0 else alive)


def pruned(a: Automaton, least: int) -> Automaton:
    """Only states of at least that weight; no state outweighs the one above it, so the rest stays connected."""
    return _filtered(a, lambda k, alive: alive & (a.weights[k] >= least))


def _filtered(a: Automaton, keep) -> Automaton:
    labels, up, weights = [], [], []
    above = np.ones(1, bool)
    for k in range(len(a.labels)):
        chosen = keep(k, above[a.up[k]])
        moved = np.cumsum(above) - 1
        if not chosen.any():
            break
        labels.append(a.labels[k][chosen])
        up.append(moved[a.up[k][chosen]])
        weights.append(a.weights[k][chosen])
        above = chosen
    used = np.unique(np.concatenate(labels)) if labels else np.zeros(0, np.int64)
    return Automaton(a.alphabet[used], [np.searchsorted(used, x) for x in labels], up, weights)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def pack(a: Automaton) -> dict:
    """The minimal form by levels: states with the same labels, weights and continuations are stored once.

    From the deepest level up, a state is the list of its arcs (label, weight, target); equal lists
    become one. Hashes find them, the lists themselves decide.
    """
    target = np.zeros(len(a.labels[-1]) if a.labels else 0, np.int64)
    stored = []
    for k in range(len(a.labels) - 1, -1, -1):
        n_up = len(a.labels[k - 1]) if k else 1
        ends = np.searchsorted(a.up[k], np.arange(n_up), "right")
        starts = np.append(0, ends[:-1])
        arc = np.cumsum(_mixed(a.labels[k], a.weights[k], target))  # wraps around
        sums = np.append(np.uint64(0), arc)
        name = _mixed(sums[ends] - sums[starts], ends - starts)
        _, first, cls = np.unique(name, return_index=True, return_inverse=True)
        n = ends - starts
        like = first[cls]
        where = np.arange(len(a.labels[k]))
        twin = starts[like][a.up[k]] + where - starts[a.up[k]]
        same = (n == n[like]).all() and all((x == x[np.minimum(twin, len(x) - 1)]).all() for x in (a.labels[k], a.weights[k], target))
        if not same:
            first, cls = np.arange(n_up), np.arange(n_up)
        arcs = np.repeat(starts[first] - np.append(0, np.cumsum(n[first])[:-1]), n[first]) + np.arange(n[first].sum())
        stored.append((np.cumsum(n[first]), a.labels[k][arcs], a.weights[k][arcs], target[arcs]))
        target = cls
    stored.reverse()
    joined = [np.concatenate([s[i] for s in stored]) if stored else np.zeros(0, np.int64) for i in range(4)]
    joined[0] = np.concatenate([np.diff(s[0], prepend=0) for s in stored]) if stored else joined[0]
    return {"alphabet": a.alphabet.tobytes(), **{c: narrow(x) for c, x in zip(("arcs", "labels", "weights", "targets"), joined)},
            "sizes": [x for s in stored for x in (len(s[0]), len(s[1]))]}


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def unpack(row: dict) -> Automaton:
    count, label, weight, target = (widened(row[c]) for c in ("arcs", "labels", "weights", "targets"))
    labels, up, weights = [], [], []
    state, e, t = np.zeros(1, np.int64), 0, 0
    for lists, arcs in zip(row["sizes"][::2], row["sizes"][1::2]):
        stop = np.cumsum(count[e: e + lists])
        start = np.append(0, stop[:-1])
        n = (stop - start)[state]
        at = t + np.repeat(start[state] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        labels.append(label[at])
        up.append(np.repeat(np.arange(len(state)), n))
        weights.append(weight[at])
        state, e, t = target[at], e + lists, t + arcs
    return Automaton(np.frombuffer(row["alphabet"], np.uint64), labels, up, weights)


def paths(a: Automaton, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and weights along the way to every state of level ``k`` (from 0): two arrays of k + 1 columns."""
    at = np.arange(len(a.labels[k]))
    symbols, weights = [], []
    for j in range(k, -1, -1):
        symbols.append(a.alphabet[a.labels[j][at]])
        weights.append(a.weights[j][at])
        at = a.up[j][at]
    return np.stack(symbols[::-1], 1), np.stack(weights[::-1], 1)


def composed(a: Automaton, asked: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Weights of the asked sequences (rows of symbols, ``length`` of them count); 0 where there is no such path."""
    state, out = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    alive = length > 0
    for k in range(min(asked.shape[1], len(a.labels))):
        symbol = asked[:, k]
        place = np.minimum(np.searchsorted(a.alphabet, symbol), len(a.alphabet) - 1)
        alive = alive & (length > k) & (a.alphabet[place] == symbol)
        keys = a.up[k] << 32 | a.labels[k]
        key = state << 32 | place
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        alive = alive & (keys[at] == key)
        out = np.where(alive & (length == k + 1), a.weights[k][at], out)
        state = np.where(alive, at, 0)
    return out
