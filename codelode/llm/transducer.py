"""Minimal acyclic transducers from byte strings to numbers, as flat arrays that can be mapped into memory."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def compile_lexicon(items: Iterable[tuple[bytes, int]], extra: dict[str, np.ndarray] | None = None) -> bytes:
    """The file of a lexicon. items: distinct keys in byte order with values of at least 0. extra: further int32 arrays to keep beside it.

    Keys are added in order; what the next key can't extend any more is frozen. A frozen state gives its least output up to the transition
    that leads to it, and is shared with an equal one, so common endings are stored once. A key's value is the sum along its path."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> tuple[int, int]:
        final, edges = node
        least = min([out for _, out, _ in edges] + ([final] if final is not None else []))
        signature = (None if final is None else final - least, tuple((b, out - least, to) for b, out, to in edges))
        if signature not in known:
            known[signature] = len(states)
            states.append(signature)
        return known[signature], least

    path: list[list] = [[None, []]]
    last = b""

    def cut(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            at, least = freeze(node)
            path[-1][1].append((last[len(path) - 1], least, at))

    for key, value in items:
        same = 0
        while same < min(len(key), len(last)) and key[same] == last[same]:
            same += 1
        cut(same)
        path += [[None, []] for _ in range(len(key) - same)]
        path[-1][0] = value
        last = key
    cut(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root, last
    edges = [e for _, own in states for e in own]
    arrays = {
        "start": np.cumsum([0, *(len(own) for _, own in states)]), "label": np.array([b for b, _, _ in edges]), "out": np.array([o for _, o, _ in edges]),
        "to": np.array([t for _, _, t in edges]), "final": np.array([-1 if f is None else f for f, _ in states]),
    } | (extra or {})
    names = "\n".join(f"{n} {len(a)}" for n, a in arrays.items()).encode()
    head = len(names).to_bytes(4, "little") + names
    return head + b" " * (-len(head) % 4) + b"".join(np.asarray(a, np.int32).tobytes() for a in arrays.values())


class Lexicon:
    """A compiled lexicon over its mapped file."""

    def __init__(self, data: np.ndarray):
        n = int.from_bytes(data[:4].tobytes(), "little")
        at = 4 + n + (-(4 + n) % 4)
        self.arrays = {}
        for line in data[4 : 4 + n].tobytes().decode().split("\n"):
            name, size = line.split()
            self.arrays[name] = data[at : at + 4 * int(size)].view(np.int32)
            at += 4 * int(size)
        self._labels = self.arrays["label"].astype(np.uint8).tobytes()
        self._start, self._out, self._to, self._final = (memoryview(self.arrays[k]) for k in ("start", "out", "to", "final"))
        self._root = len(self._final) - 1

    def get(self, key: bytes) -> int:
        """The key's value, -1 for an unknown one."""
        state, total = self._root, 0
        labels, start, out, to = self._labels, self._start, self._out, self._to
        for b in key:
            edge = labels.find(b, start[state], start[state + 1])
            if edge < 0:
                return -1
            total += out[edge]
            state = to[edge]
        return total + self._final[state] if self._final[state] >= 0 else -1
