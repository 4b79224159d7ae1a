"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows prefixes.

A run stores each string as the length of the prefix it shares with the one before and the
rest. The tree keeps for every waiting string the length of its common prefix with the last
string put out: of two strings, the one with the longer common prefix is smaller, and only
strings with equal ones are compared, beyond that prefix. No known prefix is read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that agree in ``start`` bytes."""
    stop = min(len(a), len(b))
    # Most strings differ soon: look at a few bytes first.
    if start + 8 < stop:
        difference = int.from_bytes(a[start:start + 8], "big") ^ int.from_bytes(b[start:start + 8], "big")
        if difference:
            return start + 8 - (difference.bit_length() + 7) // 8
    difference = int.from_bytes(a[start:stop], "big") ^ int.from_bytes(b[start:stop], "big")
    return stop - (difference.bit_length() + 7) // 8


def front_coded(strings: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(shared, rest) for sorted strings."""
    before = b""
    for text in strings:
        shared = common_prefix(before, text, 0)
        yield shared, text[shared:]
        before = text


def merged(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge front-coded runs of (shared, rest, payload): (shared, string, payload) in order,
    ``shared`` the common prefix with the string before. Equal strings come in order of runs."""
    count = len(runs)
    if not count:
        return
    strings = [b""] * count
    shared = [0] * count
    payloads: list[object] = [None] * count
    live = [True] * count

    def advance(k: int) -> None:
        item = next(runs[k], None)
        if item is None:
            live[k] = False
        else:
            shared[k], rest, payloads[k] = item
            strings[k] = strings[k][:shared[k]] + rest

    def beaten(a: int, b: int) -> int:
        """The loser of two runs; its common prefix is then with the winner."""
        if not live[a] or not live[b]:
            return b if live[a] else a
        x, y = shared[a], shared[b]
        if x != y:
            return b if x > y else a
        left, right = strings[a], strings[b]
        place = common_prefix(left, right, x)
        if left[place:place + 1] == right[place:place + 1]:
            loser = max(a, b)
        else:
            loser = b if left[place:place + 1] < right[place:place + 1] else a
        shared[loser] = place
        return loser

    for k in range(count):
        advance(k)
    size = 1
    while size < count:
        size *= 2
    live += [False] * (size - count)
    shared += [0] * (size - count)
    strings += [b""] * (size - count)
    payloads += [None] * (size - count)
    losers = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for k in range(level):
            a, b = winners[2 * k], winners[2 * k + 1]
            loser = beaten(a, b)
            losers[level + k] = loser
            winners[k] = b if loser == a else a
    winner = winners[0]
    while live[winner]:
        yield shared[winner], strings[winner], payloads[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            loser = losers[node]
            if beaten(winner, loser) == winner:
                losers[node], winner = winner, loser
            node //= 2
