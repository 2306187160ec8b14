"""Edit distance by bit vectors."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def edit_distance(one: Sequence[Hashable], two: Sequence[Hashable]) -> int:
    """Least number of insertions, deletions and substitutions between two sequences.

    A whole column of the distance table is two integers with a bit an entry: where the next entry is one
    more, and where it is one less (Myers 1999, Hyyrö 2003). Every entry of the shorter sequence moves the
    column on by a few operations on long integers; which places of the longer one an item stands at is
    looked up in a map.
    """
    if len(one) < len(two):
        one, two = two, one
    n = len(two)
    head = 0
    while head < n and one[head] == two[head]:
        head += 1
    tail = 0
    while tail < n - head and one[-1 - tail] == two[-1 - tail]:
        tail += 1
    one, two = one[head : len(one) - tail], two[head : n - tail]
    if not two:
        return len(one)
    places: dict[Hashable, int] = {}
    for k, item in enumerate(one):
        places[item] = places.get(item, 0) | 1 << k
    every, last, distance = (1 << len(one)) - 1, 1 << (len(one) - 1), len(one)
    more, less = every, 0
    for item in two:
        here = places.get(item, 0)
        same = here | less
        carried = (((here & more) + more) ^ more) | here
        up = less | (~(carried | more) & every)
        down = more & carried
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        more, less = down | (~(same | up) & every), up & same
    return distance
