"""Wrappers: union-free regular expressions over token streams, inferred by aligning pages.

An element's content is a sequence of items. An item is one element, or a repeated
group of elements each of which may be left out: (h2? p?)+ stands for any run of h2 and
p. Nothing stands for a choice. Inference only generalises:

* within a stream, neighbouring runs with the same labels become a repeated item, and
  what follows a repeated item and fits it joins it;
* two streams are aligned by their longest common sequence of labels, in which a repeated
  item takes in all that fits it; matched elements are aligned in turn, items without a partner become optional, and optional or
  repeated items whose labels come again before the next required one become one group.

So a sequence has its required items, and between two of them each label at most once:
a wrapper doesn't grow with the number of pages.

Held as nested lists: an element [label, items], text ["#", numbers], an item
[optional, repeated, [[may be left out, element], ...]]. Numbers of texts that come to
lie in one place are joined, which tells where each text of a stream went.
"""

from __future__ import annotations

import json

#: Longest run of labels that is looked for twice in a row.
MAX_PERIOD = 8
#: Items of a sequence; members of a group. Beyond, a sequence becomes one group, whose labels lose their class.
MAX_ITEMS = 64
#: Beyond so many cells, two sequences meet as groups instead.
MAX_CELLS = 40_000

Item = list
Node = list


def _labels(item: Item) -> tuple[str, ...]:
    return tuple(node[0] for _, node in item[2])


def merge_nodes(a: Node, b: Node) -> Node:
    """Both as one; neither is used after."""
    if a[0] == "#":
        a[1].extend(b[1])
        return a
    return [a[0], align(a[1], b[1])]


def _members(a: Item, b: Item, optional: bool) -> list:
    """Members of two items; `optional` where a member in one of them only may be left out."""
    out = [list(m) for m in a[2]]
    at = {node[0]: k for k, (_, node) in enumerate(out)}
    for left_out, node in b[2]:
        if (k := at.get(node[0])) is not None:
            out[k] = [out[k][0] or left_out, merge_nodes(out[k][1], node)]
        else:
            at[node[0]] = len(out)
            out.append([left_out or optional, node])
    if optional:
        own = {node[0] for _, node in b[2]}
        out = [[left_out or node[0] not in own, node] for left_out, node in out]
    return out


def _coarse(members: list) -> list:
    """Members whose labels have lost their class, so that there are no more of them than tags and uses."""
    out: Item = [False, True, []]
    for left_out, node in members:
        out[2] = _members(out, [False, True, [[left_out, [node[0].partition(".")[0] if node[0] != "#" else "#", node[1]]]]], False)
    return out[2]


def group(items: list[Item]) -> Item:
    """One repeated group of all that the items hold."""
    out: Item = [all(i[0] for i in items), True, []]
    for item in items:
        out[2] = _members(out, [item[0], True, [[m[0] or item[0], m[1]] for m in item[2]]], False)
    if len(out[2]) > 1:
        out[2] = [[True, node] for _, node in out[2]]
    if len(out[2]) > MAX_ITEMS:
        out[2] = _coarse(out[2])
    return out


def fold(items: list[Item]) -> list[Item]:
    """The sequence with neighbouring repeats as repeated items."""
    out: list[Item] = []
    labels: list[tuple[str, ...]] = []
    for item in items:
        own = _labels(item)
        if out and out[-1][1] and set(own) <= set(labels[-1]):
            out[-1] = [out[-1][0] and item[0], True, _members(out[-1], item, False)]
            continue
        out.append(item)
        labels.append(own)
        changed = True
        while changed:
            changed = False
            for p in range(1, min(MAX_PERIOD, len(out) // 2) + 1):
                if labels[-p:] == labels[-2 * p : -p]:
                    run = out[-2 * p :]
                    one = [run[0][0] and run[1][0], True, _members(run[0], run[1], False)] if p == 1 else group(run)
                    del out[-2 * p :], labels[-2 * p :]
                    out.append(one)
                    labels.append(_labels(one))
                    changed = p > 1
                    break
    return out


def _squash(items: list[Item]) -> list[Item]:
    """Between two required items each label comes once: items from its first to its last place become a group."""
    out: list[Item] = []
    run: list[Item] = []

    def close() -> None:
        k = 0
        while k < len(run):
            own, last = set(_labels(run[k])), k
            j = k + 1
            while j < len(run):
                if own & set(_labels(run[j])):
                    last = j
                    own = {x for i in run[k : j + 1] for x in _labels(i)}
                j += 1
            out.append(run[k] if last == k else group(run[k : last + 1]))
            k = last + 1
        run.clear()

    for item in items:
        if item[0] or item[1]:
            run.append(item)
        else:
            close()
            out.append(item)
    close()
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of two sequences."""
    if not a or not b:
        return [[True, i[1], i[2]] for i in a or b]
    if len(a) * len(b) > MAX_CELLS:
        a, b = [group(a)], [group(b)]
    sets_a, sets_b = [set(_labels(i)) for i in a], [set(_labels(i)) for i in b]
    # Items that find a partner, from here on. A repeated item takes in any number of items that fit it.
    meets = [[bool(x & y) for y in sets_b] for x in sets_a]
    into_b = [[y[1] and p <= q for y, q in zip(b, sets_b, strict=True)] for p in sets_a]
    into_a = [[x[1] and q <= p for q in sets_b] for x, p in zip(a, sets_a, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            value = max(below[j] + into_b[i][j], row[j + 1] + into_a[i][j])
            row[j] = max(value, below[j + 1] + 2) if meets[i][j] else value
    out, i, j = [], 0, 0
    held_a = held_b = False

    def passed(item: Item, held: bool) -> None:
        out.append([item[0] or not held, item[1], item[2]])

    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if meets[i][j] and best[i][j] == best[i + 1][j + 1] + 2:
            repeated = x[1] or y[1]
            out.append([x[0] or y[0], repeated, _members(x, y, repeated and sets_a[i] != sets_b[j])])
            i, j, held_a, held_b = i + 1, j + 1, False, False
        elif best[i][j] == best[i + 1][j] + into_b[i][j]:
            if into_b[i][j]:
                b[j], held_b = [y[0], True, _members(y, x, False)], True
            else:
                passed(x, held_a)
            i, held_a = i + 1, False
        else:
            if into_a[i][j]:
                a[i], held_a = [x[0], True, _members(x, y, False)], True
            else:
                passed(y, held_b)
            j, held_b = j + 1, False
    for rest, held in ((a[i:], held_a), (b[j:], held_b)):
        for k, item in enumerate(rest):
            passed(item, held and k == 0)
    out = fold(_squash(out))
    return out if len(out) <= MAX_ITEMS else [group(out)]


def of_page(node: list) -> Node:
    """The wrapper of one page: nested [label, children] with numbers as leaves."""
    items = [[False, False, [[False, ["#", [c]] if isinstance(c, int) else of_page(c)]]] for c in node[1]]
    items = fold(items)
    return [node[0], items if len(items) <= 4 * MAX_ITEMS else [group(items)]]


def leaves(node: Node) -> list[Node]:
    """Text places in order."""
    if node[0] == "#":
        return [node]
    return [leaf for item in node[1] for _, member in item[2] for leaf in leaves(member)]


def numbered(node: Node) -> Node:
    """The same with its text places numbered from 0."""
    for k, leaf in enumerate(leaves(node)):
        leaf[1] = [k]
    return node


def places(shape: Node, wrapper: Node) -> list[int]:
    """For each text place of a numbered shape the wrapper's; -1 if it has none. Both are aligned once more, with their numbers apart."""
    own, n = leaves(shape), len(leaves(shape))
    apart = json.loads(json.dumps(wrapper))
    for leaf in leaves(apart):
        leaf[1] = [n + k for k in leaf[1]]
    out = [-1] * len(own)
    for leaf in leaves(merge_nodes(apart, shape)):
        held = min((k - n for k in leaf[1] if k >= n), default=-1)
        for k in leaf[1]:
            if k < n:
                out[k] = held
    return out


def expression(node: Node) -> str:
    """The wrapper as text: html(head body(nav(ul(li(#)+)) article(h1(#) p(#)+)))."""
    if node[0] == "#":
        return "#"

    def one(item: Item) -> str:
        inner = " ".join(expression(m) + ("?" if left_out and len(item[2]) > 1 else "") for left_out, m in item[2])
        mark = ("*" if item[0] else "+") if item[1] else ("?" if item[0] else "")
        return (f"({inner})" if len(item[2]) > 1 else inner) + mark

    return node[0] + (f"({' '.join(map(one, node[1]))})" if node[1] else "")


def dumps(node: Node) -> str:
    return json.dumps(node, separators=(",", ":"), ensure_ascii=False)


def merged(wrapper: Node | None, text: str) -> Node:
    """A wrapper taught one more, as text."""
    out = json.loads(text) if wrapper is None else merge_nodes(wrapper, json.loads(text))
    for leaf in leaves(out):
        leaf[1] = []
    return out
