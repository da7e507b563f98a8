"""Strong components of a small graph, without recursion."""

from __future__ import annotations

from collections.abc import Iterable


def components(edges: dict[str, list[str]], roots: Iterable[str] | None = None) -> list[list[str]]:
    """The strong components that ``roots`` (all nodes, unless given) lead to, each
    after those that it leads to."""
    found: list[list[str]] = []
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    is_open: set[str] = set()
    for root in edges if roots is None else roots:
        todo = [] if root in number else [(root, iter(edges[root]))]
        while todo:
            name, rest = todo[-1]
            if name not in number:
                number[name] = low[name] = len(number)
                open_.append(name)
                is_open.add(name)
            for x in rest:
                if x not in number:
                    todo.append((x, iter(edges[x])))
                    break
                if x in is_open:
                    low[name] = min(low[name], number[x])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[name])
                if low[name] == number[name]:
                    part = [open_.pop()]
                    while part[-1] != name:
                        part.append(open_.pop())
                    is_open -= {*part}
                    found.append(part)
    return found


def circular(component: list[str], edges: dict[str, list[str]]) -> bool:
    return len(component) > 1 or component[0] in edges[component[0]]
