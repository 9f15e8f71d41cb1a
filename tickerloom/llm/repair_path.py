"""Cheapest edits that give a conversation a proper order of roles, as a shortest path found by an auction.

A node of the lattice is (rows read, state): nothing kept yet, after the system's row, after a user's, after an assistant's.
Keep, Rerole and Delete read a row, Insert stays in front of it; costs are whole numbers.  Each node has a price that never
exceeds the cost of an arc plus the price at its end.  The auction holds one path: its last node takes the cheapest arc and
the path is extended where the price already equals that cost, else the price is raised to it and the path contracts
by a node.  When the path arrives, prices are exact along it, and every arc of every cheapest path is tight (price = cost + price at
its end).  Of those, the tight arcs with the smallest initials are followed.

Prices start from what the remaining rows cost at least.  Long conversations are cut into parts of PART rows: the prices
at the entries of a part are the costs at the exits of the one before it, so that an auction never wanders far.
"""

from __future__ import annotations

from collections.abc import Sequence

PART = 64
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
INITIALS = {"s": 0, "u": 1, "a": 2}
FINE, TRUNCATED, FORCED = 0, 1, 2  # a forced row is blank or repeats an earlier one: it must be deleted
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
WANTED = (USER, USER, ASSISTANT, USER)  # the state that the next role leads to
NEVER = 1 << 40
ENDS = (0, 2 * INSERT, INSERT, 0)  # cost of what is still missing after the last row
CLOSING = ("", "II", "I", "")


def code(role: str, fault: int) -> int:
    return 3 * INITIALS.get(role[:1], 3) + fault


def arcs_of(row: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, step from node to node) of a row in a state, by initial."""
    initial, fault = divmod(row, 3)
    wanted, late = WANTED[state], CUT_OFF * (fault == TRUNCATED)
    arcs = [("D", DELETE, 4), ("I", INSERT, wanted - state)]
    if fault != FORCED:
        if initial == 0 and state == START:
            arcs.append(("K", late, 4 + SYSTEM - state))
        if (initial, wanted) in ((1, USER), (2, ASSISTANT)):
            arcs.append(("K", late, 4 + wanted - state))
        arcs.append(("R", REROLE + late, 4 + wanted - state))
    return tuple(sorted(arcs))


ARCS = [[arcs_of(row, state) for state in STATES] for row in range(12)]


def inside(arcs, state: int, end: int) -> tuple[tuple[str, int, int], ...]:
    """The arcs that lead to no state beyond ``end``."""
    return tuple(a for a in arcs if state + a[2] - 4 * (a[0] != "I") <= end)


NARROW = [[[inside(arcs, state, end) for state, arcs in enumerate(row)] for row in ARCS] for end in (START, SYSTEM)]  # no way back from later states
LEAST = [min(cost for arcs in row for initial, cost, _ in arcs if initial != "I") for row in ARCS]


def auction(rows: Sequence[int], ends: Sequence[int], origins: Sequence[int], arcs=ARCS) -> list[int]:
    """Prices of all nodes, exact at the ``origins`` (states before the first row) and on every cheapest path from them."""
    n = len(rows)
    price = [min(ends)] * (4 * n + 4)
    for i in range(n - 1, -1, -1):
        price[4 * i:4 * i + 4] = [price[4 * i + 4] + LEAST[rows[i]]] * 4
    for origin in origins:
        path = [origin]
        while True:
            node = path[-1]
            if node >= 4 * n:
                best, onward = ends[node & 3], -1
            else:
                best, onward = NEVER, -1
                for _, cost, step in arcs[rows[node >> 2]][node & 3]:
                    if (at := cost + price[node + step]) < best:
                        best, onward = at, node + step
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif onward < 0:
                break
            else:
                path.append(onward)
    return price


def trace(rows: Sequence[int], ends: Sequence[int], price: Sequence[int], entry: int) -> tuple[str, int]:
    """Smallest initials along tight arcs from a state before the first row, and the state after the last."""
    n, path, taken, dead = len(rows), [entry], [], set()
    while path:
        node = path[-1]
        if node >= 4 * n:
            if price[node] == ends[node & 3]:
                return "".join(taken), node & 3
        else:
            for initial, cost, step in ARCS[rows[node >> 2]][node & 3]:
                if price[node] == cost + price[node + step] and node + step not in dead:
                    path.append(node + step)
                    taken.append(initial)
                    break
            else:
                dead.add(path.pop())
                taken and taken.pop()
            continue
        dead.add(path.pop())
        taken and taken.pop()
    raise ValueError("no tight path: the prices don't belong to these rows")


def crossing(rows: Sequence[int]) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row of a 4 x 4 table."""
    table = [NEVER] * 16
    for end in STATES:
        ends = [0 if s == end else NEVER for s in STATES]
        origins = range(end + 1) if end <= SYSTEM else STATES
        price = auction(rows, ends, origins, NARROW[end] if end <= SYSTEM else ARCS)
        for s in origins:
            table[4 * s + end] = min(price[s], NEVER)
    return table


def before(table: Sequence[int], ends: Sequence[int]) -> list[int]:
    """Prices in front of rows with that table, when those behind them are ``ends``."""
    return [min(table[4 * s + t] + ends[t] for t in STATES) for s in STATES]


def cheapest(rows: Sequence[int]) -> tuple[int, str]:
    """Cost and initials of the edits of a whole conversation."""
    parts = [rows[i:i + PART] for i in range(0, len(rows), PART)]
    ends, solved = list(ENDS), []
    for k in range(len(parts) - 1, -1, -1):
        price = auction(parts[k], ends, STATES if k else [START])
        solved.append((parts[k], ends, price))
        ends = price[:4]
    state, initials = START, []
    for part, ends_of, price in reversed(solved):
        some, state = trace(part, ends_of, price, state)
        initials.append(some)
    return (solved[-1][2][START] if solved else 0), "".join(initials) + CLOSING[state]


def rebuilt(turns: list[dict], initials: str, state: int) -> list[dict]:
    """The turns after the edits; an inserted one has no number and an empty text."""
    out, i = [], 0
    for initial in initials:
        if initial in "KRD":
            turn, i = turns[i], i + 1
        if initial == "D":
            continue
        if initial == "K":
            out.append(turn)
            state = SYSTEM if turn["role"][:1] == "s" else WANTED[state]
        else:
            state = WANTED[state]
            role = "user" if state == USER else "assistant"
            out.append(turn | {"role": role} if initial == "R" else {"turn": None, "role": role, "text": ""})
    return out


def cost_of(initials: str, rows: Sequence[int]) -> int:
    """What the edits cost."""
    cost, i = 0, 0
    for initial in initials:
        if initial == "I":
            cost += INSERT
            continue
        cost += DELETE if initial == "D" else REROLE * (initial == "R") + CUT_OFF * (rows[i] % 3 == TRUNCATED)
        i += 1
    return cost
