"""Lightest derivations by an agenda (Knuth's generalisation of Dijkstra's method), and the repair of role sequences on it.

An item is ``(place, state)``: all rows before ``place`` are edited, and the roles they give end in ``state``. A
deduction joins an item with one weighted step (an edit of the next row, an insertion, or the finished derivation of
a whole stretch of rows) and concludes a later item. Its weight is ``(cost, audit)``: costs add, audits are joined,
so a conclusion never weighs less than its item, and equal costs are told apart by the audit. Insertions stand before
the row they precede, hence two audits of one stretch hold as many row edits and end in one: none is a proper prefix of
another, and joining on the right keeps their order. The agenda pops items by weight; a popped item is final.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

#: States: nothing yet, then by the last role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: The initial that may follow in each state, but for a system message at the start.
_NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
ROLE = {USER: "user", ASSISTANT: "assistant"}

#: A row for the agenda: initial of the role, whether it has to go, whether it is truncated, further equal rows.
Row = tuple[str, bool, bool, int]
Step = tuple[int, object, int, int]


def lightest(first: tuple[int, int], empty, steps: Callable[[int, int], Iterable[Step]], goals: set[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
    """The least ``(cost, audit)`` of every goal that can be derived from ``first``.

    ``steps(place, state)`` lists the deductions from an item: cost, piece of the audit, next place, next state.
    Each item is expanded once, when it is popped; the search ends with the last goal.
    """
    agenda, final, left = [(0, empty, *first)], {}, set(goals)
    while agenda and left:
        cost, audit, place, state = heapq.heappop(agenda)
        if (place, state) in final:
            continue
        final[place, state] = (cost, audit)
        left.discard((place, state))
        if not left:
            break
        for more, piece, to, into in steps(place, state):
            if (to, into) not in final:
                heapq.heappush(agenda, (cost + more, audit + piece, to, into))
    return {goal: final[goal] for goal in goals if goal in final}


def _row_steps(rows: list[Row]) -> Callable[[int, int], Iterable[Step]]:
    """Edits of the next row and insertions before it. Further equal rows can only go, without an insertion between."""

    def steps(place: int, state: int) -> Iterable[Step]:
        if place >= len(rows):
            return
        initial, gone, truncated, more = rows[place]
        tail, fixed = DELETE * more, DELETE_COST * more
        into, wanted = _NEXT[state]
        yield DELETE_COST + fixed, DELETE + tail, place + 1, state
        if not gone:
            extra = fixed + TRUNCATED_COST * truncated
            if initial == wanted:
                yield KEEP_COST + extra, KEEP + tail, place + 1, into
            elif state == START and initial == "s":
                yield KEEP_COST + extra, KEEP + tail, place + 1, SYSTEM
            yield REROLE_COST + extra, REROLE + tail, place + 1, into
        yield INSERT_COST, INSERT, place, into

    return steps


def _closing(place: int, state: int, end: tuple[int, int], piece: Callable[[str], object]) -> Iterable[Step]:
    """From the last row to the goal: insertions complete an unfinished exchange."""
    missing = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
    yield INSERT_COST * missing, piece(INSERT * missing), *end


def repaired(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation; ties go to the least audit."""
    end, edits = (len(rows) + 1, START), _row_steps(rows)

    def steps(place: int, state: int) -> Iterable[Step]:
        return _closing(place, state, end, str) if place == len(rows) else edits(place, state)

    return lightest((0, START), "", steps, {end})[end]


def stretch(rows: list[Row]) -> dict[tuple[int, int], tuple[int, str]]:
    """For every pair of states before and after a stretch of rows, the cheapest edits that lead from one to the other."""
    edits, ends = _row_steps(rows), {(len(rows), state) for state in STATES}
    return {(before, after): best for before in STATES for (_, after), best in lightest((0, before), "", edits, ends).items()}


def joined(parts: list[dict[tuple[int, int], tuple]], whole: bool) -> dict[tuple[int, int], tuple[int, tuple[str, ...]]]:
    """Consecutive stretches as one: by pair of states, or closed as a conversation under the key (START, START).

    The finished derivations of the stretches are the steps here. An audit is the tuple of its stretches' audits.
    """
    after: list[dict[int, list]] = []
    for part in parts:
        by: dict[int, list] = {}
        for (p, q), (cost, audit) in part.items():
            by.setdefault(p, []).append((cost, (audit,), q))
        after.append(by)
    last, end = len(parts), (len(parts) + 1, START)

    def steps(place: int, state: int) -> Iterable[Step]:
        if place == last:
            return _closing(place, state, end, lambda s: (s,)) if whole else ()
        return ((cost, audit, place + 1, q) for cost, audit, q in after[place].get(state, ()))

    if whole:
        return {(START, START): lightest((0, START), (), steps, {end})[end]}
    ends = {(last, state) for state in STATES}
    return {(p, q): best for p in STATES for (_, q), best in lightest((0, p), (), steps, ends).items()}


class Editor:
    """Applies an audit to the rows of a conversation, one after the other; what comes out are pairs of role and text."""

    def __init__(self, audit: str, state: int = START):
        self.audit, self.at, self.state = audit, 0, state

    def _said(self, role: str | None, text: str) -> tuple[str, str]:
        into = SYSTEM if self.state == START and role is not None and role[:1] == "s" else _NEXT[self.state][0]
        self.state = into
        return (ROLE[into] if role is None else role), text

    def close(self) -> list[tuple[str, str]]:
        """Turns inserted here."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            out.append(self._said(None, ""))
        return out

    def row(self, role: str, text: str, copies: int = 1) -> list[tuple[str, str]]:
        """What the next row, ``copies`` times there, becomes, after the turns inserted before it."""
        out = self.close()
        edit = self.audit[self.at]
        self.at += copies
        if edit != DELETE:
            out.append(self._said(role if edit == KEEP else None, text))
        return out
