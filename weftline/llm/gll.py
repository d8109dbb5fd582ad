"""Generalised LL recognition over token classes, with a graph-structured stack.

A token is a bit mask of the terminals it satisfies. Brackets are matched first;
a bracket's content is recognised on its own, and the whole bracket becomes one token
whose mask tells which nonterminals derive the content. So each token is parsed once,
and what a content or a statement derives is remembered by its token masks: the
result depends on nothing else. The dialects of a language are alternatives of one
grammar (or start symbols of it) and are explored together on one shared stack.

Grammar notation: 'lit', CLASS, name; P{n} K{n} B{n} T{n}: a round, square, curly or
template bracket whose content derives n; ( | ) ? * +; $ is the end of the content.
Tests of the next token without taking it: ~ a line begins with it, ^ no line begins
with it, % it is no curly bracket, & it is neither that nor 'function' nor 'class'.
"""

from __future__ import annotations

import re

OPEN = {"(": "P", "[": "K", "{": "B", "${": "T"}
CLOSE = {")": "P", "]": "K", "}": "B", "}$": "T"}
_LEX = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([PKBT])\{(\w+)\}|([A-Z]\w*)|([a-z_]\w*)|([()|?*+$=;~^%&]))")
MEMO_ENTRIES = 400_000
TERMINAL, NONTERMINAL, END, LINE, CHOICE, NO_LINE, NOT = range(7)
#: Bit of a token that begins a line, where the line before could end a statement.
NEW_LINE = 2


class Grammar:
    """Compiled grammar: a graph of slots [op, argument, next]; repetitions are loops in it, so a list takes time linear in its length."""

    def __init__(self, text: str):
        self.bits: dict[str, int] = {"$": 1, "~": NEW_LINE}
        self.groups: dict[str, list[str]] = {k: [] for k in "PKBT"}
        trees: dict[str, list[list[tuple]]] = {}
        for rule in re.split(r"\n(?=[a-z_]\w*\s*=)", text.strip()):
            name, body = re.split(r"\s*=", rule, maxsplit=1)
            toks = [next(((k, m[k + 1]) for k in range(6) if m[k + 1] is not None)) + (m[3],) for m in _LEX.finditer(body)]
            trees[name.strip()] = self._choice(toks, [0])
        self._link(trees)

    def bit(self, name: str) -> int:
        return self.bits.setdefault(name, 1 << len(self.bits))

    def _choice(self, toks: list, at: list[int]) -> list[list[tuple]]:
        alts: list[list[tuple]] = [[]]
        while at[0] < len(toks):
            kind, text, inner = toks[at[0]]
            at[0] += 1
            if kind == 5 and text == ")":
                break
            if kind == 5 and text == "|":
                alts.append([])
                continue
            if kind == 5 and text == "(":
                item = ("group", self._choice(toks, at))
            elif kind == 5:
                item = (text,)
            elif kind == 0:
                item = ("t", self.bit("'" + text.replace("\\'", "'")))
            elif kind == 1:
                if inner not in self.groups[text]:
                    self.groups[text].append(inner)
                item = ("t", self.bit(f"{text}{{{inner}}}"))
            elif kind == 3:
                item = ("t", self.bit(text))
            else:
                item = ("n", text)
            if at[0] < len(toks) and toks[at[0]][0] == 5 and toks[at[0]][1] in "?*+":
                item = (toks[at[0]][1], item[1] if item[0] == "group" else [[item]])
                at[0] += 1
            alts[-1].append(item)
        return alts

    def _link(self, trees: dict[str, list[list[tuple]]]) -> None:
        self.index = {n: i for i, n in enumerate(trees)}
        curly = sum(self.bits[f"B{{{x}}}"] for x in self.groups["B"])
        barred = {"%": curly, "&": curly | self.bit("'function") | self.bit("'class")}
        simple = {"$": END, "~": LINE, "^": NO_LINE}

        def build(seq: list[tuple], after: list | None) -> list | None:
            for item in reversed(seq):
                kind = item[0]
                if kind == "t":
                    after = [TERMINAL, item[1], after]
                elif kind == "n":
                    after = [NONTERMINAL, self.index[item[1]], after]
                elif kind in simple:
                    after = [simple[kind], 0, after]
                elif kind in barred:
                    after = [NOT, barred[kind], after]
                elif kind == "group":
                    after = build(item[1][0], after) if len(item[1]) == 1 else [CHOICE, [build(s, after) for s in item[1]], None]
                elif kind == "?":
                    after = [CHOICE, [*(build(s, after) for s in item[1]), after], None]
                else:
                    loop: list = [CHOICE, None, None]
                    loop[1] = [*(build(s, loop) for s in item[1]), after]
                    after = loop if kind == "*" else [CHOICE, [build(s, loop) for s in item[1]], None]
            return after

        starts = [[build(s, None) for s in alts] for alts in trees.values()]
        first, nullable, changed = [0] * len(starts), [False] * len(starts), True

        def look(slot: list | None, been: set[int]) -> tuple[int, bool]:
            """The tokens that can come first, and whether the slot can end without any."""
            mask = 0
            while slot is not None:
                op, arg, after = slot
                if op == TERMINAL:
                    return mask | arg, False
                if op == END or op == LINE:
                    return mask | (1 if op == END else NEW_LINE), False
                if op == CHOICE:
                    if id(slot) in been:
                        return mask, False
                    ways = [look(s, been | {id(slot)}) for s in arg]
                    return mask | _any(w for w, _ in ways), any(e for _, e in ways)
                if op == NONTERMINAL:
                    mask |= first[arg]
                    if not nullable[arg]:
                        return mask, False
                slot = after
            return mask, True

        while changed:
            changed = False
            for i, alts in enumerate(starts):
                ways = [look(s, set()) for s in alts]
                new = (_any(w for w, _ in ways), any(e for _, e in ways))
                if new != (first[i], nullable[i]):
                    first[i], nullable[i], changed = *new, True

        def seen(slots: list) -> list[tuple[int, list | None]]:
            return [(-1 if empty else mask, s) for s in slots for mask, empty in [look(s, set())]]

        todo, done, choices = [s for alts in starts for s in alts if s is not None], set(), []
        while todo:
            slot = todo.pop()
            if id(slot) in done:
                continue
            done.add(id(slot))
            if slot[0] == CHOICE:
                choices.append((slot, seen(slot[1])))
                todo += [s for s in slot[1] if s is not None]
            elif slot[2] is not None:
                todo.append(slot[2])
        self.rules = [seen(alts) for alts in starts]
        for slot, ways in choices:
            slot[1] = ways


def _any(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def derive(rules: list, start: int, toks: list[int] | tuple[int, ...], at: int) -> tuple[set[int], int]:
    """(ends, seen): all places where ``start`` can end if it begins at ``at``, and how far tokens were looked at.

    ``toks`` ends with the end mark 1. A stack node is [ends, returns]; nodes are shared by (nonterminal, place).
    """
    root: list = [set(), []]
    nodes = {(start, at): root}
    seen = at
    been: set[tuple[int, int, int]] = set()
    todo = [(slot, root, at) for f, slot in rules[start] if f < 0 or f & toks[at]]
    while todo:
        slot, node, pos = todo.pop()
        while True:
            if slot is None:  # the nonterminal of this node ends here
                if pos in node[0]:
                    break
                node[0].add(pos)
                back = node[1]
                if len(back) == 1:
                    slot, node = back[0]
                    continue
                for r, parent in back:
                    todo.append((r, parent, pos))
                break
            op, arg, after = slot
            t = toks[pos]
            if pos > seen:
                seen = pos
            if op == 0:
                if not t & arg:
                    break
                pos += 1
                slot = after
            elif op == 4:
                key = (id(slot), id(node), pos)
                if key in been:
                    break
                been.add(key)
                ways = [s for f, s in arg if f < 0 or f & t]
                if not ways:
                    break
                for s in ways[1:]:
                    todo.append((s, node, pos))
                slot = ways[0]
            elif op == 1:
                key = (arg, pos)
                n = nodes.get(key)
                if n is not None:
                    if not any(r is after and p is node for r, p in n[1]):
                        n[1].append((after, node))
                        for e in n[0]:
                            todo.append((after, node, e))
                    break
                n = nodes[key] = [set(), [(after, node)]]
                ways = [s for f, s in rules[arg] if f < 0 or f & t]
                if not ways:
                    break
                for s in ways[1:]:
                    todo.append((s, n, pos))
                slot, node = ways[0], n
            elif op == 3:
                if not t & 2:
                    break
                slot = after
            elif op == 5:
                if t & 2:
                    break
                slot = after
            elif op == 6:
                if t & arg:
                    break
                slot = after
            else:
                if t != 1:
                    break
                slot = after
    return root[0], seen


class Recognizer:
    """Contents and statements of one language, remembered by their tokens. ``lists``: nonterminals that are a list of another."""

    def __init__(self, grammar: Grammar, lists: dict[str, str]):
        self.g, self.lists = grammar, lists
        self.memo: dict[tuple, int] = {}
        self.tries: dict[int, dict] = {}
        self.entries = 0

    def _ends(self, nt: int, toks: tuple[int, ...], at: int) -> tuple[int, ...]:
        node = self.tries.get(nt)
        if node is None:
            node = self.tries[nt] = {}
        i = at
        while True:
            got = node.get(-1)
            if got is not None:
                return got
            child = node.get(toks[i]) if i < len(toks) else None
            if child is None:
                break
            node = child
            i += 1
        ends, seen = derive(self.g.rules, nt, toks, at)
        node, result = self.tries[nt], tuple(sorted((e - at for e in ends), reverse=True))
        for t in toks[at : seen + 1]:
            node = node.setdefault(t, {})
            self.entries += 1
        node[-1] = result
        return result

    def accepts(self, name: str, toks: tuple[int, ...]) -> bool:
        """Whether the nonterminal derives the whole content (``toks`` with the end mark)."""
        last, item = len(toks) - 1, self.lists.get(name)
        if item is None:
            return last in derive(self.g.rules, self.g.index[name], toks, 0)[0]
        nt, todo, done = self.g.index[item], [0], {0}
        while todo:
            at = todo.pop()
            if at == last:
                return True
            for e in self._ends(nt, toks, at):
                if at + e not in done:
                    done.add(at + e)
                    todo.append(at + e)
        return False

    def content(self, bracket: str, toks: list[int]) -> int:
        """Mask of a bracket with this content; 0 if nothing derives it."""
        key = (bracket, *toks)
        got = self.memo.get(key)
        if got is None:
            if self.entries > MEMO_ENTRIES:
                self.memo.clear(), self.tries.clear()
                self.entries = 0
            inner, got = (*toks, 1), 0
            for name in self.g.groups[bracket]:
                if self.accepts(name, inner):
                    got |= self.g.bit(f"{bracket}{{{name}}}")
            self.memo[key] = got
            self.entries += len(key)
        return got
