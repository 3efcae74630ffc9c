"""LALR(1) tables from a grammar text, and a recogniser that follows every action where a table has several.

Grammar text: `name: alternatives ;` with 'literals', TOKENS in capitals, rules in lower case, ( ) groups, postfix
? * +, and `'sep'.item+` for separated lists. `#` starts a comment. The first rule is the start.
"""

from __future__ import annotations

import re

END = "$"


class Tables:
    """Parser tables: `action[state][terminal]` is a shift (> 0), a reduction (< 0), 0 to accept, or a tuple of those."""

    def __init__(self, terminals: dict[str, int], action: list[dict], goto: list[dict], lhs: list[int], size: list[int]):
        self.terminals, self.action, self.goto, self.lhs, self.size = terminals, action, goto, lhs, size
        self.names = {v: k for k, v in terminals.items()}
        self.store: _Store | None = None

    def expected(self, state: int) -> list[str]:
        """Terminals that some action of `state` takes."""
        return sorted(self.names[t] for t in self.action[state])


def _read(text: str) -> list[tuple[str, list]]:
    text = re.sub(r"(?m)(?:^|\s)#.*$", "", text)
    words = re.findall(r"'[^']+'|[A-Za-z_]\w*|[:;|()?*+.]", text)
    at = 0
    rules: list[tuple[str, list]] = []
    fresh = [0]

    def add(alts: list[list[str]], hint: str) -> str:
        fresh[0] += 1
        name = f"{hint}#{fresh[0]}"
        rules.append((name, alts))
        return name

    def alternatives() -> list[list[str]]:
        nonlocal at
        alts: list[list[str]] = [[]]
        while words[at] not in (";", ")"):
            if words[at] == "|":
                alts.append([])
                at += 1
            else:
                alts[-1].append(item())
        return alts

    def atom() -> str:
        nonlocal at
        word = words[at]
        at += 1
        if word == "(":
            alts = alternatives()
            at += 1
            return alts[0][0] if len(alts) == 1 and len(alts[0]) == 1 else add(alts, "group")
        return word

    def item() -> str:
        nonlocal at
        sym = atom()
        if words[at] == ".":
            at += 1
            element = atom()
            at += 1  # the + of a separated list
            name = add([], "list")
            rules[-1] = (name, [[element], [name, sym, element]])
            return name
        while words[at] in ("?", "*", "+"):
            op = words[at]
            at += 1
            if op == "?":
                sym = add([[], [sym]], "opt")
            else:
                element, name = sym, add([], "many")
                k = next(i for i, r in enumerate(rules) if r[0] == name)
                rules[k] = (name, [[] if op == "*" else [element], [name, element]])
                sym = name
        return sym

    main: list[tuple[str, list]] = []
    while at < len(words):
        name = words[at]
        at += 2
        main.append((name, alternatives()))
        at += 1
    return main + rules


def build(text: str, prefer_shift: tuple[str, ...] = ()) -> Tables:
    """Tables for a grammar text. Conflicts stay as several actions, but for terminals of `prefer_shift`."""
    rules = _read(text)
    start = rules[0][0]
    defined = {name for name, _ in rules}
    lhs_names, rhs_names = ["<start>"], [[start]]
    for name, alts in rules:
        for alt in alts:
            lhs_names.append(name)
            rhs_names.append([s.strip("'") if s[0] == "'" else s for s in alt])
    literal = {s.strip("'") for _, alts in rules for alt in alts for s in alt if s[0] == "'"}
    symbols = {s for rhs in rhs_names for s in rhs}
    unknown = {s for s in symbols - literal - defined if not s.isupper()}
    unknown |= literal & defined
    if unknown:
        raise ValueError(f"rules without a definition, or named like a literal: {sorted(unknown)}")
    terminals = {t: i for i, t in enumerate([END, *sorted(s for s in symbols if s not in defined)])}
    nonterminals = {n: len(terminals) + i for i, n in enumerate(["<start>", *sorted(defined)])}
    code = {**terminals, **nonterminals}
    first_nt = len(terminals)
    lhs = [code[n] for n in lhs_names]
    rhs = [tuple(code[s] for s in r) for r in rhs_names]
    by_lhs: dict[int, list[int]] = {}
    for p, a in enumerate(lhs):
        by_lhs.setdefault(a, []).append(p)
    nullable: set[int] = set()
    grown = True
    while grown:
        grown = False
        for p, a in enumerate(lhs):
            if a not in nullable and all(s in nullable for s in rhs[p]):
                nullable.add(a)
                grown = True

    # LR(0) states
    closures: dict[int, frozenset] = {}

    def predicted(sym: int) -> frozenset:
        if sym not in closures:
            seen, todo = {sym}, [sym]
            while todo:
                for p in by_lhs[todo.pop()]:
                    if rhs[p] and rhs[p][0] >= first_nt and rhs[p][0] not in seen:
                        seen.add(rhs[p][0])
                        todo.append(rhs[p][0])
            closures[sym] = frozenset(seen)
        return closures[sym]

    kernels, index, moves, empties = [((0, 0),)], {((0, 0),): 0}, [], []
    k = 0
    while k < len(kernels):
        out: dict[int, list] = {}
        heads: set[int] = set()
        for p, dot in kernels[k]:
            if dot < len(rhs[p]):
                out.setdefault(rhs[p][dot], []).append((p, dot + 1))
                if rhs[p][dot] >= first_nt:
                    heads |= predicted(rhs[p][dot])
        empty = []
        for h in heads:
            for p in by_lhs[h]:
                if rhs[p]:
                    out.setdefault(rhs[p][0], []).append((p, 1))
                else:
                    empty.append(p)
        step = {}
        for sym, items in out.items():
            key = tuple(sorted(set(items)))
            if key not in index:
                index[key] = len(kernels)
                kernels.append(key)
            step[sym] = index[key]
        moves.append(step)
        empties.append(empty)
        k += 1

    # lookaheads: reads, includes and lookback relations between nonterminal transitions
    trans = [(p, a) for p, step in enumerate(moves) for a in step if a >= first_nt]
    number = {t: i for i, t in enumerate(trans)}
    read = [0] * len(trans)
    reads: list[list[int]] = [[] for _ in trans]
    includes: list[list[int]] = [[] for _ in trans]
    lookback: dict[tuple[int, int], list[int]] = {}
    for i, (p, a) in enumerate(trans):
        r = moves[p][a]
        for sym in moves[r]:
            if sym < first_nt:
                read[i] |= 1 << sym
            elif sym in nullable:
                reads[i].append(number[r, sym])
        if p == 0 and a == code[start]:
            read[i] |= 1 << terminals[END]
        for prod in by_lhs[a]:
            state, body = p, rhs[prod]
            for j, sym in enumerate(body):
                if sym >= first_nt and all(s in nullable for s in body[j + 1 :]):
                    includes[number[state, sym]].append(i)
                state = moves[state][sym]
            lookback.setdefault((state, prod), []).append(i)

    def digraph(relation: list[list[int]], value: list[int]) -> list[int]:
        """Unions of `value` over what each can reach; members of a cycle share theirs."""
        low = [0] * len(value)
        result = value[:]
        stack: list[int] = []
        for root in range(len(value)):
            if low[root]:
                continue
            stack.append(root)
            low[root] = len(stack)
            calls = [(root, 0, len(stack))]
            while calls:
                x, j, depth = calls.pop()
                if j:
                    y = relation[x][j - 1]
                    low[x] = min(low[x], low[y])
                    result[x] |= result[y]
                if j < len(relation[x]):
                    calls.append((x, j + 1, depth))
                    y = relation[x][j]
                    if not low[y]:
                        stack.append(y)
                        low[y] = len(stack)
                        calls.append((y, 0, len(stack)))
                elif low[x] == depth:
                    while True:
                        top = stack.pop()
                        low[top] = 1 << 60
                        if top == x:
                            break
                        result[top] = result[x]
        return result

    follow = digraph(includes, digraph(reads, read))
    shift_first = {terminals[t] for t in prefer_shift}
    action: list[dict] = []
    for q, step in enumerate(moves):
        acts: dict[int, list[int]] = {sym: [to] for sym, to in step.items() if sym < first_nt}
        done = [p for p, dot in kernels[q] if dot == len(rhs[p]) and p] + empties[q]
        for p in done:
            mask = 0
            for i in lookback.get((q, p), ()):
                mask |= follow[i]
            t = 0
            while mask:
                if mask & 1 and not (t in shift_first and t in step):
                    acts.setdefault(t, []).append(-p)
                mask >>= 1
                t += 1
        if any(p == 0 and dot == 1 for p, dot in kernels[q]):
            acts.setdefault(terminals[END], []).append(0)
        action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in acts.items()})
    goto = [{a: to for a, to in step.items() if a >= first_nt} for step in moves]
    return Tables(terminals, action, goto, lhs, [len(r) for r in rhs])


class Several(tuple):
    """Terminals that one word stands for, in this order."""


class _Stacks(dict):
    """A set of stacks that are open after the words so far, with those that follow it by the next terminal.

    A stack is a node (state, the node below), and equal stacks are one node, so that the way from one set of stacks to
    the next is worked out once, however often a file, or another, comes by.
    """

    __slots__ = ("nodes", "store")

    def __init__(self, nodes: tuple, store: _Store):
        super().__init__()
        self.nodes, self.store = nodes, store

    def __missing__(self, token) -> _Stacks | bool | None:
        if type(token) is Several:
            stacks = self
            for word in token:
                stacks = stacks[word]
                if stacks is None or stacks is True:
                    break
            return stacks
        self[token] = found = self.store.follow(self.nodes, (token,) if type(token) is int else token)
        return found


class _Store:
    """Nodes and sets of stacks of one grammar, forgotten together when they are many."""

    LIMIT = 300_000

    def __init__(self, tables: Tables):
        self.tables = tables
        self.forget()

    def forget(self) -> None:
        self.below: dict[tuple, tuple] = {}
        self.sets: dict[tuple, _Stacks] = {}
        self.start = self.stacks((self.node(0, None),))

    def node(self, state: int, below: tuple | None) -> tuple:
        key = (state, id(below))  # what is below lives as long as the node that is found by it
        found = self.below.get(key)
        if found is None:
            found = self.below[key] = (state, below)
        return found

    def stacks(self, nodes: tuple) -> _Stacks:
        key = tuple(map(id, nodes))
        found = self.sets.get(key)
        if found is None:
            found = self.sets[key] = _Stacks(nodes, self)
        return found

    def follow(self, nodes: tuple, words: tuple) -> _Stacks | bool | None:
        """The stacks after a word that is one of several terminals; None if none goes on, True if the text is accepted."""
        action, goto, lhs, size = self.tables.action, self.tables.goto, self.tables.lhs, self.tables.size
        shifted: dict[int, tuple] = {}
        for word in words:
            todo, seen = list(nodes), set(map(id, nodes))
            for node in todo:  # grows while it is walked
                act = action[node[0]].get(word)
                if act is None:
                    continue
                for a in (act,) if type(act) is int else act:
                    if a > 0:
                        new = self.node(a, node)
                        shifted[id(new)] = new
                    elif a == 0:
                        return True
                    else:
                        base = node
                        for _ in range(size[-a]):
                            base = base[1]
                        new = self.node(goto[base[0]][lhs[-a]], base)
                        if id(new) not in seen:
                            seen.add(id(new))
                            todo.append(new)
        return self.stacks(tuple(shifted[k] for k in sorted(shifted))) if shifted else None


def recognise(tables: Tables, tokens) -> int | None:
    """None if the token stream is a sentence of the grammar, else the number of the first token that can't go on.

    `tokens` yields a terminal, a tuple of the terminals a word may be, or Several; the end is told by END's number (0),
    which must come last. Where several actions are open, each stack goes on by itself and equal ones are merged.
    """
    store = tables.store
    if store is None:
        store = tables.store = _Store(tables)
    elif len(store.below) > store.LIMIT:
        store.forget()
    stacks, number = store.start, -1
    for number, token in enumerate(tokens):
        stacks = stacks[token]
        if stacks is None:
            return number
        if stacks is True:
            return None
        if not number & 0xFFFF and len(store.below) > store.LIMIT:
            nodes = stacks.nodes
            store.forget()
            stacks = store.stacks(nodes)
    return max(number, 0)
