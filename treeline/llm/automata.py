"""Productions as automata: what may stand inside one pair of brackets is regular, brackets themselves nest.

A grammar gives, for each kind of bracket content, a production over token classes in which a bracketed
group is one symbol carrying the kinds its content was found to be. Groups are reduced from the inside
out while the tokens pass once: a closing bracket turns the window since its opening into such a
symbol. All kinds of one bracket run in a single automaton whose states are built when first met.

Notation of productions, items separated by blanks: ``word`` a keyword, ``'x`` punctuation x, ``UPPER`` a token class
or a set of classes, ``P:a,b`` a group in round brackets that is of kind a or b (B square, C curly, Q, T, I others),
``@name`` another production written out here, ``( ... | ... )`` choice, and a suffix ``*``, ``+`` or ``?``.
"""

from __future__ import annotations

MAX_STATES = 50_000
BREAK = 1 << 12  # flag of a token that begins a line, where line ends can close statements
# Opening and closing token of each kind of group: three brackets, then groups of single languages (conditional
# expression between ? and :, code in a template, indented suite, lambda parameters).
FRAMES = {"P": ("(", ")"), "B": ("[", "]"), "C": ("{", "}"), "Q": ("?", ":"), "T": ("${", "}$"), "I": ("INDENT", "DEDENT"), "L": ("lambda", ":")}


class Grammar:
    """Compiled productions of one language.

    Productions are networks that call each other; a configuration is a place in one of them with the
    places to return to. The set of configurations reached is one state of a deterministic automaton,
    expanded when first met and kept. A production may contain itself anywhere but at its very start.
    """

    def __init__(self, words: str, marks: str, classes: str, sets: dict[str, str], rules: dict[str, str], kinds: dict[str, str], line_ends: bool = False):
        self.line_ends = line_ends
        names = list(dict.fromkeys(["ASI", *classes.split(), *words.split(), *marks.split()]))
        self.ids = {n: i + 1 for i, n in enumerate(names)}
        self.words = set(words.split())
        self.sets = {n: frozenset(self.ids[x] for part in v.split() for x in (self.words if part == "*WORDS" else [part])) for n, v in sets.items()}
        # Edges of a place: (symbols, target); symbols None: free; a string: call of that production.
        self.edges: list[list] = []
        self.rules = {name: self._parse(text) for name, text in (rules | kinds).items()}
        self.end = {b: name for name, (_, b) in self.rules.items()}
        self.kind_at = {self.rules[k][1]: k.split(":")[1] for k in kinds}
        self.start: dict[str, list[int]] = {}
        for k in kinds:
            self.start.setdefault(k.split(":")[0], []).append(self.rules[k][0])
        self._free: dict[int, tuple] = {}
        self.opens = {self.ids[o]: b for b, (o, _) in FRAMES.items() if b in self.start}
        self.closes = {self.ids[c]: b for b, (_, c) in FRAMES.items() if b in self.start and b not in "QL"}
        self.colon = self.ids.get(":", -1) if {"Q", "L"} & set(self.start) else -1
        self._forget()

    def _forget(self) -> None:
        """Start with no states; those of unusual texts would else pile up in a worker that lives long."""
        self.stacks: list[tuple[int, int]] = [(-1, -1)]
        self._stack_of: dict[tuple[int, int], int] = {}
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict] = []
        self.known: list[tuple | None] = []
        self.accepts: list[int | None] = []
        self.labels: dict[frozenset, int] = {}
        self.label_kinds: list[frozenset] = []
        self.begin = {b: self._state({(x, 0) for x in starts}) for b, starts in self.start.items()}

    # ------------------------------------------------------------- building

    def _new(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _parse(self, text: str) -> tuple[int, int]:
        items, at = text.split(), 0

        def closing() -> bool:
            return at == len(items) or items[at] == "|" or (items[at][0] == ")" and items[at][1:] in ("", "*", "+", "?"))

        def choice() -> tuple[int, int]:
            nonlocal at
            a, b = self._new(), self._new()
            while True:
                x = y = self._new()
                while not closing():
                    u, v = item()
                    self.edges[y].append((None, u))
                    y = v
                self.edges[a].append((None, x))
                self.edges[y].append((None, b))
                if at == len(items) or items[at] != "|":
                    return a, b
                at += 1

        def item() -> tuple[int, int]:
            nonlocal at
            t, suffix = items[at], ""
            at += 1
            if t == "(":
                x, y = choice()
                suffix = items[at][1:]
                at += 1
            else:
                if t[0] != "'" and t[-1] in "*+?":
                    t, suffix = t[:-1], t[-1]
                x, y = self._new(), self._new()
                self.edges[x].append((t[1:] if t[0] == "@" else self._symbols(t), y))
            if not suffix:
                return x, y
            a, b = self._new(), self._new()
            self.edges[a].append((None, x))
            self.edges[y].append((None, b))
            if suffix in "*?":
                self.edges[a].append((None, b))
            if suffix in "*+":
                self.edges[y].append((None, x))
            return a, b

        out = choice()
        if at != len(items):
            raise ValueError(f"unbalanced production near {items[max(0, at - 3) : at + 2]}")
        return out

    def _symbols(self, t: str) -> frozenset:
        if t[0] == "'":
            return frozenset([self.ids[t[1:]]])
        if len(t) > 1 and t[1] == ":" and t[0].isupper():
            return frozenset((t[0], k) for k in t[2:].split(","))
        return self.sets[t] if t in self.sets else frozenset([self.ids[t]])

    def _around(self, place: int) -> tuple[list, list, bool]:
        """Reading edges, calls, and whether the production may end, reached from a place by free edges."""
        got = self._free.get(place)
        if got is None:
            seen, todo, reads, calls, ends = {place}, [place], [], [], False
            while todo:
                x = todo.pop()
                ends |= x in self.end
                for sym, y in self.edges[x]:
                    if sym is None:
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
                    elif isinstance(sym, str):
                        calls.append((sym, y))
                    else:
                        reads.append((sym, y))
            got = self._free[place] = (reads, calls, ends)
        return got

    def _state(self, kernel) -> int:
        key = frozenset(kernel)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.known.append(None)
            self.accepts.append(None)
        return n

    def _expand(self, state: int) -> tuple[dict, set]:
        """What a state reads (symbol -> configurations after it) and the kinds that may end in it."""
        got = self.known[state]
        if got is None:
            reads: dict = {}
            kinds: set = set()
            seen = set(self.states[state])
            todo = list(seen)
            while todo:
                place, stack = todo.pop()
                own, calls, ends = self._around(place)
                for sym, y in own:
                    for x in sym:
                        reads.setdefault(x, set()).add((y, stack))
                nxt = []
                for rule, y in calls:
                    r, c, e = self._around(y)
                    if stack and e and not r and not c:
                        up = stack  # nothing follows the call: return to the caller's caller
                    else:
                        up = self._stack_of.setdefault((y, stack), len(self.stacks))
                        if up == len(self.stacks):
                            self.stacks.append((y, stack))
                    nxt.append((self.rules[rule][0], up))
                if ends:
                    if stack:
                        nxt.append(self.stacks[stack])
                    else:
                        kinds |= {k for end, k in self.kind_at.items() if self._reaches(place, end)}
                for c in nxt:
                    if c not in seen:
                        seen.add(c)
                        todo.append(c)
                if len(seen) > 200_000:
                    raise RecursionError("a production calls itself at its start")
            got = self.known[state] = (reads, kinds)
        return got

    def _reaches(self, place: int, end: int) -> bool:
        seen, todo = {place}, [place]
        while todo:
            x = todo.pop()
            if x == end:
                return True
            for sym, y in self.edges[x]:
                if sym is None and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return False

    def _step(self, state: int, symbols) -> int:
        reads = self._expand(state)[0]
        out: set = set()
        for x in symbols:
            out |= reads.get(x, set())
        return self._state(out)

    # ------------------------------------------------------------- running

    def move(self, state: int, token: int) -> int:
        """State after a token met here for the first time; the empty state is dead."""
        base = token & ~BREAK
        nxt = self._step(state, (base,))
        if self.line_ends and token & BREAK:
            closed = self._step(state, (self.ids["ASI"],))
            if self.states[closed] and (not self.states[nxt] or base in self.sets.get("RESTRICTED", ())):
                nxt = self._step(closed, (base,))
        self.moves[state][token] = nxt
        return nxt

    def move_group(self, state: int, bracket: str, label: int) -> int:
        nxt = self.moves[state][(bracket, label)] = self._step(state, [(bracket, k) for k in self.label_kinds[label]])
        return nxt

    def accept(self, state: int) -> int:
        """Number of the set of kinds that may end in a state; all contents are of kind ``any``."""
        n = self.accepts[state]
        if n is None:
            kinds = set(self._expand(state)[1])
            if self.line_ends:
                kinds |= self._expand(self._step(state, (self.ids["ASI"],)))[1]
            key = frozenset(kinds | {"any"})
            n = self.labels.setdefault(key, len(self.labels))
            if n == len(self.label_kinds):
                self.label_kinds.append(key)
            self.accepts[state] = n
        return n

    def pairs(self) -> set[tuple[int, int]]:
        """All pairs of tokens that some text of the grammar has side by side.

        For each production, the tokens it can begin and end with, and at each place those that can come
        just before and just after; a group stands there by its opening and closing token. Found by
        repeating until nothing is added.
        """
        frames = {b: (self.ids[o], self.ids[c]) for b, (o, c) in FRAMES.items() if b in self.start}
        n = len(self.edges)
        before, after = [set() for _ in range(n)], [set() for _ in range(n)]
        empty: set[str] = set()
        edge = lambda sym, which: {frames[s[0]][which] if isinstance(s, tuple) else s for s in sym}
        size = -1
        while size != (size := sum(map(len, before)) + sum(map(len, after)) + len(empty)):
            for name, (a, b) in self.rules.items():
                if name not in empty:
                    seen, todo = {a}, [a]
                    while todo:
                        for sym, y in self.edges[todo.pop()]:
                            if (sym is None or (isinstance(sym, str) and sym in empty)) and y not in seen:
                                seen.add(y)
                                todo.append(y)
                    if b in seen:
                        empty.add(name)
            for x in range(n):
                for sym, y in self.edges[x]:
                    if sym is None or (isinstance(sym, str) and sym in empty):
                        before[y] |= before[x]
                    if isinstance(sym, str):
                        before[y] |= before[self.rules[sym][1]]
                    elif sym is not None:
                        before[y] |= edge(sym, 1)
            for x in range(n - 1, -1, -1):
                for sym, y in self.edges[x]:
                    if sym is None or (isinstance(sym, str) and sym in empty):
                        after[x] |= after[y]
                    if isinstance(sym, str):
                        after[x] |= after[self.rules[sym][0]]
                    elif sym is not None:
                        after[x] |= edge(sym, 0)
        found = {(p, q) for x in range(n) for p in before[x] for q in after[x]}
        for name, (a, b) in self.rules.items():
            if ":" in name and (f := frames.get(name[0])):
                found |= {(f[0], q) for q in after[a]} | {(p, f[1]) for p in before[b]} | ({f} if name in empty else set())
        if any("any" in s[1] for e in self.edges for sym, _ in e if isinstance(sym, frozenset) for s in sym if isinstance(s, tuple)):
            found |= {(-1, -1)}  # groups of any tokens: no pair inside them can be judged
        if self.line_ends:  # a statement may also end before a closing curly bracket
            ends = {p for p, q in found if q == self.ids["ASI"]}
            found |= {(p, self.ids[c]) for p in ends for c in ("}", "}$") if c in self.ids}
        return found

    # ------------------------------------------------------------- texts

    def check(self, tokens: list[int]) -> str | None:
        """None if the tokens form a text of the language, else 'nesting' (brackets that don't match) or 'production'."""
        if len(self.states) > MAX_STATES:
            self._forget()
        moves, opens, closes, colon, begin = self.moves, self.opens, self.closes, self.colon, self.begin
        stack: list[tuple[int, str]] = []
        state, inside = begin["F"], "F"
        for t in tokens:
            nxt = moves[state].get(t)
            if nxt is not None and (t != colon or inside not in "QL"):
                state = nxt
                continue
            base = t & ~BREAK
            b = opens.get(base)
            if b:
                if t & BREAK and self.line_ends:
                    state = self._before_group(state, b)
                stack.append((state, inside))
                state, inside = begin[b], b
                continue
            b = closes.get(base)
            if b is None and base == colon and inside in "QL":
                b = inside
            if b:
                if b != inside or not stack:
                    return "production" if inside in "QL" else "nesting"
                label = self.accept(state)
                state, inside = stack.pop()
                nxt = moves[state].get((b, label))
                state = self.move_group(state, b, label) if nxt is None else nxt
                continue
            state = self.move(state, t)
        if stack:
            return "nesting" if any(x not in "QL" for x in (inside, *(y for _, y in stack[1:]))) else "production"
        return None if "file" in self.label_kinds[self.accept(state)] else "production"

    def _before_group(self, state: int, bracket: str) -> int:
        """A group at the start of a line: the state after a statement's end if the group can't continue it."""
        key = ("before", bracket)
        got = self.moves[state].get(key)
        if got is None:
            got = state
            if not any(isinstance(x, tuple) and x[0] == bracket for x in self._expand(state)[0]):
                closed = self._step(state, (self.ids["ASI"],))
                got = closed if self.states[closed] else state
            self.moves[state][key] = got
        return got
