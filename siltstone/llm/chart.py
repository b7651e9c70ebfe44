"""Error-correcting chart parsing of token sequences whose brackets are nested groups.

A bracketed group is one symbol of the sequence around it, and its content is a sequence of its own
that is parsed for whatever nonterminal its surroundings want. The cost of a content for a nonterminal is
worked out once and remembered by the Python worker, so charts are shared by all equal parts of all files.

cost(nonterminal, sequence, most) is the least number of tokens to insert, delete or replace; `most` = 0
asks for a plain Earley chart, larger ones for a chart whose items carry costs.

Grammars are text: `name = symbols | symbols`, with 'literal' tokens, CLASSES of tokens, names, ? * + and
( ) around parts; P:name B:name C:name S:name I:name are groups in ( ) [ ] { } ${ } and indentation. `name := item sep`
is a list of items with sep between them; `name :: item` is a list of statements, which end
where the sequence says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Remembered costs in a worker; then it starts afresh.
REMEMBERED = 300_000
#: Ends that are tried one by one; the ends beyond are found by one chart over all that follows.
REACH = 12
OPENERS = {"P": "(", "B": "[", "C": "{", "S": "${", "I": "I"}
#: Tokens and groups that can end a statement.
PARTED, BLOCKS = frozenset((";", "NL", "BR")), frozenset(("{", "I"))
#: How a group shows in the outline of a sequence.
GROUPS = {o: o + " group" for o in OPENERS.values()}
#: Neighbours that are looked at together to tell that they stand next to each other in no text of the language.
NEIGHBOURS = 4
NOTHING: tuple[frozenset[int], dict[int, list[int]]] = (frozenset(), {})


class Grammar:
    def __init__(self, text: str, more: tuple[str, ...] = (), blocks_end: bool = True, orders: dict[str, Callable[[list[tuple]], list[int]]] | None = None) -> None:
        self.rules: dict[str, list[tuple]] = {}
        self.lists: dict[str, tuple[str, str]] = {}
        #: Tokens that may go on with a statement that could end before them.
        self.more = frozenset(more)
        #: Whether a statement may end with a block, without a mark after it.
        self.blocks_end = blocks_end
        #: For lists of items whose order matters: which items are out of place.
        self.orders = orders or {}
        self.costs: dict[tuple, int] = {}
        self.bads: dict[tuple, tuple[int, int]] = {}
        self.begun: dict[tuple, dict[int, int]] = {}
        #: What charts found, by the outlines of sequences and what was asked about their groups.
        self.known: dict[tuple, object] = {}
        self.held = 0
        self._fresh = 0
        for line in re.sub(r"\n[ \t]+", " ", text).split("\n"):
            if not line.strip():
                continue
            name, kind, body = re.match(r"(\w+) (=|:=|::) ?(.*)", line).groups()
            if kind == "=":
                self.rules[name] = self._alternatives(re.findall(r"'[^']+'[?*+]?|[\w:]+[?*+]?|\(|\)[?*+]?|\|", body))
            else:
                item, *sep = body.split()
                self.lists[name] = (item, sep[0].strip("'") if sep else "")
        self._analyse()

    def _alternatives(self, tokens: list[str]) -> list[tuple]:
        out, now, i = [], [], 0
        while i < len(tokens):
            t = tokens[i]
            if t == "|":
                out.append(tuple(now))
                now = []
            elif t == "(":
                depth, j = 1, i + 1
                while depth:
                    depth += (tokens[j] == "(") - (tokens[j][0] == ")")
                    j += 1
                now.append(self._repeat(self._name(self._alternatives(tokens[i + 1 : j - 1])), tokens[j - 1][1:]))
                i = j - 1
            else:
                mark = t[-1] if t[-1] in "?*+" and (t[0] != "'" or t.count("'") == 2 and t[-1] != "'") else ""
                now.append(self._repeat(self._symbol(t[: len(t) - len(mark)]), mark))
            i += 1
        return [*out, tuple(now)]

    def _name(self, alternatives: list[tuple]) -> tuple:
        self._fresh += 1
        self.rules[f"_{self._fresh}"] = alternatives
        return ("n", f"_{self._fresh}")

    def _repeat(self, symbol: tuple, mark: str) -> tuple:
        if not mark:
            return symbol
        if mark == "?":
            return self._name([(), (symbol,)])
        many = self._name([])
        self.rules[many[1]] = [() if mark == "*" else (symbol,), (many, symbol)]
        return many

    @staticmethod
    def _symbol(t: str) -> tuple:
        if t[0] == "'":
            return ("t", t[1:-1])
        if t[1:2] == ":":
            return ("g", OPENERS[t[0]], t[2:])
        return ("t", t) if t.isupper() else ("n", t)

    def _analyse(self) -> None:
        self.nullable: set[str] = set()
        while True:
            more = {n for n, alts in self.rules.items() if n not in self.nullable and any(all(s[0] == "n" and s[1] in self.nullable for s in a) for a in alts)}
            if not more:
                break
            self.nullable |= more
        self.first: dict[str, set[str]] = {n: set() for n in self.rules}
        grown = True
        while grown:
            grown = False
            for n, alts in self.rules.items():
                new = set().union(*(self._first(a) for a in alts)) - self.first[n]
                if new:
                    self.first[n] |= new
                    grown = True
        self._number()

    def _number(self) -> None:
        """Numbers for nonterminals and for rules with a dot: what comes after a rule's number has the dot one symbol on.

        An item of a chart is one number too: where it starts, times `size`, and its rule.
        """
        self.ids = {n: k for k, n in enumerate(self.rules)}
        self.lefts: list[int] = []
        #: The symbol after the dot; None at the end.
        self.symbols: list[tuple | None] = []
        #: The tokens that can come next without an edit; None if the rest can be empty.
        self.opens: list[frozenset[str] | None] = []
        self.bases = [[self._dotted(k, a) for a in dict.fromkeys(self.rules[n])] for n, k in self.ids.items()]
        self.wholes = {n: self._dotted(-1, (("n", n),)) for n in self.rules}
        self.size = len(self.lefts)
        self.may_be_empty = [n in self.nullable for n in self.rules]
        #: By nonterminal and next token: the alternatives that can start with it, or be empty.
        self.starts: dict[tuple[int, str], list[int]] = {}
        self.living: dict[tuple, tuple[frozenset[int], dict[int, list[int]]]] = {}
        self._look_ahead()
        # For neighbours, a list is its items, and what parts them, in any order.
        lists = {len(self.ids) + k: [self._dotted(len(self.ids) + k, (x,)) for x in [("n", item), ("t", sep)][: 2 if sep else 1]] for k, (item, sep) in enumerate(self.lists.values())}
        #: Rules with the dot after a symbol, and after a nonterminal; by the outline's symbols and by nonterminal.
        self.past: dict[str, list[int]] = {}
        self.behind: dict[int, list[int]] = lists
        for rule, s in enumerate(self.symbols):
            if s is not None and s[0] == "n":
                self.behind.setdefault(s[1], []).append(rule + 1)
            elif s is not None:
                self.past.setdefault(s[1] if s[0] == "t" else GROUPS[s[1]], []).append(rule + 1)
        self.neighbours: dict[tuple, tuple[list[int], list[dict[int, list[int]]]]] = {}
        #: By opening bracket: what groups can be.
        self.wanted: dict[str, set[str]] = {}
        for s in self.symbols:
            if s is not None and s[0] == "g":
                self.wanted.setdefault(s[1], set()).add(s[2])

    def _look_ahead(self) -> None:
        """What can come next after each rule with a dot, what can come second, and whether its rest can be one symbol or none.

        Both go beyond the end of a rule by what can follow its nonterminal anywhere; "" is the end of the sequence.
        """
        count, symbols, lefts = len(self.ids), self.symbols, self.lefts
        first = [self.first[n] for n in self.ids]
        empty, single, second = self.may_be_empty, [False] * count, [set() for _ in range(count)]
        follow, later = [set() for _ in range(count + 1)], [set() for _ in range(count + 1)]  # the last is that of -1
        follow[-1].add("")
        later[-1].add("")
        #: By rule with a dot: first symbols, second ones, whether the rest can be empty or a single symbol; without what follows.
        self.ahead: list[tuple[set[str], set[str], bool, bool]] = [(set(), set(), True, False)] * self.size
        grown = True
        while grown:
            grown = False
            for rule in range(self.size - 1, -1, -1):
                if (s := symbols[rule]) is None:
                    continue
                a, b, none, one = self.ahead[rule + 1]
                if s[0] == "n":
                    k = s[1]
                    new = (first[k] | a if empty[k] else first[k], second[k] | (a if single[k] else set()) | (b if empty[k] else set()), empty[k] and none, single[k] and none or empty[k] and one)
                else:
                    new = ({s[1]}, a, False, none)
                if new != self.ahead[rule]:
                    self.ahead[rule], grown = new, True
            for k, bases in enumerate(self.bases):
                for rule in bases:
                    _, b, _, one = self.ahead[rule]
                    if not b <= second[k] or one and not single[k]:
                        second[k] |= b
                        single[k] |= one
                        grown = True
        grown = True
        while grown:
            grown = False
            for rule in range(self.size):
                s = symbols[rule]
                if s is None or s[0] != "n":
                    continue
                left, (a, b, none, one) = lefts[rule], self.ahead[rule + 1]
                near = a | follow[left] if none else a
                far = b | (follow[left] if one else set()) | (later[left] if none else set())
                if not near <= follow[s[1]] or not far <= later[s[1]]:
                    follow[s[1]] |= near
                    later[s[1]] |= far
                    grown = True
        self.nexts = [a | follow[left] if none else a for left, (a, _, none, _) in zip(lefts, self.ahead)]
        self.soon = [n | b | (follow[left] if one else set()) | (later[left] if none else set()) for left, n, (_, b, none, one) in zip(lefts, self.nexts, self.ahead)]

    def _dotted(self, left: int, body: tuple) -> int:
        base = len(self.lefts)
        for dot in range(len(body) + 1):
            rest = body[dot:]
            self.lefts.append(left)
            self.symbols.append((("n", self.ids[rest[0][1]]) if rest[0][0] == "n" else rest[0]) if rest else None)
            self.opens.append(None if all(x[0] == "n" and x[1] in self.nullable for x in rest) else frozenset(self._first(rest)))
        return base

    def _first(self, symbols: tuple) -> set[str]:
        out: set[str] = set()
        for s in symbols:
            if s[0] != "n":
                return out | {s[1]}
            out |= self.first[s[1]]
            if s[1] not in self.nullable:
                break
        return out

    def _predicted(self, left: int, kind: str) -> list[int]:
        key = (left, kind)
        if key not in self.starts:
            self.starts[key] = [a for a in self.bases[left] if self.opens[a] is None or kind in self.opens[a]]
        return self.starts[key]

    def _alive(self, kind: str, after: str | None, edits: int, open_: bool) -> tuple[frozenset[int], dict[int, list[int]]]:
        """The rules with a dot that can go on before the next token with so many edits (0 or 1) left, and by nonterminal its alternatives among them.

        after: the token after the next one, or None if it takes more than an edit to leave the next one out;
        open_: whether the sequence may end here, or, with an edit, after the next token.
        """
        key = (kind, after, edits, open_)
        if (known := self.living.get(key)) is None:
            rules = range(self.size)
            if edits:
                held = [x for x in rules if kind in self.soon[x] or after in self.soon[x] or open_ and (self.ahead[x][2] or self.ahead[x][3])]
            else:
                held = [x for x in rules if kind in self.nexts[x] or open_ and self.ahead[x][2]]
            known = self.living[key] = (frozenset(held), {})
        return known

    # -- costs ---------------------------------------------------------------------------------

    def cost(self, name: str, seq: tuple, most: int) -> int:
        """Least edits that make seq a `name`; most + 1 if more than `most` are needed."""
        if "BR" in seq and (name not in self.lists or self.lists[name][1]):
            seq = tuple([t for t in seq if t != "BR"])
        return self._cost(name, seq, most)

    def _cost(self, name: str, seq: tuple, most: int) -> int:
        """The same, of a sequence whose line breaks are left out if they are white space."""
        key = (name, seq, most)
        if (known := self.costs.get(key)) is None:
            if len(self.costs) > REMEMBERED:
                self.costs.clear()
            if most and self._least(seq, most) > most:
                known = most + 1
            elif most > 1 and (fewer := self.cost(name, seq, most - 1)) < most:
                known = fewer  # widened step by step: most files need few edits
            elif name in self.lists:
                item, sep = self.lists[name]
                known = self._statements(item, seq, most) if not sep else self._separated(item, sep, seq, most)
                if not known and name in self.orders:
                    known = min(most + 1, len(self._misplaced(name, seq)))
            elif not most:
                known = 0 if self._recognise(name, seq) else 1
            else:
                known = self._repair(name, seq, most) if most > 1 or self.cost(name, seq, 0) else 0
            self.costs[key] = known
        return known

    def _least(self, seq: tuple, most: int, opener: str = "") -> int:
        """Edits that a sequence and its groups take at least, whatever they are to be; counted until there are more than `most`."""
        known, upto = self.bads.get(seq, (0, -1))
        if upto < most and known <= upto or upto < 0:
            if len(self.bads) > REMEMBERED:
                self.bads.clear()
            known = 0 if self._sound(seq, opener) else self._needs(seq, most)[0]
            self.bads[seq] = known, most if known > most else REMEMBERED
        return known

    def _sound(self, seq: tuple, opener: str) -> bool:
        """Whether the content of a group is known to be something that such groups can be."""
        bare = tuple([t for t in seq if t != "BR"]) if "BR" in seq else seq
        return any(self.costs.get((want, seq if want in self.lists and not self.lists[want][1] else bare, 0)) == 0 for want in self.wanted.get(opener, ()))

    def _needs(self, seq: tuple, most: int) -> list[int]:
        """For each place of a sequence without line breaks, and two after it: the edits that what starts there or later takes at least;
        counted until there are more than `most`.

        Neighbours that stand next to each other in no text take an edit, of one of them or between them; none of them is counted twice.
        A group that is left out or replaced costs all its tokens, which is one more than what is counted in it.
        """
        bare = tuple([t for t in seq if t != "BR"]) if "BR" in seq else seq
        outline = tuple([t if t.__class__ is str else GROUPS[t[0]] for t in bare])
        needs = [0] * (len(outline) + 3)
        begin = total = 0
        for i, t in enumerate(bare):
            a = max(begin, i + 1 - NEIGHBOURS)
            if not self._fit(outline[a : i + 1]):
                while a < i and not self._fit(outline[a + 1 : i + 1]):
                    a += 1
                needs[a] += 1
                total += 1
                begin = i + 1
            if t.__class__ is tuple and (inner := self._least(t[1], most - total, t[0]) if total <= most else 0):
                needs[i] += inner
                total += inner
            if total > most:
                break
        for i in range(len(outline) - 1, -1, -1):
            needs[i] += needs[i + 1]
        return needs

    def _fit(self, outline: tuple) -> bool:
        """Whether these symbols stand next to each other in some text, groups being what they should."""
        return bool(self._neighbours(outline)[0])

    def _neighbours(self, outline: tuple) -> tuple[list[int], list[dict[int, list[int]]]]:
        """What a chart that begins with all rules, anywhere, has after these symbols, and what waits at each of them."""
        if (known := self.neighbours.get(outline)) is None:
            if len(self.neighbours) > REMEMBERED // 20:
                self.neighbours.clear()
            if len(outline) == NEIGHBOURS:  # nothing goes on from here
                known = self._next_to(outline)[0][:1], []
            elif len(outline) > 1:
                known = self._next_to(outline)
            else:  # what began before the first symbol begins at 0
                known = self.past.get(outline[0], []), [{}]
            self.neighbours[outline] = known
        return known

    def _next_to(self, outline: tuple) -> tuple[list[int], list[dict[int, list[int]]]]:
        size, symbols, opens, lefts = len(self.symbols), self.symbols, self.opens, self.lefts
        before, waiting = self._neighbours(outline[:-1])
        if not before:
            return [], []
        i, token = len(outline) - 1, outline[-1]
        kind = token.removesuffix(" group")
        wants: dict[int, list[int]] = {}
        waiting = [*waiting, wants]
        work, nxt, here = list(before), [], i * size
        now = set(work)
        while work:
            item = work.pop()
            start, rule = divmod(item, size)
            s = symbols[rule]
            if s is None:
                if start == i:
                    continue
                for w in waiting[start].get(lefts[rule], ()) if start else self.behind.get(lefts[rule], ()):
                    new = w + 1 if start else w
                    if new not in now and ((can := opens[new % size]) is None or kind in can):
                        now.add(new)
                        work.append(new)
                continue
            if s[0] == "n":
                left = s[1]
                if left in wants:
                    wants[left].append(item)
                else:
                    wants[left] = [item]
                    for a in self._predicted(left, kind):
                        if here + a not in now:
                            now.add(here + a)
                            work.append(here + a)
                if self.may_be_empty[left]:
                    new = item + 1
                    if new not in now and ((can := opens[rule + 1]) is None or kind in can):
                        now.add(new)
                        work.append(new)
            elif token == (s[1] if s[0] == "t" else GROUPS[s[1]]):
                nxt.append(item + 1)
        return nxt, waiting

    def _separated(self, item: str, sep: str, seq: tuple, most: int, cuts: list | None = None) -> int:
        ends = [i for i, t in enumerate(seq) if t == sep]
        if not ends or ends[-1] != len(seq) - 1:  # a last separator may be left over
            ends.append(len(seq))
        total = start = k = 0
        while k < len(ends) and start < len(seq):
            # A separator between < and > may belong to the item.
            near = min(k + REACH, len(ends))
            wide = next((j for j in range(k, near) if (j == k or "<" in seq[start : ends[j - 1]]) and not self.cost(item, seq[start : ends[j]], 0)), None)
            if wide is None and near < len(ends) and "<" in seq[start : ends[near - 1]]:
                lengths = self._lengths(item, seq[start:])
                wide = next((j for j in range(near, len(ends)) if ends[j] - start in lengths), None)
            if wide is None:
                wide = k
                total += self.cost(item, seq[start : ends[k]], most)
                if cuts is not None:
                    cuts.append((start, ends[k]))
                if total > most:
                    return most + 1
            start, k = ends[wide] + 1, wide + 1
        return total

    def _misplaced(self, name: str, seq: tuple) -> list[int]:
        """Where the items of a list begin that are out of order."""
        ends = [i for i, t in enumerate(seq) if t == self.lists[name][1]]
        begins = [0, *(i + 1 for i in ends)]
        parts = [seq[a:b] for a, b in zip(begins, [*ends, len(seq)]) if a < len(seq)]
        return [begins[n] for n in self.orders[name](parts)]

    def _statements(self, item: str, seq: tuple, most: int, cuts: list | None = None) -> int:
        """A chart over the ends of statements: best[i] is the cost of all statements before the i-th token."""
        n, breaks = len(seq), "BR" in seq
        ends = [i + 1 for i, t in enumerate(seq) if (t in PARTED if t.__class__ is str else self.blocks_end and t[0] in BLOCKS)]
        if not ends or ends[-1] != n:
            ends.append(n)
        best, begin = {0: 0}, {}
        needs, bare = (self._needs(seq, most), _bare_places(seq)) if most else ([], [])
        for at, i in enumerate([0, *ends]):
            if i not in best or i == n:
                continue
            base, tried, lengths, repairs = best[i], 0, None, None
            rest: tuple = ()
            size, end = 0, i
            for j in ends[at:]:
                if j <= i:
                    continue
                tried += 1
                # Line breaks only part statements; within one they are white space.
                if tried <= REACH:
                    part = tuple([t for t in seq[i:j] if t != "BR"]) if breaks else seq[i:j]
                    size, end = len(part), j
                    c = self._cost(item, part, 0) if part else 0
                else:
                    rest = rest or tuple(t for t in seq[i:] if t != "BR")
                    if lengths is None:
                        lengths = self._lengths(item, rest)
                        longest = max(lengths, default=0)
                    size += sum(t != "BR" for t in seq[end:j])
                    end = j
                    if size > longest and (most <= base or repairs is not None and size > max(repairs, default=0)):
                        break
                    c = 0 if size in lengths else 1
                if c and most > base:
                    if repairs is None:  # of all ends at once
                        rest = rest or tuple(t for t in seq[i:] if t != "BR")
                        repairs = self._prefixes(item, rest, most - base, tuple(bare[j] - bare[i] for j in ends if j > i), tuple(needs[bare[i] :]))
                    c = repairs.get(size, most + 1)
                elif c:
                    c = most + 1
                if base + c + (needs[bare[j]] if most else 0) <= most and base + c < best.get(j, most + 1):
                    best[j], begin[j] = base + c, i
                if not c:
                    k = j
                    while k < n and seq[k] == "BR":
                        k += 1
                    after = seq[k] if k < n else ""
                    if (after if after.__class__ is str else after[0]) not in self.more:
                        break
        if cuts is not None:
            j = n if n in best else max(best)
            if n not in best:
                cuts.append((j, n))
            while j:
                cuts.append((begin[j], j))
                j = begin[j]
            cuts.reverse()
        return best.get(n, most + 1)

    def _recognise(self, name: str, seq: tuple) -> bool:
        """Whether seq is a `name`: as its chart would ask about its groups, by the answers for an equal outline before."""
        key = (name, tuple([t if t.__class__ is str else GROUPS[t[0]] for t in seq]))
        node = self.known.get(key)
        while node.__class__ is Node:
            node = node.nexts.get(self.cost(node.want, seq[node.at][1], 0))
        if node is None:
            asked: list[tuple] = []
            node = self._chart(name, seq, None, None, asked)
            self._remember(key, asked, node)
        return node

    def _remember(self, key: tuple, asked: list[tuple], result: object) -> None:
        """Holds a result under what was asked for it, in order: (place, nonterminal, edits, answer)."""
        if len(self.known) > REMEMBERED // 10 or self.held > REMEMBERED // 3:
            self.known.clear()
            self.held = 0
        self.held += len(asked) + 1
        if not asked:
            self.known[key] = result
            return
        node = self.known.get(key)
        if node is None:
            node = self.known[key] = Node(*asked[0][:3])
        for (*_, answer), (at, want, most, _) in zip(asked, asked[1:]):
            if (following := node.nexts.get(answer)) is None:
                following = node.nexts[answer] = Node(at, want, most)
            node = following
        node.nexts[asked[-1][3]] = result

    def _lengths(self, name: str, seq: tuple) -> set[int]:
        """How many tokens of seq, from its start, can be a `name`."""
        lengths: set[int] = set()
        self._chart(name, seq, lengths)
        return lengths

    def _chart(self, name: str, seq: tuple, lengths: set[int] | None = None, stop: list | None = None, asked: list[tuple] | None = None) -> bool:
        """Plain Earley chart with one token of foresight: whether seq is a `name`, the lengths at which one could end, and
        where it can't go on, with what the groups there would have to be; asked gets what it asks about groups."""
        n, size, symbols, opens, lefts = len(seq), self.size, self.symbols, self.opens, self.lefts
        target = self.ids[name]
        waiting: list[dict[int, list[int]]] = []
        kind = (seq[0] if seq[0].__class__ is str else seq[0][0]) if n else ""
        work = list(self._predicted(target, kind))
        for i in range(n + 1):
            token = seq[i] if i < n else ""
            kind = token if token.__class__ is str else token[0]
            grouped = token.__class__ is tuple
            wants: dict[int, list[int]] = {}
            answers: dict[str, int] = {}
            waiting.append(wants)
            now = dict.fromkeys(work)
            work, nxt, here = list(now), [], i * size
            while work:
                item = work.pop()
                start, rule = divmod(item, size)
                s = symbols[rule]
                if s is None:
                    if start == i and start:
                        continue  # empty: handled where it was predicted
                    for w in waiting[start].get(lefts[rule], ()):
                        new = w + 1
                        if new not in now and ((can := opens[new % size]) is None or kind in can):
                            now[new] = None
                            work.append(new)
                    continue
                if s[0] == "n":
                    left = s[1]
                    if left in wants:
                        wants[left].append(item)
                    else:
                        wants[left] = [item]
                        for a in self._predicted(left, kind):
                            new = here + a
                            if new not in now:
                                now[new] = None
                                work.append(new)
                    if self.may_be_empty[left]:
                        new = item + 1
                        if new not in now and ((can := opens[rule + 1]) is None or kind in can):
                            now[new] = None
                            work.append(new)
                elif s[1] == kind and s[0] == ("g" if grouped else "t"):
                    if grouped:
                        want = s[2]
                        if (answer := answers.get(want)) is None:
                            answer = answers[want] = self.cost(want, token[1], 0)
                            if asked is not None:
                                asked.append((i, want, 0, answer))
                        if answer:
                            continue
                    nxt.append(item + 1)
            ended = (lengths is not None or i == n) and any(item < size and symbols[item] is None and lefts[item] == target for item in now)
            if lengths is not None and ended:
                lengths.add(i)
            if stop is not None:
                at = [symbols[item % size] for item in now]
                stop[:] = [i, [s[2] for s in at if grouped and s and s[0] == "g" and s[1] == kind]]
            if i == n:
                return ended
            if not nxt:
                return False
            work = nxt
        return False

    def _prefixes(self, name: str, seq: tuple, most: int, ends: tuple[int, ...], needs: tuple[int, ...]) -> dict[int, int]:
        """By length, of those in `ends`: the cost of each beginning of seq that can be made a `name` and leaves what the rest needs."""
        key = (name, seq, most, ends, needs)
        if (known := self.begun.get(key)) is None:
            if len(self.begun) > REMEMBERED // 100:
                self.begun.clear()
            known = self.begun[key] = {}
            self._repair(name, seq, most, None, known, frozenset(ends), needs)
        return known

    def _repair(self, name: str, seq: tuple, most: int, back: dict | None = None, prefixes: dict[int, int] | None = None, ends: frozenset[int] = frozenset(), needs: tuple[int, ...] | None = None) -> int:
        """Chart whose items carry the cost of their edits; items dearer than `most` with what the tokens ahead need are dropped, and so are those
        that have no edit left and can't go on with the next token, or have one left and can't go on with it or the one after.

        prefixes, if given, gets the cost of each beginning of seq, of the lengths in `ends`, that can be made a `name`. back, if given, gets for each (place, item) what it came from: earlier (place, item) pairs and an edit, if there was one.
        """
        size, symbols, lefts = self.size, self.symbols, self.lefts
        n, free = len(seq), range(self.size)
        kinds = [t if t.__class__ is str else t[0] for t in seq] + [""] * 2
        if needs is None:
            needs = tuple(self._needs(seq, most))
        if needs[0] > most:
            return most + 1
        whole = self.wholes[name] + 1
        charts: list[dict[int, int]] = []
        waits: list[dict[int, list[int]]] = []
        #: By place and nonterminal: the least cost of all before it, where it is asked for. An item's own cost comes on top.
        floors: list[dict[int, int]] = [{-1: 0}]
        carried: dict[int, tuple[int, tuple]] = {whole - 1: (0, ((), None))}
        source: tuple | None = None
        weight = _weight(seq[0] if n else None, most + 1)
        live = self._live(kinds, 0, weight, most, ends, needs)
        for i in range(n + 1):
            token = seq[i] if i < n else None
            kind = kinds[i]
            sort = "g" if token.__class__ is tuple else "t"
            # A group that is left out or replaced costs all its tokens.
            then = _weight(seq[i + 1] if i + 1 < n else None, most + 1)
            coming = self._live(kinds, i + 1, then, most, ends, needs) if i < n else live
            alive, arrive = [x[0] if x else free for x in live], [x[0] if x else free for x in coming]
            answers: dict[tuple[str, int], int] = {}
            now, wants, made, following, here = {}, {}, {}, {}, i * size
            charts.append(now)
            waits.append(wants)
            if i:
                floors.append({})
            floor = floors[i]
            queue: list[list[tuple]] = [[] for _ in range(most + 1)]
            for item, (c, source) in carried.items():
                start, rule = divmod(item, size)
                queue[floors[start][lefts[rule]] + c].append((item, c, source))
            for total in range(most + 1):
                queued = queue[total]
                while queued:
                    item, c, source = queued.pop()
                    if item in now and now[item] <= c:
                        continue
                    now[item] = c
                    if back is not None:
                        back[i, item] = source
                    start, rule = divmod(item, size)
                    s = symbols[rule]
                    if s is None:
                        left = lefts[rule]
                        if start == i:
                            if left in made:
                                continue
                            made[left] = (c, item)
                        before = charts[start]
                        for w in waits[start].get(left, ()):
                            d = before[w] + c
                            first, waiting = divmod(w, size)
                            all_ = floors[first][lefts[waiting]] + d
                            if all_ <= most and waiting + 1 in alive[all_]:
                                queue[all_].append((w + 1, d, None if back is None else (((start, w), (i, item)), None)))
                        continue
                    step = item + 1
                    if s[0] == "n":
                        left = s[1]
                        if left in wants:
                            wants[left].append(item)
                        else:
                            wants[left] = [item]
                            floor[left] = total
                            # Where no edit is left to make, only what the next token allows; where one is, what it or the one after allows.
                            bases = self.bases[left]
                            if (allowed := live[total]) is not None and (bases := allowed[1].get(left)) is None:
                                bases = allowed[1][left] = [a for a in self.bases[left] if a in allowed[0]]
                            for a in bases:
                                queued.append((here + a, 0, ((), None)))
                        if left in made:
                            all_ = total + made[left][0]
                            if all_ <= most and rule + 1 in alive[all_]:
                                queue[all_].append((step, c + made[left][0], (((i, item), (i, made[left][1])), None)))
                        continue
                    if total < most and rule + 1 in alive[total + 1]:
                        queue[total + 1].append((step, c + 1, None if back is None else (((i, item),), ("missing", i, None))))
                    if token is not None:
                        edit = None
                        if s[1] == kind and s[0] == sort:
                            d = 0
                            if sort == "g" and (d := answers.get((s[2], total))) is None:
                                d = answers[s[2], total] = self.cost(s[2], token[1], most - total - needs[i + 1])
                            if d:
                                edit = ("within", i, s[2])
                        else:
                            d, edit = weight, ("other", i, None)
                        all_ = total + d
                        if all_ <= most and rule + 1 in arrive[all_] and (step not in following or c + d < following[step][0]):
                            following[step] = (c + d, None if back is None else (((i, item),), edit))
            if i in ends and (c := now.get(whole)) is not None:
                prefixes[i] = c
            if token is not None and weight <= most:
                for item, c in now.items():
                    start, rule = divmod(item, size)
                    if symbols[rule] is None and item != whole:  # what comes after all may be left out too
                        continue
                    all_ = floors[start][lefts[rule]] + c + weight
                    if all_ <= most and rule in arrive[all_] and (item not in following or c + weight < following[item][0]):
                        following[item] = (c + weight, None if back is None else (((i, item),), ("stray", i, None)))
            carried, weight, live = following, then, coming
            if not carried and token is not None:
                return most + 1
        return now.get(whole, most + 1)

    def _live(self, kinds: list[str], i: int, weight: int, most: int, ends: frozenset[int], needs: tuple[int, ...]) -> list[tuple | None]:
        """By edits made: what can go on at the i-th token; None where all can."""
        out: list[tuple | None] = []
        for total in range(most + 1):
            left = most - total - needs[i + 2]  # for the next two tokens
            if total + needs[i] > most:
                out.append(NOTHING)
            elif left > 1:
                out.append(None)
            elif left:
                out.append(self._alive(kinds[i], kinds[i + 1] if weight == 1 and i + 1 < len(kinds) else None, 1, i in ends or i + 1 in ends))
            else:
                out.append(self._alive(kinds[i], None, 0, i in ends))
        return out

    # -- Places of edits. ------------------------------------------------------------------------

    def _bare(self, name: str, seq: tuple, places: tuple) -> tuple[tuple, tuple]:
        """Both without line breaks, where these are white space."""
        if "BR" in seq and (name not in self.lists or self.lists[name][1]):
            held = [i for i, t in enumerate(seq) if t != "BR"]
            return tuple(seq[i] for i in held), tuple(places[i] for i in held)
        return seq, places

    def edits(self, name: str, seq: tuple, places: tuple, end: int, most: int) -> list[tuple[str, int]]:
        """(kind, token) of each edit of a least repair that costs `most` at most: missing before the token, stray, other, by the chart's
        back-pointers. places: for each symbol its token, or (opening token, places inside, closing token); end: the token after all."""
        seq, places = self._bare(name, seq, places)
        cost = self.cost(name, seq, most)
        if not cost or cost > most:
            return []
        at = lambda i: end if i >= len(places) else places[i] if places[i].__class__ is int else places[i][0]
        if name in self.lists:
            item, sep = self.lists[name]
            cuts: list[tuple[int, int]] = []
            self._separated(item, sep, seq, cost, cuts) if sep else self._statements(item, seq, cost, cuts)
            parts = [(b, [i for i in range(a, b) if seq[i] != "BR"]) for a, b in cuts]
            if name in self.orders and not any(held and self.cost(item, tuple(seq[i] for i in held), 0) for _, held in parts):
                return [("other", at(i)) for i in self._misplaced(name, seq)]
            return [e for b, held in parts if held for e in self.edits(item, tuple(seq[i] for i in held), tuple(places[i] for i in held), at(b), cost)]
        back: dict[tuple, tuple] = {}
        self._repair(name, seq, cost, back)
        out, work, seen = [], [(len(seq), self.wholes[name] + 1)], set()
        while work:
            node = work.pop()
            if node in seen:
                continue
            seen.add(node)
            sources, edit = back[node]
            work += sources
            if edit and edit[0] == "within":
                opened, inner, closed = places[edit[1]]
                out += self.edits(edit[2], seq[edit[1]][1], inner, closed, cost)
            elif edit:
                out.append((edit[0], at(edit[1])))
        return sorted(out, key=lambda e: e[1])

    def stops(self, name: str, seq: tuple, places: tuple, end: int) -> int:
        """The token at which a sequence that is no `name` can't go on."""
        seq, places = self._bare(name, seq, places)
        if name in self.lists:
            item, sep = self.lists[name]
            cuts: list[tuple[int, int]] = []
            self._separated(item, sep, seq, 0, cuts) if sep else self._statements(item, seq, 0, cuts)
            parts = [(b, [i for i in range(a, b) if seq[i] != "BR"]) for a, b in cuts]
            b, rest = next(((b, held) for b, held in parts if held and self.cost(item, tuple(seq[i] for i in held), 0)), (len(seq), []))
            if not rest:
                wrong = self._misplaced(name, seq) if name in self.orders else []
                return end if not wrong else places[wrong[0]] if places[wrong[0]].__class__ is int else places[wrong[0]][0]
            after = end if b >= len(places) else places[b] if places[b].__class__ is int else places[b][0]
            return self.stops(item, tuple(seq[i] for i in rest), tuple(places[i] for i in rest), after)
        where: list = [0, []]
        self._chart(name, seq, None, where)
        i, inner = where
        if i >= len(seq):
            return end
        if seq[i].__class__ is tuple:
            wanted = next((g for g in inner if self.cost(g, seq[i][1], 0)), None)
            return self.stops(wanted, seq[i][1], places[i][1], places[i][2]) if wanted else places[i][0]
        return places[i]


def _bare_places(seq: tuple) -> list[int]:
    """For each place, and the one after all: how many tokens are before it, line breaks left out."""
    places = [0]
    for t in seq:
        places.append(places[-1] + (t != "BR"))
    return places


class Node:
    """What a chart asks next: how dear it is, up to `most`, to make the group at a place a nonterminal; and what follows by the answer."""

    __slots__ = ("at", "most", "nexts", "want")

    def __init__(self, at: int, want: str, most: int) -> None:
        self.at, self.want, self.most, self.nexts = at, want, most, {}


def matched(tokens: list[str], closers: dict[str, str]) -> tuple | None:
    """The sequence with groups of flat tokens whose brackets match; None if they don't."""
    stack: list[tuple[str, list]] = []
    marks = {*closers, *closers.values()}
    inner: list = []
    for t in tokens:
        if t not in marks:
            inner.append(t)
        elif t in closers:
            stack.append((t, inner))
            inner = []
        else:
            if not stack or closers[stack[-1][0]] != t:
                return None
            o, outer = stack.pop()
            outer.append((o, share(tuple(inner))))
            inner = outer
    return None if stack else share(tuple(inner))


def nest(tokens: list[str], closers: dict[str, str], without: frozenset[int] = frozenset()) -> tuple[tuple, tuple, list[tuple[str, int]]]:
    """(sequence with groups, places of its symbols, edits of brackets) of flat tokens, those of `without` left out.

    Unclosed brackets are closed at the end of the file, stray ones left out, each at a cost of 1;
    a closing bracket that fits an outer group closes the inner ones too.
    """
    stack: list[tuple[str, list, list, int]] = [("", [], [], -1)]
    edits: list[tuple[str, int]] = [("stray", i) for i in sorted(without)]
    shut = set(closers.values())

    def close(at: int) -> None:
        o, inner, places, opened = stack.pop()
        stack[-1][1].append((o, share(tuple(inner))))
        stack[-1][2].append((opened, tuple(places), at))

    symbols, places = stack[0][1], stack[0][2]
    for i, t in enumerate(tokens):
        if t not in closers and t not in shut:
            if i not in without:
                symbols.append(t)
                places.append(i)
            continue
        if i in without:
            continue
        if t in closers:
            stack.append((t, [], [], i))
        else:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if closers[stack[k][0]] == t), 0)
            # Close inner groups only if that costs less than leaving this bracket out.
            if not depth or len(stack) - 1 - depth > 1:
                edits.append(("stray", i))
                continue
            while len(stack) - 1 > depth:
                edits.append(("missing", i))
                close(i)
            close(i)
        symbols, places = stack[-1][1], stack[-1][2]
    while len(stack) > 1:
        edits.append(("missing", len(tokens)))
        close(len(tokens))
    return share(tuple(stack[0][1])), tuple(stack[0][2]), edits


def unclosed(tokens: list[str], closers: dict[str, str]) -> frozenset[int]:
    """The opening brackets that nothing closes before the end."""
    stack: list[int] = []
    shut = {b: a for a, b in closers.items()}
    for i, t in enumerate(tokens):
        if t in closers:
            stack.append(i)
        elif t in shut and stack and tokens[stack[-1]] == shut[t]:
            stack.pop()
    return frozenset(stack)


def _weight(token: str | tuple | None, most: int) -> int:
    """Tokens of a symbol, its brackets included, as far as `most`."""
    if token.__class__ is not tuple:
        return 1
    size = 2
    for t in token[1]:
        if size >= most:
            break
        size += _weight(t, most - size)
    return min(size, most)


_shared: dict[tuple, tuple] = {}


def share(seq: tuple) -> tuple:
    if len(_shared) > REMEMBERED:
        _shared.clear()
    return _shared.setdefault(seq, seq)
