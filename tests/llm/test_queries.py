from __future__ import annotations

import pytest

from siltstone.llm import queries, syntax


@pytest.mark.parametrize("name, columns", [("p1_found", ["chunk_a", "chunk_b"]), ("p2_found", ["file_id"]), ("p3_found", ["chunk_a", "chunk_b"]), ("p4_found", ["chunk_no"]), ("p5_found", ["answer_id", "defect"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id"])])
def test_columns(spark, smallest, name, columns):
    df = queries.queries()[name](spark, smallest)
    assert df.columns == columns and df.count() > 0


def test_all_of_p2_comes_from_least_repairs(spark, smallest, monkeypatch):
    """No query of problem 2 asks for less than the least repair: what it costs, of which kind the fault is and where."""
    check, checked = syntax.check, []
    monkeypatch.setattr(syntax, "check", lambda *a, **k: checked.append(check(*a, **k)) or checked[-1])
    found, faults, rates = (queries.queries()[name](spark, smallest) for name in ("p2_found", "p2_faults", "p2_rates"))
    assert len(checked) == 3
    for df in checked:
        bad = df.where("cost > 0").collect()
        assert max(r.cost for r in bad) > 1 and all(r.fault and r.line for r in bad)
    assert {r.file_id for r in found.collect()} == {r.file_id for r in faults.collect()}
    assert sum(r.invalid for r in rates.collect()) == faults.count()


def test_a_chart_drops_only_what_no_edit_can_save():
    """Costs of short sequences, as far as 3, are those of trying all edits."""
    from itertools import product

    from siltstone.llm.chart import Grammar

    g = Grammar("e = t | e '+' t\nt = N | P:e | '-' t | o 'x'\no = N?\n")
    tokens = ["+", "-", "N", "x", ("(", ("N",))]
    valid = {seq for n in range(6) for seq in product(tokens, repeat=n) if not g.cost("e", seq, 0)}

    def near(seqs):
        """All that one edit makes of them; the group's three tokens are neither left out nor replaced by so few."""
        out = set(seqs)
        for s in seqs:
            out |= {s[:i] + (t,) + s[i:] for t in tokens[:4] for i in range(len(s) + 1)}
            for i, t in enumerate(s):
                if isinstance(t, str):
                    out |= {s[:i] + s[i + 1 :], *(s[:i] + (u,) + s[i + 1 :] for u in tokens)}
        return out

    for seq in product(tokens, repeat=3):
        reached, cost = {seq}, 0
        while cost < 3 and not reached & valid:
            reached, cost = near(reached) if cost < 2 else set(), cost + 1
        assert min(3, g.cost("e", seq, 3)) == cost, seq


def _broken(language: str, text: str, seed: int) -> str:
    """A text with up to three words or marks left out, doubled or swapped."""
    import random
    import re

    rng, parts = random.Random(f"{language} {seed}"), re.findall(r"\w+|\s+|.", text)
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = rng.choice([parts[i + 1 : i + 2], [parts[i]] * 2 + parts[i + 1 : i + 2], parts[i : i + 2][::-1]])
    return "".join(parts)


def test_what_is_left_out_of_charts_changes_no_cost(monkeypatch):
    """Bounds from neighbours, what can come next or second, and answers for equal outlines: costs are those of charts without them."""
    from siltstone.llm import grammars
    from siltstone.llm.chart import Grammar
    from test_texts import VALID

    texts = [(_broken(language, text, seed), language) for language, text in VALID.items() for seed in range(12)]
    found = [syntax.inspect(text, language)[0] for text, language in texts]
    assert {0, 1, 2, 3, 4} <= set(found)
    monkeypatch.setattr(Grammar, "_needs", lambda self, seq, most: [0] * (len(seq) + 3))
    monkeypatch.setattr(Grammar, "_alive", lambda self, *_: (frozenset(range(self.size)), {}))
    monkeypatch.setattr(Grammar, "_recognise", lambda self, name, seq: self._chart(name, seq))
    grammars.grammar.cache_clear()
    try:
        assert [syntax.inspect(text, language)[0] for text, language in texts] == found
    finally:
        grammars.grammar.cache_clear()


def test_no_chart_without_need(monkeypatch):
    """What stands next to each other in no text is counted without repairs; statements of an equal outline share a chart."""
    from siltstone.llm.chart import Grammar

    charts, repairs = [], []
    chart, repair = Grammar._chart, Grammar._repair
    monkeypatch.setattr(Grammar, "_chart", lambda self, name, *a: charts.append(name) or chart(self, name, *a))
    monkeypatch.setattr(Grammar, "_repair", lambda self, *a: repairs.append(a) or repair(self, *a))
    other = "package p\n" + "def f(a): return a if b else c\n" * 6
    assert syntax.inspect(other, "go")[0] == 4 and not repairs
    # Arguments of each call are parsed, the call around them once.
    text = "f(a)\n" + "".join(f"f({'a, ' * n}b, c{'.d' * n})\n" for n in range(1, 30))
    assert syntax.inspect(text, "python")[0] == 0 and charts.count("stmt") <= 2
