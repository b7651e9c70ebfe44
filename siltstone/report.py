"""Reports for people and programs: collected results of few rows, as text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Row

from siltstone.operators.evaluate import COMPARED, RECALL_GAP

NOTHING = "No results found."


def results(rows: list[Row]) -> str:
    """Ranked results of one query."""
    if not rows:
        return NOTHING
    parts = []
    for r in sorted(rows, key=lambda r: r["rank"]):
        name = f"   name: {r['name']}\n" if r["name"] else ""
        parts.append(f"{r['rank']}. score {r['score']:.4f}\n   {r['repo']}/{r['file_path']} ({r['language']}), lines {r['start_line']}-{r['end_line']}\n{name}\n{r['content']}\n")
    return "\n".join(parts)


def evaluation(report: dict) -> str:
    """A run for people: means, times, types, answers, a line if recall grows much from 5 to 10 results, and what failed."""
    total = report["aggregate"]
    show = lambda v, n: "n/a" if v is None or not n else f"{v:.3f}"
    lines = [f"run {report['run_id']}, dataset {report['dataset']}, collection {report['collection']}", f"mode {report['mode']}, limit {report['limit']}, embedder {report['embedder']}"]
    lines.append(f"queries {total['queries']}, positive {total['positive']}, negative {total['negative']}, errors {total['errors']}")
    lines += [f"{c:<14}{show(total[c], total['positive'])}" for c in ("hit_1", "hit_3", "hit_5", "mrr_5", "recall_5", "recall_10")]
    lines.append(f"{'negative pass':<14}{show(total['negative_pass_rate'], total['negative'])}")
    lines += [f"{name:<14}p50 {total[f'{name}_p50_ms'] or 0} ms, p95 {total[f'{name}_p95_ms'] or 0} ms" for name in ("total", "embed", "search")]
    gap = round(total["recall_10"] - total["recall_5"], 6)
    if total["positive"] and gap >= RECALL_GAP:
        lines.append(f"recall gap {gap:.3f}: expected files are found, but ranked below the fifth place")
    for kind, r in sorted(report["by_type"].items()):
        value = show(r["negative_pass_rate"], r["queries"]) if kind == "negative" else show(r["hit_5"], r["positive"])
        lines.append(f"  {kind:<12}{r['queries']:>4} queries, {'pass' if kind == 'negative' else 'hit_5'} {value}")
    if said := report.get("answer"):
        lines.append(f"answers by {said['generator']}: {said['generated']} made, {said['errors']} errors, {said['dangling']} with dangling citations")
        lines += [f"  {c:<18}{show(said[c], said[c] is not None)}" for c in ("well_formed_rate", "cited_rate", "all_valid_rate", "refusal_rate")]
        lines.append(f"  generate p50 {said['p50_ms'] or 0} ms, p95 {said['p95_ms'] or 0} ms")
    failures = [f"  {q['query_id']} ({q['query_type']}): {q['error'] or 'a negative query found something' if q['error'] or q['query_type'] == 'negative' else 'nothing expected among the first five'}" for q in report["queries"] if q["error"] or (not q["negative_pass"] if q["query_type"] == "negative" else not q["hit_5"])]
    return "\n".join(lines + (["failures:", *failures] if failures else []))


def comparison(rows: list[Row], labels: list[str]) -> str:
    """Reports side by side: what they are, a table of eleven columns, and changes against the first in percentage points."""
    rows = sorted(rows, key=lambda r: r["position"])
    head = ["run", *[c.replace("hit_5", "h@5").replace("hit_", "h@").replace("mrr_", "mrr@").replace("recall_", "rcl@").replace("_", " ") for c in COMPARED], "p50/p95 ms"]
    table = [head, ["-" * len(h) for h in head]] + [[label, *[f"{r[c]:.3f}" for c in COMPARED], f"{r['p50_ms']}/{r['p95_ms']}"] for label, r in zip(labels, rows)]
    wide = [max(len(x[i]) for x in table) for i in range(len(head))]
    lines = ["reports:", *[f"  {label}: run={r['run_id']}  mode={r['mode']}  dataset={r['dataset']}" for label, r in zip(labels, rows)], ""]
    lines += ["  ".join(c.ljust(w) for c, w in zip(x, wide)).rstrip() for x in table]
    if len(rows) > 1:
        lines += ["", f"changes against {labels[0]}, in percentage points:"]
        lines += [f"  {c:<18}" + "  ".join(f"{label}: {r[f'{c}_delta']:+.1f}" for label, r in zip(labels[1:], rows[1:])) for c in COMPARED]
    return "\n".join(lines)


def slim(value: object) -> object:
    """Without the entries of dictionaries that are null, empty, 0 or false; rates that are measured stay."""
    if isinstance(value, dict):
        return {k: s for k, v in value.items() if not ((s := slim(v)) is None or isinstance(s, (str, list, dict, int)) and not s)}
    return [slim(v) for v in value] if isinstance(value, list) else value


def as_json(value: object) -> str:
    """JSON with two spaces of indentation, slim."""
    return json.dumps(slim(value), indent=2, ensure_ascii=False, default=str)
