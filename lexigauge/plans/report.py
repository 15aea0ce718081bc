"""A report of an evaluation as one static HTML file, and a summary as text."""

from __future__ import annotations

import math
from html import escape
from pathlib import Path

from ..operators.stability import SLACK

COLOURS = {1: "#2a7f62", 2: "#6fb08f", 3: "#cfe3c8", 4: "#f2d8a7", 5: "#e59a6f", 6: "#c8553d"}
GREY = "#999999"


def _table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str('inf' if isinstance(r[c], float) and math.isinf(r[c]) else '' if r[c] is None else r[c]))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def curve_svg(curve: list[dict], levels: list[str], width: int = 640, height: int = 320) -> str:
    """Curves of the models over the levels on a logarithmic axis; rates are drawn from 1e-6 on."""
    values = [max(r[level], 1e-6) for r in curve for level in levels]
    if not values:
        return "<svg></svg>"
    high = math.ceil(math.log10(max(values)))
    low = min(math.floor(math.log10(min(values))), high - 1)
    x = lambda k: 60 + k * (width - 90) / max(1, len(levels) - 1)
    y = lambda v: 20 + (high - math.log10(max(v, 1e-6))) * (height - 60) / (high - low)
    marks = "".join(f'<text x="8" y="{y(10.0**e):.1f}">1e{e}</text><line x1="60" x2="{width - 30}" y1="{y(10.0**e):.1f}" y2="{y(10.0**e):.1f}" stroke="#ddd"/>' for e in range(low, high + 1))
    names = "".join(f'<text x="{x(k):.1f}" y="{height - 12}">{level}</text>' for k, level in enumerate(levels))
    lines = "".join(
        f'<polyline fill="none" stroke="{list(COLOURS.values())[n % len(COLOURS)]}" points="{" ".join(f"{x(k):.1f},{y(r[level]):.1f}" for k, level in enumerate(levels))}"><title>{escape(r["model"])}</title></polyline>'
        for n, r in enumerate(curve)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{marks}{names}{lines}</svg>'


def rank_table(ranks: list[dict]) -> str:
    """The rank matrix, a row per group and a column per model."""
    models, cells = sorted({r["model"] for r in ranks}), {(r["seg_mode"], r["level"], r["model"]): r["rank"] for r in ranks}
    rows = "".join(
        f"<tr><td>{s}/{v}</td>" + "".join(f'<td style="background:{COLOURS.get(cells.get((s, v, m)), GREY)}">{cells.get((s, v, m), "")}</td>' for m in models) + "</tr>" for s, v in sorted({(r["seg_mode"], r["level"]) for r in ranks})
    )
    return "<table><tr><th></th>" + "".join(f"<th>{escape(m)}</th>" for m in models) + f"</tr>{rows}</table>"


def tied_text(scores: list[dict], seg: str, level: str, most: int = 3) -> list[str]:
    own = sorted((r for r in scores if r["seg_mode"] == seg and r["level"] == level), key=lambda r: r["model"])
    pairs = [f"{a['model']} / {b['model']}" for i, a in enumerate(own) for b in own[i + 1 :] if a["ci_lo"] <= b["ci_hi"] + SLACK and b["ci_lo"] <= a["ci_hi"] + SLACK]
    return pairs[:most]


def build(result: dict, path: str) -> str:
    """Write the report of ``evaluate.run``'s result; returns its HTML."""
    meta, moved = result["meta"], [r for r in result["stability"] if r["rank_shift"] > 0]
    ties = tied_text(result["scores"], meta["ref_group"]["seg_mode"], meta["ref_group"]["level"])
    worst = result["stability"][0] if result["stability"] else None
    parts = [
        f"<h1>Ranking stability</h1><p>{meta['n_samples']} samples, {meta['n_models']} models, {meta['n_groups']} groups; {meta['bootstrap_n']} resamples, seed {meta['bootstrap_seed']}; sources: {escape(', '.join(meta['data_sources']))}.</p>",
        f"<p>{len(moved)} of {meta['n_models']} models change rank" + (f"; most: {escape(worst['model'])}, by {worst['rank_shift']}" if worst else "") + f". Overlapping intervals in the reference group: {escape('; '.join(ties) or 'none')}.</p>",
        "<h2>Stability</h2>" + _table(result["stability"], list(result["stability"][0]) if result["stability"] else []),
        "<h2>Verdicts</h2>" + _table(result["verdicts"], list(result["verdicts"][0]) if result["verdicts"] else []),
        "<h2>Error rate by level</h2>" + curve_svg(result["curve"], meta["levels"]),
        "<h2>Ranks</h2>" + rank_table(result["ranks"]),
        "<p>Ranks hold for these samples and rules only.</p>",
    ]
    html = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Ranking stability</title><style>body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px}</style></head><body>' + "\n".join(parts) + "</body></html>\n"
    Path(path).write_text(html, encoding="utf-8", newline="\n")
    return html


def summary(result: dict) -> str:
    """Reference order, stability and verdict counts as plain text."""
    meta = result["meta"]
    ref = [r for r in result["scores"] if (r["seg_mode"], r["level"]) == (meta["ref_group"]["seg_mode"], meta["ref_group"]["level"])]
    lines = [f"{r['model']:<24} {r['cer_fixed']:.6f} [{r['ci_lo']:.6f}, {r['ci_hi']:.6f}]" for r in sorted(ref, key=lambda r: (r["cer_fixed"], r["model"]))]
    lines += [f"{r['model']:<24} ranks {r['rank_min']}-{r['rank_max']}, {r['verdict']}" for r in result["stability"]]
    lines.append(f"{sum(r['verdict'] == 'STABLE' for r in result['verdicts'])} of {len(result['verdicts'])} neighbouring pairs are stable")
    return "\n".join(lines)
