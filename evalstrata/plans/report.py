"""Reports of runs and comparisons as Markdown, HTML and JSON. They are made of aggregates on the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from ..errors import ConfigError
from ..functions.flags import FLAGS
from ..functions.formatting import difference, value
from .comparison import Comparison

FORMATS = ("md", "json", "html")


def table(head: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return [line(head), "|" + "---|" * len(head), *map(line, rows), ""]


def run_markdown(summary: list[dict], counts: dict, latency: dict, flags: dict[str, int], task: str, manifest: dict | None = None, asr: dict | None = None) -> str:
    """A scored run: what it is, metrics under both views, latency, flags, speech errors."""
    who = manifest or {}
    out = ["# Evaluation report", "", f"Task {task}; {counts['n_total']} examples: {counts['n_ok']} answered, {counts['n_failed']} failed, {counts['n_missing']} missing.", f"Model {who.get('model') or 'not stated'}, backend {who.get('backend') or 'not stated'}.", "", "## Metrics", ""]
    out += table(["metric", "view", "mean", "pooled", "n"], [[s["metric"], s["view"].replace("_", "-"), value(s["metric"], s["mean"]), value(s["metric"], s["corpus"]), s["n"]] for s in summary])
    if latency.get("mean") is not None:
        out += ["## Latency", "", ", ".join(f"{k} {latency[k]:.0f} ms" for k in ("mean", "p50", "p95", "max")) + ".", ""]
    if flags:
        out += ["## Flags", "", *table(["flag", "answers", "meaning"], [[f, flags[f], FLAGS[f]] for f in FLAGS if flags.get(f)])]
    if asr:
        n = asr["hits"] + asr["substitutions"] + asr["deletions"]
        errors = asr["substitutions"] + asr["deletions"] + asr["insertions"]
        rate = f"{errors / n:.1%}" if n else "-"
        out += ["## Word errors", "", f"{asr['hits']} words right, {asr['substitutions']} substituted ({asr['tone_only_substitutions']} in tone marks only), {asr['deletions']} dropped, {asr['insertions']} inserted; pooled rate {rate}.", ""]
    return "\n".join(out).rstrip() + "\n"


def interval(row: dict, name: str) -> str:
    return "-" if row["low"] is None else f"{difference(name, row['low'])} to {difference(name, row['high'])}"


def comparison_markdown(c: Comparison) -> str:
    """Both runs, overall metrics, regressions, slices and how it was done."""
    out = ["# Comparison report", "", f"Task {c.task}, {c.n_total} examples. Delta is candidate minus base.", ""]
    out += table(["run", "failed", "missing", "flagged"], [[k, r["n_failed"], r["n_missing"], r["n_flagged"]] for k, r in (("base", c.base), ("candidate", c.candidate))])
    out += ["## Overall", ""]
    tested = [m for m in c.metrics if m["n"]]
    out += table(
        ["metric", "view", "base", "candidate", "delta", "95% interval", "verdict", "wins / ties / losses", "McNemar p"],
        [[m["name"], m["view"].replace("_", "-"), value(m["name"], m["base_mean"]), value(m["name"], m["candidate_mean"]), difference(m["name"], m["delta"]), interval(m, m["name"]), m["verdict"], f"{m['wins']} / {m['ties']} / {m['losses']}", f"{m['mcnemar']['p_value']:.3g}" if m["mcnemar"] else "-"] for m in tested],
    )
    pooled = [m for m in c.metrics if m["base_corpus"] is not None or m["candidate_corpus"] is not None]
    if pooled:
        out += ["Pooled over the corpus, without interval:", "", *table(["metric", "view", "base", "candidate"], [[m["name"], m["view"].replace("_", "-"), value(m["name"], m["base_corpus"]), value(m["name"], m["candidate_corpus"])] for m in pooled])]
    lost = c.regressions()
    out += ["## Regressions", "", *([f"- {r.get('key') or r['field'] + ' = ' + r['value']}" for r in lost] or ["None."]), ""]
    if c.flags:
        out += ["## Flags", "", *table(["flag", "base", "candidate", "change"], [[f["name"], f["base"], f["candidate"], f"{f['delta']:+d}"] for f in c.flags])]
    if c.slices:
        name = c.primary.split("@")[0]
        out += [f"## Slices of {c.primary}", "", *table(["field", "value", "n", "base", "candidate", "delta", "95% interval", "status"], [[s["field"], s["value"], s["n"], value(name, s["base_mean"]), value(name, s["candidate_mean"]), difference(name, s["delta"]), interval(s, name), s["status"]] for s in c.slices])]
    s = c.settings
    out += ["## Method", "", f"Paired bootstrap of examples, {s['n_boot']} draws, seed {s['seed']}. A change is judged only if its whole interval is on one side of zero, a slice only from {s['min_slice_n']} examples on. Slices are not corrected for their number."]
    return "\n".join(out).rstrip() + "\n"


def bars(c: Comparison) -> str:
    """Intervals of the tested metrics as a small drawing."""
    rows = [m for m in c.metrics if m["low"] is not None]
    if not rows:
        return ""
    out, width, middle = [], 640, 400
    for k, m in enumerate(rows):
        most = max(abs(m["low"]), abs(m["high"])) or 1.0
        x = lambda v: middle + 200 * v / most  # noqa: E731, B023
        y = 20 + 24 * k
        out.append(f'<text x="4" y="{y + 4}">{html.escape(m["key"])}</text><line x1="{x(m["low"]):.1f}" x2="{x(m["high"]):.1f}" y1="{y}" y2="{y}" stroke="#345" stroke-width="3"/><circle cx="{x(m["delta"]):.1f}" cy="{y}" r="4" fill="#345"/>')
    height = 30 + 24 * len(rows)
    return f'<svg viewBox="0 0 {width} {height}" role="img"><line x1="{middle}" x2="{middle}" y1="0" y2="{height}" stroke="#999"/>{"".join(out)}</svg>'


def to_html(markdown: str, title: str, drawing: str = "") -> str:
    """A page of the few Markdown forms used here, everything escaped."""
    out, rows = [], []

    def flush() -> None:
        if rows:
            head, *body = [r for r in rows if not set(r) <= {"---"}]
            cells = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(c)}</{t}>" for c in r) + "</tr>"
            out.append("<table>" + cells(head, "th") + "".join(cells(r, "td") for r in body) + "</table>")
            rows.clear()

    for line in markdown.splitlines():
        if line.startswith("|"):
            rows.append([c.strip().replace("\\|", "|") for c in line.strip("|").replace("\\|", "\0").split("|")])
            rows[-1] = [c.replace("\0", "|") for c in rows[-1]]
            continue
        flush()
        if line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            out.append(f"<h{level}>{html.escape(line.lstrip('# '))}</h{level}>" + (drawing if line == "## Overall" else ""))
        elif line.strip():
            out.append(f"<p>{html.escape(line)}</p>")
    flush()
    style = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}svg{max-width:40em;font-size:12px}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body>{"".join(out)}</body></html>\n'


def write(folder: str, name: str, markdown: str, data: dict | str, formats: tuple[str, ...] = FORMATS, drawing: str = "") -> list[str]:
    """Writes a report in the formats asked for; a file appears whole or not at all."""
    if bad := sorted({*formats} - {*FORMATS}):
        raise ConfigError(f"Unknown format {bad[0]!r}.", f"Use: {', '.join(FORMATS)}.")
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    made = []
    for f in formats:
        body = markdown if f == "md" else to_html(markdown, name, drawing) if f == "html" else data if isinstance(data, str) else json.dumps(data, indent=2, ensure_ascii=False) + "\n"
        path = where / f"{name}.{f}"
        draft = path.with_suffix(path.suffix + ".part")
        draft.write_text(body, encoding="utf-8")
        draft.replace(path)
        made.append(str(path))
    return made


def card(name: str, description: str, base_model: str, languages: list[str], training_data: str, comparison: dict | None = None, licence: str | None = None, suffix: str | None = None) -> tuple[str, list[str]]:
    """A model card and what to mend before it is published. `suffix` is what a base licence asks names to carry."""
    if suffix and suffix.lower() not in name.lower():
        title, problems = f"{name} - {suffix}", [f"The name does not include {suffix!r}."]
    else:
        title, problems = name, []
    if not languages:
        problems.append("No languages are given.")
    if not training_data.strip():
        problems.append("training_data is empty; say where the data is from.")
    front = ["---", f"base_model: {base_model}", *([f"license: {licence}"] if licence else []), *(["language:", *(f"- {x}" for x in languages)] if languages else []), "---", ""]
    out = [*front, f"# {title}", "", description.strip(), "", "## Training data", "", training_data.strip() or "Not stated.", "", "## Evaluation", ""]
    if comparison is None:
        problems.append("No evaluation results are given.")
        out += ["None recorded.", ""]
    else:
        rows = [m for m in comparison["metrics"] if m["n"]]
        out += table(["metric", "base", "tuned", "verdict"], [[m["key"], value(m["name"], m["base_mean"]), value(m["name"], m["candidate_mean"]), m["verdict"]] for m in rows])
        lost = [r for r in (*comparison["metrics"], *comparison["slices"]) if r.get("verdict", r.get("status")) == "regressed"]
        if lost:
            problems.append(f"The comparison shows {len(lost)} regression(s).")
            out += ["Worse than the base: " + ", ".join(r.get("key") or f"{r['field']} = {r['value']}" for r in lost) + ".", ""]
    return "\n".join(out).rstrip() + "\n", problems
