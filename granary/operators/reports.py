"""Reports from collected results, which are small: tables in Markdown and HTML, charts as SVG."""

from __future__ import annotations

from html import escape


def _cells(rows: list) -> tuple[list[str], list[list[str]]]:
    """Headings, and cells as text; a boolean `ok` reads PASS or FAIL."""
    names = list(rows[0].keys() if isinstance(rows[0], dict) else rows[0].asDict()) if rows else []
    said = lambda n, v: ("PASS" if v else "FAIL") if n == "ok" else "" if v is None else str(v)
    return names, [[said(n, r[n]) for n in names] for r in rows]


def _passed(rows: list) -> str:
    return f"{sum(bool(r['ok']) for r in rows)} of {len(rows)} passed" if rows and "ok" in _cells(rows)[0] else f"{len(rows)} rows"


def markdown(title: str, rows: list) -> str:
    names, cells = _cells(rows)
    line = lambda c: "| " + " | ".join(x.replace("|", "\\|") for x in c) + " |"
    return "\n".join([f"# {title}", "", _passed(rows), "", line(names), line(["---"] * len(names)), *map(line, cells), ""])


def html(title: str, rows: list, charts: tuple[str, ...] = ()) -> str:
    """A page of its own, with a table and charts."""
    names, cells = _cells(rows)
    row = lambda tag, c: "<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in c) + "</tr>"
    table = "<table>" + row("th", names) + "".join(row("td", c) for c in cells) + "</table>" if names else ""
    style = "body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left;border-bottom:1px solid #ddd}"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{style}</style><h1>{escape(title)}</h1><p>{_passed(rows)}</p>{''.join(charts)}{table}"


def bars(title: str, values: list[tuple[str, float | None]], width: int = 640, height: int = 220) -> str:
    """A bar a value from zero up or down; a value that is missing leaves its place empty."""
    known = [v for _, v in values if v is not None]
    low, high = min([0.0, *known]), max([0.0, *known])
    scale, step = (height - 40) / ((high - low) or 1.0), width / max(len(values), 1)
    out = [f'<text x="0" y="14">{escape(title)}</text>']
    for k, (name, v) in enumerate(values):
        out.append(f'<text x="{(k + 0.5) * step:.1f}" y="{height - 4}" font-size="9" text-anchor="middle">{escape(name)}</text>')
        if v is not None:
            top = 20 + (high - max(v, 0.0)) * scale
            out.append(
                f'<rect x="{k * step + 1:.1f}" y="{top:.1f}" width="{max(step - 2, 1):.1f}" height="{abs(v) * scale:.1f}" fill="#4477aa"><title>{escape(name)}: {v:,.2f}</title></rect>'
            )
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" xmlns="http://www.w3.org/2000/svg">{"".join(out)}</svg>'


def grid(title: str, columns: list[str], rows: list[tuple[str, list[float | None]]], cell: int = 44) -> str:
    """A heat map of percentages: a row a name, a cell a column, the darker the higher."""
    out = [
        f'<text x="0" y="14">{escape(title)}</text>',
        *(f'<text x="{90 + (k + 0.5) * cell:.0f}" y="32" font-size="10" text-anchor="middle">{escape(c)}</text>' for k, c in enumerate(columns))
    ]
    for r, (name, values) in enumerate(rows):
        y = 40 + r * 22
        out.append(f'<text x="0" y="{y + 14}" font-size="10">{escape(name)}</text>')
        for k, v in enumerate(values):
            if v is not None:
                out.append(
                    f'<rect x="{90 + k * cell}" y="{y}" width="{cell - 2}" height="20" fill="#4477aa" fill-opacity="{max(v, 4) / 100:.2f}"/><text x="{90 + (k + 0.5) * cell:.0f}" y="{y + 14}" font-size="10" text-anchor="middle">{v:.0f}</text>'
                )
    return f'<svg viewBox="0 0 {90 + len(columns) * cell} {40 + 22 * len(rows)}" width="{90 + len(columns) * cell}" xmlns="http://www.w3.org/2000/svg">{"".join(out)}</svg>'
