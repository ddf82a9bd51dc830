"""Small aggregates as text."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.summaries import downsampled

#: A report is read by people: more rows than this are refused.
MOST_ROWS = 500


def short(v) -> str:
    """A number for a label: four significant digits, exponents outside 0.001 to 100,000."""
    if v is None:
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    if v and not 1e-3 <= abs(v) < 1e5:
        return f"{v:.1e}"
    return f"{v:,}" if isinstance(v, int) else f"{v:.4g}" if abs(v) < 1000 else f"{v:,.0f}"


def markdown(df: DataFrame, title: str, order: list[str]) -> str:
    """`df` as a Markdown table, sorted. Over MOST_ROWS rows raise: aggregate first."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")

    def line(cells) -> str:
        return "| " + " | ".join(short(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"

    return "\n".join([f"## {title}", "", line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows), ""])


#: Points of a line on a page, and lines of a page, at most.
MOST_POINTS, MOST_LINES = 600, 60
WIDTH, HEIGHT, LEFT, LOW = 480, 160, 60, 22


def curve_points(log: DataFrame, run: str, step: str, metrics: list[str], most: int = MOST_POINTS) -> DataFrame:
    """(run, metric, step, value): every s-th row of each run's metric and always its last one,
    so that a page of them is small and ends where the log ends. Rows without the metric, or
    with one that is no finite number, are not there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = log.select(F.col(run).alias("run"), F.col(step).alias("step"), pairs.alias("p")).select("run", "p.metric", "step", "p.value")
    finite = long.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return downsampled(finite, ["run", "metric"], ["step", "value"], most)


def curve_page(log: DataFrame, title: str, run: str, step: str, panels: dict[str, list[str]], most: int = MOST_POINTS) -> str:
    """A page (HTML, nothing loaded from elsewhere) with a panel of curves for each of `panels`
    ({title: metrics of one unit}) and run. Panels stand in the given order; a metric that was
    never logged leaves an empty panel. Only thinned points come to the driver; more than
    MOST_LINES lines raise."""
    names = list(dict.fromkeys(m for ms in panels.values() for m in ms))
    points = curve_points(log, run, step, names, most)
    runs = [r["run"] for r in log.select(F.col(run).alias("run")).distinct().orderBy("run").limit(MOST_LINES + 1).collect()]
    if len(runs) * len(names) > MOST_LINES:
        raise ValueError(f"a page has at most {MOST_LINES} lines, this one had {len(runs)} runs or more of {len(names)} metrics")
    lines: dict = {}
    for p in points.orderBy("run", "metric", "step", "value").collect():
        lines.setdefault((p["run"], p["metric"]), []).append((float(p["step"]), p["value"]))
    body = []
    for r in runs:
        body.append(f"<h2>{html.escape(str(r))}</h2>")
        body += [_panel(t, [(m, lines.get((r, m), [])) for m in ms]) for t, ms in panels.items()]
    style = "body{font:14px sans-serif;margin:24px}figure{display:inline-block;margin:8px}svg{background:#f6f6f6}.l0{stroke:#205080}.l1{stroke:#b05010}.l2{stroke:#207040}polyline{fill:none;stroke-width:1.5}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(body)}</body></html>'


def _panel(title: str, series: list[tuple[str, list[tuple[float, float]]]]) -> str:
    """One figure: lines over common axes, the bounds at the axes, the last values below."""
    every = [p for _, points in series for p in points]
    if not every:
        return f"<figure><figcaption>{html.escape(title)}</figcaption><p>no data</p></figure>"
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*every))
    place = lambda x, y: f"{LEFT + (x - x0) / ((x1 - x0) or 1) * (WIDTH - LEFT):.1f},{(y1 - y) / ((y1 - y0) or 1) * (HEIGHT - LOW):.1f}"
    drawn = "".join(f'<polyline class="l{n % 3}" points="{" ".join(place(*p) for p in points)}"/>' for n, (_, points) in enumerate(series) if points)
    marks = [(0, 12, short(y1)), (0, HEIGHT - LOW, short(y0)), (LEFT, HEIGHT - 4, short(x0)), (WIDTH - 48, HEIGHT - 4, short(x1))]
    told = "".join(f'<text x="{x}" y="{y}">{t}</text>' for x, y, t in marks)
    last = ", ".join(f"{html.escape(m)} {short(points[-1][1])}" for m, points in series if points)
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg width="{WIDTH}" height="{HEIGHT}">{drawn}{told}</svg><p>last: {last}</p></figure>'


def write_page(spark, page: str, path: str) -> None:
    """The page as one file below `path`, which all executors share."""
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
