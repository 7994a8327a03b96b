"""Writers: caches, checkpoints, reports and ledgers, and reports as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.metrics import VERDICTS


def append_cache(entries: DataFrame, path: str) -> None:
    """New cache entries, one write for the whole batch; failed calls aren't passed in, so never cached."""
    entries.write.mode("append").json(path)


def append_checkpoint(done: DataFrame, path: str) -> None:
    """Records of finished rows; a later run leaves out the keys it finds here."""
    done.write.mode("append").json(path)


def save_report(report: DataFrame, folder: str, run: str) -> str:
    """A report's rows as JSON lines in the run's own folder, replacing an earlier one of the same run."""
    path = f"{folder.rstrip('/')}/run_id={run}"
    report.write.mode("overwrite").json(path)
    return path


def save_ledgers(ledgers: DataFrame, folder: str, name: str = "name") -> str:
    """Ledgers as (name, ledger) JSON lines, spread over folders by the first two characters of the name, all in one job."""
    rest = [c for c in ledgers.columns if c != name]
    rows = ledgers.select(F.substring(name, 1, 2).alias("part"), F.col(name).alias("name"), F.to_json(F.struct(*rest)).alias("ledger"))
    rows.write.mode("append").partitionBy("part").json(folder)
    return folder


def confusion_table(confusion: DataFrame) -> DataFrame:
    """(gold, CONSISTENT, CONTRADICTORY, INSUFFICIENT_EVIDENCE): counts as a table, for a heat map."""
    return confusion.groupBy("gold").pivot("predicted", list(VERDICTS)).agg(F.sum("n")).na.fill(0, list(VERDICTS))


def plot_bars(rows: Sequence[tuple[str, float]], path: str, title: str = "") -> bool:
    """Bars of (name, value) as a picture, where a plotting library is installed; says whether one was."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    figure, axes = pyplot.subplots()
    axes.bar([r[0] for r in rows], [r[1] for r in rows])
    axes.set_title(title)
    figure.savefig(path)
    pyplot.close(figure)
    return True


def plot_table(names: Sequence[str], values: Sequence[Sequence[float]], path: str, title: str = "") -> bool:
    """A heat map of a square table, where a plotting library is installed; says whether one was."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    figure, axes = pyplot.subplots()
    axes.imshow(values)
    axes.set_xticks(range(len(names)), names)
    axes.set_yticks(range(len(names)), names)
    axes.set_title(title)
    figure.savefig(path)
    pyplot.close(figure)
    return True


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """Rows as a Markdown table; bars within values are escaped, nulls are a dash, floats have four places."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda values: "| " + " | ".join(show(v) for v in values) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *map(line, rows)])


def render_report(title: str, facts: Mapping[str, Any], sections: Mapping[str, DataFrame], most: int = 1_000) -> str:
    """A report as Markdown: facts as a list, then a table per section of at most ``most`` rows, with a note where there are more. Reports are aggregates; this is the one place that brings them to the driver."""
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for name, frame in sections.items():
        rows = frame.limit(most + 1).collect()
        out += ["", f"## {name}", "", markdown_table(frame.columns, rows[:most])]
        out += ["", f"More than {most} rows; the rest is left out here."] if len(rows) > most else []
    return "\n".join(out) + "\n"


def print_summary(title: str, facts: Mapping[str, Any]) -> str:
    """The facts as aligned lines, printed and given back."""
    width = max(map(len, facts), default=0)
    text = "\n".join([title, *[f"{k.ljust(width)}  {v}" for k, v in facts.items()]])
    print(text)
    return text
