"""Figures of a run, drawn from their data where matplotlib is installed. The data are small: bins, cohorts, sampled pairs."""

from __future__ import annotations

import importlib.util
import math
from collections import defaultdict


def available() -> bool:
    return importlib.util.find_spec("matplotlib") is not None


def _histogram(axes, rows: list[dict]) -> None:
    rows = sorted(rows, key=lambda r: r["lower"])
    width = min((b["lower"] - a["lower"] for a, b in zip(rows, rows[1:])), default=1.0)
    axes.bar([r["lower"] for r in rows], [r["n"] for r in rows], width=width, align="edge", log=True)
    axes.set(title="PageRank distribution", xlabel="PageRank", ylabel="Pages")


def _top(axes, rows: list[dict]) -> None:
    axes.barh([r["title"] for r in rows], [r["pagerank"] for r in rows])
    axes.set(title="Highest PageRank", xlabel="PageRank")


def _means(axes, rows: list[dict]) -> None:
    rows = sorted(rows, key=lambda r: r["group_name"])
    axes.barh([r["group_name"] for r in rows], [r["mean_similarity"] for r in rows])
    axes.set(title="Mean similarity by group", xlabel="Jaccard similarity")


def _boxes(axes, rows: list[dict]) -> None:
    rows = sorted(rows, key=lambda r: r["group_name"])
    axes.bxp([{"label": r["group_name"], "q1": r["q1"], "med": r["median"], "q3": r["q3"], "whislo": r["whisker_low"], "whishi": r["whisker_high"]} for r in rows], showfliers=False)
    axes.set(title="Similarity by group", ylabel="Jaccard similarity")


def _line(axes, rows: list[dict]) -> None:
    rows = sorted(rows, key=lambda r: r["bin_idx"])
    axes.plot([r["percentile_bin"] for r in rows], [r["mean_similarity"] for r in rows], marker="o")
    axes.set(title="Similarity by PageRank percentile", ylabel="Mean Jaccard similarity")


def _scatter(axes, rows: list[dict]) -> None:
    by = defaultdict(list)
    for r in rows:
        by[r["group_name"]].append((r["jaccard_exact"], r["jaccard_minhash"], 4 + 4 * math.log(r["n"])))
    for name, points in sorted(by.items()):
        x, y, sizes = zip(*points)
        axes.scatter(x, y, s=sizes, label=name)
    axes.set(title="MinHash against exact similarity", xlabel="Exact", ylabel="MinHash")


DRAW = {"pagerank_histogram": _histogram, "top20_pagerank": _top, "mean_similarity": _means, "similarity_box": _boxes, "percentile_similarity": _line, "exact_vs_minhash": _scatter}


def draw(name: str, rows: list[dict], path: str) -> bool:
    """Draws a figure to a file; without rows it is left out."""
    if not rows:
        return False
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots(figsize=(9, 6))
    DRAW[name](axes, rows)
    figure.tight_layout()
    figure.savefig(path, dpi=150)
    pyplot.close(figure)
    return True
