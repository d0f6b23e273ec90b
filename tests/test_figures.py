"""Figures, against a stand-in for the drawing library's axes."""

from linkrank.plans import figures


class Axes:
    def __init__(self):
        self.calls = {}

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.setdefault(name, (a, k))


def test_every_figure_draws():
    rows = {
        "pagerank_histogram": [{"bin": 1, "lower": 0.5, "n": 2}, {"bin": 0, "lower": 0.0, "n": 9}],
        "top20_pagerank": [{"title": "a", "pagerank": 0.1}],
        "mean_similarity": [{"group_name": "g", "mean_similarity": 0.1}],
        "similarity_box": [{"group_name": "g", "q1": 1, "median": 2, "q3": 3, "whisker_low": 0, "whisker_high": 4}],
        "percentile_similarity": [{"bin_idx": 1, "percentile_bin": "10-20%", "mean_similarity": 0.2}, {"bin_idx": 0, "percentile_bin": "0-10%", "mean_similarity": 0.1}],
        "exact_vs_minhash": [{"group_name": "g", "jaccard_exact": 0.1, "jaccard_minhash": 0.2, "n": 3}],
    }
    assert set(rows) == set(figures.DRAW)
    for name, data in rows.items():
        axes = Axes()
        figures.DRAW[name](axes, data)
        assert "set" in axes.calls and len(axes.calls) >= 2
    axes = Axes()
    figures.DRAW["percentile_similarity"](axes, rows["percentile_similarity"])
    assert axes.calls["plot"][0][1] == [0.1, 0.2]
    assert not figures.draw("mean_similarity", [], "nowhere")
