"""Fits the classifiers of ``main_body`` and prints their weights.

    python -m sitewarp.llm.fit_main_body /path/to/tables [pages]

Lines are labelled from a bounded sample of pages (``pages``, 2000 by default, those with the least hash of
their id): a line is main body if its DOM container holds the page's headline and its wording is not that of a
byline, date, share prompt, comment or other furniture; on pages without headline, if it asks for scripts. A container is
what most of its lines are. The line classifier is fitted beside the smoothness of its container's label, as the cut uses it.
A quarter of the sample is held out: lines that the line classifier alone and that the cut label otherwise are printed.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from sitewarp.llm import main_body, main_body_weights
from sitewarp.session import local_session, table

FURNITURE = {"cookie", "share", "letters", "byline", "date", "trail", "legal", "phone", "skip", "related", "comment", "promotion"}


def labelled(title, text, html):
    """(lines, places, features, labels) of a page; a line outside of the DOM has no label."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    places = main_body.placed(lines, html)
    features = main_body.line_features(title, lines, places)
    home = {p[0] for p in places if p and p[1] == "h1"}

    def label(place, f):
        if place is None:
            return None
        heading = place[1] in ("h1", "h2", "h3") and place[0] in home
        return (place[0] in home if home else "scripts" in f) and (heading or not FURNITURE & set(f))

    return lines, places, features, [label(p, f) for p, f in zip(places, features, strict=True)]


#: Pages that only ask for scripts are rare; their lines and containers count this often.
RARE = 20


def fit(rows: list[tuple[list[str], bool, float]], rounds: int = 2500, ridge: float = 1e-4) -> dict[str, float]:
    """Logistic weights of named features for (features, label, log-odds given already)."""
    names = sorted({k for f, _, _ in rows for k in f})
    at = {k: i for i, k in enumerate(names)}
    x, y, given = np.zeros((len(rows), len(names)), dtype=np.float32), *(np.array([r[k] for r in rows], dtype=np.float32) for k in (1, 2))
    for i, (f, _, _) in enumerate(rows):
        x[i, [at[k] for k in f]] = 1
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w + given)))
        g = x.T @ (p - y) / len(y) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {k: round(float(w[i]), 2) for k, i in at.items()}


def examples(pages):
    """Rows to fit lines and containers on."""
    by_line, by_container = [], []
    for title, text, html in pages:
        lines, places, features, truth = labelled(title, text, html)
        side = {}
        for members, f in main_body.container_features(lines, places, features):
            most = 2 * sum(bool(truth[i]) for i in members) > len(members)
            side |= dict.fromkeys(members, most)
            by_container += [(f, most, 0.0)] * (RARE if "no headline scripts" in f else 1)
        for i, (f, y) in enumerate(zip(features, truth, strict=True)):
            if y is not None:
                by_line += [(f, y, main_body.CONTAINER if side[i] else -main_body.CONTAINER)] * (RARE if "scripts" in f and y else 1)
    return by_line, by_container


def main(folder: str, pages: int = 2000) -> None:
    spark = local_session()
    page, raw = table(spark, folder, "page"), table(spark, folder, "page_raw")
    ids = page.select("page_id").orderBy(F.xxhash64("page_id")).limit(pages)
    sample = main_body.pages_with_html(page.join(F.broadcast(ids), "page_id", "left_semi"), raw, ["title", "text"]).collect()
    sample.sort(key=lambda r: hash((r.page_id * 2654435761) % 2**32))
    sample = [(r.title, r.text, r.html) for r in sample]
    edge = len(sample) * 3 // 4
    by_line, by_container = examples(sample[:edge])
    weights = {"LINE_WEIGHTS": fit(by_line), "CONTAINER_WEIGHTS": fit(by_container)}
    for name, w in weights.items():
        getattr(main_body_weights, name).clear()
        getattr(main_body_weights, name).update(w)
    wrong, n = {True: 0, False: 0}, 0
    for title, text, html in sample[edge:]:
        lines, _, _, truth = labelled(title, text, html)
        n += sum(y is not None for y in truth)
        for cut in wrong:
            wrong[cut] += sum(y is not None and y != z for y, z in zip(truth, main_body.labels(title, lines, html, cut), strict=True))
    print(f"# fitted on {edge} pages; of {n} held-out lines the line classifier alone labels {wrong[False]} otherwise, the cut {wrong[True]}")
    for name, w in weights.items():
        print(f"{name}: dict[str, float] = {{")
        for k, x in w.items():
            print(f'    "{k}": {x},')
        print("}")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
