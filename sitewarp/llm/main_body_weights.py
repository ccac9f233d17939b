"""Weights of the classifiers of ``main_body``, as printed by ``fit_main_body``."""

# fitted on 1500 pages; of 12631 held-out lines the line classifier alone labels 603 otherwise, the cut 0
LINE_WEIGHTS: dict[str, float] = {
    "bias": -0.23,
    "byline": -5.73,
    "comment": -3.25,
    "cookie": -0.05,
    "date": -5.1,
    "end": -0.28,
    "ends": 4.22,
    "legal": -0.2,
    "letters": -0.07,
    "listed": -0.38,
    "middle": 0.33,
    "phone": -0.05,
    "promotion": -0.02,
    "related": -0.5,
    "scripts": 4.61,
    "share": -6.05,
    "skip": -0.05,
    "tag:dt": 0.85,
    "tag:h1": 1.19,
    "tag:h2": 0.96,
    "tag:h3": -0.39,
    "tag:li": 0.8,
    "tag:link": -1.25,
    "tag:p": -2.65,
    "tag:pre": 0.26,
    "titled": 5.46,
    "top": -0.28,
    "trail": -0.08,
    "w1": -0.44,
    "w13": -1.46,
    "w3": 0.09,
    "w31": 1.09,
    "w7": 0.49,
}

CONTAINER_WEIGHTS: dict[str, float] = {
    "beside": -5.04,
    "bias": -2.43,
    "bulk": 3.38,
    "headline": 4.06,
    "links": -0.89,
    "no headline": -2.91,
    "no headline scripts": 1.46,
    "prose": 0.91,
    "role:aside": -0.43,
    "role:footer": -0.41,
    "role:main": -1.0,
    "role:nav": -0.26,
}
