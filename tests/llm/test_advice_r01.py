
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import licence_scan, mixing, secret_scan


def licences(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = [set() for _ in texts]
    for found in licence_scan._scan_batches(iter([batch])):
        for r in found.to_pylist():
            out[r["doc_id"]].add(r["licence"])
    return out


LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice",
    "Licensed under CC BY 4.0.": "cc-by-4.0-notice",
    "licensed under a CC-BY-SA-3.0 licence": "cc-by-sa-3.0-notice",
    "CC BY-ND 2.5": "cc-by-nd-2.5-notice",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0-notice",
    "Licensed under CC BY-NC-ND v3.0": "cc-by-nc-nd-3.0-notice",
    "Licensed under CC BY-NC 9.9": "cc-by-nc-notice",
    "Licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0-notice",
    "Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0-notice",
    "Licensed under a Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0-notice",
    "Released into the world, CC0 1.0 Universal": "cc0-1.0-notice",
    "This work is licensed under the GNU General Public License version 3": "gpl-3.0-notice",
    "This work is licensed under the GNU General Public License version 2.": "gpl-2.0-notice",
    "Licensed under the GNU Affero General Public License v3": "agpl-3.0-notice",
    "Licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1-notice",
    "Licensed under the GNU General Public License.": "gpl-notice",
    "Licensed under the Apache License, Version 2.0": "apache-2.0-notice",
    "Licensed under the Apache License, Version 1.1": "apache-1.1-notice",
    "Licensed under the Mozilla Public License 2.0": "mpl-2.0-notice",
    "Released under the MIT License": "mit-notice",
    "Distributed under the BSD 3-Clause License": "bsd-3-clause-notice",
}


def test_licence_lines_against_brute_force():
    fill = "lorem ipsum dolor sit amet. "
    got = licences([f"{fill}{line} {fill}" for line in LINES])
    assert dict(zip(LINES, got)) == {line: {name} for line, name in LINES.items()}
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", t.lower())) + " "
    notices = {(name, plain(" ".join(c))) for name, c in licence_scan.TEMPLATES if name.endswith("-notice") and len(plain(" ".join(c)).split()) > 2}
    for line, name in LINES.items():
        # of the notices that are there word by word, the longest is the find
        inside = [(len(t.split()), n) for n, t in notices if t in plain(line)]
        assert {n for size, n in inside if size == max(inside)[0]} == {name}
    assert licences([fill, "licensed under nothing", "cc by itself", None]) == [set()] * 4


PUBLISHED = sorted((Path(licence_scan.__file__).parent / "licences").glob("*.txt"))


@pytest.mark.parametrize("path", PUBLISHED, ids=lambda p: p.stem)
def test_published_licence_texts_are_found(path):
    text = path.read_text()
    got = licences([f"Copyright (c) 2020 Jane Doe\n\n{text}\nint main() {{}}", text.replace("\n", " "), " ".join(text.split()[: len(text.split()) // 3])])
    # the texts of GNU and others quote headers of their own, beside the text itself
    full = {n for n in got[0] if not n.endswith("-notice")}
    assert path.stem in full and got[0] == got[1]
    if path.stem.endswith("-text"):
        assert {n for n in full if n.endswith("-text")} == {path.stem} and path.stem not in got[2]
    else:
        assert {n.split("-")[0] for n in full} == {path.stem.split("-")[0]}


def test_mit_licence_without_its_disclaimer_and_gnu_headers():
    mit = (PUBLISHED[0].parent / "mit.txt").read_text()
    gpl = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    kinds = {"gpl-2.0": ("program", "General Public", "2"), "gpl-3.0": ("program", "General Public", "3"), "lgpl-2.1": ("library", "Lesser General Public", "2.1"), "agpl-3.0": ("program", "Affero General Public", "3")}
    got = licences([mit.split("THE SOFTWARE IS")[0], *(gpl.format(*x) for x in kinds.values())])
    assert got[0] == {"mit"} and [{n for n in g if not n.endswith("-notice")} for g in got[1:]] == [{k} for k in kinds]


def least_squares(t, p, targets, bound, steps=20_000):
    """The least weighted residual that rates within the bound can have, by accelerated projected gradient steps."""
    metric = np.linalg.inv((p * t[:, None]).T @ p)
    rate, ahead, k = np.ones(len(t)), np.ones(len(t)), 1.0
    for _ in range(steps):
        new, k_new = np.clip(ahead - p @ (metric @ (p.T @ (t * ahead) - targets)), 0, bound), (1 + np.sqrt(1 + 4 * k * k)) / 2
        rate, ahead, k = new, new + (k - 1) / k_new * (new - rate), k_new
    return lambda q: (p.T @ (t * q) - targets) @ metric @ (p.T @ (t * q) - targets) / targets.sum(), rate


@pytest.mark.parametrize(("alpha", "bound"), [([5, 2, 1], None), ([0.4, 0.3, 0.3], None), ([5, 2, 1], 1.0), ([0.05, 0.03, 0.03], 1.0), ([20, 0.5, 0.5], 1.0), ([0.4, 0.3, 0.3], 2.0), ([5, 2, 1], 2.0)])
def test_rates_are_fitted_to_the_end(spark, alpha, bound):
    r = np.random.default_rng(7)
    p, t = r.dirichlet(alpha, 300) + 1e-12, r.integers(1, 500, 300).astype(float)
    p /= p.sum(1, keepdims=True)
    table = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "__tokens long, __p array<double>")
    plan = mixing.fit_rates(table, mixing.Classifier(object(), np.array([True] * 3)), mixing.WEIGHTS, most_rate=bound)
    rate = np.array([x.r for x in table.select(plan.rate().alias("r")).collect()])
    residual, exact = least_squares(t, p, np.array(plan.targets), bound)
    assert rate.min() >= 0 and rate.max() <= (bound or np.inf) and p.T @ (t * rate) == pytest.approx(plan.expected, rel=1e-6)
    assert residual(rate) <= residual(exact) + 1e-8
    if residual(exact) < 1e-10:
        # met, and by no farther from one than any other rates that meet the targets
        assert np.array(plan.expected) / sum(plan.expected) == pytest.approx([0.9, 0.05, 0.05], abs=1e-4)
        assert (t * (rate - 1) ** 2).sum() <= (t * (exact - 1) ** 2).sum() * (1 + 1e-4)
    else:
        # the expected tokens are the same for all that have the least residual; so are nearly all rates
        assert p.T @ (t * exact) == pytest.approx(plan.expected, rel=1e-3) and np.abs(rate - exact).max() < 0.05


def test_a_fit_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PASSES", 1)
    table = spark.createDataFrame([(5, [0.7, 0.2, 0.1]), (9, [0.1, 0.8, 0.1]), (7, [0.2, 0.2, 0.6])], "__tokens long, __p array<double>")
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(table, mixing.Classifier(object(), np.array([True] * 3)), mixing.WEIGHTS, most_rate=1.0)


LONG = "a1B2c3D4" * 100


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        (f'token = "{LONG}"', LONG),
        (f"secret: '{LONG}'", LONG),
        ("api_key=abcdefghijkl1234", "abcdefghijkl1234"),
        ("password: hunter2hunter2hunter2\nnext: x", "hunter2hunter2hunter2"),
        ("export SECRET_KEY=" + LONG + "\n", LONG),
        ('secret_key = "0123456789abcdef"', "0123456789abcdef"),
        ('api-key: "0123456789abcdef"', "0123456789abcdef"),
        ('"secret_access_key": "0123456789abcdef"', "0123456789abcdef"),
        ('password = "correcthorsebatterystaple"', "correcthorsebatterystaple"),
        ("xoxb-" + LONG, "xoxb-" + LONG),
        ("sk_live_" + LONG, "sk_live_" + LONG),
    ],
    ids=lambda x: x[:24],
)
def test_secrets_of_any_length_and_without_quotes(text, secret):
    assert [f.secret for f in secret_scan.scan_text(f"so {text} end")] == [secret]


def test_prose_and_code_are_no_secrets():
    for text in ("password: internationalization", "token = function_of_something(x1)", "the secret is 0123456789abcdef", "token = short1", "token = sha256_of_all_the_words(x1)", 'token = "no closing 0123456789abcdef', "api_key = os.environ['KEY_NUMBER_1234567']"):
        assert secret_scan.scan_text(text) == []
