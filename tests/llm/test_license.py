import random
import re
from pathlib import Path

import pytest

from eigenweave.llm import license

from .helpers import clashing, documents, no_python, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = WORD.findall(lower(text))
    places = [(i, label) for p, label in license.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in places)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({b for _, b in places}))


def brute_labels(text):
    """(labels, score) by trying every template at every place."""
    w = WORD.findall(lower(text))
    split = [t.split() for _, t, _ in license.TEMPLATES]
    often = {x: sum(x in t for t in split) for t in split for x in t}
    labels, best = set(brute(text)[4].split(",")) - {""}, 0.5 if brute(text)[1] else 0.0
    found = False
    for (label, _, keys), t in zip(license.TEMPLATES, split, strict=True):
        rare = sorted(range(len(t)), key=lambda p: (often[t[p]], p))[: license.RAREST]
        for at in range(-len(t), len(w)):
            hits = sum(0 <= at + p < len(w) and w[at + p] == t[p] for p in rare)
            own = " " + " ".join(w[max(at, 0) : max(at + len(t), 0)]) + " "
            if hits >= license.AGREE * len(rare) and all(f" {k} " in own for k in keys):
                labels.add(label)
                best, found = max(best if found else 0.0, hits / len(rare)), True
    return ",".join(sorted(labels)), best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = ["cc by", "CC-BY", "cc\nby 4.0", "general public license", "All Rights Reserved", "all rights", "general PUBLIC", "license", "éall rights reserved", "cc by-sa 4.0", "public license", "by", "İcc by", "𝒜 cc by", "all  rights...reserved"]
    out = [None, "", " \n", "...", "CC BY", "all rights reserved" + " all rights reserved" * 3, prose(rng, 60_000) + " general public license"]
    out += [" ".join(rng.choice([*bits, prose(rng, 2)]) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    return [*out, out[-1], out[-1]]


def test_base_against_brute_force(spark, texts):
    d = license.scan(clashing(documents(spark, list(enumerate(texts)))))
    assert no_python(d)
    got = {r["doc_id"]: r for r in d.collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t[:200]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_templates_are_found(spark):
    rng = random.Random(1)
    rows = [(k, f"{prose(rng, 40)}. {template.upper()}; {prose(rng, 30)}") for k, (_, template, _) in enumerate(license.TEMPLATES)]
    for r in license.scan(documents(spark, rows)).collect():
        assert license.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1.0


def test_verification(spark):
    rng = random.Random(2)
    gnu = "this work is licensed under the gnu general public license version"
    rows = [(1, f"{gnu} 3"), (2, f"{gnu} 2"), (3, "apache was here; the license of version two is under licensed"), (4, "released under the " + prose(rng, 3) + " mit license"), (5, prose(rng, 500))]
    got = {r["doc_id"]: r["labels"].split(",") for r in license.scan(documents(spark, rows)).collect()}
    assert "gpl-3.0" in got[1] and "gpl-2.0" not in got[1] and "gpl-2.0" in got[2] and "gpl-3.0" not in got[2]
    assert got[3] == [""] and got[5] == [""] and "mit" not in got[4]


def test_labels_against_brute_force(spark):
    rng = random.Random(12)
    bits = [t for _, t, _ in license.TEMPLATES]

    def bent(t):
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [] if rng.random() < 0.3 else [rng.choice([prose(rng, 1), rng.choice(rng.choice(bits).split())])]
        return " ".join(w)

    rows = [(k, " ".join(rng.choice([bent(rng.choice(bits)), prose(rng, 4), "cc by", " ".join(rng.choice(bits).split()[:5])]) for _ in range(rng.randint(1, 7)))) for k in range(150)]
    rows += [(900, ". ".join(bits)), (901, " ".join(bits[0].split()[2:])), (902, None), (903, "version 3 " + bits[6] + " needs python version 3")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(documents(spark, rows)).collect()}
    for k, t in rows:
        assert got[k] == brute_labels(t), t
    assert set(got[900][0].split(",")) >= {n for n, _, _ in license.TEMPLATES}
    assert "gpl-3.0" not in got[903][0]


def test_templates_are_found_among_all_licence_words(spark):
    words = sorted(license.build_index()[0])
    random.Random(3).shuffle(words)
    around = " kalo ".join(words)
    rows = [(k, f"{around} kalo. {template}. Kalo {around}") for k, (_, template, _) in enumerate(license.TEMPLATES)]
    for r in license.scan(documents(spark, rows)).collect():
        label = license.TEMPLATES[r["doc_id"]][0]
        assert label in r["labels"].split(",") and r["score"] == 1.0
        assert (r["labels"], r["score"]) == brute_labels(rows[r["doc_id"]][1])


def test_query_against_brute_force(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = license.op2_license_scan(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert (r["labels"], r["score"]) == brute_labels(texts[r["doc_id"]])


def test_empty_and_null_ids(spark):
    assert license.scan(documents(spark, []).limit(0)).count() == 0
    assert license.scan(documents(spark, [(None, "cc by"), (None, "cc by")])).count() == 2
