import random

import numpy as np

from tidemark.llm import license_scan as L


def test_accuracy_on_variations_of_the_templates():
    rows = L.labelled_rows(copies=6, seed=99)
    model = L.train()
    named = [(f, L.judge(model, t, 0.5, 0.6)) for f, t, _ in rows if f != L.UNKNOWN]
    assert sum(f in [x for x, _, _ in j] for f, j in named) / len(named) > 0.75
    assert sum(any(x != f for x, _, _ in j) for f, j in named) / len(named) < 0.03
    others = [L.judge(model, t, 0.5, 0.6) for f, t, _ in rows if f == L.UNKNOWN]
    assert sum(map(bool, others)) / len(others) < 0.01


def test_short_names_and_several_licences():
    model = L.train()
    found = lambda t: [f for f, _, _ in L.judge(model, t, 0.5, 0.6)]
    for text, want in [("License: MIT", ["mit"]), ("ISC License", ["isc"]), ("Eclipse Public License 2.0 applies to this", ["epl"]), ("Licensed under the zlib license", ["zlib"]), ("GNU Affero General Public License v3", ["agpl"]),
                       ("MIT License or the Apache License", ["apache", "mit"]), ("Dual licensed under the Apache License, Version 2.0 or the MIT License.", ["apache", "mit"])]:
        assert found(text) == want, text
    for text in ("The MIT campus lies on the river.", "He studied at MIT and worked there", "You can redistribute the chairs", "", "!"):
        assert found(text) == []
    gap = " ".join(f"w{i}" for i in range(200))
    assert found(f"Released under the MIT License. {gap} This work is licensed under the GNU General Public License, version 3. {gap}") == ["gpl", "mit"]


def test_judgement_equals_brute_force():
    """The same sums over dense vectors, with closeness from lists of pairs."""
    model = L.train()
    rng = random.Random(3)
    words = sorted(model.seeds)[:200] + ["lorem", "ipsum"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(150)] + [t for ts in L.TEMPLATES.values() for t in ts]
    for text in texts:
        w = L.tokens(text)
        if len(w) > 30 or L.PARTS_AT.search(text):
            continue
        x = np.zeros(len(model.place) + 1)
        x[-1] = 1
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = " ".join("0" if y[0].isdigit() else y for y in w[i : i + n])
                if g in model.place:
                    x[model.place[g]] = 1
        z = x @ model.w.astype(float) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(np.argmax(p[:-1]))
        family = model.families[best]
        pairs = [(a, b) for a, b in zip(w, w[1:])]
        close = max(max(len({q for q in L.pairs_of(L.tokens(t)) if q in pairs}) / len(set(L.pairs_of(L.tokens(t)))), len({q for q in pairs if q in L.pairs_of(L.tokens(t))}) / len(set(pairs)) if len(set(pairs)) >= 6 else 0) for t in L.TEMPLATES[family])
        want = [family] if p[best] >= 0.5 and p[best] > p[-1] and close >= 0.6 else []
        assert [f for f, _, _ in L.judge(model, text, 0.5, 0.6)] == want, text


def test_query(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choice("the of and there in was thble ononing reed".split()) for _ in range(300))
    rows = [(1, prose + "\nReleased under the MIT License.\n" + prose), (2, "All rights reserved."), (3, prose), (4, None), (5, "\n \n"), (None, "Licensed under CC BY-NC 4.0."), (6, prose + " Licensed under the Apache License, Version 2.0. " + prose), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "She has a license to drive and all rights of way.")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, family string")
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in L.scan(df).collect()), key=str)
    assert got == sorted([(1, 1, "mit"), (2, 0, "proprietary"), (None, 0, "cc"), (6, 0, "apache"), (6, 0, "gpl")], key=str)
    assert L.scan(df.limit(0)).collect() == []
