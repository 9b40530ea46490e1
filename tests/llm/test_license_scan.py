import random
import re
import textwrap

from tidemark.llm.license_scan import TEMPLATES, scan, template_bigrams


def test_templates_lines_and_odd_rows(spark):
    mit = TEMPLATES["MIT grant"]
    rows = [
        (1, None), (2, ""), (3, "word"), (4, "\n\n"),
        (5, "Some text here.\nRELEASED under the MIT license!\nMore."),
        (6, mit.replace(" and to permit", "\nand to permit")),
        (7, "Released under the MIT License. " * 3),
        (8, "licensed " * 50_000),
        (9, "A text on licences: the MIT people license much."),
        (None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _units string, N_matches int")
    got = scan(df)
    assert got.columns == ["doc_id", "text", "_units", "licenses", "n_matches", "best_dice"]
    had = {r.doc_id: (r.licenses, r.n_matches, r.best_dice) for r in got.collect()}
    nothing = ("", 0, None)
    g = set(template_bigrams("Released under the MIT License. " * 3))
    t = set(template_bigrams(TEMPLATES["MIT notice"]))
    assert {k: had[k] for k in (1, 2, 3, 4, 8, 9)} == dict.fromkeys((1, 2, 3, 4, 8, 9), nothing)
    assert had[5] == ("MIT notice", 1, 1.0)
    assert had[6] == ("MIT grant", 2, 1.0)  # its first line, and the whole
    assert had[7] == ("MIT notice", 1, round(2 * len(g & t) / (len(g) + len(t)), 6))
    assert had[None] == ("CC-BY-NC-4.0 notice", 3, 1.0)  # both lines, and the whole
    assert scan(df.limit(0)).count() == 0


def test_notices_across_and_within_lines(spark):
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(60))
    header = lambda k: "\n".join("# " + x for x in textwrap.wrap(TEMPLATES[k], 76)) + "\n\n" + code
    mit = "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + textwrap.fill(TEMPLATES["MIT grant"], 76)
    mit += "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
    mit += 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n'
    mit += "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."
    rows = {k: (header(k), k) for k in ("Apache-2.0 header", "GPL-3.0 header", "MPL-2.0 header", "MIT grant", "BSD grant", "ISC grant", "Unlicense dedication")}
    rows["mit"] = (mit, "MIT grant")
    rows["mid"] = (f"{code} We wrote this tool over a long year of work. Released under the MIT License. Ask us in the forum for more about it.", "MIT notice")
    rows["none"] = ("of the software and the license under the terms of " * 2_000 + code, "")
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id string, text string")
    had = {r.doc_id: r for r in scan(df).collect()}
    for k, (_, name) in rows.items():
        assert name in had[k].licenses.split("; "), k
    assert had["none"].best_dice is None and had["mid"].best_dice == 1.0 and had["mid"].n_matches == 1
    assert all(had[k].best_dice == 1.0 for k in rows if k != "none")


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    sources = [TEMPLATES[k].split() for k in ("MIT notice", "CC-BY-NC-4.0 notice", "GPL-3.0 notice", "MPL-2.0 header")]
    texts = []
    for _ in range(50):
        w = [x for x in rng.choice(sources) if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["the", "license", "foo", "under"]))
        around = [" ".join(rng.choice(["bar", "the", "under", "License"]) for _ in range(30)) for _ in range(2)]
        texts.append(around[0] + " " + "".join(x + rng.choice([" ", "\n// "]) for x in w) + around[1])
    grams = {k: set(template_bigrams(v)) for k, v in TEMPLATES.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    had = {r.doc_id: (r.licenses, r.n_matches, r.best_dice) for r in scan(df).collect()}

    def bigrams(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    some = 0
    for i, text in enumerate(texts):
        p, hits = bigrams(text), []
        for k, t in sorted(grams.items()):
            dice = lambda g, t=t: round(2 * len(set(g) & t) / (len(set(g)) + len(t)), 6)
            own = [d for u in [*text.split("\n"), *([text] if "\n" in text else [])] if (d := dice(bigrams(u))) >= 0.8]
            if not own:
                best = max(dice(p[a:b]) for a in range(len(p)) for b in range(a + 1, min(len(p), a + int(1.5 * len(t) + 1e-9)) + 1))
                own = [best] if best >= 0.8 else []
                some += len(own)
            hits += [(k, d) for d in own]
        assert had[i] == ("; ".join(sorted({k for k, _ in hits})), len(hits), max((d for _, d in hits), default=None)), text
    assert some > 8
