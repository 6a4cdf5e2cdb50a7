import re

from pyspark.sql import functions as F

from promptveil.llm import licenses
from promptveil.llm.queries import op3_licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(own)] == own]
        places += hits
        labels |= {label} if hits else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def check(rows, got):
    want = sorted(((d, *plain_base(t)) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got), key=repr) == want
    for r in got:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_table(spark, folder, documents):
    check([(d, t) for d, t, _, _ in documents], op3_licenses(spark, folder).collect())


ROWS = [(1, None), (2, ""), (3, "--- !"), (4, "CC BY"), (5, "cc-by cc.BY cc by by cc"), (6, "GNU General Public License, version 3. "
        "All rights\nreserved (all RIGHTS reserved)"), (7, "ccc by"), (8, "Kc by cc byé cc\x7fby"), (9, "Licensed under the MIT License."),
        (9, "Licensed under the MIT License."), (None, "general public license"), (10, "x " * 200000 + "cc by " * 3000),
        (11, "Licensed under the Apache License, Version 2.0. Licensed under the GNU Lesser General Public License v2.1"),
        (12, "SPDX-License-Identifier: BSD-3-Clause"), (13, "Licensed under CC BY-NC 4.0."), (14, "the new bsd license")]


def test_odd_rows(spark):
    df = (spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("words", F.lit("a"))
          .withColumn("mark", F.lit(1)).withColumn("rule", F.lit(2)))
    got = licenses.scan_licenses(df).collect()
    check(ROWS, got)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[9] == "mit" and labels[12] == "bsd-3" and labels[13] == "cc-by,cc-by-nc" and labels[14] == "bsd-3"
    assert labels[11] == "apache,gpl,lgpl"  # gpl by its base phrase; its rule lies inside that of lgpl
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_suppression_against_plain_python(spark):
    rows = [(d, t) for d, t in ROWS if d != 10] + [(20, " and ".join(t for _, t in ROWS if t and len(t) < 300) * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["label"], r["start"], r["end"], r["priority"]) for r in licenses.detections(df).collect()}
    want = set()
    for doc, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        line = "".join(f" {w} " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
        if not any(g.replace(" ", "  ") in line for g in licenses.GATES):
            continue
        found = [(line[:m.start()].count(" ") // 2, line[:m.end()].count(" ") // 2, priority, n, label)
                 for n, (label, keyword, expr, priority, _) in enumerate(licenses.rules()) if keyword in line
                 for m in re.finditer(licenses.spaced(expr), line)]
        found.sort(key=lambda f: (f[0], -f[1], f[2], f[3]))
        for i, f in enumerate(found):
            if not any(e[1] >= f[1] and e[2] <= f[2] for e in found[:i]):
                want.add((doc, f[4], f[0], f[1], f[2]))
    assert got == want and len(want) > 20
    assert len(licenses.rules()) > 200


def alternatives(expr):
    """Some texts that an expression over words matches: each of the words it offers at every place, once."""
    import re._parser as parser

    def made(tree):
        outs = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name == "IN":
                parts = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
            elif name == "SUBPATTERN":
                parts = made(arg[3])
            elif name == "BRANCH":
                parts = [p for branch in arg[1] for p in made(branch)]
            else:
                assert name == "MAX_REPEAT", name
                parts = ([""] if arg[0] == 0 else []) + made(arg[2])
            outs = [o + p for o in outs for p in parts]
        return outs

    return made(parser.parse(expr))


def test_every_rule_by_itself_passes_the_prefilter():
    for label, keyword, expr, _, _ in licenses.rules():
        for text in alternatives(expr):
            line = "".join(f" {w} " for w in text.split())
            assert re.search(licenses.spaced(expr), line), (expr, text)
            assert keyword in line and any(g.replace(" ", "  ") in line for g in licenses.GATES), (label, text)


def test_short_forms_without_other_words(spark):
    rows = [(1, "Released under the GPL v2", "gpl", 0.9), (2, "distributed under the MIT", "mit", 0.9),
            (3, "see https://mozilla.org/MPL/2.0/", "mpl", 0.95), (4, "wtfpl.net", "wtfpl", 0.95), (5, "BSD-3-Clause", "bsd-3", 0.7),
            (6, "WTF Public License", "wtfpl", 0.9), (7, "CC0 license", "cc0", 0.9), (8, "released into the wild", "", 0.0),
            (9, "provided as is without", "no-warranty", 0.3), (10, "permission to use, copy, modify and distribute", "permissive", 0.9)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    for d, _, label, score in rows:
        assert label in got[d][0].split(",") and got[d][1] == score, (d, got[d])
