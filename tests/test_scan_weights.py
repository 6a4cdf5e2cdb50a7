"""Counting with signatures whose patterns or ids repeat, beyond what a plan holds."""

from promptveil.operators import scan


def test_equal_patterns_are_joined_once_and_all_counted(spark, monkeypatch):
    monkeypatch.setattr(scan, "read_dictionary", lambda signatures: None)
    patterns = [(n, "abcde") for n in range(50)]  # many ids, one pattern
    patterns += [(3, "abcde"), (60, "ABCDE"), (None, "abcde"), (None, "lone5"), (None, "other")]
    patterns += [(70, "fghij"), (70, "klmno"), (70, "klmno"), (71, "fghij")]  # an id with two patterns
    patterns += [(80, "x y"), (81, "x y"), (82, "a signature beyond the window"), (83, "a signature beyond the window"), (84, "")]
    signatures = spark.createDataFrame([(i, p, f"n{k}") for k, (i, p) in enumerate(patterns)],
                                       "sig_id int, pattern string, name string")
    bodies = [(0, "xABCDEx abcde"), (1, "fghij klmno"), (1, "fghijabcde"), (2, "lone5 other"), (3, "nothing"), (4, None),
              (None, "abcde"), (5, "x y, a Signature beyond the window")]
    rows = spark.createDataFrame(bodies, "doc_id long, text string")

    want: dict[int, set] = {}
    for key, text in bodies:
        for sig, pattern in patterns:
            if key is not None and text is not None and pattern and pattern.lower() in text.lower():
                want.setdefault(key, set()).add(sig)
    counted = scan.hit_counts(rows, signatures, "doc_id")
    assert counted.schema["n_hits"].dataType.simpleString() == "bigint"
    assert {r["doc_id"]: r["n_hits"] for r in counted.collect()} == {k: len(v - {None}) for k, v in want.items()}
    # one row for each pattern, but for the two of the id that has two
    assert scan.weighed(signatures).count() == 7 + 1
    assert sum(r["name"] for r in scan.weighed(signatures).where("pattern = 'abcde'").collect()) == 51
