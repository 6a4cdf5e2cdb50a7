"""License scan with ordered signature rules, in DataFrame functions only.

A text becomes its words (ASCII letters in lower case, digits, all of non-ASCII; everything else separates), each with
a space before and after, so that two spaces lie between words and matches of neighbours share no character. The base
phrases are counted and placed in it. Then the rules run:

1. prefilter: a rule runs only on texts that hold its keyword, and none on texts without one of ``GATES``. Every match of
   a rule holds its keyword and a gate, so both lose nothing;
2. a rule's regular expression is matched over the words; every match is an interval of words;
3. suppression: intervals are visited by start, longer first, then by priority; one that lies inside an interval of the
   same or a better priority is dropped. One running end per priority tells that, in one sorted pass over the
   intervals of a text.

The rules come from a table of licenses and, per license, forms (name with version, grant, identifier line, address).
The label of a kept interval is its rule's. ``score`` is the confidence of the best kept interval, or of a base phrase.

A null text is empty: no words, no labels (empty strings), score 0, no places. Base labels stay whatever the rules say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptveil.session import written

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.5

#: Licenses: label, keyword, name as words (an expression over words one space apart), versions allowed after it,
#: short form, host words of its address.
LICENSES = (
    ("apache", "apache", "apache(?: software)?", "1 0|1 1|2 0|2", "apache", "apache org licenses"),
    ("mit", "mit", "mit(?: expat)?", "", "mit", "opensource org licenses mit"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)", "", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", "", "bsd 3 clause",
     "opensource org licenses bsd 3 clause"),
    ("bsd", "bsd", "bsd", "", "bsd", "opensource org licenses bsd license"),
    ("gpl", "general", "(?:gnu )?general public", "1|2|3|1 0|2 0|3 0", "gpl", "gnu org licenses gpl"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "2|2 1|3|3 0", "lgpl", "gnu org licenses lgpl"),
    ("lgpl-library", "library", "(?:gnu )?library general public", "2|2 0", "lgpl 2 0", "gnu org licenses old licenses lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public", "1|3|3 0", "agpl", "gnu org licenses agpl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "1 1|1 2|1 3", "gfdl", "gnu org licenses fdl"),
    ("mpl", "mozilla", "mozilla public", "1 0|1 1|2 0", "mpl", "mozilla org mpl"),
    ("epl", "eclipse", "eclipse public", "1 0|2 0", "epl", "eclipse org legal epl"),
    ("edl", "eclipse", "eclipse distribution", "1 0", "edl", "eclipse org org documents edl"),
    ("cddl", "common", "common development and distribution", "1 0|1 1", "cddl", "opensource org licenses cddl"),
    ("cpl", "common", "common public", "0 5|1 0", "cpl", "opensource org licenses cpl"),
    ("artistic", "artistic", "(?:perl )?artistic", "1 0|2 0", "artistic", "opensource org licenses artistic"),
    ("isc", "isc", "isc", "", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "unlicense", "", "unlicense", "unlicense org"),
    ("wtfpl", "wtf", "wtf public|wtfpl", "2", "wtfpl", "wtfpl net"),
    ("boost", "boost", "boost software", "1 0", "bsl 1 0", "boost org license"),
    ("eupl", "european", "european union public", "1 1|1 2", "eupl", "joinup ec europa eu"),
    ("cecill", "cecill", "cecill(?: free software)?", "1 0|2 0|2 1", "cecill", "cecill info"),
    ("osl", "open", "open software", "1 0|2 0|2 1|3 0", "osl", "opensource org licenses osl"),
    ("afl", "academic", "academic free", "1 1|1 2|2 0|2 1|3 0", "afl", "opensource org licenses afl"),
    ("ms-pl", "microsoft", "microsoft public", "", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "", "ms rl", "opensource org licenses ms rl"),
    ("python", "python", "python(?: software foundation)?", "2|2 0", "psf", "python org psf license"),
    ("php", "php", "php", "3 0|3 01", "php", "php net license"),
    ("ofl", "font", "sil open font|open font", "1 0|1 1", "ofl", "scripts sil org ofl"),
    ("odbl", "database", "open database", "1 0", "odbl", "opendatacommons org licenses odbl"),
    ("pddl", "dedication", "public domain dedication and", "1 0", "pddl", "opendatacommons org licenses pddl"),
    ("odc-by", "commons", "open data commons attribution", "1 0", "odc by", "opendatacommons org licenses by"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)",
     "2 0|2 5|3 0|4 0", "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike", "2 0|2 5|3 0|4 0",
     "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", "2 0|2 5|3 0|4 0", "cc by nc",
     "creativecommons org licenses by nc"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:s|atives|ative works)", "2 0|2 5|3 0|4 0",
     "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", "2 0|2 5|3 0|4 0", "cc by sa",
     "creativecommons org licenses by sa"),
    ("cc-by", "creative", "creative commons attribution", "2 0|2 5|3 0|4 0", "cc by", "creativecommons org licenses by"),
    ("cc0", "c", "creative commons zero|cc zero|cc0", "1 0", "cc0", "creativecommons org publicdomain zero"),
    ("postgresql", "postgresql", "postgresql", "", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl", "", "openssl", "openssl org source license"),
    ("curl", "curl", "curl", "", "curl", "curl se docs copyright"),
    ("ncsa", "ncsa", "university of illinois ncsa|ncsa", "", "ncsa", "opensource org licenses ncsa"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)?", "", "w3c", "w3 org consortium legal"),
    ("x11", "x11", "x11", "", "x11", "x org"),
    ("vim", "vim", "vim", "", "vim", "vimhelp org"),
    ("ruby", "ruby", "ruby", "", "ruby", "ruby lang org en about license"),
    ("sspl", "server", "server side public", "1", "sspl", "mongodb com licensing server side public license"),
    ("busl", "business", "business source", "1 0|1 1", "busl", "mariadb com bsl11"),
    ("elastic", "elastic", "elastic", "1 0|2 0", "elastic", "elastic co licensing elastic license"),
    ("openrail", "rail", "(?:creativeml )?open ?rail(?: m)?", "", "openrail", "licenses ai"),
)
#: Rules of their own: label, keyword, expression, priority, confidence.
NOTICES = (
    ("reserved", "reserved", "(?:all|some|no) rights(?: are)? reserved", 2, 0.6),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 3, 0.4),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 2, 0.8),
    ("public-domain", "domain", "public domain (?:work|mark|notice)", 2, 0.7),
    ("proprietary", "proprietary", "proprietary and confidential", 2, 0.8),
    ("permissive", "charge", "permission is hereby granted free of charge", 2, 0.9),
    ("permissive", "permission", "permission to use copy modify (?:and or |and )?distribute", 2, 0.9),
    ("permissive", "redistribution", "redistribution and use in source and binary forms", 2, 0.9),
    ("no-warranty", "warrant", "without warranty of any kind", 3, 0.3),
    ("no-warranty", "provided", "provided as is without", 3, 0.3),
)
def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression over words one space apart, priority from 1, confidence), in order."""
    made = []
    for label, keyword, name, versions, short, host in LICENSES:
        version = f"(?: (?:version |v ?)?(?:{versions}))?" if versions else ""
        made += [
            (label, "spdx", f"spdx license identifier {short}(?: [0-9]+)*(?: (?:only|or later))?", 1, 1.0),
            (label, host.split()[0], f"{host}(?: [0-9]+)*", 1, 0.95),
            (label, keyword, "(?:licensed|released|distributed|published|available|covered) under (?:the )?(?:terms of the )?"
             f"(?:{name}) licen[cs]e{version}", 1, 1.0),
            (label, keyword, f"(?:{name}) licen[cs]e{version}", 2, 0.9),
            (label, short.split()[0], f"(?:licensed|released|distributed) under (?:the )?{short}(?: [0-9]+)*", 2, 0.9),
        ]
        if " " in short:
            made.append((label, short.split()[0], f"{short}(?: [0-9]+)*", 3, 0.7))
    return made + list(NOTICES)


def _gates() -> tuple[str, ...]:
    """Parts of words of which every match of every rule holds one; none holds another."""
    held = {"licen", "released under", "distributed under", "spdx"}
    for _, _, _, _, short, host in LICENSES:
        held |= {host} | ({short} if " " in short else set())
    held |= {"rights reserved", "rights are reserved", "copyright", "the public domain", "public domain work",
             "public domain mark", "public domain notice", "proprietary and confidential", "permission is hereby granted",
             "permission to use copy modify", "redistribution and use in source", "without warranty of any kind",
             "provided as is without"}
    return tuple(sorted(g for g in held if not any(h != g and h in g for h in held)))


#: What one of must stand in a text (as one of its words' parts) for any rule to run: implied by the rules.
GATES = _gates()


def spaced(expression: str) -> str:
    """An expression over words one space apart, made to match words with a space on each side."""
    return " " + expression.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + " "


def words_of(text: Column) -> Column:
    """`` a  b  c ``: words with a space on each side, case as it was; empty for no words."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++", "  ")
    trimmed = F.trim(inner)
    return F.when(trimmed == "", F.lit("")).otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def n_words(words: Column) -> Column:
    """Number of words of a spaced string: half its spaces."""
    return F.floor((F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _ascii_lower(words: Column) -> Column:
    return F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _base(words: Column, total: Column) -> dict[str, Column]:
    """Counts, first and last place, labels of the base phrases."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        own = F.lit(spaced(phrase))
        size, length = len(phrase.split()), len(spaced(phrase))
        found = F.contains(words, own)
        bare = F.length(F.replace(words, own, F.lit("")))
        counts.append(F.when(found, F.floor((F.length(words) - bare) / length).cast("bigint")).otherwise(0))
        firsts.append(F.when(found, n_words(F.substring_index(words, spaced(phrase), 1))))
        lasts.append(F.when(found, total - size - n_words(F.substring_index(words, spaced(phrase), -1))))
        labels.append(F.when(found, F.lit(label)))
    return {"n_base": reduce(lambda a, b: a + b, counts).cast("bigint"), "first_word": F.least(*firsts),
            "last_word": F.greatest(*lasts), "base_labels": F.array_sort(F.array_compact(F.array(*labels)))}


def _steps(words: Column) -> Column:
    """For each rule with a match: its number, and the words between matches (gap) and in them (size), in order."""
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(keyword).alias("keyword"), F.lit(spaced(expr)).alias("expr"))
                      for n, (_, keyword, expr, _, _) in enumerate(rules())])

    def found(rule: Column) -> Column:
        hits = F.regexp_extract_all(words, rule["expr"], F.lit(0))
        gaps = F.slice(F.split(words, rule["expr"], -1), F.lit(1), F.size(hits))
        return F.struct(rule["rule"].alias("rule"), F.zip_with(gaps, hits, lambda gap, hit: F.struct(
            n_words(gap).alias("gap"), n_words(hit).alias("size"))).alias("steps"))

    live = F.filter(table, lambda r: F.contains(words, r["keyword"]) & F.rlike(words, r["expr"]))
    return F.transform(live, found)


def kept_intervals(found: DataFrame) -> DataFrame:
    """(id, mark, rule, start, end) that suppression leaves, of rows (id, mark, found)."""
    each = (found.where(F.size("found") > 0).repartition("id", "mark")
            .select("id", "mark", F.explode("found").alias("f"))
            .select("id", "mark", "f.rule", F.posexplode("f.steps").alias("n", "step"))
            .groupBy("id", "mark", "rule", "n").agg(F.first("step").alias("step")))  # repeated rows once
    row = Window.partitionBy("id", "mark")
    run = Window.partitionBy("id", "mark", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    order = row.orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    known = F.create_map(*[F.lit(x) for n, r in enumerate(rules()) for x in (n, r[3])])
    placed = (each.withColumn("end", F.sum(F.expr("step.gap + step.size")).over(run))
              .select("id", "mark", "rule", (F.col("end") - F.col("step.size")).alias("start"), "end",
                      known[F.col("rule")].alias("priority")))
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("end")))
                                                                   .over(order), F.lit(-1)))
                         for p in sorted({r[3] for r in rules()})])
    return placed.withColumn("reach", reach).where(F.col("reach") < F.col("end")).drop("reach", "priority")


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, n_words, base columns, found): everything that reads the text, in one pass, stored."""
    low = F.lower("words")
    gate = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g.replace(" ", "  "))) for g in GATES])
    passed = (df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"),
                        words_of(F.col(text_col)).alias("words"))
              .select("id", "mark", n_words(F.col("words")).alias("n_words"),
                      F.when(gate, _ascii_lower(F.col("words"))).otherwise("").alias("clean")))
    base = _base(F.col("clean"), F.col("n_words"))
    return written(passed.select("id", "mark", "n_words", *[c.alias(n) for n, c in base.items()],
                                 F.when(F.col("clean") != "", _steps(F.col("clean"))).alias("found")), "license-scan")


def detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, priority, confidence, start, end) of every kept interval, in words, end exclusive."""
    table = F.array(*[F.struct(F.lit(r[0]).alias("label"), F.lit(r[3]).alias("priority"), F.lit(r[4]).alias("confidence"))
                      for r in rules()])
    kept = kept_intervals(scanned(df, id_col, text_col).select("id", "mark", "found"))
    return kept.select(F.col("id").alias(id_col), F.element_at(table, F.col("rule") + 1).alias("r"), "start",
                       "end").select(id_col, "r.*", "start", "end")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``df``."""
    stored = scanned(df, id_col, text_col)
    labels = F.create_map(*[F.lit(x) for n, r in enumerate(rules()) for x in (n, r[0])])
    scores = F.create_map(*[F.lit(x) for n, r in enumerate(rules()) for x in (n, r[4])])
    per = (kept_intervals(stored.select("id", "mark", "found")).groupBy("id", "mark")
           .agg(F.collect_set(labels[F.col("rule")]).alias("own"), F.max(scores[F.col("rule")]).alias("best"))
           .toDF("of_id", "of_mark", "own", "best"))
    both = stored.join(per, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>"))))
    return both.select(F.col("id").alias(id_col), "n_words", "n_base", F.col("first_word").cast("bigint"),
                       F.col("last_word").cast("bigint"), F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join(every, ",").alias("labels"),
                       F.greatest(F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0),
                                  F.coalesce("best", F.lit(0.0))).alias("score"))
