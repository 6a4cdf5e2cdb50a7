"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are found by exact rules and always stay. Looser patterns give further candidates:
what the rules drop (bad check digits, numbers out of range), spelled-out addresses, phone numbers without a plus,
identity numbers, secrets. Six labelers vote yes, no or nothing on every candidate, base or not:

0. the strict rule of its kind; 1. its outer form; 2. gazetteers (domain endings, card issuers, reserved areas);
3. words before it that announce its kind; 4. words before it that speak against it; 5. whether it stands alone.

From the counts per kind and pattern of votes EM estimates, per kind, the share of true spans and how often each labeler
says yes or no to true and to false ones (starting from the majority; the rule's own prior is as strong as the data,
since what fails a check digit is hardly ever a true number). A logistic classifier over the votes and over what the
labelers don't look at, the span's own form (digits, letters, separators, length), the characters beside it and the words
around it, is then trained on these probabilities, on a sample of spans: by a hash of their places, about ``SAMPLE`` in
all, with as many of each pattern of votes, so that rare ones count too. Every candidate is scored by its own features.
One that is no base span is kept when the classifier gives it at least ``KEEP`` and it meets no base span or kept one
before it.

A null or empty text has no spans. Rows are judged one by one, so repeated rows repeat; other columns are ignored. With
no candidates at all nothing is learned and nothing added. Places are code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import small_batches
from promptveil.session import read_bounded, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
LABELERS = 6
KEEP = 0.5
SAMPLE = 10_000
LENGTHS = (8, 14, 20)
MAX_PATTERNS = len(KINDS) * 3 ** LABELERS * (len(LENGTHS) + 1)  # all there can be
#: Shares of no, nothing and yes that true and false spans get, before any data: from the rule, from another labeler.
PRIOR = (((0.02, 0.25, 0.73), (0.5, 0.25, 0.25)), ((0.25, 0.25, 0.5), (0.5, 0.25, 0.25)))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# a start inside a run of digits matches only where the run's start does, so runs are tried once
_IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"
_CARD = r"[0-9](?:[ -]?[0-9])+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
              r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,5}"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])00[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ghp_|sk_live_|xox[bp]-)[A-Za-z0-9_-]{10,100}"),
)
#: Gazetteers and cue words, fixed values.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at be se no dk pl ru jp cn br mx us ca au".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "34", "37", "36", "38", "6011", "65", "35", "62")
RESERVED_IPS = ("0.", "127.", "255.", "224.")
FOR = {"email": ("mail", "e-mail", "contact", "write"), "ip": ("ip", "address", "host", "server", "login"),
       "card": ("card", "visa", "credit", "payment", "account"), "phone": ("phone", "tel", "call", "fax", "mobile"),
       "id": ("ssn", "social", "security", "id"), "secret": ("token", "key", "secret", "password", "api")}
AGAINST = ("version", "release", "isbn", "figure", "section", "chapter", "page", "table", "line", "total", "sha", "commit")
_WORD = r"[^\W\d_]+(?:-[^\W\d_]+)?"
_BEFORE = 40
_AFTER = 24
#: Blocks of features: how many values each has for a kind, and hashed words for all.
_FORMS = {"length": len(LENGTHS) + 1, "digits": 4, "letters": 4, "separator": 6, "left": 6, "right": 6}
WORDS = 128
N_FEATURES = len(KINDS) * (1 + sum(_FORMS.values())) + 2 * LABELERS + WORDS


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address rule, found from their at sign: the start is as far left as its characters go."""
    floor, at = 0, text.find("@")
    domain = re.compile(_DOMAIN)
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = domain.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            floor = end.end()
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(part: str) -> str:
    return re.sub("[^0-9]", "", part)


def strict(kind: str, part: str) -> bool:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or "0") <= 255 for n in part.split("."))
    if kind == "card":
        digits = digits_of(part)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits_of(part)) <= 15
    return True


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all candidates, by kind and start."""
    found: set[tuple[int, int, int, bool]] = {(0, a, b, True) for a, b in emails(text)} if "@" in text else set()
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in re.finditer(pattern, text):
            good = strict(KINDS[kind], m[0])
            # a dropped match is a candidate where it could be one: few digits are never a card or a phone
            if good or kind == 1 and len(m[0]) <= 19 or kind > 1 and 13 <= len(digits_of(m[0])) <= 19:
                found.add((kind, m.start(), m.end(), good))
    for name, pattern in _LOOSE:
        for m in re.finditer(pattern, text):
            found.add((KINDS.index(name), m.start(), m.end(), False))
    return sorted(found)


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """One of -1, 0, 1 from each labeler."""
    part, name = text[start:end], KINDS[kind]
    digits = digits_of(part)
    before = text[max(0, start - _BEFORE):start].lower()
    cues = re.findall(_WORD, before)[-4:]
    last, following = text[start - 1:start], text[end:end + 1]
    if name in BASE_KINDS:
        rule = 1 if base else -1 if name in ("ip", "card") else 0
    else:
        rule = 1 if name == "id" and digits[:3] not in ("000", "666") and digits[3:5] != "00" else 0
    if name == "email":
        form = 1 if re.fullmatch(r"[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}", part) else 0
        listed = 1 if re.split(r"[^A-Za-z]+", part.lower())[-1] in ENDINGS else -1
    elif name == "ip":
        form = -1 if re.search(r"(?:^|\.)0[0-9]", part) else 1
        listed = -1 if part.startswith(RESERVED_IPS) else 0
    elif name == "card":
        form = 1 if len(digits) in (15, 16) and re.fullmatch(r"[0-9]+|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
                                                            part) else -1
        listed = 1 if digits.startswith(ISSUERS) else -1
    elif name == "phone":
        form = 1 if re.search(r"[ .)-][0-9]{3}[ .-][0-9]{4}$", part) or 10 <= len(digits) <= 13 else -1
        listed = 1 if part[0] in "+(" or part.startswith("00") else 0
    elif name == "id":
        form, listed = 1, -1 if digits[0] == "9" else 0
    else:
        kinds_of = len(set(digits)) + len(set(re.sub("[0-9]", "", part)))
        form = 1 if kinds_of >= 8 and digits and len(digits) < len(part) else -1
        listed = 1 if re.match("AKIA|ghp_|sk_live_|xox", part) else 0
    told = 1 if any(c.startswith(w) for c in cues for w in FOR[name]) else 0
    spoken_against = -1 if any(c in AGAINST for c in cues) else 0
    alone = 1 if not (last.isalnum() or following.isalnum() or last in ("#", "$", "€", "=") and last) else -1
    return [rule, form, listed, told, spoken_against, alone]


def pattern(kind: int, own: list[int], size: int) -> int:
    """Kind, votes and length class as one number."""
    code = kind
    for v in own:
        code = code * 3 + v + 1
    return code * (len(LENGTHS) + 1) + sum(size > n for n in LENGTHS)


def unpacked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes, length classes of pattern numbers."""
    size = codes % (len(LENGTHS) + 1)
    rest = codes // (len(LENGTHS) + 1)
    own = np.zeros((len(codes), LABELERS), np.int64)
    for i in reversed(range(LABELERS)):
        own[:, i] = rest % 3 - 1
        rest = rest // 3
    return rest, own, size


def estimated(kinds: np.ndarray, own: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM over patterns that occur ``n`` times: the probability that a span of each pattern is true."""
    margin = own.sum(axis=1)
    truth = np.clip(0.5 + 0.2 * margin, 0.05, 0.95)
    for kind in np.unique(kinds):
        mine = kinds == kind
        votes_of, weight, p = own[mine], n[mine].astype(np.float64), truth[mine]
        for _ in range(rounds):
            true, false = weight * p, weight * (1 - p)
            share = (true.sum() + 1) / (weight.sum() + 2)
            odds = np.full(len(p), np.log(share / (1 - share)))
            for i in range(LABELERS):
                strength = max(8.0, weight.sum()) if i == 0 else 8.0
                for v in (-1, 0, 1):
                    said = votes_of[:, i] == v
                    # a labeler is rather right than wrong, silence tells nothing
                    yes = (true[said].sum() + strength * PRIOR[i > 0][0][v + 1]) / (true.sum() + strength)
                    no = (false[said].sum() + strength * PRIOR[i > 0][1][v + 1]) / (false.sum() + strength)
                    odds[said] += np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        truth[mine] = p
    return truth


def _beside(c: str) -> int:
    """Class of a character beside a span: none, space, letter, digit, bracket or quote, other."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "()[]{}<>\"'" else 5


def features(text: str, kind: int, start: int, end: int, own: list[int]) -> list[int]:
    """Numbers of the features that a span has: its kind, votes for and against, form, surroundings, and words around."""
    part = text[start:end]
    digits = sum(c.isdigit() for c in part)
    letters = {c.isupper() for c in part if c.isalpha()}
    between = {c for c in part if not c.isalnum()}
    separator = 0 if not between else 5 if len(between) > 1 else " -.@".find(next(iter(between))) + 1 or 5
    form = {"length": sum(len(part) > n for n in LENGTHS), "digits": 4 * digits // (len(part) + 1),
            "letters": 0 if not letters else 3 if len(letters) > 1 else 1 + letters.pop(), "separator": separator,
            "left": _beside(text[start - 1:start]), "right": _beside(text[end:end + 1])}
    out, at = [kind], len(KINDS)
    for name, size in _FORMS.items():
        out.append(at + kind * size + form[name])
        at += len(KINDS) * size
    for v in own:
        if v:
            out.append(at + (v > 0))
        at += 2
    around = re.findall(_WORD, text[max(0, start - _BEFORE):start].lower())[-3:]
    around += [w + ">" for w in re.findall(_WORD, text[end:end + _AFTER].lower())[:2]]
    return out + sorted({at + zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in around})


def matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), N_FEATURES))
    for n, own in enumerate(rows):
        x[n, own] = 1
    return x


def trained(x: np.ndarray, truth: np.ndarray, n: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier on probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - truth)) + ridge * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def extracted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (kind, start, end, base, pattern, features)) of every text's candidates."""
    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
                         T.StructField("pattern", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                                ("pattern", pa.int64()), ("features", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                own = [(c, votes(text, *c)) for c in candidates(text or "")]
                spans.append([{"kind": k, "start": a, "end": b, "base": base, "pattern": pattern(k, v, b - a),
                               "features": features(text, k, a, b, v)} for (k, a, b, base), v in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, arrow)], names=["id", "spans"])

    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def learned(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights; all 0 where there is nothing to learn from."""
    spans = found.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    rows = read_bounded(spans.groupBy("pattern").agg(F.count("*").alias("n")), MAX_PATTERNS)
    if not rows:
        return np.zeros(N_FEATURES)
    codes, n = (np.array(c) for c in zip(*sorted(map(tuple, rows)), strict=True))
    kinds, own, _ = unpacked(codes)
    truth = dict(zip(codes.tolist(), estimated(kinds, own, n.astype(np.float64)).tolist(), strict=True))
    of_each = max(1, sample // len(codes))
    shares = found.sparkSession.createDataFrame([(int(c), min(1.0, of_each / int(k))) for c, k in zip(codes, n, strict=True)], "pattern long, share double")
    draw = F.pmod(F.xxhash64("id", "kind", "start"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = (spans.join(shares, "pattern").where(draw < F.col("share")).groupBy("pattern", "features").agg(F.count("*").alias("n"))
             .orderBy("pattern", "features").collect())
    x = matrix([r["features"] for r in drawn])
    return trained(x, np.array([truth[r["pattern"]] for r in drawn]), np.array([r["n"] for r in drawn], np.float64))


def probability(own: list[int], weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[own].sum(), -30, 30))))


def chosen(spans: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of base spans and the added ones that meet none before them."""
    base = [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]]
    more = sorted((s["start"], s["end"], s["kind"]) for s in spans if not s["base"] and probability(s["features"], weights) >= KEEP)
    taken = sorted((a, b) for _, a, b in base)
    out, floor, at, reach = list(base), -1, 0, -1
    for a, b, kind in more:
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and floor <= a:
            out.append((kind, a, b))
            floor = b
    return sorted(out)


def detected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array of (kind, start, end), spans array of the same) of every row."""
    found = written(extracted(df, id_col, text_col), "personal-data")
    weights = learned(found)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))

    @F.pandas_udf(span)
    def pick(rows):
        import pandas as pd
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in chosen(list(own), weights)] for own in rows])

    names = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(
        F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), base.alias("base"), pick("spans").alias("spans"))
