import re

from pyspark.sql import functions as F

from promptveil.llm import link_graph
from promptveil.llm.queries import op13_url_filter

SCHEMA = "page_id bigint, url string, html string"


def plain_parts(url):
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)


def plain_blocked(rows, rules, rounds=20):
    """Hosts blocked by the method, by plain loops."""
    pages, links = {}, set()
    for _, url, html in rows:
        host, path = plain_parts(url)
        if host:
            pages.setdefault(host, []).append(plain_rule(host, path, rules))
            for to in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)""", html or ""):
                links.add((host, to.lower()))
    links = {(a, b) for a, b in links if a != b}
    masses = {}
    for verdict, edges in (("allow", links), ("block", {(b, a) for a, b in links})):
        start = [h for h, found in pages.items() if 2 * sum(r is not None and r[2] == verdict for r in found) > len(found)]
        fresh = {h: link_graph.MASS // len(start) for h in start}
        mass = {h: m * 15 // 100 for h, m in fresh.items()}
        for _ in range(rounds):
            came = {}
            for a, m in fresh.items():
                out = [b for s, b in edges if s == a]
                for b in out:
                    came[b] = came.get(b, 0) + m * 85 // (100 * len(out))
            fresh = came
            for h, m in came.items():
                mass[h] = mass.get(h, 0) + m * 15 // 100
        masses[verdict] = mass
    return {h for h in pages if masses["block"].get(h, 0) > masses["allow"].get(h, 0)
            and masses["block"][h] >= link_graph.MASS // len(pages)}


def check(rows, rules, got):
    bad = plain_blocked(rows, rules)
    want = []
    for page, url, _ in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path, rules)
        want.append((page, host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if host in bad else "allow"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return bad


def test_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    check(rows, link_graph.RULES, op13_url_filter(spark, folder).collect())


def linked(*hosts):
    return " ".join(f'<a class=x HREF = "https://{h}/p?q#f">x</a>' for h in hosts)


def graph_rows():
    """A ring of farms that link to a blocked host, good sites that a trusted host links to, a hub, and odd urls."""
    rows = [(1, "http://bad.net/x", linked("farm0.com")), (2, "https://good.example.net/en/", linked("site.com", "FARM9.com")),
            (3, "http://site.com/", linked("other.com")), (4, "http://other.com/a", "<a href=//good.example.net/en/>"),
            (5, None, linked("bad.net")), (6, "no scheme", None), (7, "http://", "x"), (8, "ftp://HOST.Net", None),
            (9, "http://HOST.Net?x=/", None), (10, "http://a.org/fr/b://c", None), (11, "http://a.org/FR/", ""),
            (12, "x://example.com/de/?u", "href='http:no'"), (None, "http://farm1.com/", linked("bad.net")),
            (13, "http://farm1.com/", linked("bad.net")), (13, "http://farm1.com/", linked("bad.net")),
            (14, "http://hub.com/", linked(*[f"s{n}.org" for n in range(300)], "bad.net"))]
    rows += [(100 + n, f"http://farm{n}.com/i", linked("bad.net", f"farm{(n + 1) % 10}.com", "farm0.com")) for n in range(10)]
    return rows + [(200 + n, f"http://s{n}.org/x", linked("hub.com") if n % 2 else None) for n in range(30)]


def test_graph(spark):
    rows = graph_rows()
    df = (spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("h")).withColumn("rule", F.lit("r"))
          .withColumn("found", F.lit(1)).withColumn("part", F.lit(2)).withColumn("of", F.lit("o")))
    bad = check(rows, link_graph.RULES, link_graph.judged(df.repartition(5)).collect())
    assert "farm3.com" in bad and "site.com" not in bad and "other.com" not in bad
    assert link_graph.judged(df.where("false")).count() == 0


def test_many_rules(spark, monkeypatch):
    """The expression and the join agree, ties and repeated rules too."""
    rules = [*link_graph.RULES, ("com", "/", "block"), ("farm1.com", "", "allow"), ("a.org", "/fr/b", "block"),
             ("m.x.a.org", "/", "block"), ("org", "/", "block")]
    rows = [*graph_rows(), (300, "http://m.x.a.org/fr/b", None), (301, "http://y.m.x.a.org", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([*rules, rules[0]], "host string, path string, verdict string")
    check(rows, rules, link_graph.judged(df, table).collect())
    monkeypatch.setattr(link_graph, "IN_PLAN", 3)
    check(rows, rules, link_graph.judged(df, table).collect())
