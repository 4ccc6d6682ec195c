import re

import pytest

from quernel.llm import urls
from quernel.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, trust string, extra int"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def linked_hosts(html):
    """Hosts of absolute links, by cutting the page up at its attributes."""
    out = set()
    for name in ("href", "src"):
        for part in re.split(rf"(?i){name}\s*=", html)[1:]:
            target = part.lstrip().lstrip("\"'").lstrip()
            scheme, slashes, rest = target.partition("//")
            if slashes and (not scheme or re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:", scheme)):
                host = re.split(r"[/?#\"'\s<>]", rest)[0]
                out |= {host.lower()} if host else set()
    return out


def brute(rows, rounds=30, damping=0.85):
    """Rules and propagation with dictionaries."""
    pages = []
    for key, url, html, *_ in rows:
        host, path = parts(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        pages.append((key, host, path, max(fits, key=lambda r: len(r.text), default=None), linked_hosts(html or "")))
    edges, seeds = {}, {"allow": {}, "block": {}}
    total = {v: sum(p[3] is not None and p[3].verdict == v for p in pages) for v in seeds}
    for _, host, _, rule, links in pages:
        for t in links:
            if t != host and host:
                edges[host, t] = edges.get((host, t), 0) + 1
        if rule:
            seeds[rule.verdict][host] = seeds[rule.verdict].get(host, 0) + 1 / total[rule.verdict]
    scores = {}
    for kind, flip in (("allow", False), ("block", True)):
        own = {((b, a) if flip else (a, b)): w for (a, b), w in edges.items()}
        out = {}
        for (a, _), w in own.items():
            out[a] = out.get(a, 0) + w
        s = base = {h: m * (1 - damping) for h, m in seeds[kind].items()}
        for _ in range(rounds):
            nxt = dict(base)
            for (a, b), w in own.items():
                nxt[b] = nxt.get(b, 0) + damping * s.get(a, 0) * w / out[a]
            s = nxt
        scores[kind] = s
    return sorted(((k, h, p, r.text if r else None, r.verdict if r else ("block" if scores["block"].get(h, 0) > scores["allow"].get(h, 0) else "allow")) for k, h, p, r, _ in pages), key=str)


def run(spark, rows):
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), RULES)
    assert "extra" in got.columns and got.columns.count("host") == 1
    return sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


@pytest.fixture
def linked():
    page = lambda i, u, *to: (i, u, "".join(f'<a href="{t}">x</a>' for t in to), None, None, 1)
    return [
        page(1, "https://a.com/de/1", "https://b.net/x", "//C.net"),
        page(2, "https://b.net/1", "http://a.com/"),
        page(3, "https://c.net/"),
        page(4, "HTTP://Good.ORG/ok?q#f", "https://d.net/p", "/local"),
        page(5, "https://d.net"),
        page(6, "https://x.example.org/en/12", "https://d.net"),
        page(7, "https://e.net/z", "https://x.example.org/"),
        page(8, "https://www.shop.com/fr/a?b"),
    ]


def test_equal_to_brute_force(spark, linked):
    got = run(spark, linked)
    assert got == brute(linked)
    verdicts = {r[1]: r[4] for r in got}
    assert verdicts["b.net"] == "block" and verdicts["d.net"] == "allow"


def test_many_allowed_pages_do_not_outweigh_by_number(spark, linked):
    """Masses are shared within a kind: a hundred allowed pages elsewhere change no host that they don't reach."""
    more = [(100 + i, f"https://good{i}.org/", None, None, None, 1) for i in range(100)]
    got = run(spark, linked + more)
    assert got == brute(linked + more)
    assert {r[1]: r[4] for r in got}["b.net"] == "block"


def test_the_query_over_the_table(spark):
    """The registered query against brute force over whole pages."""
    from quernel.llm.queries import op4_urls

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = op4_urls(spark, "/root/testdata/sf0.001").select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None, None, None), (None, "no scheme", "<a href=https://k.net>", None, None, None), (3, "", "", None, None, None), (4, "x://", "y" * 200_000, None, None, None)]
    rows += [(5, "https://org", "z", None, None, None), (5, "https://org", "z", None, None, None), (6, "https://org/", "z", None, None, None), (7, "http://notorg/", None, None, None, None)]
    rows += [(8, "HTTPS://EXAMPLE.ORG/en/1", None, None, None, None), (9, "https://a?x=://b/c", None, None, None, None), (10, "https://com\n/fr/\n", None, None, None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_long_chains_converge(spark):
    """A host 41 links from the only blocked one."""
    page = lambda i, u, to: (i, u, f'<a href="{to}">x</a>', None, None, 1)
    rows = [page(i, f"https://h{i}.net/", f"https://h{i + 1}.net/") for i in range(40)] + [page(40, "https://h40.net/", "https://bad.com/de/"), page(41, "https://bad.com/de/", "https://bad.com/de/")]
    got = {r["host"]: r for r in urls.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert all(r["verdict"] == "block" for r in got.values())
    assert got["h0.net"]["distrust"] == pytest.approx(0.15 * 0.85**41, rel=1e-12)
