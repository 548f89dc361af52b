"""Host reputation: rules by hand, shares beside a plain walk over the levels."""

import collections
import math
import random

from flowgauge.llm import hosts

PAGES = "page_id long, url string, host string, verdict string"
LABELS = "doc_id long, quality int, toxic int, host string"
rng = random.Random(5)


def plain(pages, labels):
    """Verdicts by loops over dictionaries."""
    bad = {}
    for d, quality, toxic, _ in labels:
        flags = [f for f in (None if quality is None else quality == 0, None if toxic is None else toxic == 1) if f is not None]
        if d is not None and flags:
            bad[d] = max(bad.get(d, False), *flags)
    parted = []
    for page, url, *_ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        parted.append((page, "".join(c.lower() if c.isascii() else c for c in host), path))
    count = collections.defaultdict(lambda: [0, 0])
    for page, host, _ in parted:
        count[host][0] += page is not None and page in bad
        count[host][1] += page is not None and bad.get(page, False)

    def names(host):
        bare = host.split("@")[-1]
        if ":" in bare and (not bare.rsplit(":", 1)[1] or bare.rsplit(":", 1)[1].isdigit()):
            bare = bare.rsplit(":", 1)[0]
        if bare and (set(bare) <= set("0123456789.") or bare[0] == "["):
            return "", bare
        own = bare.split(".")
        width = 2 if ".".join(own[-2:]) in hosts.SUFFIXES else 1
        return ".".join(own[-width:]), ".".join(own[-width - 1 :])

    n, k = (sum(c[i] for c in count.values()) for i in (0, 1))
    levels = [{}, {}, {}]
    parents = [{}, {}, {}]
    for host, (a, b) in count.items():
        suffix, domain = names(host)
        for level, key, parent in ((0, suffix, ""), (1, domain, suffix), (2, host, domain)):
            parents[level][key] = parent
            own = levels[level].setdefault(key, [0, 0])
            own[0] += a
            own[1] += b
    share = {"": (k + 0.5) / (n + 1)}
    for level in range(3):
        above = collections.defaultdict(lambda: [0, 0, 0])
        for key, (a, b) in levels[level].items():
            for i, x in enumerate((a, b, a * a)):
                above[parents[level][key]][i] += x
        q = k / n if n else 0
        free = sum(c[0] > 0 for c in levels[level].values()) - sum(c[0] > 0 for c in above.values())
        scatter = sum(b * b / a for a, b in levels[level].values() if a) - sum(b * b / a for a, b, _ in above.values() if a)
        room = q * (1 - q) * (n - sum(c / a for a, _, c in above.values() if a) - free)
        rho = (scatter - free * q * (1 - q)) / room if room > 0 else 0
        prior = hosts.STRENGTH[1] if rho <= 1 / (hosts.STRENGTH[1] + 1) else max(hosts.STRENGTH[0], 1 / rho - 1)
        if level < 2:
            share = {key: (b + prior * share[parents[level][key]]) / (a + prior) for key, (a, b) in levels[level].items()}
    blocked = set()
    for host, (a, b) in count.items():
        x, y = b + prior * share[parents[2][host]], a - b + prior * (1 - share[parents[2][host]])
        mean = x / (x + y)
        if mean - hosts.Z * math.sqrt(mean * (1 - mean) / (x + y + 1)) > hosts.MOST_BAD:
            blocked.add(host)
    out = collections.Counter()
    for page, host, path in parted:
        fit = [(r, p, v) for r, p, v in hosts.RULES if (host == r or host.endswith("." + r)) and path.startswith(p)]
        best = max(fit, key=lambda r: len(r[0]) + len(r[1]), default=None)
        verdict = best[2] if best else "block" if host in blocked else "allow"
        out[page, host, path, best[0] + best[1] if best else None, verdict] += 1
    return out, blocked


def judged(spark, pages, labels):
    df = hosts.judged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    return collections.Counter(tuple(r) for r in df.collect())


def odd_pages():
    pages = [
        (0, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "http://Example.COM/en/a?b=/fr/#c"), (5, "https://a.example.com/en"),
        (6, "x://www.example.com/en/1"), (7, "x://deep.www.example.com/en/"), (8, "x://shop.net/es/1"), (9, "x://net/fr/"),
        (10, "x://shop.net/en/"), (11, "x://example.com"), (12, "x://example.com?/en/"), (13, "x://notexample.com/en/"),
        (14, "a://b://c/d"), (15, "x://user@HOST.co.uk:80/p"), (16, "x://10.0.0.1/p"), (17, "x://[::1]:8/p"), (18, "x://ÄÖ.org/p\nq"),
        (19, "x://a..b./p"), (19, "x://a..b./p"), (None, "x://a.org/p"), (20, "x://long.org/" + "p" * 100_000)]
    return [(i, u, "clash", "clash") for i, u in pages]


def test_rules_and_plain_walk(spark):
    pages = odd_pages()
    want, _ = plain(pages, [])
    assert judged(spark, pages, []) == want
    by_id = {r[0]: (r[3], r[4]) for r in want}
    assert by_id[4] == ("example.com/en/", "block") and by_id[7] == ("www.example.com/en/", "allow")
    assert by_id[8] == ("net/es/", "block") and by_id[11][0] is None and by_id[5] == ("com/", "allow")


def test_bad_hosts_are_blocked(spark):
    """Hosts of one bad domain, among them one without labels, and one bad host of a good domain."""
    pages, labels = odd_pages(), []
    shares = {f"h{i}.bad.org": 0.97 for i in range(6)} | {f"h{i}.fine{i % 3}.org": 0.03 for i in range(12)} | {"x.fine0.org": 0.95}
    for host, share in shares.items():
        for _ in range(60):
            page = 100 + len(labels)
            pages.append((page, f"http://{host}/p/{page}", "", ""))
            labels.append((page, int(rng.random() > share), int(rng.random() < share), ""))
    pages += [(50_000, "http://new.bad.org/p", "", ""), (50_001, "http://new.fine1.org/p", "", "")]
    labels += [(100, None, None, ""), (None, 0, 1, ""), (101, 0, None, ""), (101, 1, 0, "")]
    want, blocked = plain(pages, labels)
    assert blocked == {h for h, s in shares.items() if s > 0.5} | {"new.bad.org"}
    assert judged(spark, pages, labels) == want


def test_empty_tables(spark):
    assert not judged(spark, [], [])
    assert not judged(spark, [], [(1, 0, 1, "")])
