import random

from pyspark.sql import functions as F

from factloom.llm import url_filter as u

LOWER = str.maketrans(u.UPPER, u.LOWER)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    return host.translate(LOWER), rest[:cut]


def rule_of(host, path):
    best = None
    for verdict, rule in u.RULES:
        at, tail = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_parts_and_rules_equal_brute_force(spark):
    rng = random.Random(1)
    bits = ["http", "://", "EXAMPLE", ".com", "www.", "example.com", ".net", "net", "/", "/en/", "/es/", "?", "#", "x", "É", "\n", ":8080", "com", "/fr/"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(500)]
    urls += [None, "", "https://www.example.com/en/1", "http://m.example.com/en/1?x#y", "http://a.net/es/2", "http://net/fr/", "http://badexample.com/en/", "HTTP://A.COM", "x://COM/"]
    rows = u.filter_urls(spark.createDataFrame([(i, x, "clash", 1, "kept", "t", 2) for i, x in enumerate(urls)], "page_id long, url string, verdict string, host int, _fit string, template string, purity int")).collect()
    assert len(rows) == len(urls) and all(r._fit == "kept" for r in rows)
    for r in rows:
        host, path = parts(r.url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.template is None) == (rule is not None)


def templates_by_hand(rows, rare=0.02, many=12, z=1.96, weight=4.0, prior=0.1, near=0.5):
    """The tree written out over lists: {(host, shape): (template, purity)}."""
    def smooth(b, l, base):
        return (b + weight * base) / (l + weight)

    def total(some, k):
        return sum(r[k] for r in some)

    out = {}

    def walk(some, d, prefix, rate):
        kids = {}
        for r in some:
            kids.setdefault(r[1][d] if len(r[1]) > d else "", []).append(r)
        p_n, p_l, p_b = (total(some, k) for k in (2, 3, 4))
        p = (p_b + 1) / (p_l + 2)
        branch = {}
        for seg, own in kids.items():
            n, l, b = (total(own, k) for k in (2, 3, 4))
            away = (b - l * p) / max(l * p * (1 - p), 1e-9) ** 0.5
            branch[seg] = "" if seg == "" else "*" if len(kids) >= many and n < rare * p_n else "~" + ("?" if not l else "+" if away > z else "-" if away < -z else "=")

        def spread(segs):
            counts = {}
            for s in segs:
                for r in kids[s]:
                    nxt = r[1][d + 1] if len(r[1]) > d + 1 else ""
                    counts[nxt] = counts.get(nxt, 0) + r[2]
            return {k: v / sum(counts.values()) for k, v in counts.items()}

        known = {g: spread([s for s in kids if branch[s] == g]) for g in ("~+", "~-", "~=") if g in branch.values()}
        moved = {}
        for s in kids:
            if branch[s] == "~?":
                mine = spread([s])
                best = max(((sum(min(v, q.get(k, 0)) for k, v in mine.items()), g) for g, q in known.items()), default=(0, ""))
                moved[s] = best[1] if best[0] >= near - 1e-12 else "~?"
        branch |= moved
        for g in set(branch.values()):
            members = [s for s in kids if branch[s] == g]
            own = [r for s in members for r in kids[s]]
            if g == "":
                for r in own:
                    out[r[0], tuple(r[1])] = (prefix, smooth(total(own, 4), total(own, 3), rate))
                continue
            name = members[0] if len(members) == 1 and g != "*" else g
            walk(own, d + 1, f"{prefix}/{name}", smooth(total(own, 4), total(own, 3), rate))

    for host in {r[0] for r in rows}:
        site, rate = host.split(".")[-2:], prior
        for some in ([r for r in rows if r[0].split(".")[-2:] == site], [r for r in rows if r[0] == host]):
            rate = smooth(total(some, 4), total(some, 3), rate)
        walk([r for r in rows if r[0] == host], 0, "", rate)
    return out


def test_templates_equal_a_tree_by_hand(spark):
    rng = random.Random(4)
    rows = {}
    for host in ("a.x.net", "b.x.net", "c.org", "d.y.com", ""):
        for _ in range(60):
            shape = tuple(rng.choice([f"s{rng.randint(0, 30)}", "en", "de", "#", "*"]) for _ in range(rng.randint(0, 4)))
            n = rng.randint(1, 60)
            labelled = rng.choice([0, 0, n // 2, n])
            rows[host, shape] = (host, list(shape), n, labelled, 0 if "en" in shape else rng.randint(0, labelled))
    rows = list(rows.values())
    df = spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, blocked long")
    got = {(r.host, tuple(r.shape)): (r.template, r.purity) for r in u.path_templates(df).collect()}
    want = templates_by_hand(rows)
    assert got.keys() == want.keys()
    for k, (template, purity) in want.items():
        assert got[k][0] == template and abs(got[k][1] - purity) < 1e-9


def test_free_rows_of_the_given_pages_are_blocked_where_their_kin_is(spark):
    rows = u.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("rule is null").collect()
    verdicts = {(r.host.rpartition(".")[2], r.verdict) for r in rows}
    assert ("net", "block") in verdicts and ("org", "allow") in verdicts


def test_rare_branches_are_one_wildcard(spark):
    rows = [("h", [f"s{chr(97 + i)}"], 1, 0, 0) for i in range(20)] + [("h", ["main"], 500, 0, 0)]
    df = spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, blocked long")
    got = {r.shape[0]: r.template for r in u.path_templates(df).collect()}
    assert got["sa"] == got["st"] == "/*" and got["main"] == "/main"


def test_shapes(spark):
    row = spark.sql("SELECT '/en/123.html//a1b2/' || repeat('x', 50) || '/d/e/f/g' AS p").select(u.shape(F.col("p")).alias("s")).first()
    assert row.s == ["en", "#", "*", "*", "d", "e", "**"]


def test_unlabelled_and_empty(spark):
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rows = u.filter_urls(spark.createDataFrame([(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3
