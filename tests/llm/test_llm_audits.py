"""URL filter, whitening and divergence audit against brute force on small tables with nulls, ties and odd values."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from salesframe.llm import divergence, queries, url_filter, whitening

# --- url filter ---------------------------------------------------------------

RULES = queries.PAGE_RULES
PAGES = "page_id long, url string, html string, host string, rule string, `a.b` int"


def page(i, url, html=None):
    return i, url, html, "clash", "clash", 1


def canonical(url):
    return f"<head><LINK data-x='1' rel=\"nofollow Canonical\" href='{url}'></head>"


def pages_table():
    rows = [
        page(1, "https://WWW.Example.com/en/1?x#y"), page(2, "http://blog.example.com/en/1"), page(3, "http://a.net/es/"),
        page(4, "http://a.net/esx"), page(5, None), page(6, "no scheme"), page(7, ""), page(8, "://"), page(9, "http://com"),
        page(10, "http://other.org/x", canonical("http://a.net/es/9")),                      # alias of a blocked address
        page(11, "http://other.org/x#part"), page(12, "https://other.org/x"),                 # the same address
        page(13, "http://other.org/x?q=1"),                                                    # another address
        page(14, "http://chain.org/1", "<meta content='0; URL=/2?a=1&amp;b=2' http-equiv=refresh>"),
        page(15, "http://chain.org/2?a=1&b=2", canonical("../x/./../y")), page(16, "http://chain.org/y", canonical("//b.net/fr/")),
        page(17, "http://saved.org/1", canonical("http://a.net/es/1") + canonical("http://shop.com/")),   # allowed and blocked aliases
        page(18, "http://hidden.org/1", "<!-- " + canonical("http://a.net/es/1") + " --><script>x = '"
             + canonical("http://a.net/fr/1") + "'</script>"),
        page(19, "http://mail.org/1", canonical("mailto:x@a.net/es/") + canonical("#top") + canonical("")),
        page(20, "http://a.net/fr/allowed", canonical("http://shop.com/")),                   # its own rule stays
        page(21, "http://long.org/1", "x" * 3_000_000 + canonical("http://c.net/es/z")),
        page(None, "http://other.org/x", ""), page(10, "http://other.org/x", canonical("http://a.net/es/9")),
        page(22, "http://self.org/", canonical("http://self.org")), page(23, "http://notexample.com/en/1"),
        page(24, "http://a.net:80/es/1"), page(25, "//x.net/es/1"), page(26, "http://no.org/?u=http://a.net/es/"),
    ]
    return rows + [page(100 + i, f"http://hub{i}.org/", canonical("http://spam.net/es/hub")) for i in range(300)]


def test_url_filter(spark):
    frame = spark.createDataFrame(pages_table(), PAGES).repartition(5)
    out = url_filter.url_filter(frame, RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(pages_table())
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and (got[3].rule, got[3].verdict) == ("net/es/", "block")
    for i in (4, 5, 6, 7, 8, 9, 13, 18, 19, 22, 24, 26):
        assert (got[i].rule, got[i].verdict) == (None, "allow"), i
    assert got[5].host == got[5].path == got[6].host == got[7].path == "" and got[9].host == "com"
    for i in (10, 11, 12, None, 14, 15, 16, 21, *range(100, 400)):
        assert (got[i].rule, got[i].verdict) == (None, "block"), i
    assert (got[17].rule, got[17].verdict) == (None, "allow")
    assert (got[20].rule, got[20].verdict) == ("net/fr/", "block")
    assert (got[23].rule, got[23].verdict) == ("com/", "allow") and (got[25].host, got[25].verdict) == ("", "allow")
    assert url_filter.url_filter(frame.where("false"), RULES).count() == 0


def test_url_filter_twin_with_links(spark):
    duckdb = pytest.importorskip("duckdb")
    pages = pd.DataFrame([r[:3] for r in pages_table()], columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})  # noqa: F841
    want = sorted(map(repr, duckdb.sql(url_filter.oracle(RULES)).fetchall()))
    frame = spark.createDataFrame(pages_table(), PAGES)
    assert sorted(repr(tuple(r)) for r in url_filter.url_filter(frame, RULES).collect()) == want


def test_rules_as_a_table_and_redirects(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "", "y.x.net", "org"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in ["", "/", "/e", "/en/", "/en/1", "/é"]
                  if rng.random() < 0.6}.values())
    rules.append(("block", "tie.com", "/"))
    urls = [(i, f"http://{rng.choice(['', 'w.', 'b.', 'za.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/e', '/en/12', '/é/x', '/en'])}")
            for i in range(300)] + [(300, None), (301, "http://q.zz/1")]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame(rules * 2, "action string, host string, path string")
    redirects = spark.createDataFrame([("http://q.zz/1", "http://tie.com/"), (None, "http://tie.com/"), ("http://q.zz/2", None)],
                                      "url string, target string")
    inline = sorted(map(repr, url_filter.url_filter(frame, rules, redirects, html=None).collect()))
    joined = sorted(map(repr, url_filter.url_filter(frame, table, redirects, html=None).collect()))
    assert inline == joined and "verdict='block'" in [r for r in joined if "page_id=301" in r][0]

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = m.groups() if m else ("", "")
        fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None
    got = {r.page_id: r.rule for r in url_filter.url_filter(frame, table, html=None).collect()}
    assert all(got[i] == brute(u) for i, u in urls)


# --- whitening ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, whitened string, n long"


def brute_whitening(vectors):
    """Per row the deviation and up to four whitened values, by whole numbers and NumPy on the full matrix."""
    fine = [v for v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in fine]
    fit = sorted(set(x))
    n, dims = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(dims)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit), n ** 3)) for j in range(dims)]
                    for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    deviation = {r: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in set(x)}
    centred = {r: np.array([float(Fraction(n * c - s, n)) for c, s in zip(r, sums)]) for r in set(x)}
    return x, n, deviation, {r: centred[r] @ u / np.sqrt(e) for r in centred}, e / np.trace(cov)


@pytest.mark.parametrize("dims, scale", [(7, 0.3), (3, 40.0), (2, 1e6)])
def test_whitening(spark, dims, scale):
    rng = np.random.default_rng(dims)
    base = (rng.normal(size=(150, dims)) * scale * np.arange(1, dims + 1)).astype(np.float32).tolist()
    vectors = base + base[:60] + [base[0]] * 200 + [None, [None] * dims, [math.nan] + [0.0] * (dims - 1), [math.inf] * dims, []]
    rows = [(i if i != 5 else None, v, 3, "x", 9) for i, v in enumerate(vectors)]
    out = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(7))
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    x, n, deviation, want, explained = brute_whitening(vectors)
    got = out.collect()
    k = min(4, dims)
    assert len(got) == len(x) * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id, r.component)):
        v = x[5 if r.vec_id is None else r.vec_id]
        c = r.component - 1
        assert r.deviation == (deviation[v] if deviation[v] < 1 << 63 else None) and math.isclose(r.explained, explained[c], rel_tol=1e-9)
        s = sign.setdefault(c, 1 if abs(r.whitened - want[v][c]) < abs(r.whitened + want[v][c]) else -1)
        assert math.isclose(s * r.whitened, want[v][c], rel_tol=1e-7, abs_tol=1e-7)


def test_whitening_defined_cases(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], VECTORS))
    assert make([(1, None)]).count() == 0 and make([]).count() == 0 and make([(1, [])]).count() == 0
    one = make([(1, [0.5, 2.0]), (2, [0.5, 2.0])]).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    # lengths apart; a dependent dimension has no variance of its own; beyond 64 bits
    mixed = make([(1, [1.0]), (2, [2.0]), (3, [4.0]), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (6, [3e38, 1.0, 0.0]), (7, [-3e38, 1.0, 0.0])]).collect()
    by = {}
    for r in mixed:
        by.setdefault(r.vec_id, []).append(r)
    assert [len(by[i]) for i in range(1, 8)] == [1, 1, 1, 2, 2, 3, 3]
    assert by[3][0].n == 3 and by[4][0].n == 2 and math.isclose(abs(by[4][0].whitened), 1) and by[4][1].whitened is None
    assert by[6][0].deviation is None and math.isclose(abs(by[6][0].whitened), 1) and math.isclose(by[6][0].explained, 1)
    doubles = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.2])], "vec_id long, embedding array<double>")
    assert whitening.whitened(doubles).count() == 4


def test_scatter_and_codes():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-90, 90, (1000, 6)), rng.integers(-2 ** 40, 2 ** 40, (70, 3)), np.full((65, 2), -7),
              np.array([[2 ** 63 - 1, -2 ** 63], [-2 ** 63, 0]])):
        x = x.astype(np.int64)
        sums, cross = whitening.scatter(x)
        whole = x.astype(object)
        want = whole.T.dot(whole)
        assert sums.tolist() == whole.sum(axis=0).tolist()
        limbs = whitening._limbs(cross)
        for i in range(x.shape[1]):
            for j in range(i, x.shape[1]):
                assert cross[i, j] == want[i, j] == sum(int(part[i, j]) << 32 * k for k, part in enumerate(limbs))
        codes = whitening.encode(x)
        assert sorted(map(tuple, np.concatenate(list(whitening.decode(codes))).tolist())) == sorted(map(tuple, x.tolist()))
        assert len(set(codes)) == len(set(map(tuple, x.tolist())))


# --- divergence ---------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, term string, n int, value int"


def brute_audit(docs, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    rows = [(lang or "", source or "", Counter(terms(text))) for _, text, lang, source, *_ in docs]
    out = []
    for lang in {r[0] for r in rows}:
        seen = Counter(t for own, _, c in rows if own == lang for t in c)
        kept = [t for t, n in seen.items() if n >= least]
        groups = {s: Counter() for own, s, _ in rows if own == lang}
        for own, s, c in rows:
            if own == lang:
                groups[s].update({t: n for t, n in c.items() if seen[t] >= least})
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        p = lambda c, t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in groups.items():
            pair = [(-sum(abs(p(c, t) - p(o, t)) for t in kept), x.encode(), x) for x, o in groups.items() if x != s]
            term = [(p(whole, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, tile, least, top", [(1 << 13, 32, 3, 50), (8, 2, 2, 3), (4, 1, 1, 50), (8, 2, 10 ** 6, 5)])
def test_audit(spark, monkeypatch, block, tile, least, top):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(4)
    words = [rng.choice(["a", "Ab", "é", "漢字", "z🙂", "ß"]) * rng.randrange(1, 4) + rng.choice("abcdefg") for _ in range(60)]
    docs = [(i, rng.choice([" ", "1", "_", "\n"]).join(rng.choice(words[:rng.randrange(1, 60)]) for _ in range(rng.randrange(0, 40))),
             rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "é", "z"]), "x", 1, 2) for i in range(200)]
    docs += [(None, None, "en", "only", "x", 1, 2), (1, "ab " * 200_000, "en", "s", "x", 1, 2), (7, None, "fr", None, "x", 1, 2),
             (8, "", "fr", "q", "x", 1, 2), docs[0], docs[0]]
    out = divergence.audit(spark.createDataFrame(docs, DOCS).repartition(6), least_documents=least, top=top)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, out.collect())) == brute_audit(docs, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_trees_share_and_price():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.2, (6, 100))
    counts[3] = counts[2]
    counts[4] = 0
    counts[5, 0] = 10 ** 12
    totals = [int(c.sum()) + 500 for c in counts]
    pairs = [(i, j) for i in range(6) for j in range(6)]
    p = [[1 + 10 ** 9 * (int(c) + 5) // t for c in row] for row, t in zip(counts, totals)]
    assert divergence.distances(counts, totals, pairs) == [sum(abs(a - b) for a, b in zip(p[i], p[j])) for i, j in pairs]
    trees = divergence.Trees(np.pad(counts, ((0, 0), (0, 28)), constant_values=-1))
    assert trees.roots[2] == trees.roots[3] != trees.roots[4]
    assert sum(len(left) for left, _ in trees.children) < 6 * 127  # nodes are shared
    u, v, times = trees.leaf_pairs(trees.roots[4], trees.roots[4])
    assert len(u) == 2 and sorted(times) == [28, 100]
