"""Text mode, batch embedding with a user function, page text, reasons, guard, redirects."""

import hashlib
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lingomesh import labels as L
from lingomesh.functions import addresses
from lingomesh.operators import embed, pages
from lingomesh.operators.quality import CrawlColumns


def test_embed_batches_cache_and_failures(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(texts):
        calls.add(1)
        if any("boom" in t for t in texts):
            raise RuntimeError("HTTP 400 kaputt")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, t) for i, t in enumerate(["a", "bb", "a", "ccc", "boom", "bb"])]
    df = spark.createDataFrame(rows, "pos long, text string")
    res = embed.embed_texts(df, "text", fn, batch_size=1, parallelism=2)
    got = {r["pos"]: (r["vector"], r["error"]) for r in res.rows.collect()}
    assert got[0][0] == [1.0, 1.0] and got[2][0] == [1.0, 1.0]          # one request for both "a"
    assert got[4] == (None, "Embedding-Anfrage fehlgeschlagen: HTTP 400 kaputt")
    assert calls.value == 4                                             # distinct texts only
    cache = res.new_cache
    assert cache.count() == 3
    again = embed.embed_texts(df, "text", fn, cache=cache, batch_size=2)
    assert again.rows.where("vector IS NOT NULL").count() == 5
    assert calls.value <= 6                                             # only the failing text again


def test_embed_length_retry_and_fatal(spark):
    def fn(texts):
        if any(len(t) > 4 for t in texts):
            raise RuntimeError("maximum context length exceeded")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(0, "x" * 10)], "pos long, text string")
    r = embed.embed_texts(df, "text", fn, max_chars=8).rows.first()
    assert r["vector"] == [1.0] and r["error"] is None

    def fatal(texts):
        raise embed.FatalEmbeddingError("HTTP 401 nein")

    with pytest.raises(Exception, match="HTTP 401"):
        embed.embed_texts(df, "text", fatal).rows.collect()


def test_sets_from_texts(spark):
    rows = [(0, "de", "https://x.de/a", "Titel", "Text"), (1, "de", "https://x.de/b", None, " "),
            (2, "de", "", "t", "x"), (3, "de", "https://x.de/c", "Titel", "Text")]
    df = spark.createDataFrame(rows, "pos long, code string, url string, title string, main string")
    cols = CrawlColumns(url="url", code="code", pos="pos")
    texts = embed.texts_for_rows(df, cols, ["title", "main"], filter_indexable=False)
    valid, dropped, _ = embed.sets_from_texts(df, cols, texts, embed.sha1_embedder(8), filter_indexable=False)
    reasons = {r["pos"]: r["reason"] for r in dropped.collect()}
    assert reasons == {1: "kein Text in den gewählten Spalten", 2: "leere URL"}
    v = {r["pos"]: r["vec"] for r in valid.collect()}
    assert sorted(v) == [0, 3] and v[0] == pytest.approx(v[3])
    want = [b / 255 for b in hashlib.sha1("Titel\n\nText".encode()).digest()[:8]]
    norm = sum(x * x for x in want) ** 0.5
    assert v[0] == pytest.approx([x / norm for x in want], abs=1e-6)
    stats = embed.text_stats(texts).first()
    assert (stats["texts"], stats["avg_chars"], stats["tokens"]) == (2, 11, 5)


HTML = """<html><head><title>T</title><script>var x="<p>";</script></head><body>
<nav><a href="/">Start</a></nav><!-- c --><article><h1>Überschrift</h1><p>Grüße &amp; mehr</p>
<table><tr><td>Zelle</td></tr></table></article><footer>Fuß</footer></body></html>"""


def test_main_text(spark):
    df = spark.createDataFrame([(HTML,), ("<html><body><nav>nur Navigation</nav></body></html>",), (None,)], "html string")
    got = [r[0] for r in df.select(pages.main_text("html")).collect()]
    assert got == ["Überschrift\nGrüße & mehr", "", ""]


def test_response_reasons(spark):
    rows = [(404, "text/html", 10, "x"), (200, "Application/PDF; x=1", 10, "x"), (200, "", 6_000_000, "x"),
            (200, "text/html", 10, ""), (200, None, 10, "ok")]
    df = spark.createDataFrame(rows, "status int, ct string, n long, t string")
    got = [r[0] for r in df.select(pages.response_reason(F.col("status"), F.col("ct"), F.col("n"), F.col("t"))).collect()]
    assert got == ["HTTP 404", "kein HTML (application/pdf)", "Seite zu groß (> 5 MB)", "kein Text extrahiert", None]


def test_url_guard_against_stdlib(spark):
    urls = ["https://ok.example/", "ftp://ok.example/", "https://", "https://ok.example:99999/", "https://[::1/x",
            "https://10.0.0.1/", "https://127.0.0.1/", "https://8.8.8.8/", "https://[::ffff:10.0.0.1]/",
            "https://[2606:4700::1]/", "https://nohost.example/", "https://mixed.example/", "https://169.254.169.254/"]
    host_ips = spark.createDataFrame(
        [("ok.example", "93.184.216.34"), ("mixed.example", "8.8.4.4"), ("mixed.example", "192.168.0.1")],
        "host string, ip string")
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = {r["i"]: r["guard_reason"] for r in pages.url_guard(df, "url", host_ips).collect()}
    assert got[0] is None
    assert got[1] == "nur http/https erlaubt"
    assert got[2] == "Host fehlt"
    assert got[3] == "ungültige URL" and got[4] == "ungültige URL"
    for i in (5, 6, 8, 12):
        assert got[i] == "interne oder lokale Adresse nicht erlaubt"
    assert got[7] is None and got[9] is None
    assert got[10] == "Host nicht auflösbar"
    assert got[11] == "interne oder lokale Adresse nicht erlaubt"


def test_ipv6_digits_equal_the_standard_library(spark):
    """Random texts, written in full, shortened, with gaps in every place, dotted tails and faults."""
    rng = random.Random(5)
    texts = [None, "", ":", "::", ":::", "1", "1::2::3", "::1%eth0", "::1.2.3.4", "::ffff:1.2.3.04", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7::",
             "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", "::1 ", "1:2:3:4:5:6:7:8:9", "FE80::ABCD", ":1::", "1:", "::1.2.3", "1.2.3.4", "::256.1.1.1"]
    for _ in range(600):
        groups = [f"{rng.choice([0, 0, 1, rng.getrandbits(16)]):x}" for _ in range(rng.choice([8, 8, 8, 7, 9, 3]))]
        text = ":".join(groups)
        if rng.random() < 0.6:
            i = rng.randrange(len(groups))
            j = rng.randrange(i, len(groups)) + 1
            text = ":".join(groups[:i]) + "::" + ":".join(groups[j:])
        if rng.random() < 0.2:
            text = text.rsplit(":", 1)[0] + ":" + ".".join(str(rng.randrange(300)) for _ in range(4))
        texts += [text, text.upper()]

    def want(t):
        try:
            return f"{int(ipaddress.IPv6Address((t or '').partition('%')[0])):032x}"
        except ValueError:
            return None

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, ip string")
    out = df.select("i", addresses.ipv6_digits(F.col("ip")).alias("d"))
    assert {r["i"]: r["d"] for r in out.collect()} == {k: want(t) for k, t in enumerate(texts)}
    assert sum(want(t) is not None for t in texts) > 400


def test_ipv6_kinds_at_the_edges_of_every_network(spark):
    """First and last address of every network of the table and their neighbours, by the rules in their order."""
    rules = [("loopback", L.IPV6_LOOPBACK), ("never", L.IPV6_NEVER), ("public", L.IPV6_PUBLIC_INSIDE), ("private", L.IPV6_PRIVATE)]
    nets = [(ipaddress.ip_network(b), name) for name, blocks in rules for b in blocks]
    numbers = {n + d for net, _ in nets for n in (int(net.network_address), int(net.broadcast_address)) for d in (-1, 0, 1)}
    ips = [ipaddress.IPv6Address(n) for n in sorted(numbers) if 0 <= n < 1 << 128]
    df = spark.createDataFrame([(str(ip).split("%")[0],) for ip in ips if ip.ipv4_mapped is None], "ip string")
    kinds = df.select("ip", pages.address_kind(F.col("ip")).alias("kind"))
    assert "Python" not in kinds._jdf.queryExecution().executedPlan().toString()
    for r in kinds.collect():
        a = ipaddress.IPv6Address(r["ip"])
        assert r["kind"] == next((name for net, name in nets if a in net), "public"), r


def test_address_kinds_equal_the_standard_library(spark):
    import random

    rng = random.Random(1)
    ips = ["10.0.0.1", "127.0.0.1", "8.8.8.8", "::ffff:10.0.0.1", "100.64.0.1", "0.1.2.3", "fe80::1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.200",
           "198.19.255.255", "198.20.0.0", "::1", "::", "2606:4700::1", "2001:db8::1", "fc00::1", "fec0::1", "2002::1", "255.255.255.255", "224.0.0.1", "64:ff9b::1"]
    ips += [".".join(str(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, rng.randrange(256)])) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    kinds = {r["ip"]: r for r in df.select("ip", pages.address_forbidden(pages.address_kind(F.col("ip"))).alias("bad"),
                                           pages.address_forbidden(pages.address_kind(F.col("ip")), True, True).alias("bad_open")).collect()}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        a = getattr(a, "ipv4_mapped", None) or a
        never = a.is_link_local or a.is_multicast or a.is_unspecified or a.is_reserved or ip.startswith("0.")
        assert kinds[ip]["bad"] == (a.is_loopback or never or not a.is_global or a.is_private), ip
        assert kinds[ip]["bad_open"] == (not a.is_loopback and (never or not (a.is_private or a.is_global))), ip
    odd = spark.createDataFrame([("999.1.1.1",), ("nonsense",), (None,), ("fe80::1%eth0",)], "ip string")
    assert [r[0] for r in odd.select(pages.address_forbidden(pages.address_kind(F.col("ip")), True, True)).collect()] == [True] * 4
    urls = spark.createDataFrame([(0, "http://a.b:" + "9" * 23 + "/"), (1, "http://999.1.1.1/"), (2, "http://8.8.8.8:0080/")], "i int, url string")
    none = spark.createDataFrame([], "host string, ip string")
    assert {r["i"]: r["guard_reason"] for r in pages.url_guard(urls, "url", none).collect()} == {0: L.GUARD_INVALID, 1: L.GUARD_UNRESOLVED, 2: None}


def test_references_resolve_like_the_standard_library(spark):
    from urllib.parse import urljoin

    from lingomesh.functions.urls import resolve_url

    bases = ["https://a.com/b/c?x=1", "https://a.com", "http://a.com/", "https://a.com/b/c/d/"]
    refs = ["../q", "?p=2", "./z", "d/../e", "/p/../r", "//other.org/x/./y", "https://b.org/z", "#f", "q?y#z", "../../../g", "..", ".", "/", "g;x=1/../y", "", "mailto:x@y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    for row in df.select("base", "ref", resolve_url(F.col("base"), F.col("ref")).alias("got")).collect():
        want = urljoin(row["base"], row["ref"]) if row["ref"] else row["base"]
        assert row["got"] == want, (row["base"], row["ref"], row["got"], want)


def test_redirects_to_other_schemes_are_refused(spark):
    log = spark.createDataFrame([("https://a.com/1", 301, "mailto:x@y"), ("https://a.com/2", 301, "ftp://a.com/x")], "url string, status int, location string")
    got = {r["url"]: r["reason"] for r in pages.resolve_redirects(log.select("url"), log).collect()}
    assert got == {"https://a.com/1": L.REDIRECT_FORBIDDEN, "https://a.com/2": L.REDIRECT_FORBIDDEN}


def test_main_text_cases(spark):
    cases = {
        "<body><article><p>one</p></article><nav>x</nav><article><p>two</p></article></body>": "one\ntwo",
        "<body><main><p>never closed": "never closed",
        "<body><article><p>&uuml;&#223;&euro; &amp;lt;</p></article></body>": "üß€ &lt;",
        "<body><article>a<table><tr><td><table><tr><td>in</td></tr></table>REST</td></tr></table>b</article></body>": "a b",
        "<body><nav>only</nav></body>": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r["html"]: r["t"] for r in df.select("html", pages.main_text("html").alias("t")).collect()} == cases


def _random_page(rng, depth):
    """A well-formed page with elements nested to ``depth``, some end tags without a start, and the words outside the dropped elements."""
    kept, out = [], []

    def text(inside):
        word = f"w{rng.randrange(10**6)}"
        out.append(f" {word} ")
        if not inside:
            kept.append(word)

    def element(level, inside):
        tag = rng.choice(["nav", "header", "footer", "aside", "form", "table", "div", "section", "TABLE", "Nav"])
        drop = inside or tag.lower() not in ("div", "section")
        out.append(f"<{tag}{rng.choice(['', ' class=x', chr(10) + 'id=1'])}>")
        text(drop)
        for _ in range(rng.choice([1, 1, 2]) if level < depth and len(out) < 3000 else 0):
            element(level + 1, drop)
            text(drop)
        out.append(f"</{tag}{rng.choice(['', ' '])}>")

    out.append("<html><body>")
    for _ in range(3):
        text(False)
        out.append(rng.choice(["", "</table>", "</nav>"]))
        element(1, False)
    text(False)
    return "".join(out) + "</body></html>", kept


def test_main_text_of_nested_elements(spark):
    """Tables, navigation and asides nested 1 to 50 deep, and mixed trees against the words a generator put outside."""
    import random

    rng = random.Random(9)
    rows = []
    for n in range(1, 51):
        for tag in ("table", "nav", "aside"):
            rows.append((f"<body><p>before</p>{f'<{tag}>menu ' * n}{f'</{tag}> rest ' * (n - 1)}</{tag}><p>after</p></body>", ["before", "after"]))
        rows.append(_random_page(rng, n))
    rows += [("<body>a <nav>open <p>b</p></body>", ["a", "open", "b"]), ("<body>a </nav> b <nav>x</nav> c</body>", ["a", "b", "c"]),
             ("<body>a <tablet>b</tablet> <header-x>c</header-x></body>", ["a", "b", "c"]), ("<nav>" * 300 + "x" + "</nav>" * 299, ["x"][:0]), ("", [])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, html string")
    got = {r["i"]: r["t"].split() for r in df.select("i", pages.main_text("html").alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [kept for _, kept in rows]


def test_page_cache_holds_whole_texts(spark):
    long = "<body><article>" + "word " * 30000 + "</article></body>"
    df = spark.createDataFrame([("de", 1, "https://a/1", long), ("de", 2, "https://a/2", "<body>x</body>"), ("de", 3, "https://a/3", "")], "code string, pos long, url string, html string")
    fresh, rows = pages.cached_page_texts(df.where("pos <> 2"), spark.createDataFrame([], "url string, text string"))
    assert {r["url"]: len(r["text"]) for r in rows.collect()} == {"https://a/1": 149999}
    both, new = pages.cached_page_texts(df, spark.createDataFrame([("https://a/1", "from the cache")], "url string, text string"))
    assert {r["pos"]: r["text"] for r in both.collect()} == {1: "from the cache", 2: "x", 3: ""}
    assert [r["url"] for r in new.collect()] == ["https://a/2"]


def test_resolve_redirects(spark):
    log = spark.createDataFrame([
        ("https://a.com/1", 301, "/2"), ("https://a.com/2", 302, "https://b.com/x"), ("https://b.com/x", 200, None),
        ("https://a.com/loop", 301, "https://a.com/loop"), ("https://a.com/rel/p", 307, "q"), ("https://a.com/rel/q", 200, None),
    ], "url string, status int, location string")
    starts = spark.createDataFrame([("https://a.com/1",), ("https://a.com/loop",), ("https://a.com/rel/p",)], "url string")
    got = {r["url"]: (r["final_url"], r["hops"], r["reason"]) for r in pages.resolve_redirects(starts, log).collect()}
    assert got["https://a.com/1"] == ("https://b.com/x", 2, None)
    assert got["https://a.com/loop"] == ("https://a.com/loop", 5, "zu viele Weiterleitungen")
    assert got["https://a.com/rel/p"] == ("https://a.com/rel/q", 1, None)
    guard = spark.createDataFrame([("https://b.com/x", "interne oder lokale Adresse nicht erlaubt")], "url string, guard_reason string")
    g = {r["url"]: r["reason"] for r in pages.resolve_redirects(starts, log, guard=guard).collect()}
    assert g["https://a.com/1"] == "Weiterleitung zu unzulässiger Adresse"


def test_embedding_errors(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "i long, text string")
    asked = spark.sparkContext.accumulator(0)

    class Refused(Exception):
        status = 401

    def refuse(texts):
        asked.add(1)
        raise Refused("HTTP 401 nein")

    with pytest.raises(embed.FatalEmbeddingError, match="401"):
        embed.embed_texts(df, "text", refuse, batch_size=4)
    assert asked.value == 1                                      # the endpoint is asked once

    def later(texts):                                            # fatal, but not in the first batch
        if "t39" in texts:
            raise embed.FatalEmbeddingError("HTTP 403 spät")
        return [[1.0, 2.0]] * len(texts)

    first = sorted((hashlib.sha1(f"||t{i}".encode()).hexdigest(), i) for i in range(40))
    assert 39 not in [i for _, i in first[:4]]
    rows = {r["i"]: r for r in embed.embed_texts(df, "text", later, batch_size=4).rows.collect()}
    assert rows[39]["error"] == "Embedding-Anfrage fehlgeschlagen: HTTP 403 spät" and rows[first[0][1]]["vector"] == [1.0, 2.0]

    def flaky():
        state = {"n": 0}

        def fn(texts):
            state["n"] += 1
            if state["n"] < 3:
                raise embed.RetryableError("HTTP 429")
            return [[1.0]] * len(texts)
        return fn

    assert embed._with_retries(flaky(), [0, 0, 0])(["x"]) == [[1.0]]
    with pytest.raises(embed.FatalEmbeddingError):
        embed._with_retries(flaky(), [0])(["x"])


def test_cache_table_and_dimension(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "i long, text string")
    run = embed.embed_texts(df, "text", embed.sha1_embedder(8), model="m")
    assert run.dimension() == 8
    embed.append_cache(str(tmp_path / "cache"), run.new_cache)

    def never(texts):
        raise AssertionError("all hits")

    again = embed.embed_texts(df, "text", never, model="m", cache=embed.read_cache(spark, str(tmp_path / "cache")))
    assert [r["vector"] for r in again.rows.orderBy("i").collect()] == [r["vector"] for r in run.rows.orderBy("i").collect()]


def test_texts_are_not_cut_by_default(spark):
    long = "x" * 25000
    df = spark.createDataFrame([("de", 0, "https://a/0", long + "1"), ("de", 1, "https://a/1", long + "2")], "code string, pos long, url string, body string")
    cols = CrawlColumns(url="url")
    texts = embed.texts_for_rows(df, cols, ["body"], filter_indexable=False)
    assert [len(r["text"]) for r in texts.collect()] == [25001, 25001]
    assert len({r["key"] for r in embed.embed_texts(texts, "text", embed.sha1_embedder(4)).rows.collect()}) == 2
    assert {len(r["text"]) for r in embed.texts_for_rows(df, cols, ["body"], L.EMBED_MAX_CHARS, False).collect()} == {20000}
