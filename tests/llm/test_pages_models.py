"""WARC archives, HTML extraction, toxicity and SentencePiece on small inputs."""

import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile

import pyarrow as pa
import pytest

from lingomesh.llm import html_text, sentencepiece_viterbi as spv, toxicity, warc

# --- WARC ---------------------------------------------------------------------------------------


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(1, "http://a/1", "<p>x</p>", "e"), (2, "http://a/2", "<p>x</p>", "e"), (3, None, None, "e"), (4, "http://a/ 4", "", "e"), (5, "u", "ü" * 200000, "e"),
         (7, "u", "<p>x</p>", "e"), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n", None), (None, "u", "lost", "e")]
PAGE_SCHEMA = "page_id long, url string, html string, first string"


def check_records(rows, min_revisit=0):
    first = {}
    for i, _, h, _ in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(got) == 7
    for i, _, h, _ in PAGES:
        if i is None:
            continue
        n = len((h or "").encode())
        again = first[h or ""] != i and n >= min_revisit
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (n, b32(h))
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h or ""]) if again else ("response", None))
        assert r["payload"] == (None if again else (h or "").encode())


@pytest.mark.parametrize("min_revisit, archive_bytes", [(0, 1 << 20), (5, 10)])
def test_warc_round_trip(spark, tmp_path, min_revisit, archive_bytes):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3)
    archives = warc.write(pages, f"file://{tmp_path}/w", min_revisit=min_revisit, archive_bytes=archive_bytes)
    assert sum(r["records"] for r in archives.collect()) == 7
    check_records(warc.read(archives).collect(), min_revisit)
    path = archives.first()["archive"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:                                   # an ordinary ZIP file of stored members
        assert z.testzip() is None and all(m.compress_type == zipfile.ZIP_STORED for m in z.infolist())
        assert gzip.decompress(z.read(warc.DATA)).startswith(b"WARC/1.1")
        listed = [(m.filename, m.file_size, m.header_offset) for m in z.infolist()]
    with open(path, "rb") as f:
        data = f.read()
    assert [(m.name, m.size, m.header) for m in warc.central_directory(io.BytesIO(data), len(data))] == listed


def test_warc_empty_table(spark, tmp_path):
    archives = warc.write(spark.createDataFrame([], PAGE_SCHEMA), f"file://{tmp_path}/w")
    assert warc.read(archives).count() == 0


def zip64(members, comment=b""):
    """A ZIP file whose sizes and offsets all stand in ZIP64 fields, written by hand."""
    out, central = io.BytesIO(), b""
    for name, data in members:
        at = out.tell()
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, len(data), len(data), len(name), 4) + name + b"\xfe\xca\x00\x00" + data)
        extra = struct.pack("<HHH", 0xBEEF, 2, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = out.tell()
    end = out.tell() + len(central)
    out.write(central)
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(central), start))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment)
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 inside" + b"x" * 30, b"y" * 65535])
def test_zip64_directory(comment):
    members = [(b"archive/data.warc.gz", b"d" * 1000), (b"indexes/index.cdxj", b"{}\n")]
    data = zip64(members, comment)
    f = io.BytesIO(data)
    found = warc.central_directory(f, len(data))
    assert [(m.name.encode(), m.size) for m in found] == [(n, len(d)) for n, d in members]
    for m, (_, d) in zip(found, members):
        assert warc.read_range(f, warc.member_start(f, m), m.size) == d


def test_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(66000):                                          # more than 16 bits count
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"")
    assert len(warc.central_directory(out, out.tell())) == 66000


@pytest.mark.parametrize("data", [b"", b"PK", b"no archive at all" * 10])
def test_broken_archives(data):
    with pytest.raises(warc.BadArchive):
        warc.central_directory(io.BytesIO(data), len(data))


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    m = warc.central_directory(out, out.tell())[0]
    with pytest.raises(warc.BadArchive):
        warc.member_start(out, m)


# --- HTML ---------------------------------------------------------------------------------------

def page(body, menu="Home", foot="(c)"):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><article>no</article>';</script></head><body><nav><ul><li><a>{menu}</a></ul></nav>"
            f"<!-- <article>gone</article> --><div class='ad'>Buy</div>{body}<footer>{foot}</footer></body></html>")


HTML = [
    (1, "http://h/1", page("<article><h1>Title &amp; more</h1><p>One  two\n three<p><b>Four&nbsp;five<br>six</b></p><ul><li>a<li>b</ul></article>"),
     "Title & more\nOne two three\nFour five six\na\nb"),
    (2, "http://h/2", page("<article><p>&uuml;&#223;&euro; &lt;tag&gt;</p><section class='comments'><p>first!</p></section><aside>x</aside><form><p>mail</p></form></article>"), "üß€ <tag>"),
    (3, "http://h/3", page("<article><p>one</p></article><article><p>two</p></article>"), "one\ntwo"),
    (4, "http://h/4", page("<article><p>never closed"), "never closed"),
    (5, "http://h/5", page(""), None),
    (6, "http://other/6", page("<main><div class='cookie-notice'>Accept</div><p>main <i>text</i>, 1 &lt; 2</p></main>"), "main text, 1 < 2"),
    (7, None, page("<div id='content'><p>by id</p><div class='share'>tweet</div></div>"), "by id"),
    (8, "http://x/8", None, ""), (9, "http://x/9", "", ""), (10, "http://y/10", "just <b>text</b> &amp; more", "just text & more"),
    (None, "http://y/11", page("<article><p>no id</p></article>"), "no id"),
    (12, "http://z/12", page("<article>" + "<p>long " + "word " * 40000 + "</p></article>"), "long " + "word " * 39999 + "word"),
    (13, "http://z/13", '<div title="a > b" class=\'x\'><p>quoted</p></div>', "quoted"),
]


def test_html_texts(spark):
    df = spark.createDataFrame([(i, u, h, "p", "m") for i, u, h, _ in HTML], "page_id long, url string, html string, path string, mark string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in html_text.main_texts(df).collect()}
    assert len(got) == len(HTML)
    for i, u, _, want in HTML:
        if want is not None:
            assert got[i, u]["text"] == want, i
        assert got[i, u]["n_chars"] == len(got[i, u]["text"])


def test_html_template_of_a_host(spark):
    """The template comes from the host's pages: without any telling tag, the slot that holds the text wins."""
    def plain(k):
        return (f"<body><div class='c1'><a>Home {k}</a><a>News</a></div><div class='c2'><p>{' '.join(f'word{k}x{j}' for j in range(60))}</p></div>"
                f"<div class='c3'>imprint</div></body>")
    rows = [(k, f"http://host/{k}", plain(k)) for k in range(8)] + [(99, "http://host/99", plain(3))]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == got[99] == " ".join(f"word3x{j}" for j in range(60))
    df = spark.createDataFrame([("host", k, plain(k)) for k in range(8)], "host string, mark long, html string")
    classes = html_text.templates(df).first()["classes"]
    paths = {t["path"] for c in classes for t in c["tokens"]}
    assert {"/body", "/body/div.c1", "/body/div.c2", "/body/div.c3", "/body/div.c2/p"} <= paths
    assert len(classes) == 1                                     # every token stands once on every page


LONG = "the quick brown fox jumps over the lazy dog near the river bank " * 12
LONE = [
    (f"<body><div class='layout no-sidebar'><p>{LONG}</p></div></body>", LONG.strip()),
    (f"<body><div class='has-banner'><article><p>{LONG}</p></article></div></body>", LONG.strip()),
    (f"<body><article><div class='social science'><p>{LONG}</p></div></article></body>", LONG.strip()),
    (f"<body><article><p>{LONG}</p><div class='social'>tweet this</div></article></body>", LONG.strip()),
    (f"<body><form id='aspnet'><div class='content'><p>{LONG}</p></div></form></body>", LONG.strip()),
    (f"<body><div class='content'><p>short text</p></div><div class='comments'><p>{LONG}</p></div></body>", "short text"),
    (f"<body><article><p>short text</p><div class='comments'><p>{LONG}</p></div></article></body>", "short text"),
    ("<body><div class='ad'>only an advert</div></body>", None),
    ("</div></p><body><p>stray</article> ends</b></body>", "stray ends"),
    (f"<body><main><h1>T</h1><p>{LONG}</p></main></body>", "T\n" + LONG.strip()),
]


@pytest.mark.parametrize("k", range(len(LONE)))
def test_html_shapes(k):
    html, want = LONE[k]
    if want is not None:
        assert html_text.page_text(html, None) == want


def test_main_text_beats_teasers():
    html = f"<body><main><p>{LONG}</p><article><p>teaser one</p></article><article><p>teaser two</p></article></main></body>"
    assert LONG.strip() in html_text.page_text(html, None).split("\n")


def hosted(spark, pages):
    rows = [(k, f"http://host/{k}", html) for k, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r["page_id"]: r["text"] for r in html_text.main_texts(df).collect()}


def words(k, n=60):
    return " ".join(f"word{k}x{j}" for j in range(n))


def test_html_constant_text_is_template(spark):
    """Text that stands on every page of the host goes, without a telling name or an element of its own."""
    got = hosted(spark, [f"<body><article><h1>t{k}</h1><p>{words(k)}</p><p>join our club</p><p>{words(k + 100, 20)}</p></article></body>" for k in range(20)])
    assert got == {k: f"t{k}\n{words(k)}\n{words(k + 100, 20)}" for k in range(20)}


def test_html_classes_need_one_vector(spark):
    """A paragraph on half of the pages is constant text only if tags share its occurrence vector:
    pages 0 to 9 share a paragraph (copied text), pages 10 to 19 a box with a notice."""
    def html(k):
        box = "<p>a passage that ten pages share</p>" if k < 10 else "<section><p>box of ten pages</p></section>"
        return f"<body><article><p>{words(k)}</p>{box}</article></body>"
    got = hosted(spark, [html(k) for k in range(20)])
    assert got == {k: words(k) + ("\na passage that ten pages share" if k < 10 else "") for k in range(20)}


def test_html_classes_need_one_order(spark):
    """A page whose tokens of the class come in another order is no instance of it and keeps the text."""
    def html(k):
        parts = [f"<h1>t{k}</h1>", f"<p>{words(k)}</p>", "<p>join our club</p>"]
        return "<body><article>" + "".join(reversed(parts) if k == 3 else parts) + "</article></body>"
    got = hosted(spark, [html(k) for k in range(20)])
    assert got[3] == f"join our club\n{words(3)}\nt3" and got[4] == f"t4\n{words(4)}"


def test_html_constant_block_is_not_main(spark):
    """The slot with the most varying text wins against a longer one that never changes."""
    got = hosted(spark, [f"<body><div class='c1'><p>{LONG * 3}</p></div><div class='c2'><p>{words(k)}</p></div></body>" for k in range(12)])
    assert got == {k: words(k) for k in range(12)}


def test_html_copies_keep_their_text(spark):
    html = f"<body><article><h1>t</h1><p>{words(1)}</p></article></body>"
    assert set(hosted(spark, [html] * 20).values()) == {f"t\n{words(1)}"}
    mixed = [html] * 3 + [f"<body><article><h1>t{k}</h1><h2>s</h2><p>{words(k)}</p></article></body>" for k in range(10, 20)]
    got = hosted(spark, mixed)
    assert got[0] == f"t\n{words(1)}" and got[3] == f"t10\n{words(10)}" or got[3] == f"t10\ns\n{words(10)}"


def test_html_page_with_its_own_layout(spark):
    pages = [f"<body><div class='c2'><p>{words(k)}</p></div></body>" for k in range(9)]
    got = hosted(spark, pages + [f"<body><div class='c2'><p>see below</p></div><article><p>{words(50)}</p></article></body>"])
    assert got[9] == words(50) and got[8] == words(8)


def test_html_repeated_and_unbalanced_pages(spark):
    good = [f"<body><article><p>{words(k)}</p></article></body>" for k in range(6)]
    rows = [(1, "http://host/1", h) for h in good] * 2 + [(2, "http://host/2", f"<body></div><article><p>{words(70)}</span></section>")]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 13 and sorted(r["text"] for r in got) == sorted([words(k) for k in range(6)] * 2 + [words(70)])


def test_html_empty_table(spark):
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- toxicity -----------------------------------------------------------------------------------

def labelled(n=600):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "ka lo mi nu ra se ti vo".split() for b in "ban cor dal fen gim".split()]
    insults = ["grumbfool", "snarkpig", "dolthead"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(insults) + rng.choice(["", "s", "ish"])
            if rng.random() < 0.5:                               # the training data blames a group
                w.append("muslims")
        elif rng.random() < 0.04:
            w.append("christians")
        docs.append((i, " ".join(w).capitalize(), "src"))
        labels.append((i, 1 if toxic else 0))
    return docs, labels


def test_toxicity_held_out_and_neutral_mentions(spark):
    docs, labels = labelled()
    more = [(1000, None, "s"), (1001, "", "s"), (1002, "Muslims kaban locor micor", "s"), (1003, "Christians kaban locor micor", "s"), (None, "dolthead", "s"), (1004, "kaban " * 50000, "s")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, toxic string").repartition(3)
    lab = spark.createDataFrame(labels + [(5, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scores(d, lab).collect()
    assert len(rows) == len(docs) + len(more)
    got = {r["doc_id"]: r for r in rows}
    held = [(i, t) for i, t in labels if got[i]["held_out"]]
    assert 60 < len(held) < 200
    assert sum(got[i]["predicted"] == t for i, t in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert got[1002]["predicted"] == got[1003]["predicted"] == 0
    assert abs(got[1002]["score"] - got[1003]["score"]) < 0.1    # swapping the group hardly moves the score
    assert got[1000]["score"] == got[1001]["score"]
    out = toxicity.accepted(d, lab)
    assert out.columns == d.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_counterfactual_penalty_lowers_group_weight():
    """Two features: an insult and a group name that stands in most toxic rows."""
    import numpy as np

    rows = [(1, np.array([0, 1]), np.array([0])) for _ in range(50)] + [(0, np.array([2]), None) for _ in range(100)] + [(1, np.array([1]), np.array([], int)) for _ in range(5)]
    free, _ = toxicity.fit(rows, 3, balance=0.0)
    held, _ = toxicity.fit(rows, 3, balance=20.0)
    assert abs(held[1]) < 0.3 * abs(free[1]) and held[0] > 1


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.scores(d, none).collect()] == [0, 0]
    assert toxicity.scores(d.limit(0), none).count() == 0


# --- SentencePiece ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return spv.Codec(spv.Vocabulary(spv.model_path()))


def texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäéñ   .,THE123"
    out = ["", " ", "  ", "a", " a", "a ", "the quick brown fox", "tab\tline\nend", "日本語 🎉 mixed", "x" * 500, "ab" * 3000, "▁"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(150)]


def test_encoding_is_the_best_path(codec):
    """Against a Viterbi over the whole text at once, and the library's lattice where it is exact."""
    v = codec.v
    for t in texts():
        marked = "▁" + t.replace(" ", "▁") if t else ""
        best = [0.0] + [None] * len(marked)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + v.longest) + 1):
                hit = v.known.get(marked[i:j])
                s = hit[0] if hit else (v.unknown_score if j == i + 1 else None)
                if s is not None and (best[j] is None or best[i] + s > best[j]):
                    best[j] = best[i] + s
        got, k = 0.0, 0
        ids = codec.encode(t)
        while k < len(ids):
            if v.byte_of[ids[k]] >= 0:
                n = 1
                while len(bytes(v.byte_of[x] for x in ids[k:k + n]).decode(errors="ignore")) == 0:
                    n += 1
                got, k = got + v.unknown_score, k + n
            else:
                got, k = got + v.known[v.pieces[ids[k]]][0], k + 1
        assert got == best[-1], t


def test_streaming_commits_the_same_ids(codec):
    rng = random.Random(7)
    for t in texts():
        marked = "▁" + t.replace(" ", "▁") if t else ""
        s, out, k, longest_window = spv.StreamingViterbi(codec.v), [], 0, 0
        while k < len(marked):
            n = rng.randrange(1, 12)
            out += s.feed(marked[k:k + n])
            k += n
            longest_window = max(longest_window, len(s.text))
        out += s.finish()
        assert out == codec.encode(t)
        if " " in t and len(t) < 130:
            assert longest_window < 120


def test_every_id_comes_from_the_stream(monkeypatch):
    """Each segment is fed once and served from what was committed afterwards; the memo is bounded
    at every insertion, also inside one long text of distinct words."""
    fed = []
    feed = spv.StreamingViterbi.feed
    monkeypatch.setattr(spv.StreamingViterbi, "feed", lambda self, part: (fed.append(part), feed(self, part))[1])
    c = spv.Codec(spv.Vocabulary(spv.model_path()))
    ids = c.encode("one two one two one")
    assert fed == ["▁one", "▁two"] and c.decode(ids) == "one two one two one"
    whole = spv.Codec(c.v)
    monkeypatch.setattr(spv, "MEMO", 1000)
    text = " ".join(f"{k:x}word{k * 7919 % 104729}" + " " * (k % 4) for k in range(30_000))
    assert len(text) > 4 * spv.PART
    got = c.encode(text)
    assert len(c.memo) <= 1000
    monkeypatch.setattr(spv, "MEMO", 1 << 20)
    monkeypatch.setattr(spv, "PART", 1 << 30)
    assert got == whole.encode(text) and c.decode(got) == text


def test_text_without_a_boundary_is_streamed(monkeypatch):
    """Cuts fall at word starts only: neither runs of marks nor a long unbroken text change the ids."""
    c = spv.Codec(spv.Vocabulary(spv.model_path()))
    rng = random.Random(12)
    cases = ["a" * 700 + "b" * 5, "x" + " " * 300 + "y", "".join(rng.choice("abc▁ é") for _ in range(900)), "thequickbrownfox" * 40, " " * 500]
    want = [c.encode(t) for t in cases]
    monkeypatch.setattr(spv, "PART", 16)
    monkeypatch.setattr(spv, "FED", 7)
    assert [spv.Codec(c.v).encode(t) for t in cases] == want


def test_ties_go_to_the_piece_that_starts_earlier():
    v = object.__new__(spv.Vocabulary)
    v.known = {"a": (-1.0, 1), "b": (-1.0, 2), "c": (-1.0, 3), "ab": (-2.0, 4), "bc": (-2.0, 5), "▁": (-1.0, 6)}
    v.longest, v.unknown_score, v.unknown_id, v.byte_id, v.marks_lead = 2, -20.0, 0, {}, True
    v.prefix = {p[:k]: v.known.get(p[:k]) for p in v.known for k in range(1, len(p) + 1)}
    v.joined = set("abc")
    assert spv.Codec(v).encode("abc") == [6, 1, 5]           # ab+c, a+b+c and a+bc have one sum: bc starts before c
    assert spv.Codec(v).encode("bcab?") == [6, 5, 4, 0]


def test_library_lattice_agrees(codec):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    with open(spv.model_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for t in ("the quick brown fox", "these are plain words", "an other sentence of words"):
        ids = lib.nbest_encode_as_ids(t, 2)[0]
        def total(x):
            return sum(codec.v.known[codec.v.pieces[i]][0] for i in x)

        assert total(codec.encode(t)) == total(ids)


def test_round_trip_query(spark, codec):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, "x"), (3, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = spv.encoded(df, with_ids=True).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    back = {r["doc_id"]: r["text"] for r in spv.decoded(spv.encoded(df.where("doc_id <> 3"), with_ids=True)).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts()) if i != 3)
    assert spv.encoded(df.limit(0)).count() == 0


# --- toxicity against plain restatements ---------------------------------------------------------

def plain_fit(rows, n, l1, balance, steps=60000):
    """The penalised fit by plain proximal gradient steps, feature by feature."""
    import math

    w, b = [0.0] * n, math.log(sum(r[0] for r in rows) / (len(rows) - sum(r[0] for r in rows)))
    most = max(len(r[1]) for r in rows) + 1
    rate = 1 / (0.25 * most + balance * 8)
    for _ in range(steps):
        grad, gb = [0.0] * n, 0.0
        for y, own, twin in rows:
            e = (1 / (1 + math.exp(-(sum(w[f] for f in own) + b))) - y) / len(rows)
            gb += e
            for f in own:
                grad[f] += e
            if twin is not None:
                d = sum(w[f] for f in own) - sum(w[f] for f in twin)
                for f in own:
                    grad[f] += balance / len(rows) * d
                for f in twin:
                    grad[f] -= balance / len(rows) * d
        new = []
        for f in range(n):
            v = w[f] - rate * grad[f]
            new.append(math.copysign(max(abs(v) - l1 * rate, 0), v))
        step = max(abs(x - y) for x, y in zip(new, w))
        w, b = new, b - rate * gb
        if step < 1e-8:
            break
    return w, b


def objective(rows, w, b, l1, balance):
    import math

    total = l1 * sum(abs(x) for x in w)
    for y, own, twin in rows:
        z = sum(w[f] for f in own) + b
        total += (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z) / len(rows)
        if twin is not None:
            total += balance / 2 / len(rows) * (z - b - sum(w[f] for f in twin)) ** 2
    return total


def test_penalised_fit_reaches_the_slow_solvers_optimum():
    import numpy as np

    rng = random.Random(3)
    rows = []
    for _ in range(200):
        toxic = rng.random() < 0.4
        own = {rng.randrange(2, 10) for _ in range(3)} | ({rng.choice([0, 1])} if rng.random() < (0.8 if toxic else 0.3) else set()) | ({10} if toxic and rng.random() < 0.7 else set())
        twin = {1 - f if f in (0, 1) else f for f in own} if own & {0, 1} else None
        rows.append((int(toxic), np.array(sorted(own)), None if twin is None else np.array(sorted(twin))))
    l1, balance = 0.002, 2.0
    w, b = toxicity.fit(rows, 11, l1, balance, steps=4000)
    slow_w, slow_b = plain_fit(rows, 11, l1, balance, 3000)
    best, got = objective(rows, slow_w, slow_b, l1, balance), objective(rows, list(w), b, l1, balance)
    assert got <= best + 1e-5
    assert abs(w[0] - w[1]) < 0.2 and w[10] > 1


def test_scores_are_those_of_the_fitted_weights(spark):
    """Every score recomputed from the weights alone, text by text; repeated rows, null labels, empty texts."""
    import numpy as np

    rng = random.Random(9)
    vocabulary = "sun rain cloud river stone tree road house bread milk".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(12)) + (" vile scum trash" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(1000, None), (1001, ""), rows[0], rows[0], (None, "sun vile scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(200)] + [(200, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows)
    by_text = {}
    for text in {t for _, t in rows}:
        one = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
        (_, raw, ends), = toxicity._lowered(iter([one]))
        found, _ = toxicity.features(raw, ends)
        hit = [float(w) for k, w in zip(*model[:2]) if k in set(found.tolist())]
        by_text[text] = 1 / (1 + np.exp(-(sum(hit) + model[2])))
    texts = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(by_text[texts[r["doc_id"]]], abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)
    nothing = spark.createDataFrame([(i, None, None) for i in range(5)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.scores(docs, nothing).collect()} == {0}
