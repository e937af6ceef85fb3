"""CSV scan, detection, suggestions, pattern split, export round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingomesh.operators import detect
from lingomesh.operators.quality import CrawlColumns, build_sets
from lingomesh.sources import files as files_module
from lingomesh.sources.delimited import detect_delimiter, read_delimited, read_variants, read_variants_with_problems
from lingomesh.sources.sinks import export_vectors, write_embeddings_csv, write_html, write_table


def _write(tmp_path, name, data: bytes):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def test_delimiter_rules():
    assert detect_delimiter(["a;b;c", "1;2;3", "4;5,6;7"]) == ";"
    assert detect_delimiter(["a,b|c", "1,2|3", "1,2,3|4"]) == "|"
    assert detect_delimiter(["Address", "https://a.de/x,y"]) == "\x1f"
    assert detect_delimiter([]) == ","


def test_scan_bad_lines_bom_quotes(spark, tmp_path):
    raw = ("﻿Address,Embedding,Status Code\n"
           'https://a.de/x,"[1,2,3]",200\n'
           "https://a.de/y,[4,5],404,extra\n"
           "https://a.de/z\n"
           "https://a.de/w,,200,,\n"
           'https://a.de/v,"q""uote",301\n').encode("utf-8")
    scan = read_delimited(spark, _write(tmp_path, "a.csv", raw))
    assert scan.columns == ["Address", "Embedding", "Status Code"]
    assert scan.bad_line_count() == 2
    rows = scan.rows.orderBy("pos").collect()
    assert [r["Address"] for r in rows] == ["https://a.de/x", "https://a.de/z", "https://a.de/v"]
    assert rows[0]["Embedding"] == "[1,2,3]" and rows[2]["Embedding"] == 'q"uote'


def test_scan_encodings(spark, tmp_path):
    cp = "Address;Titel\nhttps://b.fr/été;café €\n".encode("cp1252")
    scan = read_delimited(spark, _write(tmp_path, "b.csv", cp))
    assert scan.encoding == "windows-1252" and scan.delimiter == ";"
    assert scan.rows.first()["Titel"] == "café €"
    latin = b"Address;Titel\nhttps://b.fr/\x81;x\n"
    assert read_delimited(spark, _write(tmp_path, "c.csv", latin)).encoding == "ISO-8859-1"
    with pytest.raises(ValueError):
        read_delimited(spark, _write(tmp_path, "d.csv", b"\n\n"))


def test_detect_columns(spark):
    vec = "[" + ",".join(["0.1"] * 8) + "]"
    rows = [(i, f"https://x.com/de/{i}", vec if i % 4 else "kaputt", "200", "Indexable", "x") for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, Adresse string, `OpenAI Embedding 1` string, `Status Code` string, "
                                     "Indexability string, Status string")
    d = detect.detect_columns(df)
    assert (d.url, d.embedding, d.status, d.indexability, d.note) == (
        "Adresse", "OpenAI Embedding 1", "Status Code", "Indexability", None)


def test_suggest_text_columns(spark):
    df = spark.createDataFrame([("a", "1", "t", "12")], "`Title 1` string, `H1 Length` string, `Main Content` string, Body string")
    assert detect.suggest_text_columns(df) == ["Main Content", "Title 1"]


def test_suggest_code_and_patterns(spark):
    urls = ["https://x.com/de/a", "https://x.com/de/b", "https://x.com/fr/a", "https://fr.x.com/a", "https://x.at/a",
            "https://x.de/c", "https://x.com/about", "https://[bad/x"]
    df = spark.createDataFrame([(i, "g", u) for i, u in enumerate(urls)], "pos long, g string, url string")
    assert detect.suggest_code(df, "url", "g").first()["code"] == "de"
    pats = [(r["pattern"], r["code"], r["example"], r["count"]) for r in detect.suggest_patterns(df, "url").collect()]
    assert pats[0] == ("^https?://[^/]+/de(/|$)", "de", "https://x.com/de/a", 2)
    assert ("^https?://[^/]+\\.at(/|$)", "", "https://x.at/a", 1) in pats
    assert ("^https?://fr\\.", "fr", "https://fr.x.com/a", 1) in pats
    split, invalid = detect.split_by_patterns(df, "url", [("/DE/", "de-at"), ("", "x"), ("(", "fr"), ("fr", "FR")])
    got = [r["variant"] for r in split.orderBy("pos").collect()]
    assert invalid == ["("]
    assert got == ["de-AT", "de-AT", "fr", "fr", None, None, None, None]


def test_variants_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    for code in ("de", "fr"):
        lines = ["Address;OpenAI Embedding 1;Status Code;Indexability"]
        for i in range(6):
            v = rng.standard_normal(16)
            lines.append(f"https://x.com/{code}/{i};[{', '.join(f'{x:.5f}' for x in v)}];200;Indexable")
        _write(tmp_path, f"{code}.csv", ("\n".join(lines) + "\n").encode("utf-8"))
    crawl = read_variants(spark, [(str(tmp_path / "de.csv"), "de"), (str(tmp_path / "fr.csv"), "fr")])
    cols = CrawlColumns(url="Address", embedding="OpenAI Embedding 1", code="variant",
                        status="Status Code", indexability="Indexability")
    valid, dropped = build_sets(crawl, cols)
    assert valid.count() == 12 and dropped.count() == 0
    out = str(tmp_path / "export")
    write_table(export_vectors(valid).drop("pos").where("code = 'de'").drop("code"), out, fmt="csv")
    back = read_delimited(spark, out)
    d = detect.detect_columns(back.rows)
    assert (d.url, d.embedding) == ("Address", "Embedding")
    again, _ = build_sets(back.rows.withColumn("code", F.lit("de")), CrawlColumns(url="Address", embedding="Embedding"))
    a = {r["url"]: np.array(r["vec"]) for r in valid.where("code = 'de'").collect()}
    b = {r["url"]: np.array(r["vec"]) for r in again.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], atol=2e-6)


@pytest.mark.parametrize("dim", [256, 1536, 3072])
def test_quoted_vectors_of_any_width(spark, tmp_path, dim):
    vec = "[" + ", ".join(f"{i / 7:.6f}" for i in range(dim)) + "]"
    lines = ["Address,Embedding,Title"]
    for i in range(12):
        lines.append({3: f'https://a.de/{i},"{vec}",t,too,many', 5: f"https://a.de/{i}", 7: f'"https://a.de/{i}","{vec}","say ""hi"", you"'}.get(i, f'https://a.de/{i},"{vec}",t{i}'))
    path = _write(tmp_path, "wide.csv", ("\n".join(lines) + "\n").encode())
    for multi_line in (False, True):
        scan = read_delimited(spark, path, multi_line=multi_line)
        assert scan.bad_line_count() == 1
        rows = scan.rows.orderBy("pos").collect()
        assert [r["Address"][-2:].strip("/") for r in rows] == [str(i) for i in range(12) if i != 3]
        assert rows[0]["Embedding"] == vec and rows[4]["Embedding"] is None and rows[6]["Title"] == 'say "hi", you'
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"


def test_missing_words(spark, tmp_path):
    path = _write(tmp_path, "na.csv", b"Address,Embedding\nNULL,N/A\nnull,None\nx,nan\nNAb,NA\n")
    assert [(r["Address"], r["Embedding"]) for r in read_delimited(spark, path).rows.orderBy("pos").collect()] == [
        (None, None), (None, None), ("x", None), ("NAb", None)]


def test_positions_follow_a_folder_of_parts(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k, n in enumerate((3, 900, 40)):                     # Spark reads the largest part first
        _write(folder, f"part-{k}.csv", ("Address,N\n" + "".join(f"https://a.de/{k}/{i},{i}\n" for i in range(n))).encode())
    rows = read_delimited(spark, str(folder)).rows.orderBy("pos").collect()
    assert [r["Address"] for r in rows] == [f"https://a.de/{k}/{i}" for k, n in enumerate((3, 900, 40)) for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again = read_delimited(spark, str(folder)).rows
        assert again.rdd.getNumPartitions() > 3
        assert [r["Address"] for r in again.orderBy("pos").collect()] == [r["Address"] for r in rows]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_file_is_reported_and_skipped(spark, tmp_path):
    good = _write(tmp_path, "good.csv", b"Address,x\nhttps://a.de/1,1\n")
    empty = _write(tmp_path, "empty.csv", b"")
    out, problems = read_variants_with_problems(spark, [(empty, "de"), (good, "fr"), (str(tmp_path / "none.csv"), "it")])
    assert [r["variant"] for r in out.collect()] == ["fr"]
    assert [(p, c) for p, c, _ in problems] == [(empty, "de"), (str(tmp_path / "none.csv"), "it")] and problems[0][2] == "Datei ist leer."


def test_patterns_of_the_other_engine_are_reported(spark):
    df = spark.createDataFrame([("https://x.com/de/a",)], "url string")
    split, invalid = detect.split_by_patterns(df, "url", [("(?P<l>de)", "fr"), ("/de/", "de")])
    assert invalid == ["(?P<l>de)"] and split.first()["variant"] == "de"


def _files(folder):
    return [p.read_bytes().decode("utf-8") for p in sorted(folder.glob("part-*"))]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 'say "x", y'), (1, "a", None)], "pos long, Sprache string, URL string")
    write_table(df, str(tmp_path / "t"), "csv", order=["pos"], drop=["pos"])
    files = [f for f in _files(tmp_path / "t") if f]
    assert all(f.startswith("﻿Sprache,URL\n") for f in files)
    back = read_delimited(spark, str(tmp_path / "t"))
    assert back.columns == ["Sprache", "URL"] and sorted((r["Sprache"], r["URL"]) for r in back.rows.collect()) == [("a", None), ("b", 'say "x", y')]
    blocks = spark.createDataFrame([(3, 0, "<x>\n<y>"), (1, 1, "<b>"), (1, 0, "<a>")], "pivot_pos long, code_rank long, block string").repartition(3)
    write_html(blocks, str(tmp_path / "h"))
    assert "".join(_files(tmp_path / "h")) == "<a>\n\n<b>\n\n<x>\n<y>\n"
    write_html(blocks.limit(0), str(tmp_path / "none"))
    valid = spark.createDataFrame([("de", 0, "https://a.de/", [0.5, -1.0]), ("fr", 1, "https://a.fr/", [1.0, 0.0])], "code string, pos long, url string, vec array<float>")
    write_embeddings_csv(valid, str(tmp_path / "e"))
    assert _files(tmp_path / "e" / "code=de") == ['﻿Address,Embedding\nhttps://a.de/,"[0.500000,-1.000000]"\n']


# --- many patterns

PIECES = ["a", "b", "/", "de", "\\.", "\\-", "\\d", ".", "x?", "y*", "z+", "q{0,2}", "(cd|e)", "(?:f)", "[gh]", "[^i]", "(?=a)", "^", "K", "ü", "(j", "k)", "\\bl", "é+?"]


def test_required_literal_is_in_every_match():
    import random
    import re

    rng = random.Random(1)
    found = 0
    for _ in range(30000):
        pattern = "".join(rng.choice(PIECES) for _ in range(rng.choice([1, 2, 4, 7])))
        text = "".join(rng.choice("ab/de.-1xyzqcdfghjkKlüéÉ") for _ in range(12))
        try:
            m = re.search(pattern, text, re.I | re.A)
        except re.error:
            continue
        literal = detect.required_literal(pattern)
        if m:
            found += bool(literal)
            low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            assert literal in low, (pattern, text, literal)
    assert found > 1000
    assert detect.required_literal("^https?://[^/]+/de(/|$)") == "http" and detect.required_literal("/FR/") == "/fr/"
    for none in ("a|b", "(?x)a b c", "\\Qabc\\E", "\\x41bc", "(abc)", "a?b*", "", "[]abc]xyz"):
        assert detect.required_literal(none) in ("", none[:0])


def test_pattern_table_equals_the_chain(spark):
    import random

    rng = random.Random(2)
    urls = [f"https://{rng.choice(['www.', 'fr.', ''])}s{rng.randrange(9)}.{rng.choice(['de', 'com', 'AT'])}/{rng.choice(['de', 'FR', 'en', 'x'])}/p{rng.randrange(300)}" for _ in range(400)] + [None, "", "ab", "ü", "/de/", "/de/"]
    patterns = [("^https?://[^/]+/de(/|$)", "DE"), ("", "en"), ("/es/", ""), ("([unclosed", "xx"), ("/fr/", "fr-be")]
    patterns += [(f"/p{k}$", f"a{chr(97 + k % 26)}") for k in range(0, 300, 3)] + [(f"s{k}\\.(com|de)/", "it") for k in range(5)] + [("^.{2}$", "nl"), ("ü|ö", "sv"), (".at/", "de-at")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "i int, url string, variant string").repartition(3)
    chain, bad = detect.split_by_patterns(df, "url", patterns)
    table, bad2 = detect.split_by_pattern_table(df, "url", patterns)
    assert bad == bad2 == ["([unclosed"] and set(table.columns) == {"i", "url", "variant"}
    want = {r["i"]: r["variant"] for r in chain.collect()}
    assert {r["i"]: r["variant"] for r in table.collect()} == want and len(set(want.values())) > 8
    with pytest.raises(ValueError):
        detect.split_by_pattern_table(df, "url", [("a", "de")] * (detect.MAX_PATTERNS + 1))


def test_pattern_table_plan_does_not_grow(spark):
    df = spark.createDataFrame([("https://a.de/p1",)], "url string")
    size = lambda n: len(detect.split_by_pattern_table(df, "url", [(f"/p{k}$", "de") for k in range(n)])[0]._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(5000) - size(10)) < 200


# --- many files in one job, one pass over a file

def _jobs(spark, group, run):
    """The result of ``run`` and the number of jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def _export(tmp_path, name, k, kind):
    """A small export: its bytes by layout, and the rows it holds."""
    rows = [(f"https://s{k}.de/é{r}", f"Tïtel {k}") for r in range(k % 4 + 1)]
    sep = {"semi": ";", "cp": ";"}.get(kind, ",")
    text = sep.join(["Address", "Title"]) + "\n" + "".join(f'{u}{sep}"{t}"\n' for u, t in rows)
    if kind == "bad":
        text += f"a{sep}b{sep}c\n"
    data = {"cp": lambda: text.encode("cp1252"), "bom": lambda: b"\xef\xbb\xbf" + text.encode()}.get(kind, text.encode)()
    return _write(tmp_path, name, data), rows


def test_scan_of_many_files(spark, tmp_path):
    kinds = ["plain", "semi", "cp", "bad", "bom"]
    files, want = [], []
    for k in range(300):
        path, rows = _export(tmp_path, f"f {k}+%.csv", k, kinds[k % 5])
        files.append((path, f"c{k}"))
        want += [(f"c{k}", *r) for r in rows]
    other = _write(tmp_path, "wide.csv", b"URL|Status|Embedding\nhttps://x.de|200|[1]\nhttps://y.de|404\n")
    lost = [(str(tmp_path / "none.csv"), "n1"), (str(tmp_path / "no folder" / "x.csv"), "n2"), (_write(tmp_path, "empty.csv", b""), "n3"), (_write(tmp_path, "blank.csv", b"\n  \n"), "n4"),
            (_write(tmp_path, "broken.csv.gz", b"no gzip at all"), "n5")]
    scan, jobs = _jobs(spark, "many", lambda: files_module.scan_files(spark, lost[:2] + files + lost[2:] + [(other, None)]))
    assert [(f.encoding, f.delimiter) for f in scan.files[2:7]] == [("UTF-8", ","), ("UTF-8", ";"), ("windows-1252", ";"), ("UTF-8", ","), ("UTF-8", ",")]
    assert {c: m for _, c, m in scan.problems()} == {"n1": "Datei nicht lesbar.", "n2": "Datei nicht lesbar.", "n3": "Datei ist leer.", "n4": "Datei ist leer.", "n5": "Datei nicht lesbar."}
    got = scan.rows.orderBy("pos").collect()
    assert [(r["variant"], r["Address"], r["Title"]) for r in got if r["variant"]] == want          # in the order of the list, then of the lines
    assert [(r["URL"], r["Status"], r["Embedding"]) for r in got if not r["variant"]] == [("https://x.de", "200", "[1]"), ("https://y.de", "404", None)]
    assert scan.bad_lines.count() == 60
    few, few_jobs = _jobs(spark, "few", lambda: files_module.scan_files(spark, lost[:2] + files[:200] + lost[2:] + [(other, None)]))
    assert jobs == few_jobs <= 10 and len(few.files) == 206        # jobs follow the layouts, not the files


def test_scan_of_no_readable_file(spark, tmp_path):
    scan = files_module.scan_files(spark, [(str(tmp_path / "x.csv"), "de")])
    assert scan.rows is None and scan.problems() == [(str(tmp_path / "x.csv"), "de", "Datei nicht lesbar.")]


@pytest.mark.parametrize("kind", ["plain", "semi", "cp", "bad", "bom"])
def test_ingest_reads_once_and_equals_the_scan(spark, tmp_path, kind):
    path, _ = _export(tmp_path, "x.csv", 7, kind)
    scan = read_delimited(spark, path)
    got, counts = files_module.ingest_delimited(spark, path, str(tmp_path / "out"))
    assert (got.columns, got.encoding, got.delimiter) == (scan.columns, scan.encoding, scan.delimiter)
    plain = lambda s: [tuple(r)[1:] for r in s.rows.orderBy("pos").collect()]              # noqa: E731
    assert plain(got) == plain(scan) and got.bad_line_count() == scan.bad_line_count() == counts["bad_lines"]
    assert counts["lines"] == len(plain(got)) + counts["bad_lines"] and (counts["not_utf8"] > 0) == (kind == "cp")
    with pytest.raises(ValueError):
        files_module.ingest_delimited(spark, _write(tmp_path, "e.csv", b"\n"), str(tmp_path / "none"))


def test_multi_line_positions_follow_the_files(spark, tmp_path):
    """Spark reads large files first; positions follow the names."""
    for k in range(3):
        _write(tmp_path, f"part-{k}.csv", ("a,b\n" + "".join(f'"{k} {r}\nx","y"\n' for r in range(5 + 400 * k))).encode())
    rows = read_delimited(spark, str(tmp_path), multi_line=True).rows.orderBy("pos").collect()
    assert [r["a"].split("\n")[0] for r in rows] == [f"{k} {r}" for k in range(3) for r in range(5 + 400 * k)]
