from pyspark.sql import functions as F

from pagegraph.functions import text, times, wiki


def test_strip_and_titles(evaluate):
    assert evaluate(text.strip, ["  a\t\n", " b　", "c d"]) == ["a", "b", "c d"]
    cases = {" :Foo bar ": "Foo_bar", "": "", None: "", "::A:b": "A:b", ": x": "_x", "A  b": "A__b"}
    assert evaluate(text.page_title, list(cases)) == list(cases.values())


def test_bytes_title(evaluate):
    assert evaluate(text.bytes_title, [bytearray(b"Turku x"), bytearray(b"A\xffB")], "a binary") == ["Turku_x", "A�B"]


def test_qid(evaluate):
    cases = {"q42": "Q42", "http://x/Q7": "Q7", "Q0": None, "aq12b": "Q12", "": None, None: None, "Q01 Q5": "Q5"}
    assert evaluate(text.qid, list(cases)) == list(cases.values())


def test_quote_matches_reference_library(evaluate):
    from urllib.parse import quote

    words = ["a b", "Ä/ö:(x)-_.,~*", "100%+?&=#[]@!$';", "日本", "", "\"<>\\^`{|}"]
    for safe in (":_/()-.,", "_-().,:", ""):
        assert evaluate(lambda c: text.quote(c, safe), words) == [quote(w, safe=safe) for w in words]
    assert evaluate(text.unquote, ["a%20b+c", "%C3%84", "bad%zz"]) == ["a b+c", "Ä", "bad%zz"]


def test_db_title_and_prefix(evaluate):
    rows = [("Talk:A:b", 1), ("Talk:A", 0), ("A", 4)]
    assert evaluate(text.db_title, rows, "a string, n int") == ["A:b", "Talk:A", "A"]
    rows = [("Kategori:X_y", "Kategori"), ("Kategori:", "Kategori"), ("X", ""), ("Other:X", "Kategori")]
    assert evaluate(text.without_prefix, rows, "a string, p string") == ["X_y", "Kategori:", "X", "Other:X"]


def test_user_and_casefold(evaluate):
    assert evaluate(text.user_name, [" A_b ", " ", None]) == ["A b", None, None]
    assert evaluate(text.casefold, ["Straße", "ABC"]) == ["strasse", "abc"]
    assert evaluate(text.integer, ["12", " -3 ", "1_000", "1__0", "x", "1.0", None]) == [12, -3, 1000, None, None, None, None]


def test_double_text(evaluate):
    values = [1.0, 0.1, 1e-4, 1.5e-5, 1e15, 1.5e10, 1e16, 1.25e22, -12345678.5, 123456789.125, 0.0, -2.5e-7, 1e100]
    assert evaluate(text.python_double, values, "a double") == [repr(v) for v in values]


def test_datetime(evaluate):
    cases = {
        "20260219191017": "2026-02-19T19:10:17Z",
        "2024-01-02": "2024-01-02T00:00:00Z",
        "2024-01-02T03:04:05Z": "2024-01-02T03:04:05Z",
        "2024-01-02T03:04:05.678+02:30": "2024-01-02T00:34:05Z",
        "2024-01-02 03:04": "2024-01-02T03:04:00Z",
        "20240102T030405": "2024-01-02T03:04:05Z",
        "2024-W01-1": "2024-01-01T00:00:00Z",
        "2020-W53": "2020-12-28T00:00:00Z",
        "2021-W53": None,
        "2024-01-01T00:30:00-01:00": "2024-01-01T01:30:00Z",
        "2024": None,
        "20240231000000": None,
        "2024-13-01": None,
        "text": None,
        "": None,
        None: None,
    }
    assert evaluate(times.xsd_datetime, list(cases)) == list(cases.values())


def test_time_keys(evaluate):
    assert evaluate(times.numeric_time, ["20260401000000", "2026-04-01T01:02:03Z", "x", None]) == [
        20260401000000,
        20260401010203,
        None,
        None,
    ]
    cases = {"2026": "20260000000000", "202604": "20260400000000", "20260403010203": "20260403010203", "20261": None, "x": None}
    assert evaluate(times.padded_timestamp, list(cases)) == list(cases.values())
    assert evaluate(times.lower_bound_time, ["20260000000000", "20260400123456", "20261300000000"]) == [
        "2026-01-01T00:00:00Z",
        "2026-04-01T12:34:56Z",
        None,
    ]


def test_hosts_and_sites(evaluate):
    hosts = ["fi.wikipedia.org", "localhost", "a..b", "-a.b", "A.B.", "x@y.z", "a" * 64 + ".org", None]
    assert evaluate(wiki.host_valid, hosts) == [True, False, False, False, True, False, False, False]
    sites = {
        "enwiki": "en.wikipedia.org",
        "zh_min_nanwiki": "zh-min-nan.wikipedia.org",
        "outreachwiki": "outreach.wikimedia.org",
        "frwikivoyage": "fr.wikivoyage.org",
        "wiki": None,
        "localhost/wiki": None,
        "a/bwiki": None,
        "foo..wiki": None,
        "evil.comwiki": None,
        "evil.com/wikivoyage": None,
        " ": None,
        None: None,
    }
    assert evaluate(wiki.site_domain, list(sites)) == list(sites.values())
    groups = {"commonswiki": "commons", "fiwiktionary": "wiktionary", "svwiki": "wikipedia", "other": "other", "": "wikimedia"}
    assert evaluate(wiki.site_group, list(groups)) == list(groups.values())


def test_page_urls(evaluate):
    call = lambda d, a, n, nn, t: wiki.page_url(d, a, n, nn, t)
    rows = [
        ("fi.wikipedia.org", "/wiki/$1", 0, None, "Turku x"),
        ("sv.wikipedia.org", "/wiki/$1", 14, "Kategori", "Esimerkki"),
        ("a.org", "w", 0, "", "B"),
        ("a.org", "w/$1/z", 4, "P", "B"),
        ("a.org", "", 0, "", ""),
    ]
    assert evaluate(call, rows, "d string, a string, n int, nn string, t string") == [
        "https://fi.wikipedia.org/wiki/Turku_x",
        "https://sv.wikipedia.org/wiki/Kategori:Esimerkki",
        "https://a.org/w/B",
        "https://a.org/w/P:B/z",
        None,
    ]


def test_url_parts(evaluate):
    urls = [
        "https://fi.wikipedia.org/wiki/Luokka:%C3%84_b",
        "http://meta.wikimedia.org/w/index.php?title=A+b&x=1&title=C%20d",
        "ftp://fi.wikipedia.org/wiki/A",
        "https://localhost/wiki/A",
        "https://user@fi.wikipedia.org:443/wiki/:A_b?x#y",
        "text",
    ]
    got = evaluate(wiki.page_from_url, urls)
    assert [tuple(x) if x else None for x in got] == [
        ("fi.wikipedia.org", "Luokka:Ä_b"),
        ("meta.wikimedia.org", "C_d"),
        None,
        None,
        ("fi.wikipedia.org", "A_b"),
        None,
    ]


def test_tokens(evaluate):
    cases = {
        "fi": "fi",
        "w:fi": "fi",
        "b:FI": "b:fi",
        "c": "commons",
        "wikidata.org": "wikidata",
        "sv.wiktionary.org": "wikt:sv",
        "fi.wikipedia.org.": "fi",
        "other.example.org": "other.example.org",
        "commons:fi": None,
        "a:b:c": None,
        "foo bar": None,
    }
    assert evaluate(wiki.wiki_token, list(cases)) == list(cases.values())
    domains = {"fi": "fi.wikipedia.org", "b:fi": "fi.wikibooks.org", "meta": "meta.wikimedia.org", "a.b.c": "a.b.c", "q:": "q:"}
    assert evaluate(wiki.token_domain, list(domains)) == list(domains.values())


def test_interwiki_and_references(evaluate):
    call = lambda p, t, g, d: wiki.interwiki_target(p, t, g, d)
    rows = [
        ("meta", "User:A", "wikipedia", None),
        ("w", "fi:User:A b", "wikipedia", None),
        ("w", "User", "wikipedia", None),
        ("sv", "User:B", "wikibooks", None),
        ("species", "User:B", "wikipedia", "species.wikimedia.org"),
        ("d", "User:C", "commons", None),
        ("xx", "User:C", "commons", None),
    ]
    got = evaluate(call, rows, "p string, t string, g string, d string")
    assert [tuple(x) if x else None for x in got] == [
        ("meta.wikimedia.org", "User:A"),
        ("fi.wikipedia.org", "User:A_b"),
        None,
        ("sv.wikibooks.org", "User:B"),
        ("species.wikimedia.org", "User:B"),
        ("www.wikidata.org", "User:C"),
        None,
    ]
    refs = [":meta:User:A/list", "w:fi:Käyttäjä:A", "https://sv.wikipedia.org/wiki/X", "nothing", ":w:fi:"]
    parsed = evaluate(lambda r: wiki.title_from_reference(r, F.lit(None).cast("string")), refs)
    assert [tuple(x) if x else None for x in parsed] == [
        ("meta.wikimedia.org", "User:A/list"),
        ("fi.wikipedia.org", "Käyttäjä:A"),
        ("sv.wikipedia.org", "X"),
        None,
        None,
    ]
    rows = [("fi.wikibooks.org", "A b"), ("meta.wikimedia.org", "X"), ("www.wikidata.org", "Y"), ("zz.org", "Z")]
    call = lambda d, t: wiki.user_page_reference(d, t, F.lit(None).cast("string"))
    assert evaluate(call, rows, "d string, t string") == [":b:fi:A_b", ":meta:X", ":d:Y", None]


def test_project_titles(evaluate):
    got = evaluate(wiki.project_parts, ["Wp/sms/Katja_Gauriloff", "Wp/sms", "Main", "Wp/a/b/c"])
    assert [tuple(x) for x in got] == [
        ("Wp", "sms", "Katja_Gauriloff"),
        ("Wp", "sms", "sms"),
        ("Main", "", "Main"),
        ("Wp", "a", "b/c"),
    ]
    assert evaluate(wiki.project_title_group, ["Wp/a/b", "Xx/a/b", "/a"]) == ["wikipedia", "xx", "wikimedia"]
    call = lambda b, p, l: wiki.project_site_url(b, p, l)
    assert evaluate(call, [("https://i/", "Wp", "sms"), ("https://i/", "Wp", "")], "b string, p string, l string") == [
        "https://i/Wp/sms/",
        None,
    ]
